"""The small labelled table that the PII model is trained on.

Sentences are (tokens, tags) pairs, made from patterns by a seeded generator:
invented words in several scripts around personal data and secrets, with
look-alikes that are not personal (dates, prices, versions, times, counts).
"""

from __future__ import annotations

import random
import string

TAGS = ("O", "EMAIL", "IP", "CARD", "KEY", "SECRET", "SSN", "B-PHONE", "I-PHONE")
SYLLABLES = "an er th in ent ion ver lich é à que ción ado ñe ß ü gen st мо ла 中 が ka lo mi re".split()
PLAIN = ["2019", "1998", "42", "7", "10", "3.5", "1,200", "$15.99", "2024-05-17", "12:30", "v2.1", "1.2.3", "50%", "3rd", "A4", "b2b", "#12", "10-15", "2/3", "1990s", "100000", "http://www.example.org/a1", "10.5%", "x=1", "=", "|", "-", "**", "$$$", "C3PO", "MP3", "12345", "€99", "0.001", "ISO-9001", "2001/02", "id=7", "20,000", "1e5", "covid19"]


def word(g: random.Random) -> str:
    w = "".join(g.choice(SYLLABLES) for _ in range(g.randint(1, 4)))
    return g.choice((w, w, w, w, w.title(), w.upper()))


def digits(g: random.Random, n: int) -> str:
    return "".join(g.choice(string.digits) for _ in range(n))


def hexa(g: random.Random, n: int) -> str:
    return "".join(g.choice("0123456789abcdef") for _ in range(n))


def name(g: random.Random) -> str:
    return "".join(g.choice(string.ascii_lowercase) for _ in range(g.randint(2, 9)))


def example(g: random.Random) -> list[tuple[str, str]]:
    """Tokens with tags of one piece of personal data."""
    kind = g.randrange(11)
    if kind < 2:
        user = g.choice((name(g), f"{name(g)}.{digits(g, 2)}", f"{name(g)}_{name(g)}", f"{name(g)}.{name(g)}", f"{name(g)}{digits(g, 3)}", f"{name(g).title()}.{name(g).title()}"))
        return [(f"{user}@{name(g)}{g.choice(('', digits(g, 1)))}.{g.choice(('com', 'org', 'de', 'example.com', 'co.uk'))}", "EMAIL")]
    if kind == 2:
        return [(".".join(str(g.randint(0 if k else 1, 255)) for k in range(4)), "IP")]
    if kind == 3:
        return [(g.choice("3456") + digits(g, 15), "CARD")] if g.random() < 0.7 else [("-".join(digits(g, 4) for _ in range(4)), "CARD")]
    if kind == 4:
        letters = string.ascii_uppercase + (string.digits if g.random() < 0.8 else "")
        return [(g.choice(("AKIA", "ASIA", "AIza", "ghp_", "sk-")) + "".join(g.choice(letters) for _ in range(g.choice((16, 20, 24)))), "KEY")]
    if kind == 5:
        key = g.choice(("password", "passwd", "pwd", "secret", "api_key", "token"))
        return [(f"{key}={hexa(g, g.choice((12, 16, 18, 20, 32)))}", "SECRET")]
    if kind == 6:
        key = g.choice(("token", "secret", "api_key", "password"))
        return [(key, "O"), (g.choice("=:"), "O"), (f'"{hexa(g, g.choice((24, 32, 40)))}"', "SECRET")]
    if kind == 7:
        return [(f"{digits(g, 3)}-{digits(g, 2)}-{digits(g, 4)}", "SSN")]
    a, b, c = digits(g, 3), digits(g, 3), digits(g, 4)
    forms = ([f"+{digits(g, 1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(g, 2)}", a, b + c], [f"+{digits(g, 11)}"])
    chosen = g.choice((forms[0], *forms))
    return [(t, "I-PHONE" if k else "B-PHONE") for k, t in enumerate(chosen)]


def sentences(n: int = 900, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """The labelled table: ``n`` sentences of tokens and tags."""
    g, out = random.Random(seed), []
    for _ in range(n):
        rows: list[tuple[str, str]] = []
        for _ in range(g.randint(1, 3)):
            rows += [(word(g), "O") for _ in range(g.randint(0, 4))]
            if g.random() < 0.25:  # words run together, and long ones in capitals
                rows.append((g.choice((f"{word(g)}.{word(g)}", f"{word(g)}.{word(g)}.{word(g)}", f"{word(g)},{word(g)}", f"{word(g)}-{word(g)}", (word(g) + word(g) + word(g)).upper(), f"{word(g)}/{word(g)}", f"{word(g)}@")), "O"))
            rows += example(g) if g.random() < 0.6 else [(g.choice(PLAIN), "O") for _ in range(g.randint(1, 2))]
        rows += [(word(g), "O") for _ in range(g.randint(0, 3))]
        rows = [(t + g.choice((",", ".", "!!", "###", "&&&")) if g.random() < 0.12 else t, tag) for t, tag in rows]
        out.append(([t for t, _ in rows], [tag for _, tag in rows]))
    return out
