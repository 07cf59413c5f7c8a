"""PII: a linear-chain conditional random field over word-shape features, decoded by Viterbi in numpy.

A token (white-space word) is reduced to its signature: the shape of its core
(letters, digits and punctuation in runs), a keyword if it is one, and what
stands before '='. All features derive from the signatures of a token and of its
two neighbours, so emissions are sums of three table rows. The model is trained
by gradient ascent of the conditional likelihood on the labelled table of
``pii_table``; sentence ends count as tag O on both sides.

A token with delimiters inside its core (JSON or CSV without blanks, a URL, two
addresses joined by a semicolon) or with ASCII beside a script without letter case
(Chinese around an address) is no word: it is cut there, and its pieces are the
tokens of the chain, so each can be a span of its own. Grouped digits (``1,200``)
and fractions or dates with strokes (``2/3``) stay whole. Shapes are taken of whole
pieces, however long.

Decoding is exact. Where O beats every other tag of a token by more than twice
the span of the transition weights, no best path leaves O there (replacing the
tag by O would gain), so the chain falls apart at such tokens and Viterbi runs
over the remaining stretches only, all stretches of a slice at once.

Defined results: null, empty and blank texts hold no PII; offsets are code points
of the original text; a repeated row gives its spans again; of paths of equal score
the one with the tag that stands first in ``TAGS`` wins, at the last token where they
differ.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import pii_table
from tessera.llm import textkit as tk

TAGS = pii_table.TAGS
KINDS = [t.removeprefix("B-").removeprefix("I-") for t in TAGS]
BUCKETS = 4096
KEYWORDS = frozenset("password passwd pwd secret token key api_key apikey phone tel call ssn ip card email mail".split())
LEAD, TAIL = re.compile(r"^[^\w+(]+"), re.compile(r"[^\w)]+$")
RUNS = re.compile(r"(X+|x+|9+|H+)")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{12,}(?![0-9A-Za-z])")
SPAN = re.compile(r"\S+")
#: Longer shapes are computed anew instead of being kept by the worker.
KEPT = 200
UNCASED = "\u0590-\u10ff\u1100-\u1cff\u2e80-\u2fff\u3040-\ua63f\ua960-\uabff\uac00-\ufdff\ufe70-\ufefe\uff66-\uffdc\U00020000-\U0003ffff"
DELIMITERS = "\"'`´“”‘’„«»‹›\\\\,;&?!/|<>{}\\[\\]*#$^~…、。「」『』【】《》〈〉（），：；！？"
#: A piece is a secret with its name, an uncased word, any other word, or a sign that tells what follows; quotes and brackets fall out.
PIECE = re.compile(
    rf"\\(?:[bfnrt]|u[0-9a-fA-F]{{4}})|(?P<piece>(?<![\w-])(?i:password|passwd|pwd|secret|api_key|apikey|token|key)=[^{DELIMITERS}{UNCASED}=:()]+"
    rf"|(?:(?!\d)[{UNCASED}])+|(?:\d|[^{DELIMITERS}{UNCASED}=:()]|\((?=\d)|(?<=\d)\))+|:(?!//)|[=,;])"
)
#: Where a token falls apart: a delimiter between other signs, or a change between ASCII and an uncased script.
BORDER = re.compile(rf"[\"`“”„«»‹›\\,;&?/|<>{{}}\[\]、。「」『』【】《》〈〉（），：；！？]|[{UNCASED}][0-9A-Za-z+(]|[0-9A-Za-z)][{UNCASED}]")
NUMBER = re.compile(r"\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:/\d+)+|\d+,\d+")


def core(token: str) -> tuple[int, int]:
    """Where the token's core begins and ends, without decoration."""
    lead = LEAD.match(token)
    start = lead.end() if lead else 0
    tail = TAIL.search(token, start)
    return start, tail.start() if tail else len(token)


def pieces(token: str) -> list[tuple[int, int]]:
    """Where the chain's tokens begin and end in a white-space token: the whole, if nothing divides it."""
    if not (token.isascii() and token.isalnum()) and BORDER.search(token):
        start, end = core(token)
        if BORDER.search(token, start, end) and not NUMBER.fullmatch(token, start, end):
            return [m.span() for m in PIECE.finditer(token) if m["piece"]] or [(0, len(token))]
    return [(0, len(token))]


@functools.lru_cache(maxsize=200_000)
def run(kind: str, n: int) -> str:
    return kind + (str(n) if n <= 4 else "5" if n < 8 else "8" if n < 12 else "12" if n < 15 else "15" if n < 20 else "20")


def signature(token: str) -> str:
    """The shape of a token's core, with its keyword."""
    if token.isalpha() and (len(token) < 16 or not token.isupper()):
        if token.lower() in KEYWORDS:
            return "k:" + token.lower()
        return "x" if token.islower() else "X" if token.isupper() and len(token) > 1 else "Xx"
    start, end = core(token)
    body = token[start:end]
    if body.isalpha() and len(body) < len(token):
        return signature(body)
    if not body:
        return "=" if "=" in token else ":" if token == ":" else "."
    head, eq, _ = body.partition("=")
    word = head.lower() if eq and head.lower() in KEYWORDS else ""
    body = HEX.sub(lambda m: "\0" * len(m[0]) if not m[0].isdigit() else m[0], body)
    flat = "".join("9" if c.isdigit() else "H" if c == "\0" else c if not c.isalnum() else "X" if c.isupper() else "x" for c in body)
    return RUNS.sub(lambda m: run(m[0][0], len(m[0])), flat) + "|" + word + ("|" + body[:4] if body.isalnum() and body.isascii() and any(c.isupper() for c in body) and len(body) >= 16 else "")


def features(sig: str) -> list[str]:
    """Feature names of a signature."""
    shape, _, word = sig.partition("|")
    kinds = re.sub(r"\d+", "", shape) if not sig.startswith("k:") else shape
    digits = sum(int(n) for n in re.findall(r"9(\d+)", shape))
    return ["s:" + sig, "h:" + shape, "c:" + kinds, "w:" + word, "@" if "@" in shape else "a", f"d:{min(digits, 12)}", f"p:{shape[:3]}", f"e:{shape[-3:]}", f"dots:{min(shape.count('.'), 4)}", f"dash:{min(shape.count('-'), 4)}", "H" if "H" in shape else "h", f"up:{'X' in shape and '9' in shape and '-' not in shape}", "par" if "(" in shape else "nopar", "plus" if shape[:1] == "+" else "noplus"]


def context(sig: str) -> list[str]:
    """Feature names that a signature lends its neighbours."""
    shape = sig.partition("|")[0]
    return ["s:" + sig, "c:" + re.sub(r"\d+", "", shape), f"p:{shape[:2]}"]


def bucket(role: str, name: str) -> int:
    h = 2166136261
    for b in f"{role}{name}".encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


class Model:
    """Weights [BUCKETS, tags] and transitions [tags, tags]."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.rows: dict[str, np.ndarray] = {}

    def row(self, sig: str) -> np.ndarray:
        """Emissions [3, tags] that a signature gives to itself, to the next token and to the one before."""
        found = self.rows.get(sig)
        if found is None:
            if len(self.rows) > 50_000:
                self.rows.clear()
            own = self.weights[[bucket("o", f) for f in features(sig)]].sum(0)
            found = np.stack([own, *(self.weights[[bucket(r, f) for f in context(sig)]].sum(0) for r in "nb")])
            if len(sig) <= KEPT:
                self.rows[sig] = found
        return found

    def emissions(self, sigs: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Emission scores of every token of a slice."""
        table = np.array([self.row(s) for s in sigs])
        first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        full = offsets[:-1] < offsets[1:]
        first[offsets[:-1][full]] = True
        last[offsets[1:][full] - 1] = True
        e = table[:, 0][codes]
        e[1:] += np.where(first[1:, None], 0, table[:, 1][codes[:-1]])
        e[:-1] += np.where(last[:-1, None], 0, table[:, 2][codes[1:]])
        return e

    def decode(self, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best tag of every token. ``offsets`` bound the texts, whose ends count as O."""
        tags = np.zeros(len(e), np.int64)
        slack = 2 * (self.moves.max() - self.moves.min())
        open_ = e[:, 0] - e[:, 1:].max(1) <= slack if len(e) else np.zeros(0, bool)
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | np.isin(at[1:], offsets)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        order = np.argsort(-length, kind="stable")
        begin, length = at[begin[order]], length[order]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        back = []
        score = e[begin] + self.moves[0]
        final = np.empty((len(begin), len(TAGS)))
        final[:] = score
        for t in range(1, length[0]):
            n = live[t]
            step = score[:n, :, None] + self.moves[None]
            back.append(step.argmax(1))
            score = step.max(1) + e[begin[:n] + t]
            final[:n] = score
        tag = (final + self.moves[:, 0]).argmax(1)
        for t in range(length[0] - 1, -1, -1):
            n = live[t]
            tags[begin[:n] + t] = tag[:n]
            if t:
                tag[:n] = back[t - 1][np.arange(n), tag[:n]]
        return tags


def train(table: list[tuple[list[str], list[str]]], steps: int = 90, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Maximise the conditional log likelihood by Adam over the whole table, forward-backward in numpy."""
    size = max(len(t) for t, _ in table)
    n, k = len(table), len(TAGS)
    gold, mask = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    own, nxt, bef, place = [], [], [], []
    for i, (tokens, tags) in enumerate(table):
        sigs = [signature(t) for t in tokens]
        for j, (s, tag) in enumerate(zip(sigs, tags)):
            gold[i, j], mask[i, j] = TAGS.index(tag), True
            f = [bucket("o", x) for x in features(s)]
            f += [bucket("n", x) for x in context(sigs[j - 1])] if j else []
            f += [bucket("b", x) for x in context(sigs[j + 1])] if j + 1 < len(sigs) else []
            own += f
            place += [i * size + j] * len(f)
    own, place = np.array(own), np.array(place)
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order], prepend=-1))
    w, m = np.zeros((BUCKETS, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (w, w, m, m)]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    spot = place[starts]
    last = mask.sum(1) - 1
    for step in range(1, steps + 1):
        e = np.zeros((n * size, k))
        e[spot] = np.add.reduceat(w[own], starts, axis=0)
        e = e.reshape(n, size, k)
        a, b = np.zeros((n, size, k)), np.zeros((n, size, k))
        a[:, 0] = e[:, 0] + m[0]
        for t in range(1, size):
            a[:, t] = e[:, t] + lse(a[:, t - 1, :, None] + m[None], 1)
        b[np.arange(n), last] = m[:, 0]
        for t in range(size - 2, -1, -1):
            b[:, t] = np.where((t < last)[:, None], lse(m[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t])
        z = lse(a[np.arange(n), last] + m[:, 0], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        d = p.copy()
        d[np.nonzero(mask) + (gold[mask],)] -= 1
        gm = np.zeros_like(m)
        both = mask[:, 1:]
        pair = np.exp(a[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gm += pair.sum((0, 1))
        np.add.at(gm, (gold[:, :-1][both], gold[:, 1:][both]), -1)
        gm[0] += d[:, 0].sum(0)
        gm[:, 0] += d[np.arange(n), last].sum(0)
        gw = np.zeros_like(w)
        gw[own[order][cut]] = np.add.reduceat(d.reshape(-1, k)[place[order]], cut, axis=0)
        for x, g, s1, s2 in ((w, gw / n + decay * w, state[0], state[1]), (m, gm / n + decay * m, state[2], state[3])):
            s1 += 0.1 * (g - s1)
            s2 += 0.01 * (g * g - s2)
            x -= rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-6)
    return Model(w, m)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    return train(pii_table.sentences())


def tag_slice(model: Model, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, str]]]]:
    """(row, spans) of each text of a slice that holds PII; a span is (start, end, kind)."""
    w = tk.split_words(texts, lower=False)
    sigs: list[str] = []
    count = np.ones(len(w.vocab), np.int64)
    for i, x in enumerate(w.vocab.to_pylist()):
        cut = [signature(x[a:b]) for a, b in pieces(x)]
        sigs += cut
        count[i] = len(cut)
    known = {s: i for i, s in enumerate(dict.fromkeys(sigs))}
    codes, offsets = w.codes, w.offsets
    if sigs:
        n = count[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        codes = np.array([known[s] for s in sigs], np.int32)[np.repeat((np.cumsum(count) - count)[codes] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[offsets]
    tags = model.decode(model.emissions(list(known), codes, offsets), offsets) if len(codes) else np.zeros(0, np.int64)
    hit = np.flatnonzero(tags)
    out: list[tuple[int, list[tuple[int, int, str]]]] = []
    for row in np.unique(np.searchsorted(offsets, hit, side="right") - 1):
        lo = offsets[row]
        spans: list[tuple[int, int, str]] = []
        at = -2
        for k, (begin, token) in enumerate((m.start() + a, m[0][a:b]) for m in SPAN.finditer(texts[int(row)].as_py()) for a, b in pieces(m[0])):
            if not (tag := tags[lo + k]):
                continue
            a, b = core(token)
            if a >= b:
                continue
            if TAGS[tag].startswith("I-") and at == k - 1 and spans[-1][2] == KINDS[tag]:
                spans[-1] = (spans[-1][0], begin + b, KINDS[tag])
            else:
                spans.append((begin + a, begin + b, KINDS[tag]))
            at = k
        if spans:
            out.append((int(row), spans))
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, start, end, kind."""
    model = trained()
    weights, moves = model.weights, model.moves
    holder: list[Model] = []

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Model(weights, moves))
        ids = part.column("doc_id")
        found = [(ids[row].as_py(), *span) for row, spans in tag_slice(holder[0], tk.as_strings(part.column("text"))) for span in spans]
        cols = list(zip(*found)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "kind"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tk.over_slices(make, "text"), "doc_id bigint, start bigint, end bigint, kind string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; an integer column ``n_chars``, where there is one, follows the new text."""
    model = trained()
    weights, moves = model.weights, model.moves
    holder: list[Model] = []
    length = dict(docs.dtypes).get("n_chars") in ("int", "bigint")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Model(weights, moves))
        at = part.schema.get_field_index("text")
        found = tag_slice(holder[0], tk.as_strings(part.column(at)))
        if not found:
            return part
        texts = part.column(at).to_pylist()
        sizes = part.column("n_chars").to_pylist() if length else []
        for row, spans in found:
            text, out, end = texts[row], [], 0
            for a, b, kind in spans:
                out += [text[end:a], f"[{kind}]"]
                end = b
            texts[row] = "".join([*out, text[end:]])
            if length:
                sizes[row] = len(texts[row])
        cols = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(sizes, part.column("n_chars").type)} if length else {})
        return pa.RecordBatch.from_arrays([cols.get(c, part.column(k)) for k, c in enumerate(part.schema.names)], names=part.schema.names)

    return docs.mapInArrow(tk.over_slices(make, "text"), docs.schema)
