"""Slow versions of the operators, one value at a time, for tests to compare with."""

import hashlib
import itertools
import math
import re

import numpy as np
import regex

from tessera.llm import bpe, mixing, neardup, pii, toxicity


# --- toxicity: every window by scalar loops ----------------------------------------


def words(text):
    found = [w if w.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (text or "").lower().split()]
    return [w for w in found if w]


def trigram_buckets(word):
    b, full = f"^{word}$".encode(), 0xFFFFFFFF
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (x * 2654435761 & full) ^ (y * (40503 * 65537 & full) & full) ^ (z * 2246822519 & full)
        out.append((((h ^ h >> 15) * 2654435761 & full) >> 19) % toxicity.BUCKETS)
    return out


def squash(x):
    return 1 / (1 + math.exp(-x))


def window_logit(m, window):
    p, H = m.p, toxicity.HIDDEN
    listed = {w: i for i, w in enumerate(m.words)}
    vectors = []
    for w in window:
        rows = trigram_buckets(w)
        vectors.append(sum(p["Ec"][r].astype(float) for r in rows) / len(rows) + p["Ew"][listed.get(w, len(m.words))])
    sides = []
    for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
        h, states = np.zeros(H), {}
        for t in order:
            x = vectors[t] @ p[f"W{d}"] + p[f"B{d}"]
            gate = [squash(x[i] + sum(h[j] * p[f"U{d}"][j, i] for j in range(H))) for i in range(2 * H)]
            r, z = np.array(gate[:H]), np.array(gate[H:])
            c = np.array([math.tanh(x[2 * H + i] + sum(r[j] * h[j] * p[f"U{d}"][j, 2 * H + i] for j in range(H))) for i in range(H)])
            h = states[t] = h + z * (c - h)
        sides.append(states)
    hs = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(window))]
    energy = [sum(math.tanh(u) * v for u, v in zip(h @ p["A"] + p["a"], p["v"])) for h in hs]
    top = max(energy)
    share = [math.exp(e - top) for e in energy]
    pooled = sum(s * h for s, h in zip(share, hs)) / sum(share)
    return float(pooled @ p["o"] + p["c"][0])


def toxic_logit(m, text):
    """The highest logit over windows of WINDOW words every STRIDE words; None without words."""
    w, best, at = words(text), None, 0
    while w:
        logit = window_logit(m, w[at : at + toxicity.WINDOW])
        best = logit if best is None else max(best, logit)
        if at + toxicity.WINDOW >= len(w):
            break
        at += toxicity.STRIDE
    return best


# --- near duplicates: all pairs ---------------------------------------------------------


def near_groups(texts, threshold=neardup.THRESHOLD):
    """Least id of each id's group, of the pairs that share a table key and are similar enough; ``texts`` maps ids to texts."""
    import pyarrow as pa

    ids = [i for i, t in texts.items() if t]
    h, start, _, _ = neardup.shingles(pa.array([texts[i] for i in ids], pa.string()))
    small = neardup.small_hashes(h, start)
    plain = {i: [w for w in (re.sub(r"[\W_]+", "", x) for x in texts[i].lower().split()) if w] for i in ids}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in plain.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    side = neardup.SIDE
    for a, b in itertools.combinations(range(len(ids)), 2):
        s, t = sets[ids[a]], sets[ids[b]]
        if s and t and (small[a, :side] == small[b, :side]).any() and (small[a, side:] == small[b, side:]).any() and len(s & t) >= threshold * len(s | t):
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


# --- PII: plain Viterbi over one text -------------------------------------------------------


def viterbi(model, e):
    best = [(model.moves[0][t] + e[0][t], [t]) for t in range(len(pii.TAGS))]
    for i in range(1, len(e)):
        best = [max(((s + model.moves[p[-1]][t] + e[i][t], [*p, t]) for s, p in best), key=lambda x: x[0]) for t in range(len(pii.TAGS))]
    return max(((s + model.moves[p[-1]][0], p) for s, p in best), key=lambda x: x[0])[1]


def masked(text):
    model = pii.trained()
    tokens = [(m.start() + a, m.start() + b) for m in re.finditer(r"\S+", text or "") for a, b in pii.pieces(m[0])]
    if not tokens:
        return text
    sigs = [pii.signature(text[a:b]) for a, b in tokens]
    sums = [model.row(s)[0].copy() for s in sigs]
    for i in range(len(sigs)):
        if i:
            sums[i] += model.row(sigs[i - 1])[1]
        if i + 1 < len(sigs):
            sums[i] += model.row(sigs[i + 1])[2]
    spans, last = [], -2
    for k, ((a, b), t) in enumerate(zip(tokens, viterbi(model, sums))):
        x, y = pii.core(text[a:b])
        if not t or x >= y:
            continue
        kind = pii.TAGS[t].removeprefix("B-").removeprefix("I-")
        if pii.TAGS[t].startswith("I-") and last == k - 1 and spans and spans[-1][2] == kind:
            spans[-1] = (spans[-1][0], a + y, kind)
        else:
            spans.append((a + x, a + y, kind))
        last = k
    for a, b, kind in reversed(spans):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


# --- mixing: one sort of each source ---------------------------------------------------------


def copies(rows, rate=mixing.RATE):
    """Copies of each (id, source, size) by the default weights."""
    rows = {r for r in rows if None not in r and r[2]}
    weight = {s: float(mixing.WEIGHTS.get(s, mixing.OTHERS)) for _, s, _ in rows}
    total, out = sum(n for *_, n in rows), {}
    for source in weight:
        own = [(i, n, 1000 * n // (n + 500) + 1) for i, s, n in rows if s == source]
        target, mx = rate * total * weight[source] / sum(weight.values()), sum(n * m for _, n, m in own)
        ranked, units = [], 0
        for i, n, m in own:
            e = target * m / mx
            out[i, source, n] = math.floor(e)
            p = math.floor((e - math.floor(e)) * mixing.SCALE)
            units += p
            if p:
                u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
                q = p / mixing.SCALE
                ranked.append((u / (1 - u) / (q / (1 - q)), i, n))
        for _, i, n in sorted(ranked)[: (units + mixing.SCALE // 2) // mixing.SCALE]:
            out[i, source, n] += 1
    return out


# --- byte-level BPE: merging by rank ------------------------------------------------------------


def tokens(ranks, text):
    return [t for piece in regex.findall(bpe.PATTERN, text or "") for t in bpe.merge_by_rank(ranks, piece.encode())]
