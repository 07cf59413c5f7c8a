"""Document fingerprints by consistent weighted sampling.

For sample k and term t of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1)
drawn from the hash of (t, k): ``n = floor(ln w / r + b)`` and
``ln a = ln c - r * (n - b) - r``; the sample is the pair (t, n) of least a
(Ioffe, 2010). Two documents agree on a sample with probability equal to their
generalised Jaccard similarity, sum of min weights over sum of max weights.
Terms are lower-case words stripped of edge punctuation, weights their counts.

The draws depend on (term, weight) only, so they are made once per distinct
pair of a slice; the documents then take minima over gathered rows.

Defined results: a text without terms (null, empty, punctuation) gives an empty
signature, a null fingerprint and zero counts; repeated rows give equal rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textkit as tk

SAMPLES = 32
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SCHEMA = "doc_id bigint, n_terms int, total_weight bigint, signature array<bigint>, fingerprint bigint"


def log_gamma2(h: np.ndarray, salt: int) -> np.ndarray:
    """A Gamma(2, 1) draw per hash: -ln(u1 u2)."""
    return -np.log(tk.uniforms(h, salt) * tk.uniforms(h, salt + 1))


def draws(h: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``ln a`` and the sample's identity for each (term hash, weight) and sample number k."""
    r, c, b = log_gamma2(h, 5 * k), log_gamma2(h, 5 * k + 2), tk.uniforms(h, 5 * k + 4)
    n = np.floor(np.log(weight) / r + b)
    with np.errstate(over="ignore"):
        name = tk.mix64(h ^ tk.mix64(n.astype(np.int64).view(np.uint64) + np.uint64(k + 1)))
    return np.log(c) - r * (n - b) - r, name


def terms(texts: pa.Array) -> tk.Words:
    w = tk.split_words(texts)
    return tk.remap(w, [x if x.isalnum() else EDGE.sub("", x) for x in w.vocab.to_pylist()])


def signatures(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature matrix [documents, samples], distinct terms and total weight; zero rows for documents without terms."""
    w = terms(texts)
    n, rows = len(w.offsets) - 1, tk.rows_of(w.offsets)
    sig = np.zeros((n, samples), np.uint64)
    pair, weight = np.unique(rows * max(len(w.vocab), 1) + w.codes, return_counts=True)
    row, code = pair // max(len(w.vocab), 1), pair % max(len(w.vocab), 1)
    count = np.bincount(row, minlength=n)
    if len(pair):
        kinds, at = np.unique(code * (weight.max() + 1) + weight, return_inverse=True)
        h, wt = tk.hash_words(w.vocab)[kinds // (weight.max() + 1)], (kinds % (weight.max() + 1)).astype(np.float64)
        has = np.flatnonzero(count)
        begin, size = (np.cumsum(count) - count)[has], count[has]
        for k in range(samples):
            lna, name = draws(h, wt, k)
            v = lna[at]
            best = v == np.repeat(np.minimum.reduceat(v, begin), size)
            first = np.flatnonzero(best)
            own = row[first]
            tie = np.diff(own, prepend=-1) == 0
            if tie.any():  # equal draws: the least identity wins, whatever the order
                order = np.lexsort((name[at[first]], own))
                first = first[order]
                tie = np.diff(row[first], prepend=-1) == 0
            sig[has, k] = name[at[first[~tie]]]
    return sig, count, w.lengths


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, n_terms, total_weight, signature (``samples`` values), fingerprint of the signature."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sig, count, total = signatures(part.column("text"), samples)
        one = np.zeros(len(sig), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(samples):
                one = tk.mix64(one * np.uint64(31) + sig[:, k])
        keep = count > 0
        off = np.concatenate([[0], np.cumsum(np.where(keep, samples, 0))])
        cols = [part.column("doc_id"), pa.array(count.astype(np.int32)), pa.array(total.astype(np.int64)), tk.ragged(sig[keep].ravel().view(np.int64), off, pa.int64()), pa.array(one.view(np.int64), mask=~keep)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_terms", "total_weight", "signature", "fingerprint"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tk.over_slices(make, "text"), SCHEMA)
