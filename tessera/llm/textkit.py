"""Arrow/numpy text helpers shared by the corpus operators.

A *slice* is a run of rows whose texts hold about ``SLICE_BYTES`` bytes, so a
worker's memory depends on the slice size and not on the batch; one longer
document is a slice of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6_000_000


def as_strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null text reads as the empty text)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.string():
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows holding about ``limit`` bytes of ``column``."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // limit
    cut = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, n]):
        yield batch.slice(int(lo), int(hi - lo))


@dataclass
class Words:
    """White-space words of a slice: ``codes`` index ``vocab``; row i owns ``codes[offsets[i]:offsets[i+1]]``."""

    vocab: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Split on Unicode white space and dictionary-encode; runs in Arrow's C++ kernels."""
    texts = as_strings(texts)
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = offsets - offsets[0]
    return drop_words(Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets), pc.equal(coded.dictionary, ""))


def drop_words(w: Words, gone: pa.Array | np.ndarray) -> Words:
    """The same slice without the vocabulary entries flagged in ``gone``."""
    flag = np.asarray(gone, dtype=bool)
    if not flag.any():
        return w
    keep = ~flag[w.codes]
    total = np.concatenate([[0], np.cumsum(keep)])
    return Words(w.vocab, w.codes[keep], total[w.offsets])


def remap(w: Words, words: list[str]) -> Words:
    """Replace vocabulary entry i by ``words[i]``; entries that become equal merge, empty ones vanish."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    to = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return drop_words(Words(coded.dictionary, to[w.codes] if len(to) else w.codes, w.offsets), pc.equal(coded.dictionary, ""))


def hash_words(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each vocabulary word; the same on every machine."""
    if not len(vocab):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocab.to_numpy(zero_copy_only=False), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform doubles in (0, 1) made from 64-bit hashes and a salt."""
    with np.errstate(over="ignore"):
        z = mix64(h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every element of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array over flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def over_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``make`` to every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return run
