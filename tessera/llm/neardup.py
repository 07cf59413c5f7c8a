"""Near-duplicate groups by MinHash with tensored banding, every candidate verified.

Tensored banding: instead of K hashes for each of L tables, two collections of
``SIDE`` small hashes (each the combination of ``DEPTH`` MinHashes) are drawn,
and every pair (A_i, B_j) is the key of one table. ``SIDE`` squared tables thus
cost ``2 * SIDE * DEPTH`` MinHashes in place of ``2 * DEPTH * SIDE**2``; two
documents of Jaccard similarity s meet with probability
``(1 - (1 - s**DEPTH)**SIDE)**2``: 0.96 at s = 0.6, 0.92 at 0.55, 0.86 at 0.5, 0.0001 at 0.05.

Steps: (1) MinHashes of lower-case word 3-shingles, in Arrow batches; copies with
equal normalised words collapse into one representative, so a key never holds
them twice. (2) Table keys are formed in the JVM and aggregated to counts and set
digests, which combine before the shuffle; of keys met by the same set of
representatives one is kept, and its members are rows, never an array, so a key that a
third of the corpus meets is rows that the engine can split. (3) Candidates are verified
by the exact Jaccard similarity of their shingle sets (``array_intersect``), in rounds
that never test inside a group already joined: each document against the least one it
meets, then group against group. What is still apart goes through an exact prefix
filter: a pair that reaches the threshold shares one of the rarest shingles of both
documents, so only such pairs are formed, and those that meet in some key and are of
different groups are verified. So the groups are exactly the connected components of all
verified candidate pairs, without a cap on key sizes, and neither a large group nor a
large key of unlike documents is squared. (4) Components by large-star / small-star, by
joins of rows.

Defined results: null, empty and word-less texts belong to no group; a text of
one or two words counts as one shingle; rows repeated with the same doc_id are
one document; rows with a null doc_id are in no group; the least doc_id of a
group is the one kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import textkit as tk
from tessera.llm.shared import Scratch

SIDE, DEPTH, THRESHOLD, GRAM, ROUNDS = 9, 2, 0.5, 3, 3
PLAIN = re.compile(r"[\W_]+")


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all word 3-shingles, their offsets, and two hashes of the whole normalised text."""
    w = tk.split_words(texts)
    w = tk.remap(w, [x if x.isalnum() else PLAIN.sub("", x) for x in w.vocab.to_pylist()])
    h, n = tk.hash_words(w.vocab)[w.codes], w.lengths
    count = np.where(n > 0, np.maximum(1, n - GRAM + 1), 0)
    start = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(start[-1]) - np.repeat(start[:-1], count) + np.repeat(w.offsets[:-1], count)
    end = np.repeat(w.offsets[1:], count)
    padded = np.concatenate([h, np.zeros(GRAM, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            word = np.where(at + k < end, padded[at + k], np.uint64(0))
            out = tk.mix64(out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k))
        place = (np.arange(len(h)) - np.repeat(w.offsets[:-1], n)).astype(np.uint64)
        whole = []
        for salt in (0xA5A5A5A5A5A5A5A5, 0x5DEECE66D1234567):
            x = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix64(h + tk.mix64(place + np.uint64(salt))), dtype=np.uint64)])
            whole.append(tk.mix64(x[w.offsets[1:]] - x[w.offsets[:-1]] + n.astype(np.uint64)))
    return out, start, whole[0], whole[1]


def small_hashes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The 2 * SIDE small hashes of each document that has shingles, [documents, 2 * SIDE]."""
    out = np.zeros((len(start) - 1, 2 * SIDE), np.uint64)
    rows = np.flatnonzero(np.diff(start) > 0)
    if not len(rows):
        return out
    begin = start[:-1][rows]
    with np.errstate(over="ignore"):
        for k in range(2 * SIDE):
            for d in range(DEPTH):
                seed = k * DEPTH + d + 1
                a = np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF | 1)
                least = np.minimum.reduceat((h ^ (a >> np.uint64(7))) * a, begin)
                out[rows, k] = tk.mix64(out[rows, k] * np.uint64(31) + least)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, two digests of the normalised text, and the collections ``a`` and ``b``; word-less texts are left out."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        h, start, one, two = shingles(part.column("text"))
        small = small_hashes(h, start).view(np.int64)
        ok = np.flatnonzero(np.diff(start) > 0)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x[ok]).ravel()), SIDE).cast(pa.list_(pa.int64())) for x in (small[:, :SIDE], small[:, SIDE:])]
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ok)), pa.array(one.view(np.int64)[ok]), pa.array(two.view(np.int64)[ok]), *lists], names=["doc_id", "d1", "d2", "a", "b"])

    schema = "doc_id bigint, d1 bigint, d2 bigint, a array<bigint>, b array<bigint>"
    return plain(docs).mapInArrow(tk.over_slices(make, "text"), schema)


def plain(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ``s``, the distinct shingles, of the wanted documents. Hashes of 32 bits stand for shingles: a chance match of two shingles of a pair has odds of 2**-32."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        h, start, _, _ = shingles(part.column("text"))
        h = (h >> np.uint64(32)).astype(np.uint32)
        sets = [np.unique(h[lo:hi]) for lo, hi in zip(start[:-1], start[1:])]
        size = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flat = np.concatenate(sets).view(np.int32) if sets else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), tk.ragged(flat, size, pa.int32())], names=["doc_id", "s"])

    chosen = plain(docs).join(wanted.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.mapInArrow(tk.over_slices(make, "text"), "doc_id bigint, s array<int>")


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (doc_id, root), root the least id, for ids that have an edge.

    Alternates large-star and small-star (Kiveris et al., 2014) until nothing
    changes; every round is written to the shared folder. Neighbours are rows, so a
    hub of any degree is split by the engine like any hot join key.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{tag}-0")
    before, k = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).where("u <> v").distinct()
        k += 1
        now = scratch.write(small, f"{tag}-{k}")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{tag}-{k - 1}")
        if mark == before:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = mark


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose exact Jaccard similarity reaches the threshold."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "uv")
    small, large = F.least(F.size("su"), F.size("sv")), F.greatest(F.size("su"), F.size("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    joined = left.join(pairs.hint("shuffle_hash"), "u").hint("shuffle_hash").join(right, "v").where(small >= threshold * large)
    return joined.where(common >= threshold * (small + large - common)).select("u", "v")


def meetings(keys: DataFrame) -> DataFrame:
    """Rows (key, doc_id, least) of the keys that several representatives share; of keys with the same members one stays."""
    digest = [F.bit_xor(F.xxhash64(F.lit(salt), "rep")).alias(f"x{salt}") for salt in (1, 2)]
    sets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least"), *digest).where("n > 1")
    kept = sets.groupBy("n", "least", "x1", "x2").agg(F.min("key").alias("key")).select("key", "least")
    return keys.join(kept.hint("shuffle_hash"), "key").select("key", F.col("rep").alias("doc_id"), "least")


def prefix_pairs(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v), u > v, of open documents (key, doc_id, root) that share a key, are of different groups and may reach the threshold.

    Shingles are ordered by how many open documents have them. If J(x, y) >= t and
    |y| <= |x|, they share at least t |x| shingles, hence one of the first
    |x| - ceil(t |x|) + 1 of x and the first |y| - ceil(2 t / (1 + t) |y|) + 1 of y.
    """
    docs = open_.select("doc_id", "root").distinct()
    held = docs.join(sets.hint("shuffle_hash"), "doc_id")
    item = held.select("doc_id", "root", F.size("s").alias("n"), F.explode("s").alias("x"))
    uses = item.groupBy("x").agg(F.count("*").alias("uses"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("uses", "x"))
    short = F.col("n") - F.ceil(F.lit(2 * threshold / (1 + threshold) - 1e-9) * F.col("n")) + 1
    long = F.col("n") - F.ceil(F.lit(threshold - 1e-9) * F.col("n")) + 1
    ranked = item.join(uses, "x").where("uses > 1").withColumn("nth", nth + F.col("n") - F.count("*").over(Window.partitionBy("doc_id")))
    ranked = ranked.where(F.col("nth") <= long)
    y = ranked.where(F.col("nth") <= short).select("x", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    x = ranked.select("x", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    pairs = y.join(x, "x").where((F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b")) & (F.col("ra") != F.col("rb")) & (F.col("na") >= F.lit(threshold) * F.col("nb")))
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    of = open_.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # at most SIDE * SIDE of them
    ku, kv = (of.select(F.col("doc_id").alias(c), F.col("keys").alias(f"k{c}")) for c in "uv")
    return pairs.join(ku, "u").join(kv, "v").where(F.arrays_overlap("ku", "kv")).select("u", "v")


def duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, group_id, group_size, is_kept) of every document that has a near or exact copy.

    ``group_id`` is the least doc_id of the group and the one document kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    sk = scratch.write(sketch(docs), "sketch")
    same = sk.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    key = F.xxhash64("i", "x", "j", "y")
    keys = same.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y")).select(key.alias("key"), "rep")
    member = scratch.write(meetings(keys), "members")
    sets = scratch.write(shingle_sets(docs, member.select("doc_id").distinct()), "sets")

    first = member.where("doc_id <> least").groupBy(F.col("doc_id").alias("u")).agg(F.min("least").alias("v"))
    edges = scratch.write(verified(first, sets, threshold), "edges-0")
    open_, k = member.select("key", "doc_id"), 0
    while True:
        roots = components(scratch, edges, f"cc-{k}")
        named = open_.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        open_ = scratch.write(named.join(apart.select("key", "lo"), "key"), f"open-{k}")
        if open_.isEmpty() or k == ROUNDS:
            break
        k += 1
        if k < ROUNDS:  # one document of each group against one of the key's least group
            of = open_.groupBy("key", "lo", "root").agg(F.min_by("doc_id", F.xxhash64(F.lit(k), "doc_id")).alias("doc_id"))
            at = of.where("root = lo").select("key", F.col("doc_id").alias("v"))
            pairs = of.where("root <> lo").select("key", F.col("doc_id").alias("u")).join(at, "key").select("u", "v")
            pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        else:  # the rest, exactly
            pairs = prefix_pairs(open_, sets, threshold)
        new = scratch.write(verified(pairs, sets, threshold), f"edges-{k}")
        edges = edges.unionByName(new)
        open_ = open_.select("key", "doc_id")
    roots = roots.select(F.col("doc_id").alias("rep"), "root")
    groups = sk.select("doc_id", "d1", "d2").join(same.select("d1", "d2", "rep"), ["d1", "d2"]).join(roots, "rep", "left")
    groups = groups.select("doc_id", F.coalesce("root", "rep").alias("group_id")).distinct()
    size = groups.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return groups.join(size, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("is_kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose group keeps another one; columns unchanged."""
    gone = duplicate_groups(docs, threshold).where("not is_kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
