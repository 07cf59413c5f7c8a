"""Checks of compiled rows and their packing into training samples."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.compile import compile_rows
from tessera.protocol import IGNORED, Invalid

NEEDED = {"input_ids", "labels"}


def mode(df: DataFrame, messages: str = "messages_json") -> str:
    """'precompiled' if both id columns are there, 'messages' if the messages column is; else Invalid."""
    if NEEDED <= set(df.columns):
        return "precompiled"
    if messages in df.columns:
        return "messages"
    raise Invalid(f"neither {sorted(NEEDED)} nor {messages} is a column")


def fault(vocab_size: int, max_length: int, full_loss: bool = False, ids: str = "input_ids", labels: str = "labels") -> Column:
    """What is wrong with a compiled row, or null: missing, empty, length, too_long, id_range, label, no_target."""
    i, lb = F.col(ids), F.col(labels)
    fits = lambda a, b: (b.isNotNull() & a.isNotNull()) & ((b == IGNORED) | (b == a))
    return (
        F.when(i.isNull() | lb.isNull(), "missing")
        .when(F.size(i) == 0, "empty")
        .when(F.size(i) != F.size(lb), "length")
        .when(F.size(i) > max_length, "too_long")
        .when(~F.forall(i, lambda x: F.coalesce((x >= 0) & (x < vocab_size), F.lit(False))), "id_range")
        .when(~F.forall(F.zip_with(i, lb, fits), lambda x: x), "label")
        .when(F.lit(not full_loss) & (T.count_targets(lb) == 0), "no_target")
    )


def check_types(df: DataFrame) -> None:
    """Both sequences must be arrays of integers; floats and booleans are refused."""
    kinds = dict(df.dtypes)
    for c in sorted(NEEDED):
        if kinds.get(c) not in {f"array<{k}>" for k in ("tinyint", "smallint", "int", "bigint")}:
            raise Invalid(f"{c} must be an array of integers, not {kinds.get(c)}")


def validate(df: DataFrame, vocab_size: int, max_length: int = 2048, full_loss: bool = False, strict: bool = True) -> DataFrame:
    """The rows with checked ids; with ``full_loss`` labels become the ids. ``strict`` fails the job at a bad row, else ``fault`` names it."""
    check_types(df)
    wrong = fault(vocab_size, max_length, full_loss)
    out = df.withColumn("labels", F.col("input_ids")) if full_loss and strict else df
    if strict:
        checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("bad compiled row: "), wrong)).cast("array<int>")).otherwise(F.col("input_ids").cast("array<int>"))
        labels = checked if full_loss else F.col("labels").cast("array<int>")
        return df.withColumns({"input_ids": checked, "labels": labels})
    out = df.withColumn("fault", wrong)
    return out.withColumn("labels", F.when(F.col("fault").isNull(), F.col("input_ids")).otherwise(F.col("labels"))) if full_loss else out


def compile_strict(df: DataFrame, tokenizer: Any, max_length: int | None = None, full_loss: bool = False, messages: str = "messages_json") -> DataFrame:
    """Compile rows of messages for training (``tools`` or ``tools_json``, ctrl_json, caps_json and preserve_thinking where they are there); any row that fails, fails the job."""
    tools = next((F.col(c) for c in ("tools", "tools_json") if c in df.columns), F.lit(None))
    rows = df.withColumns({"messages_json": F.col(messages), "tools_json": F.coalesce(tools.cast("string"), F.lit("[]"))})
    done = compile_rows(rows.drop("rejection"), tokenizer, max_length, full_loss=full_loss)
    bad = F.col("rejection").isNotNull() & ~((F.col("rejection") == "no_target") & F.lit(full_loss))
    ok = F.when(bad, F.raise_error(F.concat(F.lit("row can't be compiled: "), "rejection")).cast("array<int>")).otherwise(F.col("input_ids"))
    return done.withColumn("input_ids", ok).drop("rejection")


def check_manifest(manifest: Mapping[str, Any], tokenizer: str, revision: str, digest: str) -> None:
    """Raises Invalid unless the manifest describes complete, compatible data with this checksum."""
    want = {"complete": True, "pretokenized": True, "format_version": 2, "assistant_only_loss": True, "preserve_thinking": True, "tokenizer": tokenizer, "tokenizer_revision": revision, "output_sha256": digest}
    wrong = [k for k, v in want.items() if manifest.get(k) != v] + [c for c in sorted(NEEDED) if c not in manifest.get("columns", [])]
    if wrong:
        raise Invalid(f"the manifest does not fit: {', '.join(wrong)}")


def load_precompiled(spark, paths: list[str], manifest_path: str | None, tokenizer: str, revision: str, **check: Any) -> DataFrame:
    """Gate, then read: one output, its manifest, its checksum, every row checked."""
    from tessera.sources import sinks, storage

    if len(paths) != 1:
        raise Invalid("exactly one precompiled output is needed")
    check_manifest(storage.read_json(spark, manifest_path or f"{paths[0]}.manifest.json"), tokenizer, revision, sinks.checksum(spark, paths[0]))
    return validate(spark.read.parquet(paths[0]), **check)


def load(spark, paths: list[str], tokenizer: Any, *, manifest_path: str | None = None, name: str = "bytes", revision: str = "1", messages: str = "messages", max_length: int = 2048, full_loss: bool = False) -> DataFrame:
    """Training rows of either kind: a compiled table behind its gate, or messages (Parquet or JSON lines) compiled strictly."""
    from tessera.sources import readers

    if all(p.endswith((".jsonl", ".json")) for p in paths):
        df = spark.read.schema(f"`{messages}` string, tools string, tools_json string, ctrl_json string, caps_json string, preserve_thinking boolean").json(paths)
    else:
        df = readers.scan(spark, paths)
    if mode(df, messages) == "precompiled":
        return load_precompiled(spark, paths, manifest_path, name, revision, vocab_size=tokenizer.size, max_length=max_length, full_loss=full_loss)
    return compile_strict(df, tokenizer, None, full_loss, messages)


def best_fit(lengths: list[int], size: int) -> list[int]:
    """Bin of each item, by best fit decreasing; equal room goes to the earlier bin. Space classes keep it O(n * size) at worst, O(n) in practice."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # sorted free spaces in use
    out, bins = [0] * len(lengths), 0
    for i in order:
        need = lengths[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            b, room = bins, size
            bins += 1
        else:
            room = rooms[at]
            b = open_[room].pop(0)
            if not open_[room]:
                rooms.pop(at)
        out[i] = b
        left = room - need
        if left:
            if not open_[left]:
                insort(rooms, left)
            insort(open_[left], b)
    return out


PACKED = "bin_id string, seg_no int, row_id string, input_ids array<int>, labels array<int>, position_ids array<int>, fault string"


def fit_counts(counts: Mapping[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The bins of ``best_fit`` for ``counts[n]`` items of each length n, as pieces, and their number.

    A piece (n, rank, bin, each, seg) says: of the items of length n, from the ``rank``-th on, ``each`` go to ``bin``, as its
    segments ``seg`` and on, as many to the next bin and so on, up to the next piece of n. Bins of consecutive
    numbers and the same content are one run, so the work and the result depend on ``size``, not on the number of items.
    """
    open_: dict[int, list[tuple[int, int, int]]] = {}  # by free space: runs (first bin, bins, segments in each)
    rooms: list[int] = []
    pieces, bins = [], 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room and run[1]:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            insort(open_[room], run)

    for n in sorted((n for n in counts if counts[n]), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                room, runs = size, [(bins, -(-left // (size // n)), 0)]
                bins += runs[0][1]
            else:
                room = rooms.pop(at)
                runs = open_.pop(room)
            each = room // n  # an item that leaves room for another is followed by it: no other bin fits better
            for first, many, seg in runs:
                full, rest = divmod(min(left, many * each), each)
                if left:
                    pieces.append((n, counts[n] - left, first, each, seg))
                left -= full * each + rest
                put(room - each * n, (first, full, seg + each))
                put(room - rest * n, (first + full, min(1, rest), seg + rest))
                used = full + min(1, rest)
                put(room, (first + used, many - used, seg))
    return pieces, bins


#: Ranges of row ids by which rows are numbered, and ids drawn to cut them.
RANGES, DRAWN = 256, 16_384
#: Ids and rows of an output batch.
BATCH_IDS, BATCH_ROWS = 1_000_000, 1024


def pack(df: DataFrame, row_id: str, max_length: int = 2048, group_tokens: int | None = None) -> DataFrame:
    """Pack rows into bins of at most ``max_length`` ids by best-fit decreasing. Every row comes back once.

    A row that fits no bin is returned whole with a ``fault``, as ``fault()`` names it:
    ``too_long`` in a bin of its own, which is over ``max_length``; ``empty`` and
    ``missing`` (null ids) in no bin. ``fault`` is null for packed rows.

    The bins are those of ``best_fit`` over all rows in the order (row id, ids, labels), at any size of the table, and
    depend on the rows alone, not on partitions or settings. They follow from the number of rows of each length
    (``fit_counts``) and a row's rank among those of its length, for which rows are counted by length and range of
    row ids; a task streams its ranges in order and holds none of them. With ``group_tokens``
    rows are spread over groups of about so many ids by a hash of their row id instead and packed inside each, as
    pieces of at most twice that. Each segment's position ids start at 0, which marks where a recurrent state begins anew.
    """
    size = F.size("input_ids")
    wrong = F.when(F.col("input_ids").isNull(), "missing").when(size == 0, "empty").when(size > max_length, "too_long").alias("fault")
    ids, labels = (F.col(c).cast("array<int>").alias(c) for c in ("input_ids", "labels"))
    rows = df.select(F.coalesce(size, F.lit(0)).alias("n"), F.col(row_id).cast("string").alias("row_id"), ids, labels, wrong)
    return packed_whole(rows, max_length) if group_tokens is None else packed_groups(rows, max_length, group_tokens)


def batch_of(part: pa.RecordBatch | pa.Table, bins: list[str | None], seg: list[int | None]) -> Iterator[pa.RecordBatch]:
    """Rows (n, row_id, input_ids, labels, fault) with their bins and segments, as PACKED."""
    lengths = np.maximum(part.column("n").to_numpy(), 0)
    lo = 0
    while lo < len(lengths):
        hi = min(len(lengths), lo + BATCH_ROWS, lo + 1 + int(np.searchsorted(np.cumsum(lengths[lo:]), BATCH_IDS)))
        cut, sizes = part.slice(lo, hi - lo), lengths[lo:hi]
        ends = np.cumsum(sizes)
        starts = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(ends - sizes, sizes)
        mask = pa.array([b is None for b in bins[lo:hi]])
        positions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(starts.astype(np.int32)), mask=mask)
        cols = [pa.array(bins[lo:hi], pa.string()), pa.array(seg[lo:hi], pa.int32()), cut.column("row_id"), cut.column("input_ids"), cut.column("labels"), positions, cut.column("fault")]
        yield from pa.table(cols, names=[c.split()[0] for c in PACKED.split(", ")]).combine_chunks().to_batches()
        lo = hi


def range_of(cuts: list[str], key: Column) -> Column:
    """How many of the sorted texts ``cuts`` are not over ``key``, in two steps over about the root of their number each."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    under = lambda c: F.coalesce(c <= key, F.lit(False))
    block = F.size(F.filter(F.lit(cuts[::step]), under)) - 1
    inside = F.size(F.filter(F.slice(F.lit(cuts), F.greatest(block, F.lit(0)) * step + 1, F.lit(step)), under))
    return F.when(block < 0, 0).otherwise(block * step + inside)


def packed_whole(rows: DataFrame, max_length: int) -> DataFrame:
    """One best-fit decreasing packing over all rows."""
    drawn = sorted(r[0] for r in rows.where("row_id is not null").select("row_id").orderBy(F.rand(0)).limit(DRAWN).collect())
    cuts = sorted({drawn[len(drawn) * k // RANGES] for k in range(1, RANGES)} if drawn else [])
    ranged = rows.withColumn("g", range_of(cuts, F.col("row_id")))
    key = F.when(F.col("n") <= 0, -1).when(F.col("n") > max_length, 0).otherwise(F.col("n"))  # no filter, which would compile each row twice
    counted = ranged.groupBy("g", key.alias("n")).agg(F.count("*").alias("many")).toArrow()
    g, n, many = (counted.column(c).to_numpy().astype(np.int64) for c in ("g", "n", "many"))
    g, n, many = g[n >= 0], n[n >= 0], many[n >= 0]
    order = np.lexsort((g, n))
    g, n, many = g[order], n[order], many[order]
    firsts = np.flatnonzero(np.diff(n, prepend=-1))  # where each length begins
    before = np.cumsum(many) - many
    before -= np.repeat(before[firsts], np.diff(firsts, append=len(n)))  # rows of that length in lesser ranges; length 0 stands for those too long
    pieces, bins = fit_counts({int(n[a]): int(x) for a, x in zip(firsts, np.add.reduceat(many, firsts)) if n[a]} if len(n) else {}, max_length)
    table = np.array(pieces, np.int64).reshape(-1, 5)
    by_range = np.argsort(g, kind="stable")
    g, n, before = g[by_range], n[by_range], before[by_range]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = -table[:, 0]  # ascending
        known: dict[int, tuple[list[int], list[list[int]]]] = {}
        now, rank = None, {}

        def of(length: int) -> tuple[list[int], list[list[int]]]:
            if length not in known:
                mine = table[np.searchsorted(lengths, -length) : np.searchsorted(lengths, -length, side="right")]
                known[length] = mine[:, 1].tolist(), mine.tolist()
            return known[length]

        for batch in batches:
            found, seg = [], []
            for at, length, why in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), batch.column("fault").to_pylist()):
                if at != now:
                    lo, hi = np.searchsorted(g, [at, at + 1])
                    now, rank = at, dict(zip(n[lo:hi].tolist(), before[lo:hi].tolist()))
                if why in ("empty", "missing"):
                    found.append(None)
                    seg.append(None)
                    continue
                length = 0 if why else length
                k = rank[length]
                rank[length] = k + 1
                if why:
                    found.append(f"0-0-{bins + k}")
                    seg.append(0)
                    continue
                ranks, mine = of(length)
                _, first, b, each, s = mine[bisect_right(ranks, k) - 1]
                found.append(f"0-0-{b + (k - first) // each}")
                seg.append(s + (k - first) % each)
            yield from batch_of(batch, found, seg)

    return ranged.repartition("g").sortWithinPartitions("g", "row_id", "input_ids", "labels").mapInArrow(run, PACKED)


def packed_groups(rows: DataFrame, max_length: int, group_tokens: int) -> DataFrame:
    """Packings of groups of about ``group_tokens`` ids, each held by its task as Arrow arrays; a group that grows beyond twice its size (one id repeated over and over) is packed in pieces of the order (row id, ids)."""
    total = rows.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def packed(t: pa.Table, piece: int) -> Iterator[pa.RecordBatch]:
        size, faults = t.column("n").to_numpy(), t.column("fault").to_pylist()
        fit = [i for i, f in enumerate(faults) if f is None]
        bin_of = [-1] * len(faults)
        for i, b in zip(fit, best_fit([int(size[i]) for i in fit], max_length)):
            bin_of[i] = b
        order = sorted(fit, key=lambda i: (bin_of[i], -size[i], i))
        n = 1 + max(bin_of, default=-1)
        for i, f in enumerate(faults):
            if f == "too_long":
                bin_of[i], n = n, n + 1
                order.append(i)
        order += [i for i, f in enumerate(faults) if f in ("empty", "missing")]
        seg, last = [], None
        for i in order:
            seg.append(None if bin_of[i] < 0 else 0 if bin_of[i] != last else seg[-1] + 1)
            last = bin_of[i]
        g = t.column("g")[0].as_py()
        for lo in range(0, len(order), 1024):
            at = order[lo : lo + 1024]
            yield from batch_of(t.take(at), [None if bin_of[i] < 0 else f"{g}-{piece}-{bin_of[i]}" for i in at], seg[lo : lo + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens, now, piece = 0, None, 0
        for batch in batches:
            g, n = batch.column("g").to_numpy(), np.maximum(batch.column("n").to_numpy(), 1)
            lo = 0
            while lo < len(g):
                if g[lo] != now:
                    if held:
                        yield from packed(pa.Table.from_batches(held), piece)
                    held, tokens, piece, now = [], 0, 0, g[lo]
                hi = lo + int(np.searchsorted(g[lo:], now, side="right"))
                hi = min(hi, lo + 1 + int(np.searchsorted(np.cumsum(n[lo:hi]), 2 * group_tokens - tokens)))
                held.append(batch.slice(lo, hi - lo))
                tokens += int(n[lo:hi].sum())
                if tokens >= 2 * group_tokens:
                    yield from packed(pa.Table.from_batches(held), piece)
                    held, tokens, piece = [], 0, piece + 1
                lo = hi
        if held:
            yield from packed(pa.Table.from_batches(held), piece)

    group = F.pmod(F.xxhash64("row_id"), F.lit(groups))
    return rows.withColumn("g", group).repartition("g").sortWithinPartitions("g", "row_id", "input_ids").mapInArrow(run, PACKED)
