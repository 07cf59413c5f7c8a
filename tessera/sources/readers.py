"""Scans: Parquet and JSON lines, several shards interleaved, cached copies of remote files."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path
from random import Random
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.batches import pieces
from tessera.protocol import Invalid
from tessera.sources import hub, remote, storage
from tessera.sources.catalogue import SourceSpec
from tessera.sources.scratch import folder

CACHE_VARIABLE = "TESSERA_SOURCE_CACHE"
RowProvider = Callable[[SparkSession, SourceSpec, int], DataFrame]


def cached_path(url: str, root: str | Path) -> Path:
    """Where the cached copy of ``url`` lies: its SHA-256 and its suffix without the query."""
    return Path(root) / (hashlib.sha256(url.encode()).hexdigest() + Path(urlsplit(url).path).suffix)


def resolve(spark: SparkSession, urls: list[str] | tuple[str, ...], cache: str | None = None) -> list[str]:
    """The addresses to read.

    With a cache every file must lie in it; one that isn't there is an error, never
    fetched. Without one, web addresses are copied to the shared folder by the
    executors, and other addresses are read where they are.
    """
    cache = cache or os.environ.get(CACHE_VARIABLE)
    if cache:
        found = [f"{cache.rstrip('/')}/{cached_path(u, cache).name}" for u in urls]
        for url, path in zip(urls, found):
            if not storage.exists(spark, path):
                raise FileNotFoundError(f"not in the cache: {url}")
        return found
    web = [u for u in urls if urlsplit(u).scheme in ("http", "https")]
    copies = dict(zip(web, remote.copy_all(spark, web, f"{folder(spark)}/sources"))) if web else {}
    return [copies.get(u, u) for u in urls]


def json_lines(spark: SparkSession, paths: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per line that isn't blank: ``raw``, the line, or its object cut to ``columns`` (missing ones as null).

    Lines that hold no object stay as they are, so that they are counted as
    invalid rows; so do malformed lines. A ``.json`` file that is one array gives its
    elements; such a file is read whole by one task, which is meant for small ones.
    """
    arrays = [p for p in paths if p.endswith(".json")]
    rest = [p for p in paths if p not in arrays]
    parts = ([spark.read.text(rest)] if rest else []) + ([spark.read.text(arrays, wholetext=True).mapInArrow(elements, "value string")] if arrays else [])
    lines = reduce(DataFrame.unionByName, parts).select(F.col("value").alias("raw")).where(~T.is_blank(F.col("raw")))
    if columns is None:
        return lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in pieces(full)):
            yield pa.RecordBatch.from_arrays([pa.array([projected(x, columns) for x in batch.column(0).to_pylist()], pa.string())], names=["raw"])

    return lines.mapInArrow(run, "raw string")


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of texts that are JSON arrays, the lines of others."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = None
            if text.lstrip().startswith("["):
                try:
                    found = json.loads(text)
                except (json.JSONDecodeError, RecursionError):
                    found = None
            rows = text.split("\n") if found is None else [json.dumps(x, ensure_ascii=False) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])


def projected(line: str, columns: tuple[str, ...]) -> str:
    try:
        found = json.loads(line)
    except (json.JSONDecodeError, RecursionError):
        return line
    return json.dumps({c: found.get(c) for c in columns}, ensure_ascii=False) if isinstance(found, dict) else line


def kind(paths: list[str]) -> str:
    """'json' or 'parquet', by the suffixes."""
    kinds = {Path(urlsplit(p).path).suffix for p in paths}
    if kinds <= {".jsonl", ".json"}:
        return "json"
    if kinds <= {".parquet", ""}:
        return "parquet"
    raise Invalid(f"files of kind {sorted(kinds)} are not supported")


def scan(spark: SparkSession, paths: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """Parquet files with column pruning, or JSON lines (by suffix)."""
    if kind(paths) == "json":
        return json_lines(spark, paths, columns)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def interleave(shards: list[DataFrame], seed: int | None = None) -> DataFrame:
    """All rows of all shards with ``pos``: one row of each shard in turn, exhausted shards left out.

    Shards are shuffled by ``seed``. Inside a shard the order is that of its hash
    key with a seed, that of the rows without one.
    """
    order = list(range(len(shards)))
    if seed is not None:
        Random(seed).shuffle(order)
    parts = [shards[i].withColumns({"__shard": F.lit(k), "__at": F.monotonically_increasing_id()}) for k, i in enumerate(order)]
    return interleaved(reduce(DataFrame.unionByName, parts), "__shard", "__at").withColumn("pos", F.struct("turn", "__shard")).drop("__at", "turn", "__shard")


def interleaved(df: DataFrame, shard: str, order: str) -> DataFrame:
    """Adds ``turn``, the row's number within its shard by ``order``; rows go by (turn, shard)."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(shard).orderBy(order)))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``pos``, a seeded shuffle of the rows by their unique ``key``."""
    return df.withColumn("pos", T.seeded_order(F.col(key), seed))


def numbered(df: DataFrame, content: str, name: str = "nth", salts: int = 64) -> DataFrame:
    """Adds ``name``, which numbers the rows of equal ``content`` from 0.

    Equal rows are interchangeable, so the numbered table is the same whatever the
    files' splits. The rows of one content are spread over ``salts`` tasks, and
    their counts, not the rows, decide where each task's numbers begin.
    """
    d = df.withColumn("__hash", F.sha2(content, 256)).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    d = d.withColumn("__nth", F.row_number().over(Window.partitionBy("__hash", "__salt").orderBy(F.lit(0))) - 1)
    count = d.groupBy("__hash", "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__hash").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = count.withColumn("__base", before).where("__base > 0").drop("__n")
    d = d.join(start, ["__hash", "__salt"], "left")
    return d.withColumn(name, F.coalesce("__base", F.lit(0)) + F.col("__nth")).drop("__hash", "__salt", "__nth", "__base")


def read_source(spark: SparkSession, spec: SourceSpec, seed: int = 42, cache: str | None = None, order: str = "shuffled") -> DataFrame:
    """The default row provider: the source's rows with ``pos``, their place in the source's order.

    ``shuffled`` is a seeded shuffle of all rows. A Parquet row's key is its file and
    its number in it, which the scan knows, so nothing is shuffled or read for it; a
    JSON line's key is the line and its number among equal ones. ``interleaved``
    (Parquet only) takes one row of each file in turn, files in seeded order. Neither
    depends on how files are split. A source without addresses is read from the hub.
    """
    if order not in ("shuffled", "interleaved"):
        raise Invalid(f"no order is named {order}")
    if spec.urls:
        paths, names = resolve(spark, spec.urls, cache), list(spec.urls)
    else:
        paths = names = hub.snapshot_files(spark, spec)
        if not paths:
            return keyed_lines(hub.stream(spark, spec), seed, order)
    if kind(paths) == "json":
        return keyed_lines(json_lines(spark, paths, spec.columns), seed, order)
    last = [p.rsplit("/", 1)[-1] for p in paths]
    plain = len(set(last)) == len(last)
    ranks = list(range(len(paths)))
    Random(seed).shuffle(ranks)
    known = F.create_map(*[F.lit(x) for n, u, r in zip(last, names, ranks) for x in (n, f"{r} {u.rsplit('/', 1)[-1]}")]) if plain else None
    df = spark.read.parquet(*paths)
    columns = [F.col(c) for c in spec.columns or df.columns]
    file = F.col("_metadata.file_path") if known is None else F.coalesce(F.element_at(known, F.col("_metadata.file_name")), F.col("_metadata.file_path"))
    if order == "shuffled":
        pos = T.seeded_order(F.concat_ws(":", F.regexp_replace(file, r"^\d+ ", ""), F.col("_metadata.row_index")), seed)
    elif known is None:
        raise Invalid("files of one name can't be interleaved")
    else:
        pos = F.col("_metadata.row_index") * len(paths) + F.regexp_extract(file, r"^(\d+) ", 1).cast("bigint")
    return df.select(*columns, pos.alias("pos"))


def keyed_lines(lines: DataFrame, seed: int, order: str) -> DataFrame:
    """JSON lines with ``pos``."""
    if order != "shuffled":
        raise Invalid("JSON lines can only be shuffled")
    d = numbered(lines, "raw")
    return d.select("raw", T.seeded_order(F.concat_ws(":", F.sha2("raw", 256), "nth"), seed).alias("pos"))
