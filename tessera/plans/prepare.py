"""The corpus build: sources, adapters, compilation, dedup and quotas, table and manifest."""

from __future__ import annotations

import logging
import math
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches
from tessera.operators import adapters, mixture
from tessera.operators.compile import compile_rows
from tessera.protocol import Invalid
from tessera.sources import readers, sinks, storage
from tessera.sources.catalogue import DEFAULT_SOURCES, SourceSpec, as_record

ORDER = "pos"
FIRST_SPAN = 20_000
LOG = logging.getLogger("tessera.prepare")


def candidates(rows: DataFrame, adapter: str | Callable, limits: dict[str, Any]) -> DataFrame:
    """Candidate rows of a source (with ``pos``), by its adapter."""
    raw = "raw" if "raw" in rows.columns else None
    return adapters.adapt(rows.select(ORDER, raw) if raw else rows, adapter, (ORDER,), raw_json=raw, **limits)


def needed(compiled: DataFrame) -> DataFrame:
    """What the build reads of compiled rows: no mask, and ids of good rows alone. Rejected rows are counted only, and those too long would fill a reader's memory."""
    good = F.col("rejection").isNull()
    return compiled.withColumns({c: F.when(good, F.col(c)) for c in ("input_ids", "labels")}).drop("assistant_mask")


def fill_quota(rows: DataFrame, quota: int, accepted: DataFrame | None, build: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, str], DataFrame], name: str, first: int = FIRST_SPAN, progress: Callable[[dict[str, Any]], None] | None = None) -> DataFrame:
    """Outcomes of one source, worked off in spans of its order until its accepted tokens reach the quota.

    Only the spans that are needed are adapted and compiled (``build``), so a source much
    larger than its quota costs a scan of its order keys and little more. Every span is
    decided against what the spans and sources before it accepted, so the result is that of
    one pass. ``progress`` gets the counts after each span.
    """
    keyed, spans = mixture.spans(rows, ORDER, first)
    done, tokens, seen, compiled, taken = None, 0, 0, 0, 0
    for k, (lo, hi) in enumerate(spans):
        part = save(build(keyed.where(F.col("__b").between(lo, hi)).drop("__b")), f"compiled-{name}-{k}")
        known = [d.where("outcome = 'accepted'").select("fingerprint") for d in (accepted, done) if d is not None]
        known = known[0].unionByName(known[1]) if len(known) == 2 else known[0] if known else None
        out = save(mixture.decide(part, known, quota - tokens).withColumn("source", F.lit(name)), f"outcomes-{name}-{k}")
        n = out.agg(F.count("*").alias("seen"), F.count_if(F.col("outcome") == "accepted").alias("rows"), F.sum(F.when(F.col("outcome") == "accepted", F.col("target_tokens"))).alias("tokens")).first()
        tokens, seen, taken, compiled = tokens + (n["tokens"] or 0), seen + n["seen"], taken + n["rows"], compiled + part.count()
        done = out if done is None else done.unionByName(out)
        event = {"source": name, "span": k + 1, "spans": len(spans), "seen": seen, "compiled": compiled, "rows": taken, "target_tokens": tokens, "quota": quota}
        LOG.info("source %(source)s: span %(span)d of %(spans)d, seen %(seen)d, accepted %(rows)d rows / %(target_tokens)d of %(quota)d tokens", event)
        if progress:
            progress(event)
        if tokens >= quota:
            break
    return save(mixture.decide(build(rows), None, quota).withColumn("source", F.lit(name)), f"outcomes-{name}") if done is None else done


def prepare(spark: SparkSession, output: str | Path, sources: tuple[SourceSpec, ...] = DEFAULT_SOURCES, tokenizer: Any = None, *, manifest_path: str | Path | None = None, max_length: int = 2048, seed: int = 42, min_score: float = adapters.MIN_SCORE, max_chars: int = 1_000_000, max_bytes: int = 4_000_000, max_nodes: int = 100_000, max_depth: int = 128, compile_batch: int = 128, row_group_rows: int = 1024, row_provider: Callable[[SparkSession, SourceSpec, int], DataFrame] | None = None, tokenizer_name: str = "bytes", revision: str = "1", keep_work: bool = False, single_file: bool = False, first_span: int = FIRST_SPAN, custom: dict[str, Callable] | None = None, progress: Callable[[dict[str, Any]], None] | None = None) -> dict[str, Any]:
    """Build the compiled table and its manifest; returns the manifest.

    Addresses may lie on any file system that Spark knows. An incomplete mixture is
    written, too, with ``complete`` false. Intermediate tables go beside the output
    and are deleted at the end. ``custom`` gives adapters of the caller's own by name.
    """
    for name, value in (("max_length", max_length), ("max_chars", max_chars), ("max_bytes", max_bytes), ("max_nodes", max_nodes), ("max_depth", max_depth), ("compile_batch", compile_batch), ("row_group_rows", row_group_rows), ("first_span", first_span)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise Invalid(f"{name} must be a positive integer")
    if not math.isfinite(min_score):
        raise Invalid("min_score must be finite")
    sinks.refuse_existing(spark, output)
    work = sinks.beside(output, "work")
    storage.delete(spark, work)
    read = row_provider or readers.read_source
    limits = {"min_score": min_score, "max_chars": max_chars, "max_bytes": max_bytes, "max_nodes": max_nodes, "max_depth": max_depth}

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    by_name = {s.name: s for s in sources}
    outcomes: DataFrame | None = None
    for k, name in enumerate(mixture.source_order(list(by_name), seed)):
        spec = by_name[name]
        if spec.quota == 0:
            continue
        adapter = (custom or {}).get(spec.adapter, spec.adapter)
        build = lambda rows, a=adapter: needed(compile_rows(candidates(rows, a, limits), tokenizer, max_length, compile_batch))
        with small_batches(spark):
            done = fill_quota(read(spark, spec, seed + k), spec.quota, outcomes, build, save, name, first_span, progress)
        outcomes = done if outcomes is None else outcomes.unionByName(done)
    counts, lost = {}, {}
    if outcomes is not None:
        sinks.write_table(outcomes.where("outcome = 'accepted'"), output, row_group_rows, single_file)
        counts = {r["source"]: r for r in mixture.report(outcomes, {s.name: s.quota for s in sources}).collect()}
        for r in mixture.rejections(outcomes).collect():
            lost.setdefault(r["source"], {})[r["reason"]] = r["n"]
    else:
        sinks.write_table(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in sinks.COLUMNS.items())), output, row_group_rows)
    stats = [{**as_record(s), "rows": counts[s.name]["rows"] if s.name in counts else 0, "target_tokens": counts[s.name]["target_tokens"] if s.name in counts else 0, "rejected": lost.get(s.name, {})} for s in sources]
    parameters = {"max_length": max_length, "seed": seed, "max_serialized_chars": max_chars, "max_raw_bytes": max_bytes, "max_raw_nodes": max_nodes, "max_raw_depth": max_depth, "compile_batch_size": compile_batch, "row_group_size": row_group_rows, "source_cache": os.environ.get(readers.CACHE_VARIABLE), "tokenizer_timeout_seconds": getattr(tokenizer, "timeout", None), "shuffle": "all rows, by a seeded hash"}
    content = sinks.manifest(spark, output, stats, parameters, tokenizer_name, revision)
    storage.write_json(spark, str(manifest_path or f"{output}.manifest.json"), content)
    if not keep_work:
        storage.delete(spark, work)
    return content
