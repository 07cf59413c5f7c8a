"""Command line: ``prepare`` builds the compiled table, ``cache`` fetches source files, ``check`` gates a table."""

from __future__ import annotations

import argparse
import json
import sys

from tessera.sources.catalogue import DEFAULT_SOURCES, override_quotas


def tokenizer_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tokenizer", default="bytes", help="'bytes', or the address of a serialised tokenizer")
    p.add_argument("--eos", default="<|endoftext|>", help="the end-of-sequence token of a serialised tokenizer")
    p.add_argument("--revision", default="1")
    p.add_argument("--tokenizer-timeout-seconds", type=float, help="run the tokenizer in a process of its own with this limit for a batch")


def tokenizer_of(spark, a: argparse.Namespace):
    """The tokenizer that the options name."""
    from functools import partial

    from tessera.operators.tokenizers import ByteTokenizer, IsolatedTokenizer, from_backend_json
    from tessera.sources import storage

    make = ByteTokenizer if a.tokenizer == "bytes" else partial(from_backend_json, storage.read_text(spark, a.tokenizer), a.eos)
    own = make()
    return own if a.tokenizer_timeout_seconds is None else IsolatedTokenizer(make, a.tokenizer_timeout_seconds, own.ids, own.eos, own.size)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare", help="build the compiled table and its manifest")
    p.add_argument("--output", required=True)
    p.add_argument("--manifest")
    p.add_argument("--quota", action="append", default=[], metavar="NAME=INT")
    p.add_argument("--minimum-code-score", type=float, default=0.8)
    p.add_argument("--single-file", action="store_true", help="write one Parquet file in place of a folder")
    tokenizer_options(p)
    for name, default in (("max-length", 2048), ("max-serialized-chars", 1_000_000), ("max-raw-bytes", 4_000_000), ("max-raw-nodes", 100_000), ("max-raw-depth", 128), ("seed", 42), ("row-group-size", 1024), ("compile-batch-size", 128)):
        p.add_argument(f"--{name}", type=int, default=default)
    p = sub.add_parser("cache", help="fetch the files of the sources")
    p.add_argument("--cache", required=True)
    p.add_argument("--workers", type=int, default=4)
    p = sub.add_parser("check", help="check a compiled table against its manifest and pack it")
    p.add_argument("--data", required=True, nargs="+", help="a compiled table, or Parquet or JSON lines with messages")
    p.add_argument("--manifest")
    p.add_argument("--messages-column", default="messages")
    p.add_argument("--chat-template", help="a text template to check and keep beside the packed samples")
    p.add_argument("--max-length", type=int, default=2048)
    p.add_argument("--no-packing", action="store_true")
    tokenizer_options(p)
    p.add_argument("--full-loss", action="store_true")
    p.add_argument("--packed", help="where the packed samples go")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "cache":
        from tessera.sources.sinks import fill_cache

        fill_cache([u for s in DEFAULT_SOURCES for u in s.urls], a.cache, a.workers)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if a.command == "prepare":
        from tessera.plans.prepare import prepare

        done = prepare(spark, a.output, override_quotas(DEFAULT_SOURCES, a.quota), manifest_path=a.manifest, max_length=a.max_length, seed=a.seed, min_score=a.minimum_code_score, max_chars=a.max_serialized_chars, max_bytes=a.max_raw_bytes, max_nodes=a.max_raw_nodes, max_depth=a.max_raw_depth, compile_batch=a.compile_batch_size, row_group_rows=a.row_group_size, tokenizer=tokenizer_of(spark, a), tokenizer_name=a.tokenizer, revision=a.revision, single_file=a.single_file, progress=lambda e: print("source {source}: span {span}/{spans}, seen {seen}, accepted {rows} rows / {target_tokens} tokens".format(**e), flush=True))
        if not done["complete"]:
            print("warning: some quota was not reached", file=sys.stderr)
        print(json.dumps({k: done[k] for k in ("output", "total_rows", "target_tokens", "complete")}))
        return 0
    from pyspark.sql import functions as F

    from tessera.operators.precompiled import load, pack
    from tessera.plans.template import load_template
    from tessera.sources import storage

    template = load_template(a.chat_template)
    rows = load(spark, a.data, tokenizer_of(spark, a), manifest_path=a.manifest, name=a.tokenizer, revision=a.revision, messages=a.messages_column, max_length=a.max_length, full_loss=a.full_loss)
    if not a.packed:
        print(rows.agg(F.count("input_ids")).first()[0])
        return 0
    keyed = rows.withColumn("row_id", F.sha2(F.concat_ws(",", "input_ids"), 256))
    (keyed.select("row_id", "input_ids", "labels") if a.no_packing else pack(keyed, "row_id", a.max_length).repartition("bin_id").sortWithinPartitions("bin_id", "seg_no")).write.parquet(a.packed)
    storage.write_text(spark, f"{a.packed}/_chat_template.txt", template)
    return 0


if __name__ == "__main__":
    sys.exit(main())
