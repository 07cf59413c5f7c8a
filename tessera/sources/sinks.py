"""Writing the compiled table: staged commit, checksum, manifest; and the cache of remote files."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.protocol import Invalid
from tessera.sources import storage
from tessera.sources.readers import cached_path

COLUMNS = {"messages_json": "string", "tools_json": "string", "source": "string", "target_tokens": "bigint", "input_ids": "array<int>", "labels": "array<int>"}


def checksum_table(files: DataFrame) -> DataFrame:
    """The (part, sha256) list of files loaded with the ``binaryFile`` format; executors read and hash them."""
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("part"), F.sha2("content", 256).alias("sha256"))


def checksum(spark: SparkSession, path: str | Path) -> str:
    """SHA-256 of a file; of a folder, that of the sorted (part, SHA-256) list of its data files."""
    files = storage.listed(spark, str(path))
    if not files:
        raise FileNotFoundError(str(path))
    parts = sorted(tuple(r) for r in checksum_table(spark.read.format("binaryFile").load(files)).collect())
    if files == [storage.qualified(spark, str(path))]:
        return parts[0][1]
    return hashlib.sha256("".join(f"{name} {digest}\n" for name, digest in parts).encode()).hexdigest()


def beside(output: str | Path, ending: str) -> str:
    """A hidden address next to ``output``."""
    parent, slash, name = str(output).rstrip("/").rpartition("/")
    return f"{parent}{slash}.{name}.{ending}"


def staging(output: str | Path) -> str:
    return beside(output, "incomplete")


def refuse_existing(spark: SparkSession, output: str | Path) -> None:
    for path in (str(output), staging(output)):
        if storage.exists(spark, path):
            raise FileExistsError(f"{path} exists")


def write_table(df: DataFrame, output: str | Path, row_group_rows: int = 1024, single_file: bool = False, part_rows: int = 50_000) -> str:
    """Write the fixed schema as zstd Parquet to a staging folder, then rename; ``single_file`` makes ``output`` one file.

    An output or a staging folder that exists is an error; after a failure the
    staging folder stays, so that the next run stops at it. Parts hold at most
    ``part_rows`` rows, so each can be hashed by one task.
    """
    spark, stage = df.sparkSession, staging(output)
    refuse_existing(spark, output)
    typed = df.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])
    writer = (typed.coalesce(1) if single_file else typed).write.mode("errorifexists").option("compression", "zstd").option("parquet.block.row.count.limit", row_group_rows)
    (writer if single_file else writer.option("maxRecordsPerFile", part_rows)).parquet(stage)
    if single_file:
        [part] = storage.listed(spark, stage)
        storage.rename(spark, part, str(output))
        storage.delete(spark, stage)
    else:
        storage.rename(spark, stage, str(output))
    return str(output)


def manifest(spark: SparkSession, output: str | Path, sources: list[dict[str, Any]], parameters: dict[str, Any], tokenizer: str, revision: str) -> dict[str, Any]:
    """What was written, how, and whether every quota was reached. ``sources`` has quota, rows, target_tokens and rejected of each."""
    return {
        **parameters,
        "format_version": 2,
        "output": str(output),
        "output_sha256": checksum(spark, output),
        "columns": list(COLUMNS),
        "tokenizer": tokenizer,
        "tokenizer_revision": revision,
        "pretokenized": True,
        "assistant_only_loss": True,
        "preserve_thinking": True,
        "sources": sources,
        "total_rows": sum(s["rows"] for s in sources),
        "target_tokens": sum(s["target_tokens"] for s in sources),
        "requested_target_tokens": sum(s["quota"] for s in sources),
        "complete": all(s["target_tokens"] >= s["quota"] for s in sources),
    }


def fetch(url: str, root: Path, tries: int = 8) -> dict[str, Any]:
    """Download one file with retries and resume; it takes its name only when complete."""
    path = cached_path(url, root)
    if not path.is_file():
        part = path.with_name(path.name + ".partial")
        subprocess.run(["curl", "--fail", "--location", "--silent", "--show-error", "--retry", str(tries), "--continue-at", "-", "--output", str(part), url], check=True)
        os.replace(part, path)
    return {"url": url, "path": path.name, "size": path.stat().st_size}


def fill_cache(urls: Iterable[str], root: str | Path, workers: int = 4) -> dict[str, Any]:
    """Fetch all files and write ``manifest.json`` (complete, files)."""
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    with ThreadPoolExecutor(workers) as pool:
        files = list(pool.map(lambda u: fetch(u, root), urls))
    content = {"complete": True, "files": files}
    (root / "manifest.json").write_text(json.dumps(content, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return content


def wait_for(pid: int, every: float = 60.0) -> None:
    """Return when the process ``pid`` has ended."""
    while True:
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return
        except PermissionError:  # it runs, as another user
            pass
        time.sleep(every)


def prepare_command(output: str, **options: Any) -> list[str]:
    """The command line of a build, for launchers; an option that is None is left out."""
    words = [w for k, v in options.items() if v is not None for w in (f"--{k.replace('_', '-')}", str(v))]
    return [sys.executable, "-m", "tessera.cli", "prepare", "--output", output, *words]


def check_launch(cache_manifest: dict[str, Any] | None, mixture: dict[str, Any] | None, output: str | Path | None, min_tokens: int = 10_000_000) -> None:
    """The gates before training: a complete cache, a complete mixture of enough tokens, nothing overwritten."""
    if cache_manifest is not None and not (cache_manifest.get("complete") and cache_manifest.get("files")):
        raise Invalid("the cache is not complete")
    if mixture is not None and not (mixture.get("complete") and mixture.get("target_tokens", 0) >= min_tokens):
        raise Invalid("the mixture is not complete or too small")
    if output is not None and Path(output).exists():
        raise FileExistsError(f"{output} exists")


def may_delete_cache(path: str | Path, content: dict[str, Any], data_root: str | Path) -> bool:
    """Whether a cache folder may go: it is the one that the manifest used, and it lies strictly inside the data root."""
    path, root = Path(path).resolve(), Path(data_root).resolve()
    used = content.get("source_cache")
    return bool(used) and Path(used).resolve() == path and root in path.parents
