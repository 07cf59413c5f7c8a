"""Sources that are named by data set, configuration, split and revision, without addresses.

``snapshot_files`` finds them in a folder of snapshots, ``<root>/<dataset>/<revision>/...``,
on any file system (``TESSERA_HUB_ROOT``). ``stream`` reads them through the ``datasets``
package as a Spark data source with a partition for each shard.
"""

from __future__ import annotations

import importlib.util
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.protocol import Invalid
from tessera.sources import storage
from tessera.sources.catalogue import SourceSpec

ROOT_VARIABLE = "TESSERA_HUB_ROOT"


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower())


def snapshot_files(spark: SparkSession, spec: SourceSpec, root: str | None = None) -> list[str]:
    """The source's data files in the snapshot folder; none where no folder is named.

    Of the files of the revision, those whose path names the configuration stay, then
    those that name the split, where any do.
    """
    root = root or os.environ.get(ROOT_VARIABLE)
    if not root:
        return []
    top = f"{root.rstrip('/')}/{spec.dataset}/{spec.revision}"
    files = [f for f in storage.listed(spark, top) if f.endswith((".parquet", ".jsonl", ".json"))]
    base = storage.qualified(spark, top)
    for word in (spec.config, spec.split):
        named = [f for f in files if word and re.search(rf"(^|_){re.escape(plain(word))}(_|$)", plain(f.removeprefix(base)))]
        files = named or files
    if not files:
        raise FileNotFoundError(f"no snapshot of {spec.name} under {top}")
    return files


class HubShards(DataSourceReader):
    """Rows of a streamed data set as JSON text, a shard in each partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def data(self):
        from datasets import load_dataset

        o = self.options
        return load_dataset(o["dataset"], o.get("config") or None, split=o["split"], revision=o["revision"], streaming=True)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(max(1, getattr(self.data(), "n_shards", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        data = self.data()
        n = max(1, getattr(data, "n_shards", 1))
        for row in data.shard(num_shards=n, index=partition.value) if n > 1 else data:
            yield (json.dumps(row, ensure_ascii=False, default=str),)


class HubDataSource(DataSource):
    """``spark.read.format("tessera_hub")`` with the options dataset, config, split and revision."""

    @classmethod
    def name(cls) -> str:
        return "tessera_hub"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema) -> HubShards:
        return HubShards(dict(self.options))


def stream(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The source's rows as JSON lines (``raw``)."""
    if importlib.util.find_spec("datasets") is None:
        raise Invalid(f"{spec.name} has no direct files: set {ROOT_VARIABLE}, install the datasets package or pass a row provider")
    spark.dataSource.register(HubDataSource)
    reader = spark.read.format("tessera_hub").option("dataset", spec.dataset).option("split", spec.split).option("revision", spec.revision)
    return (reader.option("config", spec.config) if spec.config else reader).load()
