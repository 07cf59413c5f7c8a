"""Files by address, through Hadoop's file systems: whatever Spark reads and writes, on any cluster.

Only small files (manifests, state) go through the driver.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def located(spark: SparkSession, address: str) -> tuple[Any, Any]:
    """The file system and Hadoop path of an address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(address))
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.makeQualified(path)


def qualified(spark: SparkSession, address: str) -> str:
    return located(spark, address)[1].toString()


def exists(spark: SparkSession, address: str) -> bool:
    fs, path = located(spark, address)
    return fs.exists(path)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move ``source`` to ``target``, which must not exist."""
    fs, path = located(spark, source)
    to = located(spark, target)[1]
    if fs.exists(to):
        raise FileExistsError(f"{target} exists")
    if not fs.rename(path, to):
        raise OSError(f"{source} can't be moved to {target}")


def delete(spark: SparkSession, address: str) -> None:
    fs, path = located(spark, address)
    fs.delete(path, True)


def listed(spark: SparkSession, address: str) -> list[str]:
    """The data files under a folder at any depth, sorted; hidden and underscored ones are left out."""
    fs, root = located(spark, address)
    if not fs.exists(root):
        return []
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        path = files.next().getPath().toString()
        if not any(part.startswith(("_", ".")) for part in path.removeprefix(root.toString()).split("/")):
            found.append(path)
    return sorted(found)


def read_text(spark: SparkSession, address: str) -> str:
    fs, path = located(spark, address)
    if not fs.exists(path):
        raise FileNotFoundError(str(address))
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, address: str, text: str) -> None:
    """Write a small file, replacing one of that name."""
    fs, path = located(spark, address)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, address: str) -> Any:
    return json.loads(read_text(spark, address))


def write_json(spark: SparkSession, address: str, content: Any) -> None:
    write_text(spark, address, json.dumps(content, indent=2, sort_keys=True, allow_nan=False) + "\n")
