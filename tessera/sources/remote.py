"""Copies of web files in the shared folder, fetched by the executors."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

CHUNK, TRIES, WAIT = 8 << 20, 8, 1.0


def file_system(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of an address such as file:/x, file:///x or hdfs://host/x."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return pafs.FileSystem.from_uri(address)


def stream(url: str, out, tries: int = TRIES, wait: float = WAIT) -> int:
    """Write the file at ``url`` to ``out``; a broken connection goes on where it broke off. Returns the size."""
    done = 0
    for n in range(tries):
        request = urllib.request.Request(url, headers={"Range": f"bytes={done}-"} if done else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as reply:
                if done and reply.status != 206:  # the server sends it from the start
                    reply.read(done)
                size = reply.headers.get("Content-Length")
                goal = None if size is None else int(size) + (done if reply.status == 206 else 0)
                while chunk := reply.read(CHUNK):
                    out.write(chunk)
                    done += len(chunk)
                if goal is None or done >= goal:
                    return done
        except urllib.error.HTTPError as bad:
            if bad.code < 500 or n + 1 == tries:
                raise
        except OSError:
            if n + 1 == tries:
                raise
        time.sleep(wait * 2**n)
    raise OSError(f"{url} broke off {tries} times")


def copy_all(spark: SparkSession, urls: list[str], root: str) -> list[str]:
    """Addresses of copies under ``root``, one task for each file; a copy that is there is kept, and takes its name only when whole."""
    names = {u: hashlib.sha256(u.encode()).hexdigest() + Path(urlsplit(u).path).suffix for u in urls}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                fs, path = file_system(f"{root}/{names[url]}")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    part = f"{path}.{TaskContext.get().taskAttemptId()}.partial"
                    with fs.open_output_stream(part) as out:
                        stream(url, out)
                    fs.move(part, path)
                yield pa.RecordBatch.from_pydict({"url": [url]})

    rows: DataFrame = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    rows.mapInArrow(run, "url string").count()
    return [f"{root}/{names[u]}" for u in urls]
