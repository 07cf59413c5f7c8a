"""Incremental corpus build: micro-batches with a compact state of earlier ones.

``foreachBatch`` joins each micro-batch with the accepted fingerprints and the
tokens so far, decides by the same plan as the batch build, and appends.

State after batch n is one small file, ``state/<n>.json``: tokens per source and the
list of fingerprint segments. A segment holds the accepted fingerprints of a run of
batches, spread by ``b``, the fingerprint's first two characters. Segments of equal
level are merged like the digits of a binary counter, so n batches have at most
log2(n) + 1 of them, and a batch reads only state n - 1: no outcome is read again and
no directory of all batches is listed. A batch that meets few values of ``b`` reads
only their folders (partition pruning by the join's own keys).

A micro-batch that is replayed after a failure starts from the same state file and
writes its own folders again, so its rows count once; state takes effect with its file,
which is written last. Segments that no state of the last two batches names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tessera.operators import mixture
from tessera.sources import storage

STATE = ST.StructType([ST.StructField("fingerprint", ST.StringType()), ST.StructField("source", ST.StringType()), ST.StructField("target_tokens", ST.LongType()), ST.StructField("outcome", ST.StringType()), ST.StructField("batch", ST.LongType())])
SEEN = "fingerprint string, b string"


def outcomes(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All outcomes written so far (those of batches under ``before``), for readers of the result."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*")
    listed = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    paths = sorted(s.getPath().toString() for s in listed or [])
    found = [p for p in paths if before is None or int(p.rsplit("=", 1)[1]) < before]
    return spark.read.schema(STATE).option("basePath", root).parquet(*found) if found else spark.createDataFrame([], STATE)


def state_file(root: str, number: int) -> str:
    return f"{root}/state/{number}.json"


def state(spark: SparkSession, root: str, number: int) -> dict:
    """The state after batch ``number``: tokens per source and segments [level, address]."""
    return storage.read_json(spark, state_file(root, number)) if number >= 0 else {"tokens": {}, "segments": []}


def seen(spark: SparkSession, segments: list) -> DataFrame | None:
    """Accepted fingerprints of the segments."""
    parts = [spark.read.schema(SEEN).parquet(path) for _, path in segments]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def write_seen(df: DataFrame, path: str) -> None:
    df.select("fingerprint", F.substring("fingerprint", 1, 2).alias("b")).repartition("b").write.mode("overwrite").partitionBy("b").parquet(path)


def merged(spark: SparkSession, root: str, number: int, segments: list) -> list:
    """Segments after those of equal level at the end are merged."""
    k = 0
    while len(segments) > 1 and segments[-1][0] == segments[-2][0]:
        (level, one), (_, two) = segments[-2:]
        path, k = f"{root}/seen/{number}-{k + 1}", k + 1
        write_seen(seen(spark, segments[-2:]), path)
        segments = [*segments[:-2], [level + 1, path]]
    return segments


def handler(root: str, quotas: dict[str, int], small: bool = False) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function. Rows need source, pos, fingerprint, rejection and target_tokens; sources without a quota are left out."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = state(spark, root, number - 1)
        tokens, before = dict(now["tokens"]), seen(spark, now["segments"])
        open_ = [s for s, quota in quotas.items() if tokens.get(s, 0) < quota]
        batch = batch.where(F.col("source").isin(open_)).persist()
        here = sorted(r["source"] for r in batch.select("source").distinct().collect())  # at most the quotas' names
        at, wrote = f"{root}/batch={number}", False
        for name in here:
            rows, accepted = batch.where(F.col("source") == name), None
            if before is not None:  # only the folders of the batch's own first characters are read
                keys = rows.select(F.substring("fingerprint", 1, 2).alias("b"), "fingerprint").distinct()
                accepted = before.join(keys, ["b", "fingerprint"], "left_semi").select("fingerprint")
            if wrote:  # what the batch's earlier sources accepted is read back, so no source replays another
                mine = spark.read.schema(STATE[:-1]).parquet(at).where("outcome = 'accepted'").select("fingerprint")
                accepted = mine if accepted is None else accepted.unionByName(mine)
            one = mixture.decide(rows, accepted, quotas[name] - tokens.get(name, 0), small)
            one.select("fingerprint", "source", F.col("target_tokens").cast("bigint"), "outcome").write.mode("append" if wrote else "overwrite").parquet(at)
            wrote = True
        batch.unpersist()
        segments = list(now["segments"])
        if wrote:
            new = spark.read.schema(STATE[:-1]).parquet(at).where("outcome = 'accepted'")
            for r in new.groupBy("source").agg(F.sum("target_tokens").alias("n")).collect():
                tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"]
            write_seen(new, f"{root}/seen/{number}-0")
            segments = merged(spark, root, number, [*segments, [0, f"{root}/seen/{number}-0"]])
        storage.write_json(spark, state_file(root, number), {"tokens": tokens, "segments": segments})
        tidy(spark, root, number, now, segments)

    return handle


def tidy(spark: SparkSession, root: str, number: int, before: dict, segments: list) -> None:
    """Delete segments and states that neither this batch nor a replay of it can need."""
    if number < 2:
        return
    older = state(spark, root, number - 2) if storage.exists(spark, state_file(root, number - 2)) else {"segments": []}
    needed = {path for _, path in [*before["segments"], *segments]}
    for _, path in older["segments"]:
        if path not in needed:
            storage.delete(spark, path)
    storage.delete(spark, state_file(root, number - 2))


def run(stream: DataFrame, root: str, checkpoint: str, quotas: dict[str, int]) -> None:
    """Work off everything that is there, then stop. The reader's ``maxFilesPerTrigger`` bounds a micro-batch."""
    query = stream.writeStream.foreachBatch(handler(root, quotas)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
