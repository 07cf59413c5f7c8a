"""Accepting rows: exact dedup against all accepted rows, and per-source token quotas.

The rule, row by row in order: a row that is already rejected keeps its reason
unless its fingerprint was accepted before (then it is a duplicate); a good row
whose fingerprint was accepted is a duplicate; else it is accepted, and the
source stops at the row that reaches its quota, which still counts. A repeat of
a rejected row repeats the rejection, and rows behind the quota row are neither
counted nor seen.

As a plan: within a source the accepted rows are first good occurrences whose
running sum of tokens *before* them is under the quota. The running sum is a
two-level prefix sum (per bucket of the order key, then inside each bucket), so
no task holds a whole source. Tables of few rows (bucket sums, quotas) are joined
without a hint: the engine broadcasts what it has measured to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1024


def bucketed(df: DataFrame, order: str = "pos", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``__b``, a bucket of the order key that keeps its order: a text's first three characters (a seeded shuffle's
    keys are even over them), for a number the place among ``buckets`` quantiles of the key (each within 1 in
    10 ``buckets``), so that uneven keys don't crowd one bucket.
    """
    kind = dict(df.dtypes)[order]
    if kind == "string":
        return df.withColumn("__b", F.substring(order, 1, 3))
    key = F.col(order) if not kind.startswith("struct") else F.col(order)[df.schema[order].dataType.names[0]]
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("c")).first()["c"]
    return df.withColumn("__b", place(sorted(set(cuts or [])), key, dict(df.select(key.alias("k")).dtypes)["k"]))


def place(cuts: list, key: Column, kind: str) -> Column:
    """How many of the sorted numbers ``cuts`` lie under ``key``, in two steps over about the root of their number each."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731 - folded to one constant
    block = F.size(F.filter(literal(cuts[::step]), lambda c: c < key)) - 1
    inside = F.size(F.filter(F.slice(literal(cuts), F.greatest(block, F.lit(0)) * step + 1, F.lit(step)), lambda c: c < key))
    return F.when(block < 0, 0).otherwise(block * step + inside)


def running_before(df: DataFrame, value: Column, order: str = "pos", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of lesser ``order``.

    Rows fall into buckets of the order key. Bucket sums are few rows (at most
    ``buckets`` or the number of three-character prefixes), their prefix sums are joined
    back, and each bucket runs its own window.
    """
    d = bucketed(df.withColumn("__v", value.cast("bigint")), order, buckets)
    totals = d.groupBy("__b").agg(F.sum("__v").alias("__t"))
    upto = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(upto, "__b")
    return d.withColumn("before", F.col("__base") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__b", "__v", "__base")


def spans(df: DataFrame, order: str = "pos", first: int = 20_000, grow: int = 4) -> tuple[DataFrame, list[tuple]]:
    """``df`` with ``__b``, and consecutive spans (lo, hi) of it: about ``first`` rows, then ``grow`` times as many each.

    A caller that works span by span can stop early without having seen the rest.
    """
    d = bucketed(df, order)
    counts = sorted((r["__b"], r["n"]) for r in d.groupBy("__b").agg(F.count("*").alias("n")).collect())
    out: list[tuple] = []
    held, goal, lo = 0, first, None
    for b, n in counts:
        lo = b if lo is None else lo
        held += n
        if held >= goal:
            out.append((lo, b))
            held, goal, lo = 0, goal * grow, None
    return d, out if lo is None else [*out, (lo, counts[-1][0])]


def running_before_native(df: DataFrame, value: Column, order: str = "pos") -> DataFrame:
    """The same by one window, for inputs known to be small."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value.cast("bigint")).over(w), F.lit(0)))


def decide(rows: DataFrame, accepted: DataFrame | None, quota: int | None, small: bool = False) -> DataFrame:
    """Rows (all columns of ``rows``, plus ``outcome``) that the source looks at: 'accepted', 'duplicate' or the rejection.

    ``rows`` has unique ``pos``, fingerprint, rejection, target_tokens; ``accepted``
    the fingerprints of earlier sources. Without a quota no running sum is taken.
    """
    seen = rows if accepted is None else rows.join(accepted.select("fingerprint", F.lit(True).alias("__seen")), "fingerprint", "left")
    known = F.lit(False) if accepted is None else F.coalesce(F.col("__seen"), F.lit(False))
    d = seen.withColumn("__known", known)
    good = F.col("rejection").isNull() & ~F.col("__known")
    first = d.where(good).groupBy("fingerprint").agg(F.min("pos").alias("__first"))
    d = d.join(first, "fingerprint", "left").withColumn("__take", good & F.coalesce(F.col("__first") == F.col("pos"), F.lit(False)))
    tokens = F.when(F.col("__take"), F.col("target_tokens")).otherwise(0)
    d = d if quota is None else running_before_native(d, tokens) if small else running_before(d, tokens)
    repeat = F.col("__known") | F.coalesce(F.col("__first") < F.col("pos"), F.lit(False))
    outcome = F.when(F.col("__take"), "accepted").when(repeat & F.col("fingerprint").isNotNull(), "duplicate").otherwise(F.col("rejection"))
    return (d if quota is None else d.where(F.col("before") < quota)).select(*rows.columns, outcome.alias("outcome"))


def source_order(names: list[str], seed: int) -> list[str]:
    """The order in which sources are taken."""
    out = list(names)
    Random(seed).shuffle(out)
    return out


def mix(sources: dict[str, DataFrame], quotas: dict[str, int], save: Callable[[DataFrame, str], DataFrame], seed: int | None = 42, small: bool = False) -> DataFrame:
    """Outcomes of all sources (with ``source``); ``save`` writes a table and rereads it, so no source replays another.

    Sources with quota 0 are skipped. Each later source meets the fingerprints that
    the earlier ones accepted.
    """
    names = [n for n in sources if quotas.get(n, 0) > 0]
    names = names if seed is None else source_order(names, seed)
    done: DataFrame | None = None
    for n in names:
        accepted = None if done is None else done.where("outcome = 'accepted'").select("fingerprint")
        out = save(decide(sources[n], accepted, quotas[n], small).withColumn("source", F.lit(n)), n)
        done = out if done is None else done.unionByName(out)
    if done is None:
        raise ValueError("every quota is 0")
    return done


def report(outcomes: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Per source: quota, rows, target_tokens, complete; sources without rows included."""
    spark = outcomes.sparkSession
    dim = spark.createDataFrame(sorted(quotas.items()), "source string, quota bigint")
    got = outcomes.where("outcome = 'accepted'").groupBy("source").agg(F.count("*").alias("rows"), F.sum("target_tokens").alias("target_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return dim.join(got, "source", "left").select("source", "quota", zero("rows"), zero("target_tokens"), (F.coalesce("target_tokens", F.lit(0)) >= F.col("quota")).alias("complete"))


def rejections(outcomes: DataFrame) -> DataFrame:
    """Per source and reason: the number of rows not accepted."""
    return outcomes.where("outcome <> 'accepted'").groupBy("source", F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))
