"""Mixing sources to target weights by Pareto order sampling.

``weights`` gives each source its share of the output's characters. A document
of source s with size x and utility m = 1000 x / (x + 500) (longer texts are
preferred, with diminishing return) has expected copies
``e = T_s m / sum(m x)``, where T_s is the target number of characters of s, so
that the expected characters of s are exactly T_s. ``floor(e)`` copies are
certain. The remainder p = e - floor(e) is sampled: documents of s are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with u a hash of the doc_id, and the
``round(sum p)`` least ranked get one copy more (Rosen's Pareto sampling: fixed
size, inclusion close to p).

Selecting the n least of a source does not sort it: odds fall into ``2 * BINS + 1``
logarithmic bins, counts per bin locate the bin in which the n-th lies, that bin falls
into ``FINE`` equal parts, whose counts locate the part, and only that part is ranked.
A bin near the median holds some 4 % of a source and a part of it 1 row in 100 000, so
a hot source spreads over all tasks.

What is joined to the documents is one row for each source. It is broadcast where the
sources are counted and no more than ``FEW`` (some 10 MB); beyond, the join is left to
the engine, which splits hot sources.

All sums are of integers (p in units of 2**-40), so the result does not depend on
the order of addition. Defined results: null and empty texts and null sources get
no copy; a source that ``WEIGHTS`` doesn't name has weight ``OTHERS``, but where the
caller gives weights, a source without one gets no copy; a row with null doc_id gets none; rows
repeated with the same doc_id are copies of one document (the draw is shared).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import Scratch

SCALE, BINS, FINE, FEW, SEED = 1 << 40, 64, 4096, 100_000, "mix-1"


#: Production weights: the hot source is held to a twentieth, two curated ones are raised.
WEIGHTS = {"src0": 1, **{f"src{i}": 1 for i in range(3, 20)}, "src1": 3, "src2": 2}
#: Weight of each source that WEIGHTS doesn't name.
OTHERS = 1
#: Characters of the output for each character of the input.
RATE = 0.5


def draw(doc_id: Column) -> Column:
    """A uniform number in (0, 1) with 48 bits, from md5, which other engines have too."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.lit(":"), doc_id.cast("string"))), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def small(df: DataFrame) -> DataFrame:
    """A table of one row for each source, broadcast where it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def allocate(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, source, n_chars, certain, p_units, odds) of the documents that can be drawn, from the shared folder."""
    others, weights = (OTHERS, WEIGHTS) if weights is None else (0, weights)
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    named = spark.createDataFrame(sorted((s, float(w)) for s, w in weights.items() if w > 0), "source string, weight double")
    x = F.length("text").cast("bigint")
    rows = docs.where("doc_id is not null and source is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", x.alias("n_chars")).distinct()
    if not others:
        rows = rows.join(named.select("source"), "source", "left_semi")
    rows = scratch.write(rows, "rows").withColumn("m", F.expr("1000 * n_chars div (n_chars + 500) + 1"))
    totals = rows.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.sum(F.col("m") * F.col("n_chars")).alias("mx"))
    totals = scratch.write(totals.join(named, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(float(others)))), "totals")
    every = totals.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    targets = totals.crossJoin(F.broadcast(every)).select("source", (F.lit(float(rate)) * F.col("all_chars") * F.col("weight") / F.col("all_weight")).alias("target"), "mx")
    e = F.col("target") * F.col("m") / F.col("mx")
    p = F.floor((F.col("e") - F.floor("e")) * F.lit(float(SCALE))).cast("bigint")
    u, q = draw(F.col("doc_id")), F.col("p_units") / F.lit(float(SCALE))
    odds = (F.col("u") / (1 - F.col("u"))) / (q / (1 - q))
    rows = rows.join(small(targets), "source").withColumn("e", e).withColumn("certain", F.floor("e").cast("bigint")).withColumn("p_units", p).withColumn("u", u)
    return scratch.write(rows.select("doc_id", "source", "n_chars", "certain", "p_units", F.when(F.col("p_units") > 0, odds).alias("odds")), "odds")


def cut_of(counts: DataFrame, need: Column, order: str) -> DataFrame:
    """(source, cut, left): the ``order`` value at which the source's running sum of ``n`` reaches its need, and how many of its rows are needed."""
    by = Window.partitionBy("source")
    upto = F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("need", need).withColumn("before", upto - F.col("n"))
    return c.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n"))).select("source", F.col(order).alias("cut"), (F.col("need") - F.col("before")).alias("left"))


def sample(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, source, n_chars, copies) of the drawn documents."""
    # bins are monotone in the odds: quarters of powers of two, cut off at both ends; so are the parts of a bin
    quarter = F.log2("odds") * 4
    rows = allocate(docs, weights, rate).withColumn("slot", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(quarter))).cast("int"))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor((quarter - F.col("slot")) * FINE))).cast("int"))
    counts = rows.groupBy("source", "slot").agg(F.count("odds").alias("n"), F.sum("p_units").alias("units"))
    need = F.floor((F.sum("units").over(Window.partitionBy("source")) + F.lit(SCALE // 2)) / F.lit(float(SCALE))).cast("bigint")
    slots = small(cut_of(counts.where("slot is not null"), need, "slot").withColumnsRenamed({"cut": "cut_slot", "left": "left_slot"}))
    rows = rows.join(slots, "source", "left")
    edge = rows.where("slot = cut_slot")
    parts = small(cut_of(edge.groupBy("source", "part").agg(F.count("*").alias("n"), F.first("left_slot").alias("goal")), F.col("goal"), "part").withColumnsRenamed({"cut": "cut_part", "left": "left_part"}))
    here = (F.col("slot") == F.col("cut_slot")) & (F.col("part") == F.col("cut_part"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("odds", "doc_id"))
    ranked = edge.join(parts, "source").where("part = cut_part").withColumn("won", (nth <= F.col("left_part")).cast("int"))
    sure = (F.col("slot") < F.col("cut_slot")) | ((F.col("slot") == F.col("cut_slot")) & (F.col("part") < F.col("cut_part")))
    rest = rows.join(parts, "source", "left").where(~F.coalesce(here, F.lit(False))).withColumn("won", F.coalesce(sure, F.lit(False)).cast("int"))
    cols = ["doc_id", "source", "n_chars", (F.col("certain") + F.col("won")).cast("bigint").alias("copies")]
    return rest.select(*cols).unionByName(ranked.select(*cols)).where("copies > 0")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE) -> DataFrame:
    """``docs`` with every row repeated as often as it was drawn; columns unchanged."""
    drawn = sample(docs, weights, rate)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = (F.col("row.doc_id") == drawn["doc_id"]) & (F.col("row.source") == drawn["source"]) & (F.length("row.text") == drawn["n_chars"])
    copies = rows.join(drawn, on).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle(weights: dict[str, float] | None = None, rate: float = RATE) -> str:
    """The same rows as ``sample``, by one ranking per source."""
    values = ", ".join(f"('{s}', {float(w)!r}::double)" for s, w in sorted((WEIGHTS if weights is None else weights).items()) if w > 0)
    return f"""
with w(source, weight) as (values {values}),
d as (select distinct doc_id, source, length(text) as n_chars from documents where doc_id is not null and source is not null and text <> '' and source in (select source from w)),
m as (select *, 1000 * n_chars // (n_chars + 500) + 1 as m from d),
t as (select source, sum(n_chars)::bigint as chars, sum(m * n_chars)::bigint as mx from m group by source),
a as (select sum(chars)::bigint as all_chars, sum(weight) as all_weight from t join w using (source)),
g as (select source, {float(rate)!r}::double * all_chars * weight / all_weight as target, mx from t join w using (source), a),
e as (select m.*, target * m / mx as e, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::ubigint::double + 0.5) / {float(1 << 48)!r}::double as u from m join g using (source)),
p as (select *, floor(e)::bigint as certain, floor((e - floor(e)) * {float(SCALE)!r}::double)::bigint as p_units from e),
o as (select *, case when p_units > 0 then (u / (1 - u)) / ((p_units / {float(SCALE)!r}::double) / (1 - p_units / {float(SCALE)!r}::double)) end as odds from p),
r as (select *, case when odds is not null then row_number() over (partition by source, odds is null order by odds, doc_id) end as rn,
      floor((sum(p_units) over (partition by source) + {SCALE // 2}) / {float(SCALE)!r}::double)::bigint as n from o)
select doc_id, source, n_chars, (certain + case when rn <= n then 1 else 0 end)::bigint as copies from r where certain + case when rn <= n then 1 else 0 end > 0"""
