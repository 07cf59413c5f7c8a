"""Exact substring dedup on lines and their sentences: each repeated unit stays once, at its earliest ranked place.

Units are the lines of a text (split at ``\\n``) and, of a line with several
sentences, each sentence (a run of characters up to and with its ``.``, ``!`` or
``?``), so that a passage pasted into a longer line is found, too. A unit is
normalised (lower case, runs of white space as one space, ends trimmed) and
hashed; digests are grouped over the whole corpus, the occurrence of least
(doc_id, unit number, part number) stays and the others are removed. Part 0 is
the whole line; a line that goes takes its sentences with it, which are not
listed again. Offsets are code points of the original text.

Only units of ``MIN_WORDS`` words or more take part: shorter ones ("Yes.") are
said anew rather than copied. The grouping aggregates a minimum per digest,
which combines on the map side, so a line repeated a million times sends one row
per task; occurrences then join that minimum.

Defined results: null and empty texts have no units; a null doc_id takes part in
nothing; an occurrence is (doc_id, unit number, part number, digest), so a row
repeated with one doc_id adds no occurrence.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import textkit as tk

MIN_WORDS = 8
SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
UNITS = "doc_id bigint, unit_no int, part_no int, start bigint, end bigint, digest binary"


def one_each(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as bigint) doc_id", "text")


def units_of(text: str, min_words: int):
    """(unit_no, part_no, start, end, normalised words) of a text's units."""
    at = 0
    for no, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if len(words) >= min_words:
            yield no, 0, at, at + len(line), " ".join(words)
            parts = [(m.start(), m.end(), m[0].lower().split()) for m in SENTENCE.finditer(line)]
            if sum(map(bool, (w for _, _, w in parts))) > 1:
                for k, (a, b, words) in enumerate(parts, 1):
                    if len(words) >= min_words:
                        yield no, k, at + a, at + b, " ".join(words)
        at += len(line) + 1


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit of every document: doc_id, unit_no, part_no, start, end, digest."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc, *where, xxhash.xxh3_128_digest(norm)) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for *where, norm in units_of(text or "", min_words)]
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "unit_no", "part_no", "start", "end", "digest"])

    return one_each(docs).mapInArrow(tk.over_slices(make, "text"), UNITS)


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit to remove: doc_id, unit_no, part_no, start, end, and where the kept copy stands (kept_doc_id, kept_unit_no, kept_part_no, kept_start)."""
    found = units(docs, min_words)
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "unit_no", "part_no", "start")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, "digest").where("doc_id <> kept.doc_id or unit_no <> kept.unit_no or part_no <> kept.part_no")
    gone = gone.selectExpr("doc_id", "unit_no", "part_no", "start", "end", "kept.doc_id kept_doc_id", "kept.unit_no kept_unit_no", "kept.part_no kept_part_no", "kept.start kept_start")
    whole = F.min("part_no").over(Window.partitionBy("doc_id", "unit_no"))
    return gone.withColumn("least", whole).where("part_no = 0 or least > 0").drop("least").distinct()


def rewrite(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut from ``text`` (a line with its line break) and ``removed``, the cut spans of the original."""
    found = removals(docs, min_words).withColumnRenamed("doc_id", "__id")
    cut = found.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kept_doc_id", (F.col("part_no") == 0).alias("whole")))).alias("__cut"))
    size = F.length("text")
    # a line goes with the break after it; the last one with the break before what is left
    after = lambda s: s["end"] + F.when(s["whole"], 1).otherwise(0)
    piece = lambda a, b: F.substr("text", a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"), after(s).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    left = F.aggregate("__cut", start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], size)))
    last = F.exists("__cut", lambda s: s["whole"] & (s["end"] == size))
    text = F.when(F.col("__cut").isNull(), F.col("text")).when(last, F.regexp_replace(left, r"\n\z", "")).otherwise(left)
    spans = F.transform("__cut", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kept_doc_id"].alias("kept_doc_id")))
    rows = docs.drop("removed", "__id", "__cut").join(cut, F.col("doc_id") == F.col("__id"), "left")
    return rows.withColumns({"text": text, "removed": spans}).drop("__id", "__cut")


ORACLE = f"""
with d as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
s as (select doc_id, string_split(text, chr(10)) as l from d),
u as (select doc_id, generate_subscripts(l, 1) - 1 as unit_no, unnest(l) as line from s),
o as (select *, sum(length(line) + 1) over (partition by doc_id order by unit_no) - length(line) - 1 as start from u),
p as (select doc_id, unit_no, start, regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+') as ps from o),
q as (select doc_id, unit_no, generate_subscripts(ps, 1) as part_no, start as base, unnest(ps) as line from p),
c as (select *, base + sum(length(line)) over (partition by doc_id, unit_no order by part_no) - length(line) as start, count(case when trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' then 1 end) over (partition by doc_id, unit_no) as several from q),
a as (select doc_id, unit_no, 0 as part_no, start, line from o union all select doc_id, unit_no, part_no, start, line from c where several > 1),
n as (select *, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as norm from a),
k as (select * from n where len(string_split(norm, ' ')) >= {MIN_WORDS}),
r as (select *, row_number() over w as rn, first_value(doc_id) over w as kept_doc_id, first_value(unit_no) over w as kept_unit_no, first_value(part_no) over w as kept_part_no, first_value(start) over w as kept_start
      from k window w as (partition by norm order by doc_id, unit_no, part_no)),
g as (select *, min(part_no) over (partition by doc_id, unit_no) as least from r where rn > 1)
select doc_id, cast(unit_no as integer) as unit_no, cast(part_no as integer) as part_no, cast(start as bigint) as start, cast(start + length(line) as bigint) as "end", kept_doc_id, cast(kept_unit_no as integer) as kept_unit_no, cast(kept_part_no as integer) as kept_part_no, cast(kept_start as bigint) as kept_start
from g where part_no = 0 or least > 0"""
