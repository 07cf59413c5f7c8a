"""The registered queries of the conversation engine and their SQL.

Every query runs over its whole tables. The test tables hold no tool calls,
generations or scores, so the queries that need them build them from the columns
at hand, in both languages alike. ``tool_queries`` and ``build_queries`` hold more of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import adapters, mixture, precompiled
from tessera.operators.compile import byte_compiled, compile_rows, token_counts
from tessera.operators.tokenizers import ByteTokenizer
from tessera.plans import render
from tessera.protocol import MODEL_ROLE
from tessera.sources import readers
from tessera.sources.scratch import folder, saver
from tessera.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.scan(spark, [f"{sf_dir}/{name}.parquet"])


# --- conversations: render, count, compile ------------------------------------

MARKER = "case role when 'assistant' then '<|out|>' when 'system' then '<|sys|>' when 'developer' then '<|dev|>' when 'user' then '<|usr|>' else '<|obs|>' end"
TURNS = f"""
t as (select conv_id, turn, role, coalesce(text, '') as text, role = 'assistant' as model, {MARKER} as marker,
  lag(role = 'assistant') over w as before, lead(turn) over w is null as is_last from conversations window w as (partition by conv_id order by turn)),
p as (select *, coalesce(before <> model, false) as flips, not (model and trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') as said from t)"""
PIECES = """
f as (select conv_id, turn, 0 as part, s.structural, s.value, before as target, s.n from p, (values (true, '<|eot|>', 0), (false, chr(10), 1)) s(structural, value, n) where flips
  union all select conv_id, turn, 1, s.structural, case s.n when 0 then marker when 2 then text else chr(10) end, model, s.n from p, (values (true, 0), (false, 1), (false, 2), (false, 3)) s(structural, n) where said
  union all select conv_id, turn, 2, s.structural, s.value, model, s.n from p, (values (true, '<|eot|>', 0), (false, chr(10), 1)) s(structural, value, n) where is_last),
g as (select conv_id, row_number() over (partition by conv_id order by turn, part, n) - 1 as frag_no, structural, value, target from f)"""
TEXT = "case when flips then '<|eot|>' || chr(10) else '' end || case when said then marker || chr(10) || text || chr(10) else '' end || case when is_last then '<|eot|>' || chr(10) else '' end"


@query(f"with {TURNS} select conv_id, string_agg({TEXT}, '' order by turn) || '<eos>' as rendered from p group by conv_id")
def conversation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return c.select("conv_id", F.concat(render.text_of(F.col("parts")), F.lit("<eos>")).alias("rendered"))


COUNTS = f"""with {TURNS}, {PIECES}, s as (select conv_id, target, case when structural then 1 else octet_length(encode(value)) end as n from g),
e as (select conv_id, bool_or(is_last and model) as ends from p group by conv_id)
select conv_id, cast(sum(n) + 1 as bigint) as n_tokens, cast(sum(case when target then n else 0 end) + max(ends::int) as bigint) as n_targets from s join e using (conv_id) group by conv_id"""


@query(COUNTS)
def conversation_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"with {TURNS}, {PIECES} select conv_id, cast(frag_no as integer) as frag_no, structural, value, target from g")
def fragments_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return c.select("conv_id", F.posexplode("parts").alias("frag_no", "p")).select("conv_id", "frag_no", "p.structural", "p.value", "p.target")


@query(f"with {TURNS}, {PIECES} select value, count(*) as uses, cast(octet_length(encode(value)) as integer) as n_tokens from g where not structural group by value")
def plaintext_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.turn_fragments(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    p = c.select(F.explode("parts").alias("p")).where("not p.structural")
    return p.groupBy("p.value").agg(F.count("*").alias("uses")).select("value", "uses", F.octet_length("value").alias("n_tokens"))


BYTES = f"""with {TURNS}, {PIECES},
h as (select conv_id, frag_no, structural, value, target, hex(encode(value)) as x from g),
b as (select conv_id, frag_no, 0 as k, case value {' '.join(f"when '{m}' then {i}" for m, i in ByteTokenizer.ids.items())} end as id, target from h where structural
  union all select conv_id, frag_no, k, cast('0x' || substr(x, 2 * k + 1, 2) as integer) + 11, target from (select *, unnest(range(length(x) // 2)) as k from h where not structural)
  union all select conv_id, 1000000000, 0, 0, bool_or(is_last and model) from p group by conv_id),
i as (select conv_id, cast(row_number() over (partition by conv_id order by frag_no, k) - 1 as integer) as pos, cast(id as integer) as id, cast(case when target then id else -100 end as integer) as label from b)"""


@query(BYTES + " select * from i")
def byte_ids_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = byte_compiled(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return c.select("conv_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "x")).select("conv_id", "pos", F.col("x.input_ids").alias("id"), F.col("x.labels").alias("label"))


@query(BYTES + " select conv_id, count(*) as n, cast(sum(id) as bigint) as label_sum, cast(sum((pos + 1) * id) as bigint) as weighted from i group by conv_id")
def full_loss_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = byte_compiled(table(spark, sf_dir, "conversations"), "conv_id", "turn", full_loss=True)
    x = c.select("conv_id", F.posexplode("labels").alias("pos", "id"))
    return x.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("id").alias("label_sum"), F.sum((F.col("pos") + 1) * F.col("id")).cast("bigint").alias("weighted"))


@query(BYTES + ", s as (select conv_id, count(*) as n_tokens, count(*) filter (label <> -100) as target_tokens, cast(sum((pos + 1) * id) as bigint) as weighted from i group by conv_id) select * from s")
def compiled_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general route: message JSON through the Arrow compiler."""
    m = message_json(table(spark, sf_dir, "conversations"))
    c = compile_rows(m.withColumn("tools_json", F.lit("[]")), ByteTokenizer(), max_length=None)
    return weighted_ids(c)


def weighted_ids(c: DataFrame) -> DataFrame:
    """Counts of compiled conversations, with a sum that weighs each id by its place."""
    weighted = F.aggregate(F.transform("input_ids", lambda x, i: (i + 1) * x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return c.select("conv_id", F.size("input_ids").cast("bigint").alias("n_tokens"), "target_tokens", weighted.alias("weighted"))


HISTORY = "h as (select conv_id, max(turn) filter (role <> 'assistant') as upto from conversations group by conv_id having upto is not null)"


@query(f"with {HISTORY}, {TURNS.replace('from conversations window', 'from conversations join h using (conv_id) where turn <= upto window')} select conv_id, string_agg({TEXT}, '' order by turn) as prompt from p group by conv_id")
def generation_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt up to the last runtime turn, open for the model."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    history = t.withColumn("upto", F.max(F.when(F.col("role") != MODEL_ROLE, F.col("turn"))).over(w)).where("turn <= upto").drop("upto")
    return render.conversations(history, "conv_id", "turn").select("conv_id", render.text_of(F.col("parts")).alias("prompt"))


ALIASED = "case role when 'user' then case turn % 3 when 0 then 'Human' when 1 then 'prompter' else 'USER' end when 'assistant' then case turn % 3 when 0 then 'gpt' when 1 then 'Bot' else 'assistant' end else upper(role) end"


@query("select role, count(*) as n from conversations group by role")
def role_alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles disguised by aliases and cases, and named again."""
    t = table(spark, sf_dir, "conversations").select(F.expr(ALIASED).alias("raw"))
    return t.select(T.role_name(F.col("raw")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def message_json(turns: DataFrame) -> DataFrame:
    """conv_id and its canonical messages."""
    one = F.concat(F.lit('{"content":'), T.quote(F.coalesce("text", F.lit(""))), F.lit(',"role":'), T.quote(F.col("role")), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x["m"]), ",")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("messages_json"))


CANONICAL = """with m as (select conv_id, '[' || string_agg('{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(role) || '}', ',' order by turn) || ']' as messages_json from conversations group by conv_id)"""


@query(CANONICAL + """ select conv_id, messages_json, sha256('{"messages":' || messages_json || ',"tools":[]}') as fingerprint from m""")
def canonical_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_json(table(spark, sf_dir, "conversations")).withColumn("fingerprint", T.fingerprint(F.col("messages_json"), F.lit("[]")))


# --- documents: dedup, quotas, shuffles ----------------------------------------


@query("select sha256(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's rule without a quota: the first of each content is accepted, the others are its copies."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("fingerprint"), F.lit(None).cast("string").alias("rejection"), F.lit(1).alias("target_tokens"))
    done = mixture.decide(d, None, None)
    return done.groupBy("fingerprint").agg(F.min(F.when(F.col("outcome") == "accepted", F.col("pos"))).alias("doc_id"), F.count("*").alias("copies"))


#: Sources of the mixture over documents (by language), in order, with their quotas in bytes.
QUOTAS = {"de": 200_000, "en": 600_000, "es": 10**12, "fr": 150_000}
REASON = "case when octet_length({b}) > 8000 then 'too_long' when text not like '% %' then 'no_target' end"


BASE = f"select doc_id as pos, lang as source, sha256(text) as fingerprint, octet_length(encode(text)) as target_tokens, {REASON.format(b='encode(text)')} as rejection from documents"


def mixture_sql(base: str = BASE, quotas: dict[str, int] = QUOTAS, more: str = "") -> str:
    """CTEs up to ``o``, the outcomes of ``base`` (pos, source, fingerprint, target_tokens, rejection and the columns ``more``), sources in the quotas' order."""
    parts = [f"d as ({base})", "a as (select '' as fingerprint where false)"]
    before = "a"
    for s, quota in quotas.items():
        parts.append(f"k_{s} as (select *, fingerprint in (select fingerprint from {before}) as known from d where source = '{s}')")
        parts.append(f"f_{s} as (select *, min(case when rejection is null and not known then pos end) over (partition by fingerprint) as first from k_{s})")
        parts.append(f"r_{s} as (select *, rejection is null and not known and first = pos as take from f_{s})")
        parts.append(f"b_{s} as (select *, coalesce(sum(case when take then target_tokens else 0 end) over (order by pos rows between unbounded preceding and 1 preceding), 0) as before from r_{s})")
        parts.append(f"o_{s} as (select source, pos, fingerprint, target_tokens{more}, case when take then 'accepted' when known or coalesce(first < pos, false) then 'duplicate' else rejection end as outcome from b_{s} where before < {quota})")
        parts.append(f"a_{s} as (select fingerprint from {before} union all select fingerprint from o_{s} where outcome = 'accepted')")
        before = f"a_{s}"
    return "with " + ",\n".join(parts) + ", o as (" + " union all ".join(f"select * from o_{s}" for s in quotas) + ")"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang", F.sha2("text", 256).alias("fingerprint"), F.octet_length("text").cast("bigint").alias("target_tokens"), F.expr(REASON.format(b="text")).alias("rejection"))
    return mixture.mix({s: d.where(F.col("lang") == s).drop("lang") for s in QUOTAS}, QUOTAS, saver(spark, "mixture"), seed=None)


@query(mixture_sql() + " select source, pos, fingerprint, cast(target_tokens as bigint) as target_tokens, outcome from o")
def quota_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("source", "pos", "fingerprint", "target_tokens", "outcome")


@query(mixture_sql() + " select source, outcome as reason, count(*) as n from o where outcome <> 'accepted' group by all")
def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.rejections(outcomes(spark, sf_dir))


@query(mixture_sql() + f""", q(source, quota) as (values {', '.join(f"('{s}', {n}::bigint)" for s, n in QUOTAS.items())}), g as (select source, count(*) as n, sum(target_tokens)::bigint as tokens from o where outcome = 'accepted' group by source)
select source, quota, coalesce(n, 0) as rows, coalesce(tokens, 0) as target_tokens, coalesce(tokens, 0) >= quota as complete from q left join g using (source)""")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(outcomes(spark, sf_dir), QUOTAS)


@query(mixture_sql() + " select source, fingerprint, cast(target_tokens as bigint) as target_tokens from o where outcome = 'accepted'")
def streaming_dedup_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture by Structured Streaming: a file stream worked off in micro-batches."""
    path, name = f"{sf_dir}/documents.parquet", "documents.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", name).parquet(sf_dir)
    rows = stream.select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("fingerprint"), F.octet_length("text").cast("bigint").alias("target_tokens"), F.expr(REASON.format(b="text")).alias("rejection"))
    root = f"{folder(spark)}/stream-{os.urandom(8).hex()}"
    ingest.run(rows, f"{root}/outcomes", f"{root}/checkpoint", QUOTAS)
    done = ingest.outcomes(spark, f"{root}/outcomes")
    return done.where("outcome = 'accepted'").select("source", "fingerprint", "target_tokens")


@query("select doc_id, row_number() over (partition by source order by doc_id) as turn, source from documents")
def shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return readers.interleaved(d, "source", "doc_id").select("doc_id", F.col("turn").cast("bigint").alias("turn"), "source")


@query("select doc_id, md5('42:' || doc_id) as pos from documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42)


# --- adapters -------------------------------------------------------------------

STRIP = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
ASKED, SAID = "split_part(text, chr(10), 1)", "substr(text, length(split_part(text, chr(10), 1)) + 2)"
PAIR = """'[{"content":' || to_json(a) || ',"role":"user"},{"content":' || to_json(b) || ',"role":"assistant"}]'"""


@query(f"""with s as (select doc_id, {STRIP.format(x=ASKED)} as a, {STRIP.format(x=SAID)} as b from documents),
m as (select doc_id, case when a <> '' and b <> '' then {PAIR} end as messages_json from s)
select doc_id, case when messages_json is null then 'invalid' end as rejection, messages_json, sha256('{{"messages":' || messages_json || ',"tools":[]}}') as fingerprint from m""")
def single_turn_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line as the prompt, the rest as the answer."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "split_part(text, char(10), 1) as inputs", "substr(text, length(split_part(text, char(10), 1)) + 2) as targets")
    return adapters.native_pair(d, ("doc_id",)).select("doc_id", "rejection", "messages_json", "fingerprint")


@query(f"""with s as (select d.doc_id, case when quality is null then null else cast(quality * 0.95 as double) end as score, {STRIP.format(x=ASKED)} as a, {STRIP.format(x=SAID)} as b from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id))
select doc_id, case when score >= 0.8 and a <> '' and b <> '' then null else 'invalid' end as rejection, case when score >= 0.8 and a <> '' and b <> '' then {PAIR} end as messages_json from s""")
def score_filter_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr("doc_id", "quality * double(0.95) as average_test_score", "split_part(text, char(10), 1) as input", "substr(text, length(split_part(text, char(10), 1)) + 2) as output")
    return adapters.native_scored(d, ("doc_id",)).select("doc_id", "rejection", "messages_json")


@query(f"""with s as (select doc_id, case when doc_id % 2 = 0 then {STRIP.format(x=SAID)} else {STRIP.format(x=ASKED)} end as g from documents where doc_id % 5 <> 4)
select doc_id, case when g <> '' then g end as chosen from s union all select doc_id, null from documents where doc_id % 5 = 4""")
def first_correct_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tries per document: a wrong one, one that is right for even ids, one that is right; none is complete where doc_id % 5 = 4."""
    d = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "array(text, substr(text, length(split_part(text, char(10), 1)) + 2), split_part(text, char(10), 1)) as generations",
        "if(doc_id % 5 = 4, array(true), if(doc_id % 2 = 0, array(true, true), array(true, false, true))) as is_reasoning_complete",
        "array(false, doc_id % 2 = 0) as correctness_math_verify",
        "array(false, false, true) as correctness_llama",
    )
    return d.select("doc_id", adapters.first_correct().alias("chosen"))


@query(f"select doc_id, case when doc_id % 3 = 0 then {STRIP.format(x='text')} else {STRIP.format(x=ASKED)} end as reasoning, case when doc_id % 3 = 0 then null else regexp_replace({SAID}, '^\\s+', '') end as answer from documents")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, text, concat('<think>\n', split_part(text, char(10), 1), '</think>\n', substr(text, length(split_part(text, char(10), 1)) + 2))) as t")
    thought, said = T.think_split(F.col("t"))
    return d.select("doc_id", T.strip(thought).alias("reasoning"), said.alias("answer"))


# --- tools ----------------------------------------------------------------------

ARGS = """'{"k":' || regexp_extract(props, '-?[0-9]+') || '}'"""


@query(f"""select event_id, case when user_id % 7 = 0 then 'invalid' end as rejection, case when user_id % 7 <> 0 then
'[{{"content":"go","role":"user"}},{{"content":null,"role":"assistant","tool_calls":[{{"function":{{"arguments":' || {ARGS} || ',"name":"' || event_type || '"}},"id":"call_1_0","type":"function"}}]}}]' end as messages_json from events""")
def tool_call_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose arguments are JSON text; one user in seven sends text that isn't."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id", "props").withColumn("quoted", F.expr("if(user_id % 7 = 0, 'oops', props)"))
    m = F.concat(F.lit('[{"role":"human","content":"go"},{"from":"gpt","content":null,"tool_calls":[{"name":"'), "event_type", F.lit('","arguments":'), T.quote(F.col("quoted")), F.lit("}]}]"))
    return adapters.adapt(e.select("event_id", m.alias("messages")), "nemotron", ("event_id",)).select("event_id", "rejection", "messages_json")


# --- compiled rows ----------------------------------------------------------------


@query(COUNTS.replace("select conv_id, cast(sum(n) + 1", ", c as (select conv_id, cast(sum(n) + 1", 1) + ") select conv_id, case when conv_id % 11 = 1 then 'label' when conv_id % 11 = 2 then 'id_range' when conv_id % 11 = 3 then 'length' when conv_id % 11 = 4 or n_targets = 0 then 'no_target' end as fault from c")
def precompiled_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled conversations, four in eleven of them spoilt in one way each."""
    c = byte_compiled(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    kind = F.col("conv_id") % 11
    labels = F.when(kind == 1, F.transform("labels", lambda x: F.lit(1000000))).when(kind == 3, F.slice("labels", 1, F.size("labels") - 1)).when(kind == 4, F.transform("labels", lambda x: F.lit(-100))).otherwise(F.col("labels"))
    ids = F.when(kind == 2, F.transform("input_ids", lambda x: x + 100000)).otherwise(F.col("input_ids"))
    d = c.select("conv_id", ids.alias("input_ids"), labels.alias("labels"))
    return precompiled.validate(d, ByteTokenizer.size, 10**9, strict=False).select("conv_id", "fault")


from tessera import build_queries, tool_queries  # noqa: E402, F401 - they register more queries here
