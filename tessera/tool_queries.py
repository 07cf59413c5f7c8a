"""Queries of the tool, content and rendering rules; each event or conversation is made into a row that the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import adapters
from tessera.operators.compile import compile_rows, rendered_rows
from tessera.operators.tokenizers import ByteTokenizer
from tessera.queries import ARGS, ASKED, PAIR, PIECES, SAID, STRIP, TURNS, message_json, query, table

# --- layouts ---------------------------------------------------------------------------


def sized_sql(name: str, c: str) -> str:
    """Raw bytes count the two keys and the answer, too; a compiled pair has 13 ids besides its prompt's bytes."""
    return f"""select '{name}' as kind, case when {c} is null or a = '' or octet_length(encode({c})) + 15 > 20000 then 'invalid' when length({PAIR}) + 2 > 10000 then 'oversized_text' when octet_length(encode(a)) + 13 > 2048 then 'too_long' else 'ok' end as bucket
from (select {c}, {STRIP.format(x=c)} as a, 'ok' as b from {name})"""


@query(f"select bucket, kind, count(*) as n from ({sized_sql('documents', 'text')} union all {sized_sql('pages', 'html')}) group by all")
def size_and_length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw budget, serialised size and compiled length, each row with the first limit that it breaks."""

    def sized(name: str, c: str) -> DataFrame:
        d = table(spark, sf_dir, name).select(F.col(c).alias("inputs"), F.lit("ok").alias("targets"))
        done = compile_rows(adapters.adapt(d, "aya", max_bytes=20000, max_chars=10000), ByteTokenizer(), max_length=2048)
        return done.select(F.coalesce("rejection", F.lit("ok")).alias("bucket"), F.lit(name).alias("kind"))

    return sized("documents", "text").unionByName(sized("pages", "html")).groupBy("bucket", "kind").agg(F.count("*").alias("n"))


@query(f"""with s as (select doc_id, {STRIP.format(x=ASKED)} as a, {STRIP.format(x=SAID)} as b from documents),
m as (select doc_id, case when a <> '' then '[{{"content":' || to_json(a) || ',"role":"user"}},{{"content":' || to_json(case when b = '' then '42' else b end) || ',"reasoning_content":' || to_json(a) || ',"role":"assistant"}}]' end as messages_json from s)
select doc_id, case when messages_json is null then 'invalid' end as rejection, messages_json from m""")
def reasoning_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three tries is right: the first line as its thought, the rest as its answer."""
    d = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "split_part(text, char(10), 1) as problem",
        "'42' as answer",
        "array(text, concat('<think>', split_part(text, char(10), 1), '</think>', substr(text, length(split_part(text, char(10), 1)) + 2)), 'late') as generations",
        "array(true, true, true) as is_reasoning_complete",
        "array(false, true) as correctness_math_verify",
        "array(false, false, true) as correctness_llama",
    )
    return adapters.adapt(d, "openr1", ("doc_id",)).select("doc_id", "rejection", "messages_json")


CHATS = """with m as (select conv_id, '[' || string_agg('{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || to_json(role) || '}', ',' order by turn) || ']' as messages_json from conversations group by conv_id)
select conv_id, cast(null as varchar) as rejection, messages_json, sha256('{"messages":' || messages_json || ',"tools":[]}') as fingerprint from m"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages as structs, roles by other names."""
    one = F.struct(F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "GPT").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x["m"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed.alias("messages"))


@query(CHATS)
def chat_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.adapt(chats(spark, sf_dir), "ultrachat", ("conv_id",)).select("conv_id", "rejection", "messages_json", "fingerprint")


@query(CHATS)
def chat_adapter_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.native_chat(chats(spark, sf_dir), ("conv_id",)).select("conv_id", "rejection", "messages_json", "fingerprint")


# --- tools in the text -----------------------------------------------------------------------

XML = [
    ("system", "'<tool_call> stays'"),
    ("human", "'go'"),
    ("gpt", """concat('a<tool_call> {"name":"', event_type, '", "arguments":', props, '} </tool_call>b<tool_call>{"name": "g"}</tool_call> ')"""),
    ("function", """concat('<tool_response> ', props, '</tool_response>, <tool_response>', event_type, ' done </tool_response>')"""),
]


@query(f"""select event_id, cast(null as varchar) as rejection, '[{{"content":"<tool_call> stays","role":"system"}},{{"content":"go","role":"user"}},{{"content":"ab","role":"assistant","tool_calls":[{{"function":{{"arguments":' || {ARGS} || ',"name":"' || event_type || '"}},"id":"hermes_call_0","type":"function"}},{{"function":{{"arguments":{{}},"name":"g"}},"id":"hermes_call_1","type":"function"}}]}},{{"content":' || {ARGS} || ',"role":"tool","tool_call_id":"hermes_call_0"}},{{"content":"' || event_type || ' done","role":"tool","tool_call_id":"hermes_call_1"}}]' as messages_json from events""")
def tool_xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and responses as blocks in the text of a conversation for each event."""
    turns = F.array(*[F.struct(F.lit(role).alias("from"), F.expr(text).alias("value")) for role, text in XML])
    e = table(spark, sf_dir, "events").select("event_id", turns.alias("conversations"))
    return adapters.adapt(e, "hermes", ("event_id",)).select("event_id", "rejection", "messages_json")


@query("""select event_id, case when event_id % 4 > event_id % 3 + 1 then 'invalid' end as rejection, cast(n as integer) as n, case when n is not null then 'hermes_call_' || n end as call_id
from events left join (values (0), (1), (2)) v(n) on n < event_id % 4 and event_id % 4 <= event_id % 3 + 1""")
def tool_link_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three calls and none to three responses for each event: the n-th response answers the n-th call; one too many is invalid."""
    calls = F.expr("""array_join(transform(sequence(0, int(event_id % 3)), i -> concat('<tool_call>{"name":"', event_type, '","arguments":{"i":', i, '}}</tool_call>')), ' ')""")
    turn = lambda role, text: F.struct(F.lit(role).alias("from"), text.alias("value"))
    answers = F.transform(F.expr("filter(array(0, 1, 2), i -> i < event_id % 4)"), lambda i: turn("tool", F.concat(F.lit("<tool_response>"), i, F.lit("</tool_response>"))))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.array(turn("human", F.lit("go")), turn("gpt", calls)), answers).alias("conversations"))
    found = adapters.adapt(e, "hermes", ("event_id",)).withColumn("m", F.from_json("messages_json", "array<struct<role string, tool_call_id string>>"))
    rows = found.select("event_id", "rejection", F.posexplode_outer(F.filter("m", lambda x: x["role"] == "tool")).alias("n", "x"))
    return rows.select("event_id", "rejection", "n", F.col("x.tool_call_id").alias("call_id"))


# --- declared tools and references -----------------------------------------------------------

DECLARED = '[{"function":{"name":"click"},"type":"function"},{"function":{"name":"purchase"},"type":"function"},{"function":{"name":"view"},"type":"function"}]'


def act_sql(args: str, name: str) -> str:
    """Ids of an action block: its JSON, the marker and two line breaks."""
    return f"""length('{{"arguments":' || {args} || ',"id":"{name}","name":"' || event_type || '","type":"tool"}}') + 3"""


@query(f"""with e as (select event_id, case when event_type in ('click', 'purchase', 'view') and event_id % 5 in (0, 4) then null else 'invalid' end as rejection, length('{{"tools":' || '{DECLARED}' || '}}') + 3 + 5 + 2 as before, {act_sql(ARGS, 'a')} + {act_sql("'{}'", 'b')} + 2 as acts, length('{{"caused_by":"a","content":"fine"}}') + 3 + 2 + 1 as after from events)
select event_id, rejection, cast(case when rejection is null then before + acts + after end as integer) as n_tokens, cast(case when rejection is null then acts end as bigint) as target_tokens from e""")
def tool_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls and an observation for each event; by turns the ids repeat, the observation answers no call, or the tool is not declared."""
    m = """concat('[{"role":"user","content":"go"},{"role":"assistant","tool_calls":[{"id":"a","function":{"name":"', event_type, '","arguments":', props,
      '}},{"id":"', if(event_id % 5 = 1, 'a', 'b'), '","function":{"name":"', if(event_id % 5 = 3, 'none', event_type), '","arguments":{}}}]},{"role":"tool","tool_call_id":"',
      case event_id % 5 when 2 then 'c' when 4 then 'b' else 'a' end, '","content":"fine"}]')"""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(m).alias("messages_json"), F.lit(DECLARED).alias("tools_json"))
    done = compile_rows(e, ByteTokenizer(), max_length=None)
    return done.select("event_id", "rejection", F.when(F.col("rejection").isNull(), F.size("input_ids")).alias("n_tokens"), F.when(F.col("rejection").isNull(), F.col("target_tokens")).alias("target_tokens"))


FORMS = [
    """concat('[{"function":{"name":" ', event_type, '"}}]')""",
    """concat('{"tools":[{"name":"', event_type, '"}]}')""",
    """concat('{"name":"', event_type, ' ","parameters":{"type":"object","properties":{}}}')""",
    """concat("[{'name': '", event_type, "', }]")""",
    """'[{"name":"  "}]'""",
]


@query("""select event_id, case when event_id % 5 = 4 then 'invalid' end as rejection, case when event_id % 5 < 4 then '[{"function":{"name":"' || event_type || '","parameters":{"properties":{},"type":"object"}},"type":"function"}]' end as tools_json from events""")
def tool_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool in five forms: a JSON list, an object around a list, an object, a literal that is no JSON, and one without a name."""
    e = table(spark, sf_dir, "events").select("event_id", F.lit("[]").alias("messages"), F.element_at(F.array(*map(F.expr, FORMS)), F.expr("int(event_id % 5) + 1")).alias("tools"))
    return adapters.adapt(e, "nemotron", ("event_id",)).select("event_id", "rejection", "tools_json")


# --- content and rendering ------------------------------------------------------------------

CONTENT = [
    """concat('["x",{"text":"', event_type, '"},"y"]')""",
    """concat('{"text":"', event_type, '"}')""",
    """concat('{"z":[true,null],"k":', regexp_extract(props, '-?[0-9]+', 0), '}')""",
    "'null'",
    "'12.5'",
    "'[1]'",
]


@query("""select event_id, case when event_id % 6 = 5 then 'invalid' end as rejection, case when event_id % 6 < 5 then '<|ctrl|>' || chr(10) || '{"a":' || event_id || ',"b":"' || event_type || '"}' || chr(10) || '<|caps|>' || chr(10) || 'raw' || chr(10) || '<|usr|>' || chr(10) ||
case event_id % 6 when 0 then 'x' || event_type || 'y' when 1 then event_type when 2 then '{"k":' || regexp_extract(props, '-?[0-9]+') || ',"z":[true,null]}' when 3 then '' else '12.5' end || chr(10) || '<|eot|>' || chr(10) || case when event_id % 2 = 0 then '<|think|>' || chr(10) || 'why' || chr(10) else '' end || '<|out|>' || chr(10) || 'so' || chr(10) || '<|eot|>' || chr(10) end as rendered from events""")
def content_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content as a list, an object with text, an object without, null and a number, and one that has no text; control, capabilities and thoughts by row."""
    content = F.element_at(F.array(*map(F.expr, CONTENT)), F.expr("int(event_id % 6) + 1"))
    m = F.concat(F.lit('[{"role":"user","content":'), content, F.lit('},{"role":"assistant","reasoning_content":"why","content":"so"}]'))
    ctrl = F.expr("""concat('{"b":"', event_type, '","a":', event_id, '}')""")
    e = table(spark, sf_dir, "events").select("event_id", m.alias("messages_json"), F.lit("[]").alias("tools_json"), ctrl.alias("ctrl_json"), F.lit('"raw"').alias("caps_json"), F.expr("event_id % 2 = 0").alias("preserve_thinking"))
    return rendered_rows(e).select("event_id", "rejection", "rendered")


@query(f"""with {TURNS}, {PIECES}, e as (select conv_id, bool_or(is_last and model) as ends from p group by conv_id)
select conv_id, string_agg(value, '' order by frag_no) || '<eos>' as rendered, cast(sum(case when target then length(value) else 0 end) + 5 * max(ends::int) as integer) as learnt from g join e using (conv_id) group by conv_id""")
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text template of conversations, and how many characters the model learns."""
    m = message_json(table(spark, sf_dir, "conversations")).withColumn("tools_json", F.lit("[]"))
    return rendered_rows(m, "template", eos="<eos>").select("conv_id", "rendered", "learnt")
