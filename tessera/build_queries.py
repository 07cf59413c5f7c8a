"""Queries of sources, strict and isolated compilation, packing and the whole build."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mixture, precompiled
from tessera.operators.compile import byte_compiled, compile_rows
from tessera.operators.tokenizers import ByteTokenizer, IsolatedTokenizer, TrieTokenizer, byte_level
from tessera.plans.prepare import prepare
from tessera.protocol import MARKERS
from tessera.queries import ASKED, COUNTS, ORACLE_SQL, PAIR, SAID, STRIP, message_json, mixture_sql, query, table, weighted_ids
from tessera.sources import catalogue, readers
from tessera.sources.catalogue import SourceSpec
from tessera.sources.scratch import folder

# --- tokenizers ---------------------------------------------------------------------------


@query(ORACLE_SQL["compiled_from_json"])
def isolated_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As compiled_from_json, with the tokenizer in a process of its own under a time limit."""
    m = message_json(table(spark, sf_dir, "conversations")).withColumn("tools_json", F.lit("[]"))
    apart = IsolatedTokenizer(ByteTokenizer, 60.0, ByteTokenizer.ids, ByteTokenizer.eos, ByteTokenizer.size)
    return weighted_ids(compile_rows(m, apart, max_length=None))


@query(COUNTS)
def strict_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trainer's own compilation, at which any bad row fails the job; with full loss every row has targets."""
    m = message_json(table(spark, sf_dir, "conversations")).withColumnRenamed("messages_json", "messages")
    c = precompiled.compile_strict(m, ByteTokenizer(), None, True, "messages")
    masked = F.size(F.filter("assistant_mask", lambda x: x == 1)).cast("bigint")
    return c.select("conv_id", F.size("input_ids").cast("bigint").alias("n_tokens"), masked.alias("n_targets"))


#: A byte-level vocabulary of 50 000 tokens; the path may be another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def byte_vocabulary(path: str = VOCABULARY) -> TrieTokenizer:
    """The tokens of a ``base64 rank`` file as a longest-match vocabulary; it has every byte, so nothing is unknown."""
    stand_in = byte_level()
    with open(path, "rb") as f:
        vocab = {"".join(stand_in[b] for b in base64.b64decode(a)): int(i) for a, i in map(bytes.split, f)}
    top = max(vocab.values()) + 1
    return TrieTokenizer(vocab | {"<unk>": top}, "<unk>", top + 1, {m: top + 2 + i for i, m in enumerate(MARKERS.values())}, byte_pieces=True)


@query()
def wordpiece_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by longest match over a byte-level vocabulary; the driver reads it and sends its arrays along."""
    tokenizer = byte_vocabulary()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = tokenizer.encode_batch([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "input_ids"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, input_ids array<int>")


# --- packing ---------------------------------------------------------------------------------

PACK_SQL = COUNTS.replace("select conv_id, cast(sum(n) + 1", ", lens as (select conv_id, cast(sum(n) + 1", 1).replace("with ", "with recursive ", 1) + """),
items as (select cast(conv_id as varchar) as row_id, n_tokens as n, row_number() over (order by n_tokens desc, cast(conv_id as varchar)) as i from lens where n_tokens <= 4096),
pk as (select 0::bigint as i, []::bigint[] as rooms, 0::bigint as bin, 0::bigint as n
  union all
  select x.i, case when x.pos is null then list_append(x.rooms, 4096 - x.n) else list_concat(list_concat(x.rooms[1:x.pos - 1], [x.rooms[x.pos] - x.n]), x.rooms[x.pos + 1:]) end, coalesce(x.pos, len(x.rooms) + 1), x.n
  from (select t.i, t.n, pk.rooms, list_position(pk.rooms, list_min(list_filter(pk.rooms, lambda r: r >= t.n))) as pos from pk join items t on t.i = pk.i + 1) x),
bins as (select '0-0-' || (bin - 1) as bin_id, cast(null as varchar) as fault, count(*) as segments, cast(sum(n) as bigint) as used from pk where i > 0 group by bin)
select * from bins union all
select '0-0-' || ((select count(*) from bins) + row_number() over (order by cast(conv_id as varchar)) - 1), 'too_long', 1, n_tokens from lens where n_tokens > 4096"""


@query(PACK_SQL)
def bfd_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all conversations; one over 4096 ids is a bin of its own with the fault too_long."""
    c = byte_compiled(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    p = precompiled.pack(c, "conv_id", 4096)
    return p.groupBy("bin_id", "fault").agg(F.count("*").alias("segments"), F.sum(F.size("input_ids")).alias("used"))


# --- sources ---------------------------------------------------------------------------------


@query("""select * from (values ('ultrachat', 3500000::bigint, 'ultrachat', 0), ('aya', 1000000, 'aya', 1), ('nemotron_agentic', 2810000, 'nemotron', 1), ('hermes_func_calling', 190000, 'hermes', 0), ('openr1_math', 1000000, 'openr1', 10), ('opencodeinstruct', 1500000, 'opencode', 50)) v(name, quota, adapter, n_urls)""")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.dimension(spark).select("name", "quota", "adapter", F.size("urls").alias("n_urls"))


@query("select url, sha256(url) || regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/](\\.[^./]+)$', 1) as file from pages where url is not null")
def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that a cache keeps for each page's address."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([readers.cached_path(u, "/").name for u in b.column(0).to_pylist()], pa.string())], names=["url", "file"])

    return table(spark, sf_dir, "pages").where("url is not null").select("url").mapInArrow(run, "url string, file string")


@query("select doc_id, md5(text) as digest, cast(null as varchar) as missing from documents")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back with a projection, one column of which is missing."""
    path = f"{folder(spark)}/lines-{os.urandom(8).hex()}.jsonl"
    table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "text"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    raw = readers.scan(spark, [path], ("doc_id", "text", "other")).select(F.from_json("raw", "doc_id bigint, text string, other string").alias("r"))
    return raw.select("r.doc_id", F.md5("r.text").alias("digest"), F.col("r.other").alias("missing"))


# --- the whole build --------------------------------------------------------------------------

#: Sources of the build over documents (by language) with their quotas in target tokens.
QUOTAS = {"de": 20_000, "en": 60_000, "es": 10**12, "fr": 15_000}
ORDERED = {s: QUOTAS[s] for s in mixture.source_order(list(QUOTAS), 42)}
BASE = f"""select doc_id as pos, lang as source, messages_json, sha256('{{"messages":' || messages_json || ',"tools":[]}}') as fingerprint, octet_length(encode(b)) + 6 as target_tokens, octet_length(encode(a)) + octet_length(encode(b)) + 11 as n_ids,
case when messages_json is null then 'invalid' when octet_length(encode(a)) + octet_length(encode(b)) + 11 > 2048 then 'too_long' end as rejection
from (select doc_id, lang, a, b, case when a <> '' and b <> '' then {PAIR} end as messages_json from (select doc_id, lang, {STRIP.format(x=ASKED)} as a, {STRIP.format(x=SAID)} as b from documents))"""
BUILT = mixture_sql(BASE, ORDERED, ", messages_json, n_ids")


def build(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """The corpus build with languages as sources: first lines as prompts, the rest as answers, in the order of ids."""

    def rows(session: SparkSession, spec: SourceSpec, seed: int) -> DataFrame:
        d = table(session, sf_dir, "documents").where(F.col("lang") == spec.name)
        return d.selectExpr("doc_id as pos", "split_part(text, char(10), 1) as inputs", "substr(text, length(split_part(text, char(10), 1)) + 2) as targets")

    specs = tuple(SourceSpec(s, "documents", None, "train", "1", "none", quota, "aya") for s, quota in QUOTAS.items())
    out = f"{folder(spark)}/build-{os.urandom(8).hex()}"
    return out, prepare(spark, out, specs, row_provider=rows)


@query(BUILT + " select source, md5(messages_json) as digest, cast(target_tokens as bigint) as target_tokens, cast(n_ids as integer) as n_ids from o where outcome = 'accepted'")
def build_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readers.scan(spark, [build(spark, sf_dir)[0]])
    return d.select("source", F.md5("messages_json").alias("digest"), "target_tokens", F.size("input_ids").alias("n_ids"))


@query(BUILT + f""", q(name, quota) as (values {', '.join(f"('{s}', {n}::bigint)" for s, n in QUOTAS.items())})
select name, quota, count(*) filter (outcome = 'accepted') as rows, cast(coalesce(sum(target_tokens) filter (outcome = 'accepted'), 0) as bigint) as target_tokens, count(*) filter (outcome = 'duplicate') as duplicate, count(*) filter (outcome = 'too_long') as too_long, count(*) filter (outcome = 'invalid') as invalid from q left join o on name = source group by all""")
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s["name"], s["quota"], s["rows"], s["target_tokens"], *(s["rejected"].get(r, 0) for r in ("duplicate", "too_long", "invalid"))) for s in build(spark, sf_dir)[1]["sources"]]
    return spark.createDataFrame(rows, "name string, quota bigint, rows bigint, target_tokens bigint, duplicate bigint, too_long bigint, invalid bigint")
