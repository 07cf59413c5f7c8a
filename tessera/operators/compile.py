"""Plans to token ids, labels and masks.

``compile_plans`` encodes each distinct plaintext of a batch once, in one call
of the tokenizer. ``compile_rows`` applies it in Arrow batches to rows of message
JSON; a batch that fails is halved until the failing row stands alone.
``byte_compiled`` does the whole work in Column expressions for text turns and
the byte tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tessera.functions import text as T
from tessera.functions.batches import pieces
from tessera.functions.canonical import decode
from tessera.operators.tokenizers import ByteTokenizer, TokenizerFailure, TokenizerTimeout, batch_encode, one_encode
from tessera.plans import render, template
from tessera.protocol import IGNORED, Invalid, check_ids

Compiled = tuple[list[int], list[int], list[int]]  # ids, labels, mask


def assemble(plan: render.Plan, lookup: dict[str, list[int]], ids: dict[str, int], eos: int | None) -> Compiled:
    """Ids of a plan's fragments in order, with label and mask of each."""
    out: list[int] = []
    mask: list[int] = []
    for structural, value, target in plan.fragments:
        new = [ids[value]] if structural else lookup[value]
        out += new
        mask += [int(target)] * len(new)
    if plan.append_eos:
        if eos is None:
            raise Invalid("the tokenizer has no end-of-sequence id")
        out.append(eos)
        mask.append(int(plan.eos_target))
    labels = [i if m or plan.full_loss else IGNORED for i, m in zip(out, mask)]
    return out, labels, mask


def compile_plans(plans: list[render.Plan], tokenizer: Any) -> list[Compiled]:
    """All plans with one tokenizer call over their distinct plaintexts."""
    ids = check_ids(tokenizer.ids)
    texts = list(dict.fromkeys(v for p in plans for s, v, _ in p.fragments if not s))
    found = batch_encode(tokenizer, texts) if texts else []
    lookup = dict(zip(texts, found))
    return [assemble(p, lookup, ids, tokenizer.eos) for p in plans]


def compile_one(tokenizer: Any, messages: list, tools: Any = None, **options: Any) -> Compiled:
    return compile_plans([render.plan(messages, tools, **options)], tokenizer)[0]


def halving(plans: list[render.Plan], tokenizer: Any) -> list[Compiled | str]:
    """As ``compile_plans``; where the tokenizer fails on a row, that row's entry is 'tokenizer_failure' or 'invalid'."""
    try:
        return list(compile_plans(plans, tokenizer))
    except Exception as bad:  # noqa: BLE001 - any failure is narrowed down to its row
        if len(plans) > 1:
            half = len(plans) // 2
            return halving(plans[:half], tokenizer) + halving(plans[half:], tokenizer)
        if isinstance(bad, (TokenizerFailure, TokenizerTimeout)):
            return ["tokenizer_failure"]
        try:  # a batch method may fail where the scalar one doesn't
            texts = {v for s, v, _ in plans[0].fragments if not s}
            return [assemble(plans[0], {t: one_encode(tokenizer, t) for t in texts}, check_ids(tokenizer.ids), tokenizer.eos)]
        except Exception:  # noqa: BLE001
            return ["invalid"]


OPTIONS = ("ctrl_json", "caps_json")
ADDED = [("rejection", ST.StringType()), ("input_ids", ST.ArrayType(ST.IntegerType())), ("labels", ST.ArrayType(ST.IntegerType())), ("assistant_mask", ST.ArrayType(ST.IntegerType())), ("target_tokens", ST.LongType())]


def compile_rows(df: DataFrame, tokenizer: Any = None, max_length: int | None = 2048, batch: int = 128, **options: Any) -> DataFrame:
    """``df`` (messages_json, tools_json, optional ctrl_json, caps_json, preserve_thinking, rejection) with rejection, input_ids, labels, assistant_mask and target_tokens.

    Rows that come with a rejection keep it and are not compiled. In this order a
    row gets: invalid (no valid conversation), tokenizer_failure, too_long (more
    than ``max_length`` ids), no_target (no label to learn), or null for a good one.
    """
    tokenizer = tokenizer or ByteTokenizer()
    kept = [c for c in df.columns if c not in {n for n, _ in ADDED}]
    schema = df.select(*kept).schema
    for name, kind in ADDED:
        schema = schema.add(name, kind)
    source = df.select(*kept, *(["rejection"] if "rejection" in df.columns else [F.lit(None).cast("string").alias("rejection")]))

    def plan_of(r: dict) -> render.Plan | None:
        try:
            extra = {k.removesuffix("_json"): decode(r[k]) for k in OPTIONS if r.get(k) is not None}
            own = {"preserve_thinking": r["preserve_thinking"]} if r.get("preserve_thinking") is not None else {}
            return render.plan(decode(r["messages_json"]), decode(r["tools_json"] or "[]"), **extra, **(options | own))
        except (Invalid, TypeError, ValueError, KeyError, RecursionError):
            return None

    def work(rows: list[dict]) -> list[tuple]:
        plans = [None if r["rejection"] else plan_of(r) for r in rows]
        good = iter(halving([p for p in plans if p], tokenizer))
        out = []
        for r, p in zip(rows, plans):
            found = (r["rejection"] or "invalid") if p is None else next(good)
            if isinstance(found, str):
                out.append((found, None, None, None, None))
                continue
            targets = sum(x != IGNORED for x in found[1])
            why = "too_long" if max_length is not None and len(found[0]) > max_length else None if targets else "no_target"
            out.append((why, *found, targets))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for part in pieces(full, batch):
                cols = list(zip(*work(part.select([c for c in ("messages_json", "tools_json", "rejection", "preserve_thinking", *OPTIONS) if c in part.schema.names]).to_pylist())))
                kinds = [pa.string(), *[pa.list_(pa.int32())] * 3, pa.int64()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=schema.names)

    return source.mapInArrow(run, schema)


def rendered_rows(df: DataFrame, form: str = "plan", **options: Any) -> DataFrame:
    """``df`` (messages_json, tools_json, optional ctrl_json, caps_json, preserve_thinking) with rejection, ``rendered`` and ``learnt``, the number of characters that the model learns.

    ``plan`` is the compiler's own text, ``template`` the text template for trusted payloads. A row that has none is ``invalid``.
    """
    added = [("rejection", ST.StringType()), ("rendered", ST.StringType()), ("learnt", ST.IntegerType())]
    kept = [c for c in df.columns if c not in {n for n, _ in added}]
    schema = df.select(*kept).schema
    for name, kind in added:
        schema = schema.add(name, kind)

    def one(r: dict) -> tuple:
        try:
            own = {k.removesuffix("_json"): decode(r[k]) for k in OPTIONS if r.get(k) is not None}
            own |= {"preserve_thinking": r["preserve_thinking"]} if r.get("preserve_thinking") is not None else {}
            messages, tools = decode(r["messages_json"]), decode(r["tools_json"] or "[]")
            if form == "template":
                text, spans = template.render(messages, tools, **own, **options)
                return None, text, sum(b - a for a, b in spans)
            p = render.plan(messages, tools, **own, **options)
            return None, render.plan_text(p), sum(len(v) for _, v, target in p.fragments if target)
        except (Invalid, TypeError, ValueError, KeyError, AttributeError, RecursionError):
            return "invalid", None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in pieces(full)):
            rows = batch.select([c for c in ("messages_json", "tools_json", "preserve_thinking", *OPTIONS) if c in kept]).to_pylist()
            cols = zip(*map(one, rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32())))], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def fragment_ids(p, ids: dict[str, int] = ByteTokenizer.ids):
    """Byte-tokenizer ids of one fragment, as a Column."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.when(p["structural"], F.array(F.element_at(table, p["value"]))).otherwise(F.transform(T.utf8_bytes(p["value"]), lambda b: b + F.lit(11)))


def byte_compiled(turns: DataFrame, key: str, order: str, full_loss: bool = False) -> DataFrame:
    """Per conversation of text turns: (key, input_ids, labels, assistant_mask, target_tokens); no Python is involved."""
    c = render.conversations(turns, key, order)
    end = F.array(F.lit(ByteTokenizer.eos))
    each = F.transform("parts", lambda p: F.struct(fragment_ids(p).alias("ids"), p["target"].alias("target")))
    c = c.withColumn("each", each)
    ids = F.concat(F.flatten(F.transform("each", lambda x: x["ids"])), end)
    mask = F.concat(F.flatten(F.transform("each", lambda x: F.array_repeat(x["target"].cast("int"), F.size(x["ids"])))), F.array(F.col("ends_on_model").cast("int")))
    c = c.select(key, ids.alias("input_ids"), mask.alias("assistant_mask"))
    labels = F.col("input_ids") if full_loss else F.zip_with("input_ids", "assistant_mask", lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))
    c = c.withColumn("labels", labels)
    return c.select(key, "input_ids", "labels", "assistant_mask", T.count_targets(F.col("labels")).alias("target_tokens"))


def token_counts(turns: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n_tokens, n_targets) with the byte tokenizer, from lengths alone."""
    c = render.conversations(turns, key, order)
    size = lambda p: F.when(p["structural"], F.lit(1)).otherwise(F.octet_length(p["value"]))
    add = lambda cond: F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.when(cond(p), size(p)).otherwise(0))
    return c.select(key, (add(lambda p: F.lit(True)) + 1).alias("n_tokens"), (add(lambda p: p["target"]) + F.col("ends_on_model").cast("bigint")).alias("n_targets"))
