"""Source layouts to the one message model.

``adapt`` runs any layout in Arrow batches: rows of open schema become candidate
rows (messages_json, tools_json, fingerprint, rejection), and a row that does not
fit is marked, never raised. For layouts of fixed schema there are ``native``
versions in Column expressions with the same results.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tessera.functions import text as T
from tessera.functions.batches import pieces
from tessera.functions.canonical import canonical, check_budget, decode, decode_lenient, fingerprint, is_list, required
from tessera.protocol import ALIASES, Invalid

Adapted = tuple[list[dict[str, Any]], list[dict[str, Any]]]
CALLS, ANSWERS = (re.compile(rf"<{t}>\s*(.*?)\s*</{t}>", re.S) for t in ("tool_call", "tool_response"))
THINK = re.compile(r"\s*<think>\s*(.*?)\s*</think>\s*(.*)", re.S)
MIN_SCORE = 0.8


def arguments_of(value: Any) -> dict:
    found = decode(value, "arguments")
    if found is None:
        return {}
    if not isinstance(found, Mapping):
        raise Invalid("arguments must be an object")
    canonical(found)
    return dict(found)


def tools_of(value: Any) -> list[dict[str, Any]]:
    """Declared tools in one form: type ``function``, a name, parameters."""
    if value is None or value == "":
        return []
    found = decode_lenient(value, "tools")
    if isinstance(found, Mapping):
        found = found["tools"] if "tools" in found else [found]
    if isinstance(found, Mapping):
        found = [found]
    if not is_list(found):
        raise Invalid("tools must be an array")
    out = []
    for tool in found:
        body = tool.get("function", tool) if isinstance(tool, Mapping) else None
        if not isinstance(body, Mapping):
            raise Invalid("a tool must be an object")
        default = {"parameters": {"type": "object", "properties": {}}}
        out.append({"type": "function", "function": default | dict(body) | {"name": required(body.get("name"), "tool name")}})
    canonical(out)
    return out


def call_of(value: Any, fallback: str) -> dict[str, Any]:
    """A tool call in one form, with ``fallback`` as its id where it has none."""
    found = decode_lenient(value, "tool call")
    body = found.get("function", found) if isinstance(found, Mapping) else None
    if not isinstance(body, Mapping):
        raise Invalid("a tool call must be an object")
    name = required(body.get("name"), "tool call name")
    given = body["arguments"] if "arguments" in body else body.get("parameters", {})
    return {"id": required(found.get("id") or fallback, "tool call id"), "type": "function", "function": {"name": name, "arguments": arguments_of(given)}}


def messages_of(value: Any) -> list[dict[str, Any]]:
    """Messages with roles, content and calls in one form."""
    found = decode(value, "messages")
    if not is_list(found):
        raise Invalid("messages must be an array")
    out = []
    for i, raw in enumerate(found):
        if not isinstance(raw, Mapping):
            raise Invalid("a message must be an object")
        low = str(raw["role"] if "role" in raw else raw.get("from")).lower()
        m: dict[str, Any] = {"role": ALIASES.get(low, low), "content": raw["content"] if "content" in raw else raw.get("value", "")}
        if m["role"] == "assistant" and raw.get("tool_calls") is not None:
            calls = decode(raw["tool_calls"], "tool_calls")
            calls = [calls] if isinstance(calls, Mapping) else calls
            if not is_list(calls):
                raise Invalid("tool_calls must be an array")
            m["tool_calls"] = [call_of(c, f"call_{i}_{k}") for k, c in enumerate(calls)]
        if m["role"] in ("tool", "observation"):
            cause = raw["tool_call_id"] if "tool_call_id" in raw else raw.get("call_id")
            if cause is not None:
                m["tool_call_id"] = required(cause, "tool_call_id")
        m |= {k: raw[k] for k in ("reasoning_content", "thinking") if raw.get(k) is not None}
        out.append(m)
    return out


def blocks_of(text: str, pattern: re.Pattern, tag: str) -> list[str]:
    found = [x.strip() for x in pattern.findall(text)]
    if not found and f"<{tag}>" in text:
        raise Invalid(f"an opened {tag} block isn't closed")
    return found


def chat(row: Mapping) -> Adapted:
    return messages_of(row.get("messages")), []


def pair(row: Mapping) -> Adapted:
    """Prompt and answer columns."""
    asked, said = required(row.get("inputs"), "inputs"), required(row.get("targets"), "targets")
    return [{"role": "user", "content": asked}, {"role": "assistant", "content": said}], []


def agentic(row: Mapping) -> Adapted:
    return messages_of(row.get("messages")), tools_of(row.get("tools"))


def tagged(row: Mapping) -> Adapted:
    """Calls and responses as XML blocks in the text; responses answer the open calls first in, first out."""
    found = decode_lenient(row["conversations"] if "conversations" in row else row.get("messages"), "conversations")
    if not is_list(found):
        raise Invalid("conversations must be an array")
    tools = tools_of(row.get("tools"))
    names = {k: v for k, v in ALIASES.items() if k in ("human", "gpt", "function")}
    out: list[dict[str, Any]] = []
    open_: deque[str] = deque()
    made = 0
    for raw in found:
        if not isinstance(raw, Mapping):
            raise Invalid("a conversation item must be an object")
        low = str(raw["from"] if "from" in raw else raw.get("role", "")).lower()
        role, text = names.get(low, low), raw["value"] if "value" in raw else raw.get("content", "")
        if not isinstance(text, str):
            raise Invalid("a conversation item must hold text")
        blocks = blocks_of(text, CALLS, "tool_call") if role == "assistant" else []
        if blocks:
            calls = [call_of(b, f"hermes_call_{made + k}") for k, b in enumerate(blocks)]
            made += len(calls)
            open_.extend(c["id"] for c in calls)
            out.append({"role": role, "content": CALLS.sub("", text).strip(), "tool_calls": calls})
        elif role == "tool":
            for answer in blocks_of(text, ANSWERS, "tool_response") or [text]:
                if not open_:
                    raise Invalid("a tool response answers no call")
                try:
                    content = decode_lenient(answer)
                except ValueError:
                    content = answer  # tools often print plain text
                out.append({"role": role, "tool_call_id": open_.popleft(), "content": content})
        else:
            out.append({"role": role, "content": text})
    return out, tools


def flag(values: Any, i: int) -> bool:
    return is_list(values) and i < len(values) and bool(values[i])


def reasoning(row: Mapping) -> Adapted:
    """The first complete and correct generation, split into reasoning and answer."""
    tries = row.get("generations")
    if not is_list(tries):
        raise Invalid("generations must be an array")
    good = (g.strip() for i, g in enumerate(tries) if flag(row.get("is_reasoning_complete"), i) and (flag(row.get("correctness_math_verify"), i) or flag(row.get("correctness_llama"), i)) and isinstance(g, str) and g.strip())
    chosen = next(good, None)
    if chosen is None:
        raise Invalid("no generation is complete and correct")
    split = THINK.fullmatch(chosen)
    thought, said = split.groups() if split else (chosen, "")
    answer = required(said or row.get("answer", ""), "answer")
    return [{"role": "user", "content": required(row.get("problem"), "problem")}, {"role": "assistant", "reasoning_content": required(thought, "reasoning"), "content": answer}], []


def scored(row: Mapping, min_score: float = MIN_SCORE) -> Adapted:
    """Prompt and answer of rows whose test score reaches the threshold."""
    raw = row.get("average_test_score")
    if isinstance(raw, bool) or not isinstance(raw, (str, int, float)):
        raise Invalid("the score is no number")
    score = float(raw)
    if not math.isfinite(score) or score < min_score:
        raise Invalid("the score is below the threshold")
    return pair({"inputs": row.get("input"), "targets": row.get("output")})


ADAPTERS: dict[str, Callable[..., Adapted]] = {"ultrachat": chat, "aya": pair, "nemotron": agentic, "hermes": tagged, "openr1": reasoning, "opencode": scored}
CANDIDATE = [("rejection", ST.StringType()), ("fingerprint", ST.StringType()), ("messages_json", ST.StringType()), ("tools_json", ST.StringType())]


def candidate(row: Any, adapter: Callable[[Mapping], Adapted], max_chars: int, budget: tuple[int, int, int]) -> tuple:
    """(rejection, fingerprint, messages_json, tools_json) of one raw row; cheap checks come first."""
    try:
        if not isinstance(row, Mapping):
            raise Invalid("a row must be an object")
        check_budget(row, *budget)
        messages, tools = adapter(row)
        m, t = canonical(messages), canonical(tools)
    except (Invalid, ValueError, TypeError, KeyError, AttributeError, OverflowError, RecursionError):
        return "invalid", None, None, None
    if len(m) + len(t) > max_chars:
        return "oversized_text", None, None, None
    return None, fingerprint(m, t), m, t


def adapt(df: DataFrame, name: str | Callable[[Mapping], Adapted], keep: tuple[str, ...] = (), raw_json: str | None = None, *, min_score: float = MIN_SCORE, max_chars: int = 1_000_000, max_bytes: int = 4_000_000, max_nodes: int = 100_000, max_depth: int = 128) -> DataFrame:
    """Candidate rows of ``df``, with the columns ``keep``. ``name`` is a layout's name or a function from a row to (messages, tools). With ``raw_json`` the row is the JSON text of that column (a malformed one is invalid)."""
    if not callable(name) and name not in ADAPTERS:
        raise Invalid(f"no adapter is named {name}")
    if not math.isfinite(min_score):
        raise Invalid("the least score must be finite")
    function = name if callable(name) else (lambda r: scored(r, min_score)) if name == "opencode" else ADAPTERS[name]
    schema = df.select(*keep).schema
    for column, kind in CANDIDATE:
        schema = schema.add(column, kind)
    budget = (max_bytes, max_nodes, max_depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in pieces(full)):
            rows = batch.select([c for c in batch.schema.names if c not in keep or c == raw_json]).to_pylist()
            if raw_json:
                rows = [parsed(r[raw_json]) for r in rows]
            cols = zip(*(candidate(r, function, max_chars, budget) for r in rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    return df.mapInArrow(run, schema)


def parsed(text: str | None) -> Any:
    try:
        return json.loads(text or "null")
    except (json.JSONDecodeError, RecursionError):
        return None


# --- native versions of the layouts with fixed schema ---------------------------


def message(role: str, content: Column, thought: Column | None = None) -> Column:
    """A canonical JSON message of text content."""
    middle = [] if thought is None else [F.lit(',"reasoning_content":'), T.quote(thought)]
    return F.concat(F.lit('{"content":'), T.quote(content), *middle, F.lit(f',"role":"{role}"}}'))


def as_candidate(df: DataFrame, messages: Column, bad: Column, keep: tuple[str, ...], max_chars: int) -> DataFrame:
    m, t = F.when(~bad, messages), F.lit("[]")
    long = F.length("messages_json") + 2 > max_chars
    c = df.select(*keep, m.alias("messages_json")).select(*keep, F.when(F.col("messages_json").isNull(), "invalid").when(long, "oversized_text").alias("rejection"), "messages_json")
    good = F.col("rejection").isNull()
    return c.select(*keep, "rejection", F.when(good, T.fingerprint(F.col("messages_json"), t)).alias("fingerprint"), F.when(good, F.col("messages_json")).alias("messages_json"), F.when(good, t).alias("tools_json"))


def native_pair(df: DataFrame, keep: tuple[str, ...] = (), asked: str = "inputs", said: str = "targets", max_chars: int = 1_000_000, also: Column | None = None) -> DataFrame:
    """``pair`` in Column expressions; ``also`` is a further condition of good rows."""
    a, b = T.strip(F.col(asked)), T.strip(F.col(said))
    bad = T.is_blank(F.col(asked)) | T.is_blank(F.col(said))
    bad = bad if also is None else bad | ~F.coalesce(also, F.lit(False))
    return as_candidate(df, F.concat(F.lit("["), message("user", a), F.lit(","), message("assistant", b), F.lit("]")), bad, keep, max_chars)


def native_scored(df: DataFrame, keep: tuple[str, ...] = (), min_score: float = MIN_SCORE, max_chars: int = 1_000_000) -> DataFrame:
    """``scored`` in Column expressions, for text or numeric scores."""
    kind = dict(df.dtypes)["average_test_score"]
    score = F.lit(None).cast("double") if kind == "boolean" else T.parse_score(F.col("average_test_score")) if kind == "string" else F.col("average_test_score").cast("double")
    return native_pair(df, keep, "input", "output", max_chars, T.is_finite(score) & (score >= min_score))


def first_correct(tries: str = "generations", complete: str = "is_reasoning_complete", checks: tuple[str, ...] = ("correctness_math_verify", "correctness_llama")) -> Column:
    """The stripped first generation that is complete, correct and not blank; null without one."""

    def good(g: Column, i: Column) -> Column:
        right = F.lit(False)
        for c in checks:
            right = right | T.flag_at(F.col(c), i)
        return T.flag_at(F.col(complete), i) & right & ~T.is_blank(g)

    return T.strip(F.get(F.filter(tries, good), F.lit(0)))


def native_reasoning(df: DataFrame, keep: tuple[str, ...] = (), max_chars: int = 1_000_000) -> DataFrame:
    """``reasoning`` in Column expressions."""
    thought, said = T.think_split(F.col("__try"))
    d = df.withColumn("__try", first_correct()).withColumn("__thought", T.strip(thought)).withColumn("__said", T.strip(F.coalesce(F.when(said != "", said), F.col("answer"))))
    bad = F.col("__try").isNull() | T.is_blank(F.col("__thought")) | T.is_blank(F.col("__said")) | T.is_blank(F.col("problem"))
    pair_ = F.concat(F.lit("["), message("user", T.strip(F.col("problem"))), F.lit(","), message("assistant", F.col("__said"), F.col("__thought")), F.lit("]"))
    return as_candidate(d, pair_, bad, keep, max_chars)


def native_chat(df: DataFrame, keep: tuple[str, ...] = (), max_chars: int = 1_000_000) -> DataFrame:
    """``chat`` for ``messages array<struct<role, content>>`` of text content (null content stays null)."""
    one = lambda m: F.concat(F.lit('{"content":'), F.coalesce(T.quote(m["content"]), F.lit("null")), F.lit(',"role":'), T.quote(T.role_name(m["role"])), F.lit("}"))
    text = F.concat(F.lit("["), F.array_join(F.transform("messages", one), ","), F.lit("]"))
    return as_candidate(df, text, F.col("messages").isNull() | F.exists("messages", lambda m: m["role"].isNull()), keep, max_chars)
