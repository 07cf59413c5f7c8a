"""From messages to an ordered plan of fragments.

Two routes with one grammar. ``plan`` takes Python messages of open schema and
applies every rule of the protocol; Arrow functions call it per row.
``fragments`` is the same for tables of plain text turns, as DataFrame
operations that Catalyst optimises. A fragment is (kind, value, target):
``structural`` values are marker names, ``plaintext`` values are tokenised each on
its own, and ``target`` says whether the model is trained to emit it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.canonical import canonical, is_list
from tessera.protocol import EOT, MARKERS, MODEL_ROLE, PAYLOAD_KEY, ROLES, RUNTIME_BLOCK, TEXT_KEY, Invalid

Fragment = tuple[bool, str, bool]  # structural, value, target


@dataclass
class Plan:
    """The fragments of a conversation, and how it ends."""

    fragments: list[Fragment] = field(default_factory=list)
    append_eos: bool = True
    eos_target: bool = False
    full_loss: bool = False

    def mark(self, kind: str, target: bool) -> None:
        self.fragments.append((True, MARKERS[kind], target))

    def block(self, kind: str, payload: str, target: bool) -> None:
        self.mark(kind, target)
        self.fragments += ((False, x, target) for x in ("\n", payload, "\n"))

    def hand_over(self, target: bool) -> None:
        self.mark("eot", target)
        self.fragments.append((False, "\n", target))


def own_text(value: Mapping) -> str | None:
    """The text that structured content carries itself, or None."""
    for key in (PAYLOAD_KEY, TEXT_KEY):
        if key in value:
            if not isinstance(value[key], str):
                raise Invalid(f"{key} must be text")
            return value[key]
    return None


def content_text(value: Any) -> str:
    """Message content as text."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, Mapping):
        text = own_text(value)
        return canonical(value) if text is None else text
    if is_list(value):
        parts = [x if isinstance(x, str) else own_text(x) if isinstance(x, Mapping) else None for x in value]
        if None in parts:
            raise Invalid("content items must hold text")
        return "".join(parts)
    if isinstance(value, (bool, int, float)):
        return canonical(value)
    raise Invalid("content of this type has no text")


def option_text(value: Any) -> str:
    """A control or capability payload: text as it is, other JSON in canonical form."""
    if isinstance(value, (str,)):
        return value
    if isinstance(value, (Mapping, list, tuple, bool, int, float)):
        return canonical(value)
    raise Invalid("option of this type has no text")


def declared_names(tools: Any, caps: Any) -> set[str]:
    """Names of the declared tools; duplicates and nameless tools are errors."""
    if not tools and isinstance(caps, Mapping):
        tools = caps.get("tools")
    if not tools:
        return set()
    if not is_list(tools):
        raise Invalid("tools must be an array")
    names = []
    for tool in tools:
        body = tool.get("function", tool) if isinstance(tool, Mapping) else None
        name = body.get("name") if isinstance(body, Mapping) else None
        if not isinstance(name, str) or not name:
            raise Invalid("every tool needs a name")
        names.append(name)
    if len(set(names)) < len(names):
        raise Invalid("a tool is declared twice")
    return set(names)


def model_blocks(out: Plan, message: Mapping, ids: set[str], names: set[str], thinking: bool) -> None:
    """Think, out and act blocks of a model-side message."""
    thought = message.get("reasoning_content") or message.get("thinking")
    if thinking and thought:
        out.block("think", content_text(thought), True)
    said = content_text(message.get("content"))
    if said.strip():
        out.block("out", said, True)
    calls = message.get("tool_calls")
    if calls is None:
        return
    if not is_list(calls):
        raise Invalid("tool_calls must be an array")
    for call in calls:
        body = call.get("function", call) if isinstance(call, Mapping) else None
        if not isinstance(body, Mapping):
            raise Invalid("a tool call must be an object")
        action: dict[str, Any] = {"type": "tool", "name": body.get("name"), "arguments": body.get("arguments", {})}
        if call.get("id") is not None:
            action["id"] = call["id"]
            if not isinstance(call["id"], str) or not call["id"] or call["id"] in ids:
                raise Invalid("tool call ids must be unique texts")
            ids.add(call["id"])
        if not isinstance(action["name"], str) or action["name"] not in names or not action["name"]:
            raise Invalid("a call names no declared tool")
        if not isinstance(action["arguments"], Mapping):
            raise Invalid("tool arguments must be an object")
        out.block("act", canonical(action), True)


def runtime_text(message: Mapping, ids: set[str]) -> str:
    """Payload of a runtime-side message; an observation that answers a call is wrapped with the call's id."""
    raw = message.get("content")
    text = content_text(raw)
    cause = message.get("tool_call_id") if RUNTIME_BLOCK[message["role"]] == "obs" else None
    if cause is None:
        return text
    if not isinstance(cause, str) or cause not in ids:
        raise Invalid("an observation answers no earlier call")
    return canonical({"caused_by": cause, "content": raw})


def plan(messages: Any, tools: Any = None, ctrl: Any = None, caps: Any = None, *, full_loss: bool = False, generation_prompt: bool = False, preserve_thinking: bool = True) -> Plan:
    """Validate a conversation and lay out its fragments; raises Invalid."""
    if tools is not None and not is_list(tools):
        raise Invalid("tools must be an array")
    if tools and caps is not None:
        raise Invalid("either tools or caps, not both")
    names, ids = declared_names(tools, caps), set()
    out = Plan(append_eos=not generation_prompt, full_loss=full_loss)
    model: bool | None = None  # the side that spoke last
    if ctrl is not None:
        out.block("ctrl", option_text(ctrl), False)
        model = False
    if caps is not None or tools:
        out.block("caps", option_text({"tools": list(tools)} if caps is None else caps), False)
        model = False
    for message in messages:
        role = message.get("role") if isinstance(message, Mapping) else None
        if not isinstance(role, str) or role not in ROLES:
            raise Invalid("a message needs one of the protocol's roles")
        now = role == MODEL_ROLE
        if model is not None and model != now:
            out.hand_over(model)
        model = now
        if now:
            model_blocks(out, message, ids, names, preserve_thinking)
        else:
            out.block(RUNTIME_BLOCK[role], runtime_text(message, ids), False)
    if generation_prompt and model:
        raise Invalid("a generation prompt must follow the runtime side")
    if model is not None:
        out.hand_over(model)
    out.eos_target = bool(model)
    return out


def plan_text(p: Plan, eos: str = "") -> str:
    return "".join(v for _, v, _ in p.fragments) + (eos if p.append_eos else "")


# --- the same for tables of text turns ----------------------------------------

FRAGMENT = "array<struct<structural:boolean,value:string,target:boolean>>"


def fragment(value: Column | str, target: Column, structural: bool = False) -> Column:
    v = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(structural).alias("structural"), v.alias("value"), target.alias("target"))


def block(marker: Column, payload: Column, target: Column) -> Column:
    return F.array(fragment(marker, target, True), fragment("\n", target), fragment(payload, target), fragment("\n", target))


def turn_fragments(turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: (key, order, model, flips, is_last, parts), ``parts`` being its fragments in order.

    One window per conversation finds the turns at which the side changes and the
    last turn, which also carries the closing hand-over.
    """
    marker = F.create_map(*[F.lit(x) for k, v in RUNTIME_BLOCK.items() for x in (k, MARKERS[v])])
    w = Window.partitionBy(key).orderBy(order)
    model = F.col(role) == MODEL_ROLE
    t = turns.select(key, order, model.alias("model"), F.coalesce(text, F.lit("")).alias("payload"), F.when(model, F.lit(MARKERS["out"])).otherwise(F.element_at(marker, F.col(role))).alias("marker"))
    t = t.withColumn("before", F.lag("model").over(w)).withColumn("is_last", F.lead("model").over(w).isNull())
    none = F.array().cast(FRAGMENT)
    hand = lambda side: F.array(fragment(EOT, side, True), fragment("\n", side))
    flips = F.coalesce(F.col("before") != F.col("model"), F.lit(False))
    said = F.when(~F.col("model") | ~T.is_blank(F.col("payload")), block(F.col("marker"), F.col("payload"), F.col("model"))).otherwise(none)
    parts = F.concat(F.when(flips, hand(F.col("before"))).otherwise(none), said, F.when(F.col("is_last"), hand(F.col("model"))).otherwise(none))
    return t.select(key, order, "model", flips.alias("flips"), "is_last", parts.alias("parts"))


def conversations(turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: (key, parts, ends_on_model), ``parts`` its fragments in order."""
    t = turn_fragments(turns, key, order, role, text)
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "parts"))), lambda x: x["parts"]))
    return t.groupBy(key).agg(parts.alias("parts"), F.bool_or(F.col("is_last") & F.col("model")).alias("ends_on_model"))


def text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["value"]), "")
