"""Canonical JSON and its relatives for values of open schema (plain Python, used inside Arrow functions).

Spark's VARIANT and ``to_json`` change numbers, drop nulls and sort keys in
another order, so fingerprints over open JSON need this form: keys sorted by code
point, no blanks, raw non-ASCII, finite numbers only.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Mapping
from typing import Any

from tessera.protocol import Invalid

LITERAL_LIMIT = 1_000_000


def canonical(value: Any) -> str:
    """The canonical JSON text; raises Invalid for what is not finite JSON or not UTF-8."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        text.encode()
    except (TypeError, ValueError, RecursionError) as bad:
        raise Invalid("not finite canonical JSON") from bad
    return text


def decode(value: Any, what: str = "value") -> Any:
    """A string is parsed as JSON; anything else passes."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except (json.JSONDecodeError, RecursionError) as bad:
            raise Invalid(f"{what}: no JSON") from bad
    return value


def decode_lenient(value: Any, what: str = "value") -> Any:
    """As ``decode``, but a bracketed text of bounded length may be a Python literal; code is never evaluated."""
    try:
        return decode(value, what)
    except Invalid:
        if len(value) > LITERAL_LIMIT or value.lstrip()[:1] not in ("{", "["):
            raise
    try:
        found = ast.literal_eval(value)
    except (ValueError, SyntaxError, MemoryError, RecursionError) as bad:
        raise Invalid(f"{what}: neither JSON nor a literal") from bad
    if not isinstance(found, (dict, list)):
        raise Invalid(f"{what}: an object or array is needed")
    return found


def required(value: Any, what: str) -> str:
    """Text that isn't blank, stripped."""
    if not isinstance(value, str) or not (text := value.strip()):
        raise Invalid(f"{what}: text is needed")
    return text


def is_list(value: Any) -> bool:
    return not isinstance(value, (str, bytes, Mapping)) and hasattr(value, "__len__") and hasattr(value, "__getitem__")


def fingerprint(messages_json: str, tools_json: str) -> str:
    """SHA-256 (hex) of the object with the two parts, which are canonical already."""
    return hashlib.sha256(f'{{"messages":{messages_json},"tools":{tools_json}}}'.encode()).hexdigest()


def check_budget(value: Any, max_bytes: int, max_nodes: int, max_depth: int) -> None:
    """Raises Invalid if a raw value has too many nodes (containers, keys, leaves), levels, or bytes of text. Iterative."""
    nodes = size = 0
    open_: list[tuple[Any, int]] = [(value, 0)]
    while open_:
        item, depth = open_.pop()
        nodes += 1
        if depth > max_depth or nodes > max_nodes:
            raise Invalid("raw value is too deep or has too many nodes")
        if isinstance(item, str):
            size += len(item.encode("utf-8", "surrogatepass"))
        elif isinstance(item, (bytes, bytearray)):
            size += len(item)
        elif isinstance(item, Mapping):
            for pair in item.items():
                open_.extend((x, depth + 1) for x in pair)
        elif isinstance(item, (list, tuple)):
            open_.extend((x, depth + 1) for x in item)
        if size > max_bytes:
            raise Invalid("raw value has too much text")
