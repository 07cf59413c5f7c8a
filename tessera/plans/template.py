"""The text form of a conversation, for trusted payloads.

Unlike the compiler's plan it keeps JSON in source order with blanks after
separators, does not check tool names and ids, and gives no guarantee against
payloads that spell markers. Returns the text and the spans that the model is to
learn.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from importlib import resources
from pathlib import Path
from typing import Any

from tessera.functions.canonical import is_list
from tessera.protocol import EOT, MARKERS, MODEL_ROLE, PAYLOAD_KEY, RUNTIME_BLOCK, TEXT_KEY, Invalid


def load_template(path: str | Path | None = None) -> str:
    """The text of a template for other renderers: that at ``path`` (no link, and it must exist), else the packaged one."""
    if path is None:
        return resources.files("tessera.plans").joinpath("conversation.jinja").read_text(encoding="utf-8")
    given = Path(path).expanduser()
    if given.is_symlink() or not given.is_file():
        raise FileNotFoundError(f"no template at {given}")
    return given.read_text(encoding="utf-8")


def to_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def item_text(value: Any) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, Mapping):
        for key in (PAYLOAD_KEY, TEXT_KEY):
            if key in value:
                return str(value[key])
    return None


def content(value: Any) -> str:
    if value is None:
        return ""
    text = item_text(value)
    if text is not None:
        return text
    if isinstance(value, Mapping):
        return to_json(value)
    if not is_list(value):
        raise Invalid("payload must be text, an object or a list of texts")
    parts = [item_text(x) for x in value]
    if None in parts:
        raise Invalid("content items must hold text")
    return "".join(parts)


class Writer:
    """Collects text; spans written with ``learn`` are remembered."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.spans = 0, []

    def put(self, text: str, learn: bool) -> None:
        if learn and text:
            if self.spans and self.spans[-1][1] == self.size:
                self.spans[-1] = (self.spans[-1][0], self.size + len(text))
            else:
                self.spans.append((self.size, self.size + len(text)))
        self.parts.append(text)
        self.size += len(text)

    def block(self, kind: str, text: str, learn: bool) -> None:
        self.put(f"{MARKERS[kind]}\n{text}\n", learn)


def action(call: Mapping) -> str:
    body = call.get("function") or call
    if not body.get("name"):
        raise Invalid("every tool call needs a name")
    if not isinstance(body.get("arguments"), Mapping):
        raise Invalid("tool arguments must be an object")
    shown = ({"id": call["id"]} if call.get("id") else {}) | {"type": "tool", "name": body["name"], "arguments": body["arguments"]}
    return "{" + ",".join(f"{to_json(k)}:{to_json(v)}" for k, v in shown.items()) + "}"


def render(messages: list[Mapping], tools: Any = None, ctrl: Any = None, caps: Any = None, *, generation_prompt: bool = False, preserve_thinking: bool = True, eos: str = "") -> tuple[str, list[tuple[int, int]]]:
    """The text and the learnt spans; raises Invalid."""
    listed = tools if is_list(tools) and len(tools) else None
    if listed is not None and caps is not None:
        raise Invalid("either tools or caps, not both")
    w, model = Writer(), None
    if ctrl is not None:
        w.block("ctrl", to_json(ctrl) if isinstance(ctrl, Mapping) else str(ctrl), False)
        model = False
    if caps is not None:
        if not isinstance(caps, Mapping) and not is_list(caps):
            raise Invalid("caps must be an object or a list")
        w.block("caps", to_json(caps), False)
        model = False
    elif listed is not None:
        w.block("caps", f'{{"tools":{to_json(listed)}}}', False)
        model = False
    for m in messages:
        role = m.get("role")
        if role != MODEL_ROLE and role not in RUNTIME_BLOCK:
            raise Invalid("a message needs one of the protocol's roles")
        now = role == MODEL_ROLE
        if model is not None and now != model:
            w.put(f"{EOT}\n", model)
        model = now
        if not now:
            text = None
            if RUNTIME_BLOCK[role] == "obs" and m.get("tool_call_id"):
                if "content" not in m:
                    raise Invalid("an observation needs content")
                text = f'{{"caused_by":{to_json(m["tool_call_id"])},"content":{to_json(m["content"])}}}'
            w.block(RUNTIME_BLOCK[role], content(m.get("content")) if text is None else text, False)
            continue
        thought = m.get("reasoning_content") or m.get("thinking")
        if preserve_thinking and thought:
            w.block("think", content(thought), True)
        said = content(m.get("content"))
        if said.strip():
            w.block("out", said, True)
        calls = m.get("tool_calls") or []
        if isinstance(calls, (str, Mapping)):
            raise Invalid("tool_calls must be a list")
        for call in calls:
            w.block("act", action(call), True)
    if generation_prompt and model:
        raise Invalid("a generation prompt must follow the runtime side")
    if model is not None:
        w.put(f"{EOT}\n", model)
    if not generation_prompt:
        w.put(eos, bool(model))
    return "".join(w.parts), w.spans
