"""The structural vocabulary of the conversation protocol.

A stream is a run of transmissions; a transmission is one or more typed blocks
closed by the end-of-transmission marker. Ten markers are structural; payload
text can never produce one, because markers enter as ids and never as text.
"""

from __future__ import annotations

from collections.abc import Mapping

KINDS = ("ctrl", "sys", "dev", "caps", "usr", "obs", "think", "out", "act", "eot")
MARKERS = {k: f"<|{k}|>" for k in KINDS}
EOT = MARKERS["eot"]

#: Runtime-side roles and the block that each opens; ``assistant`` is the model's side.
RUNTIME_BLOCK = {"system": "sys", "developer": "dev", "user": "usr", "tool": "obs", "observation": "obs"}
MODEL_ROLE = "assistant"
ROLES = frozenset((*RUNTIME_BLOCK, MODEL_ROLE))

#: Other names of roles found in source data.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "function": "tool"}

#: Keys under which structured content carries its own text; both are names of the wire format.
PAYLOAD_KEY, TEXT_KEY = "smi_payload", "text"
IGNORED = -100


class Invalid(ValueError):
    """A row that the protocol does not admit."""


def check_ids(ids: Mapping[str, int], vocab_size: int | None = None) -> dict[str, int]:
    """The ids of the ten markers, checked: all there, distinct, not negative, within the vocabulary where its size is known."""
    if set(ids) != set(MARKERS.values()):
        raise Invalid("the id map must hold exactly the ten structural markers")
    values = list(ids.values())
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in values) or len(set(values)) != len(values):
        raise Invalid("structural ids must be distinct integers from 0")
    if vocab_size is not None and max(values) >= vocab_size:
        raise Invalid("a structural id lies outside the vocabulary")
    return dict(ids)
