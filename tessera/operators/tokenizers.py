"""Tokenizers: bytes, longest match over a compact trie, and one that runs apart under a time limit.

A tokenizer has ``eos``, ``ids`` (the structural ids), ``size`` and either
``encode_batch(texts) -> list of id lists`` or the call
``tokenizer(texts, add_special_tokens=False, split_special_tokens=True, padding=False,
truncation=False)["input_ids"]``, by which markers in payloads stay text. It must
pickle, as it travels to the executors once per task.
"""

from __future__ import annotations

import json
import multiprocessing as mp
import os
from collections.abc import Callable, Sequence
from queue import Empty
from typing import Any

import numpy as np

from tessera.protocol import MARKERS, Invalid, check_ids


#: The only options under which payload text can't become structure.
SECURE = {"add_special_tokens": False, "split_special_tokens": True, "padding": False, "truncation": False}


class Secure:
    """The call of third-party tokenizers, which refuses every option but the secure ones."""

    def __call__(self, texts: Sequence[str], **options: Any) -> dict[str, list[list[int]]]:
        if options != SECURE:
            raise Invalid(f"only these options are secure: {SECURE}")
        return {"input_ids": self.encode_batch(texts)}


def batch_encode(tokenizer: Any, texts: Sequence[str]) -> list[list[int]]:
    """Ids of all texts, by the tokenizer's batch, its call, or one by one."""
    if hasattr(tokenizer, "encode_batch"):
        found = tokenizer.encode_batch(texts)
    elif callable(tokenizer):
        found = tokenizer(list(texts), **SECURE)["input_ids"]
    else:
        found = [one_encode(tokenizer, t) for t in texts]
    if len(found) != len(texts):
        raise TokenizerFailure("the tokenizer answered another number of texts")
    return found


def one_encode(tokenizer: Any, text: str) -> list[int]:
    """Ids of one text, by the tokenizer's scalar method where it has one."""
    if hasattr(tokenizer, "encode"):
        return tokenizer.encode(text, add_special_tokens=False, split_special_tokens=True)
    return batch_encode(tokenizer, [text])[0]


class ByteTokenizer(Secure):
    """One id per UTF-8 byte: EOS 0, markers 1 to 10, byte b as 11 + b."""

    eos, size = 0, 267
    ids = {m: i + 1 for i, m in enumerate(MARKERS.values())}

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        return [[b + 11 for b in t.encode()] for t in texts]


def byte_level() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TrieTokenizer(Secure):
    """Greedy longest match. A piece in which some position matches nothing is one unknown id as a whole.

    The trie is kept as flat int32 arrays (offsets, sorted edge characters, edge
    targets, terminal ids), which are small to send; a dictionary of edges is made
    from them on first use.
    """

    def __init__(self, vocab: dict[str, int], unknown: str, eos: int, ids: dict[str, int], byte_pieces: bool = False) -> None:
        if unknown not in vocab:
            raise Invalid("the unknown token is not in the vocabulary")
        self.unknown, self.eos, self.byte_pieces = vocab[unknown], eos, byte_pieces
        self.size = max([*vocab.values(), eos, *ids.values()]) + 1
        self.ids = check_ids(ids, self.size)
        if set(self.ids.values()) & set(vocab.values()):
            raise Invalid("a structural id is also an id of the vocabulary")
        self.offsets, self.chars, self.targets, self.terminals = flatten({k: v for k, v in vocab.items() if k and k != unknown})
        self.edges: dict[int, int] | None = None

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"edges": None}

    def match(self, piece: str) -> list[int] | None:
        """Ids of the greedy longest prefixes, or None where nothing matches."""
        if self.edges is None:
            origin = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
            self.edges = dict(zip((origin.astype(np.int64) << 21 | self.chars).tolist(), self.targets.tolist()))
            self.ends = self.terminals.tolist()
        edges, ends, out, at, points = self.edges, self.ends, [], 0, [ord(c) for c in piece]
        while at < len(points):
            node, found, to = 0, -1, at
            for k in range(at, len(points)):
                node = edges.get(node << 21 | points[k], -1)
                if node < 0:
                    break
                if ends[node] >= 0:
                    found, to = ends[node], k + 1
            if found < 0:
                return None
            out.append(found)
            at = to
        return out

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        table = byte_level() if self.byte_pieces else None
        out = []
        for text in texts:
            piece = "".join(table[b] for b in text.encode()) if table else text
            found = self.match(piece)
            out.append([self.unknown] if found is None else found)
        return out


def flatten(vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Breadth-first arrays of the trie of ``vocab``."""
    nodes: list[dict[str, int]] = [{}]
    ends = [-1]
    for token in sorted(vocab):
        at = 0
        for c in token:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                ends.append(-1)
            at = nodes[at][c]
        ends[at] = vocab[token]
    order, rank = [0], {0: 0}
    for n in order:
        for c in sorted(nodes[n]):
            rank[nodes[n][c]] = len(order)
            order.append(nodes[n][c])
    count = [len(nodes[n]) for n in order]
    chars = [ord(c) for n in order for c in sorted(nodes[n])]
    targets = [rank[nodes[n][c]] for n in order for c in sorted(nodes[n])]
    as32 = lambda x: np.array(x, dtype=np.int32)
    return as32(np.concatenate([[0], np.cumsum(count)])), as32(chars), as32(targets), as32([ends[n] for n in order])


def markers_of(config: dict[str, Any]) -> dict[str, int]:
    """The structural ids of a serialised tokenizer: those of its added tokens; markers that it lacks get new ids behind all others."""
    taken = {**{str(k): int(v) for k, v in (config.get("model") or {}).get("vocab", {}).items()}, **{t["content"]: int(t["id"]) for t in config.get("added_tokens") or []}}
    added = {t["content"]: int(t["id"]) for t in config.get("added_tokens") or []}
    free = iter(range(max(taken.values(), default=-1) + 1, 1 << 31))
    return {m: added[m] if m in added else next(free) for m in MARKERS.values()}


def from_backend_json(text: str, eos: int | str, ids: dict[str, int] | None = None, expected_size: int | None = None) -> TrieTokenizer:
    """A trie tokenizer from a serialised tokenizer, if it has exactly the supported form. ``eos`` is an id or a token's text."""
    config = json.loads(text)
    model, pieces = config.get("model") or {}, config.get("pre_tokenizer") or {}
    right = (model.get("type") == "WordPiece", not model.get("continuing_subword_prefix"), model.get("max_input_chars_per_word") == 2**31 - 1, pieces.get("type") == "ByteLevel", pieces.get("use_regex") is False, config.get("normalizer") is None)
    vocab = model.get("vocab")
    if not all(right) or not isinstance(vocab, dict):
        raise Invalid("not a byte-level longest-match tokenizer")
    if expected_size is not None and len(vocab) != expected_size:
        raise Invalid("the vocabulary has another size than stated")
    if isinstance(eos, str):
        named = {t["content"]: int(t["id"]) for t in config.get("added_tokens") or []}
        if eos not in named and eos not in vocab:
            raise Invalid("the tokenizer has no such end-of-sequence token")
        eos = named.get(eos, vocab.get(eos))
    ids = markers_of(config) if ids is None else ids
    own = {str(k): int(v) for k, v in vocab.items() if k not in ids}
    return TrieTokenizer(own, str(model.get("unk_token")), int(eos), ids, byte_pieces=True)


class TokenizerTimeout(RuntimeError):
    """The process did not answer in time and was ended."""


class TokenizerFailure(RuntimeError):
    """The process reported an error."""


def serve(make: Callable[[], Any], requests, replies, parent: int) -> None:
    """The child's loop; it ends when it is told to or when its parent is gone."""
    try:
        tokenizer = make()
    except BaseException as bad:  # noqa: BLE001 - reported to the parent
        replies.put((0, None, f"{type(bad).__name__}: {bad}"))
        return
    replies.put((0, [], None))
    while True:
        try:
            job = requests.get(timeout=2)
        except Empty:
            if os.getppid() != parent:
                return
            continue
        if job is None:
            return
        number, texts = job
        try:
            replies.put((number, batch_encode(tokenizer, texts), None))
        except Exception as bad:  # noqa: BLE001 - reported to the parent
            replies.put((number, None, f"{type(bad).__name__}: {bad}"))


class IsolatedTokenizer:
    """Runs ``make()`` in a process of its own; a batch that takes longer than ``timeout`` seconds ends that process.

    The process is spawned, not forked, as its parent has threads; it starts at the
    first batch (within ``startup`` seconds) and again after a timeout. Use it for
    third-party tokenizers that may hang; in a Spark task it lives as long as the
    worker.
    """

    def __init__(self, make: Callable[[], Any], timeout: float, ids: dict[str, int], eos: int, size: int, startup: float = 120.0) -> None:
        if not (0 < timeout < float("inf")):
            raise Invalid("the time limit must be positive and finite")
        self.make, self.timeout, self.startup, self.ids, self.eos, self.size = make, timeout, startup, ids, eos, size
        self.process, self.number, self.closed = None, 0, False

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"process": None, "requests": None, "replies": None}

    def __enter__(self) -> IsolatedTokenizer:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
        self.closed = True

    def start(self) -> None:
        context = mp.get_context("spawn")
        self.requests, self.replies = context.Queue(), context.Queue()
        self.process = context.Process(target=serve, args=(self.make, self.requests, self.replies, os.getpid()), daemon=True)
        self.process.start()
        self.answer(0, self.startup)

    def answer(self, number: int, seconds: float) -> list[list[int]]:
        """The reply to request ``number``."""
        try:
            got, found, error = self.replies.get(timeout=seconds)
        except Empty:
            self.close()
            raise TokenizerTimeout(f"no answer within {seconds} s") from None
        if got != number:
            self.close()
            raise TokenizerFailure("the answer is to another request")
        if error is not None:
            if not number:
                self.close()
            raise TokenizerFailure(error)
        return found

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        if self.closed:
            raise TokenizerFailure("the tokenizer is closed")
        if self.process is None or not self.process.is_alive():
            self.start()
        self.number += 1
        self.requests.put((self.number, list(texts)))
        found = self.answer(self.number, self.timeout)
        if len(found) != len(texts):
            self.close()
            raise TokenizerFailure("the answer is of another number of texts")
        return found

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join(5)
            self.process = None
