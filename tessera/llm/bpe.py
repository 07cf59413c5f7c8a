"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Encoding. Let enc(p) be the BPE encoding of a byte string p. Its last token t is
the one token that ends p and may follow the last token of enc(p without t);
two tokens may follow each other when BPE leaves their joined bytes as just that
pair. So the encodings of all prefixes of a piece form a tree, and any longer
piece's encoding runs through a node from which some vocabulary token reaches
past the bytes read so far. The transducer's state is the set of those live
nodes, each with its tokens since their common ancestor; reading a byte adds a
node, drops dead ones, and emits the tokens that all live nodes now share. No
live node lies further back than the longest token, which bounds the lookahead.
States and transitions are made when first met and then looked up. The result
equals merging by rank, which the tests check.

Texts are cut into pieces by the vocabulary's pattern; each worker keeps encoded
pieces up to ``PIECES`` and transducer states up to ``STATES``, and starts afresh
beyond (a matter of speed only).

Decoding. The streaming decoder takes tokens in any portions and returns the text
that is complete, keeping at most three bytes of an unfinished character, with a
UTF-8 automaton (malformed bytes become U+FFFD as the standard recommends).

Defined results: null and empty texts give no tokens and round_trip true; ids may be
null or repeated, and each row is encoded by itself, so a repeated row gives its tokens
again; a very long piece is one run of the transducer, with no cut.
"""

from __future__ import annotations

import base64
import os
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm import textkit as tk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STATES, PIECES = 250_000, 200_000
START, ANY = -1, -2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a ``base64 rank`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """BPE by its definition: join the adjacent pair of least rank until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Byte-driven; ``encode`` runs it over one piece."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sorted = sorted(ranks)
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token in sorted(self.bytes_of):
            self.compile_merge(token)
        self.reaches: dict[tuple[int, bytes], bool] = {}
        self.reset()

    def compile_merge(self, token: int) -> None:
        """Record the last merge that makes ``token``; the merges of lower rank are known."""
        b = self.bytes_of[token]
        self.halves[token] = (token, token)
        for k in range(1, len(b)):
            left, right = self.ranks.get(b[:k], token), self.ranks.get(b[k:], token)
            if left < token and right < token and self.may_follow(left, right):
                self.pairs[left, right], self.halves[token] = token, (left, right)
                break

    def may_follow(self, s: int, t: int) -> bool:
        """Whether BPE leaves the bytes of s and t as just these two tokens.

        Undoes the later of the merges that touch the border, again and again; a
        merge across the border that ranks before the one undone would have won.
        """
        limit, pairs, halves = 1 << 60, self.pairs, self.halves
        while True:
            if pairs.get((s, t), limit) < limit:
                return False
            if s > t:
                limit, s = s, halves[s][1]
                if s == limit:
                    limit, t = t + 1, halves[t][0]
                    if t + 1 == limit:
                        return True
            else:
                limit, t = t + 1, halves[t][0]
                if t + 1 == limit:
                    limit, s = s, halves[s][1]
                    if s == limit:
                        return True

    def alive(self, last: int, rest: bytes) -> bool:
        """Whether some longer token begins with ``rest`` and may follow ``last``; taken for granted of one byte, which begins many."""
        if len(rest) < 2:
            return True
        found = self.reaches.get((last, rest))
        if found is None:
            found, at = False, bisect_right(self.sorted, rest)
            while at < len(self.sorted) and (b := self.sorted[at]).startswith(rest):
                if last == START or self.may_follow(last, self.ranks[b]):
                    found = True
                    break
                at += 1
            self.reaches[last, rest] = found
        return found

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.reaches.clear()
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self.state((b"", ((0, ()),), START))

    def state(self, key: tuple) -> int:
        """Number of the state (pending bytes, live nodes as (offset, tokens since the common ancestor), token before those)."""
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
        return found

    def move(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one byte and the tokens that became certain."""
        pending, nodes, base = self.states[at]
        pending += bytes((byte,))
        new = None
        for off, path in nodes:
            token = self.ranks.get(pending[off:])
            if token is not None:
                last = path[-1] if path else base
                if last == START or self.may_follow(last, token):
                    new = (len(pending), (*path, token))
                    break
        if new is None:
            raise ValueError("the vocabulary lacks a single byte")
        live = [(off, path) for off, path in nodes if self.alive(path[-1] if path else base, pending[off:])] + [new]
        paths = [path for _, path in live]
        same = 0
        while all(len(p) > same for p in paths) and len({p[same] for p in paths}) == 1:
            same += 1
        sure = paths[0][:same]
        cut = live[0][0]
        if same:
            base = sure[-1]
        if all(len(p) > same for p in paths):
            base = ANY
        found = (self.state((pending[cut:], tuple((off - cut, path[same:]) for off, path in live), base)), sure)
        self.moves[at << 8 | byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        at, out, moves = self.start, [], self.moves
        for byte in piece:
            step = moves.get(at << 8 | byte)
            if step is None:
                step = self.move(at, byte)
            at, sure = step
            if sure:
                out += sure
        pending, nodes, _ = self.states[at]
        return out + [*nodes[-1][1]]


class Encoder(dict):
    """Pieces to their tokens as int32 bytes; missing ones go through the transducer."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.machine, self.pattern = Transducer(ranks), regex.compile(PATTERN)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = array("i", self.machine.encode(piece.encode())).tobytes()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """All tokens of a text as int32 bytes."""
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def tidy(self) -> None:
        """Once full, become the older generation; pieces still in use move back from there."""
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()


def utf8_need(first: int) -> tuple[int, int, int]:
    """Continuation bytes after a first byte, and the range of the next one; (-1, ..) for a byte that starts nothing."""
    if first < 0x80:
        return 0, 0, 0
    if 0xC2 <= first <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= first <= 0xEF:
        return 2, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first <= 0xF4:
        return 3, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return -1, 0, 0


class Utf8Machine:
    """Incremental UTF-8: ``step`` maps (unfinished bytes, more bytes) to (text, unfinished bytes)."""

    @staticmethod
    def step(held: bytes, more: bytes) -> tuple[str, bytes]:
        out, char, need, lo, hi = [], held, 0, 0x80, 0xBF
        if held:
            need, lo, hi = utf8_need(held[0])
            need -= len(held) - 1
            if len(held) > 1:
                lo, hi = 0x80, 0xBF
        for b in more:
            if char:
                if lo <= b <= hi:
                    char, need, lo, hi = char + bytes((b,)), need - 1, 0x80, 0xBF
                    if not need:
                        out.append(char.decode())
                        char = b""
                    continue
                out.append("\ufffd")
                char = b""
            need, lo, hi = utf8_need(b)
            if need > 0:
                char = bytes((b,))
            else:
                out.append(chr(b) if need == 0 else "\ufffd")
        return "".join(out), char


class Decoder:
    """Streaming decoder; transitions on (unfinished bytes, token) are made when first met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.table[i] = b
        plain = (Utf8Machine.step(b"", b) for b in self.table)
        self.whole = [text if not held else None for text, held in plain]
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.held = b""

    def feed(self, tokens: list[int]) -> str:
        """The text that is complete after these tokens."""
        parts = list(map(self.whole.__getitem__, tokens))
        if not self.held and None not in parts:
            return "".join(parts)
        out, held, moves = [], self.held, self.moves
        for token, text in zip(tokens, parts):
            if held or text is None:
                step = moves.get((held, token))
                if step is None:
                    step = moves[held, token] = Utf8Machine.step(held, self.table[token])
                text, held = step
            out.append(text)
        self.held = held
        return "".join(out)

    def end(self) -> str:
        """What remains: one replacement character for an unfinished one."""
        rest, self.held = "\ufffd" if self.held else "", b""
        return rest


#: Machines of this worker by vocabulary file; a reused worker keeps what it has determinised.
MACHINES: dict[str, tuple[Encoder, Decoder]] = {}


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary file to all executors, which may not have it at that place; returns its path."""
    if os.path.isfile(path):
        spark.sparkContext.addFile(path)
    return path


def machines(path: str) -> tuple[Encoder, Decoder]:
    if path not in MACHINES:
        ranks = read_ranks(path if os.path.isfile(path) else SparkFiles.get(os.path.basename(path)))
        MACHINES[path] = Encoder(ranks), Decoder(ranks)
    return MACHINES[path]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text``, with ``tokens``, ``n_tokens`` and ``round_trip`` (the decoded tokens equal the text); columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("text", "tokens", "n_tokens", "round_trip")]
    source, vocabulary = docs.select(*kept, "text"), shipped(docs.sparkSession, vocabulary)
    schema = docs.select(*kept).schema.add("tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("round_trip", T.BooleanType())

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = machines(vocabulary)
        found, size, same = [], [], []
        for text in part.column("text").to_pylist():
            tokens = encoder.encode(text or "")
            ids = np.frombuffer(tokens, np.int32)
            found.append(tokens)
            size.append(len(ids))
            same.append(decoder.feed(ids.tolist()) + decoder.end() == (text or ""))
        encoder.tidy()
        flat = np.frombuffer(b"".join(found), np.int32)
        cols = [part.column(c) for c in kept]
        cols += [tk.ragged(flat, np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(size, pa.int32()), pa.array(same)]
        return pa.RecordBatch.from_arrays(cols, names=[*kept, "tokens", "n_tokens", "round_trip"])

    return source.mapInArrow(tk.over_slices(make, "text", 4_000_000), schema)


def decode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``text`` made from ``tokens``; a null list gives a null text."""
    kept = [c for c in docs.columns if c != "text"]
    schema, vocabulary = docs.select(*kept).schema.add("text", T.StringType()), shipped(docs.sparkSession, vocabulary)

    def run(batches):
        decoder = machines(vocabulary)[1]
        for batch in batches:
            texts = [None if t is None else decoder.feed(t) + decoder.end() for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return docs.select(*kept).mapInArrow(run, schema)
