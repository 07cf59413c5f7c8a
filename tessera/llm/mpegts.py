"""MPEG transport streams in a binary column: demultiplex, check, reassemble, index.

``demux`` turns each medium into one row per program and elementary stream: its program and
type from the program tables (PAT and PMT, sections reassembled over packets and
CRC-checked), continuity-counter errors, the reassembled elementary bytes, the
time stamps of its packets and its random-access points.

Headers of all packets of a medium are read at once as columns of a
[packets, 188] matrix; only tables and packet starts are visited singly.

Defined results: null, empty and unsynchronised media, and media without a valid
program table, give no row; leading bytes before the first sync byte and a torn
last packet are skipped; packets with lost sync or the error flag are dropped
and counted; a repeated packet (same counter and bytes) is legal once and
dropped; an elementary packet that a counter gap or a wrong length touches is
counted as broken and its bytes are kept out of ``data``; a stream that programs
share is a row of each; the clock is read on the pid that the program's table
names, and on the stream's own where that has none; a stream without a
time stamp has empty lists. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

SIZE, NULL_PID = 188, 0x1FFF
SCHEMA = """media_id bigint, program int, pid int, stream_type int, n_packets int, continuity_errors int, dropped_packets int,
n_pes int, broken_pes int, pts array<bigint>, dts array<bigint>, random_access array<struct<packet:int,pts:bigint>>, pcr_first bigint, pcr_last bigint, data binary"""


@functools.lru_cache(maxsize=1)
def crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1 & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


@functools.lru_cache(maxsize=4096)
def crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own checksum."""
    c, table = 0xFFFFFFFF, crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


# --- a multiplexer, for tables that hold no media and for tests ---------------


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc(head).to_bytes(4, "big")


def stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0xE) | 1]) + (((t >> 15 & 0x7FFF) << 1) | 1).to_bytes(2, "big") + (((t & 0x7FFF) << 1) | 1).to_bytes(2, "big")


def pes(payload: bytes, pts: int, dts: int | None = None, stream_id: int = 0xE0) -> bytes:
    stamps = stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
    rest = bytes([0x80, 0x80 if dts is None else 0xC0, len(stamps)]) + stamps + payload
    return b"\0\0\1" + bytes([stream_id]) + (len(rest) if len(rest) < 65536 else 0).to_bytes(2, "big") + rest


def packets(pid: int, unit: bytes, counter: int, access: bool = False, pcr: int | None = None) -> list[bytes]:
    """The transport packets of one unit (a PES packet, or a section with its pointer)."""
    out, at = [], 0
    while at < len(unit):
        fields = b""
        if not at and (access or pcr is not None):
            fields = bytes([0x40 * access | 0x10 * (pcr is not None)]) + (b"" if pcr is None else (pcr << 15 | 0x7E00).to_bytes(6, "big"))
        room = SIZE - 4 - (1 + len(fields) if fields else 0)
        body = unit[at : at + room]
        gap = SIZE - 4 - len(body)
        if gap:
            fields = b"" if gap == 1 else (fields or b"\0").ljust(gap - 1, b"\xff")
            adaptation = bytes([gap - 1]) + fields
        else:
            adaptation = b""
        flags = 0x30 if adaptation else 0x10
        out.append(bytes([0x47, (0x40 if not at else 0) | pid >> 8, pid & 0xFF, flags | (counter + len(out)) & 15]) + adaptation + body)
        at += len(body)
    return out


def mux(video: bytes, extra: bytes = b"", unit: int = 1400, every: int = 8, lose: int = -1) -> bytes:
    """One program: ``video`` in access units of ``unit`` bytes (pid 0x100) and ``extra`` as private data (0x101). ``lose`` drops that packet."""
    streams = [(0x1B, 0x100), (0x06, 0x101)] if extra else [(0x1B, 0x100)]
    pmt = b"\xe1\x00\xf0\x00" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for t, p in streams)
    out = packets(0, b"\0" + section(0, 1, b"\0\1\xf0\0"), 0) + packets(0x1000, b"\0" + section(2, 1, pmt), 0)
    if extra:
        out += packets(0x101, pes(extra, 900, stream_id=0xBD), 0)
    counter = 0
    for k in range(max(1, -(-len(video) // unit))):
        pts = 3600 + 3003 * k
        new = packets(0x100, pes(video[k * unit : (k + 1) * unit], pts, pts - 1800), counter, k % every == 0, pts - 3600 if k % every == 0 else None)
        counter += len(new)
        out += new
    if 0 <= lose < len(out):
        del out[lose]
    return b"".join(out)


# --- the demultiplexer -------------------------------------------------------


@dataclass
class Stream:
    program: int
    pid: int
    kind: int
    n_packets: int = 0
    errors: int = 0
    n_pes: int = 0
    broken: int = 0
    pts: list[int] = field(default_factory=list)
    dts: list[int] = field(default_factory=list)
    access: list[tuple[int, int | None]] = field(default_factory=list)
    pcr: list[int] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)


def align(media: bytes) -> int:
    """Offset of the first packet: the sync byte that most often recurs at packet distance over the next 20 packets; -1 if in no more than half."""
    best, found = 0.5, -1
    for at in range(min(SIZE, len(media) - SIZE + 1)):
        if media[at] == 0x47:
            seen = media[at : at + 20 * SIZE : SIZE]
            if (share := seen.count(0x47) / len(seen)) > best:
                best, found = share, at
    return found


def read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def sections(rows: list[int], raw: bytes, start: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Complete sections with a right checksum, from the packets ``rows`` of one pid."""
    out: list[bytes] = []
    held: bytes | None = None
    for i in rows:
        body = raw[i * SIZE + start[i] : (i + 1) * SIZE]
        if begins[i]:
            if not body:
                continue
            if held is not None:
                held += body[1 : 1 + body[0]]
                take(held, out)
            held = body[1 + body[0] :]
        elif held is not None:
            held += body
        if held is not None:
            held = take(held, out)
    return out


def take(held: bytes, out: list[bytes]) -> bytes | None:
    """Move complete sections to ``out``; the rest, or None past stuffing."""
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < size:
            return held
        if crc(held[:size]) == 0:
            out.append(held[:size])
        held = held[size:]
    return held if held and held[0] != 0xFF else None


def demux_one(media: bytes) -> tuple[list[Stream], int]:
    """The elementary streams of a medium, and how many packets were dropped."""
    at = align(media)
    if at < 0:
        return [], 0
    n = (len(media) - at) // SIZE
    raw = media[at : at + n * SIZE]
    m = np.frombuffer(raw, np.uint8).reshape(n, SIZE)
    good = (m[:, 0] == 0x47) & (m[:, 1] & 0x80 == 0)
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]
    begins, afc, cc = m[:, 1] & 0x40 != 0, m[:, 3] >> 4 & 3, m[:, 3] & 15
    extra = afc & 2 != 0
    alen = np.where(extra, m[:, 4], 0).astype(np.int32)
    flags = np.where(extra & (alen > 0), m[:, 5], 0)
    start = np.where(extra, 5 + alen, 4)
    full = (afc & 1 != 0) & (start < SIZE)
    rows_of = {int(p): np.flatnonzero(good & (pid == p)) for p in np.unique(pid[good]) if p != NULL_PID}
    dropped = int(n - good.sum())
    pmts: dict[int, list[int]] = {}
    for s in sections([int(i) for i in rows_of.get(0, ()) if full[i]], raw, start, begins):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                if number := int.from_bytes(s[k : k + 2], "big"):
                    pmts.setdefault(int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF, []).append(number)
    kinds: dict[tuple[int, int], int] = {}
    clock_of: dict[int, int] = {}
    for pmt, numbers in sorted(pmts.items()):
        for s in sections([int(i) for i in rows_of.get(pmt, ()) if full[i]], raw, start, begins):
            number = own if (own := int.from_bytes(s[3:5], "big")) in numbers else numbers[-1]
            k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            if s[0] == 2:
                clock_of[number] = int.from_bytes(s[8:10], "big") & 0x1FFF
            while s[0] == 2 and k + 5 <= len(s) - 4:
                p = int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF
                kinds[number, p] = s[k]
                k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)

    def clock(p: int) -> list[int]:
        rows = rows_of.get(p, np.zeros(0, np.int64))
        stamps = [int.from_bytes(raw[i * SIZE + 6 : i * SIZE + 12], "big") for i in rows[(flags[rows] & 0x10 != 0) & (alen[rows] >= 7)]]
        return [(v >> 15) * 300 + (v & 0x1FF) for v in stamps]

    clocks = {p: clock(p) for p in {*clock_of.values(), *(p for _, p in kinds)}}
    streams = {p: Stream(0, p, 0) for _, p in kinds}
    for p, stream in streams.items():
        rows = rows_of.get(p, np.zeros(0, np.int64))
        stream.n_packets = len(rows)
        gap = np.zeros(len(rows), bool)
        keep = full[rows].copy()
        if len(rows) > 1:
            step = (cc[rows[1:]].astype(np.int16) - cc[rows[:-1]]) & 15
            free = flags[rows[1:]] & 0x80 != 0
            twin = (step == 0) & full[rows[1:]] & (m[rows[1:]] == m[rows[:-1]]).all(1)
            gap[1:] = ~free & ~twin & (step != full[rows[1:]])
            keep[1:] &= ~twin
            stream.errors = int(gap.sum())
        if not len(rows):
            continue
        first = np.flatnonzero(begins[rows] & keep)
        lost = np.concatenate([[0], np.cumsum(gap)])
        if len(first) and first[0] or not len(first):
            stream.broken += int(keep[: first[0] if len(first) else None].any())
        for a, b in zip(first, [*first[1:], len(rows)]):
            unit = b"".join([raw[i * SIZE + start[i] : (i + 1) * SIZE] for i in rows[a:b][keep[a:b]]])
            add_pes(stream, unit, int(rows[a]), bool(flags[rows[a]] & 0x40), bool(lost[b] - lost[a + 1]) or (b < len(rows) and bool(gap[b])))
    return [replace(streams[p], program=number, kind=kinds[number, p], pcr=clocks[clock_of[number]] or clocks[p]) for p, number in sorted((p, number) for number, p in kinds)], dropped


def add_pes(stream: Stream, unit: bytes, packet: int, access: bool, hurt: bool) -> None:
    """Parse one elementary packet into its stream."""
    stream.n_pes += 1
    if len(unit) < 9 or unit[:3] != b"\0\0\1":
        stream.broken += 1
        return
    size = int.from_bytes(unit[4:6], "big")
    whole = not size or len(unit) >= 6 + size
    end = 6 + size if size else len(unit)
    pts = dts = None
    head = 6
    if unit[6] >> 6 == 2:
        head = 9 + unit[8]
        if unit[7] & 0x80 and len(unit) >= 14:
            pts = dts = read_stamp(unit[9:14])
            if unit[7] & 0x40 and len(unit) >= 19:
                dts = read_stamp(unit[14:19])
    if pts is not None:
        stream.pts.append(pts)
        stream.dts.append(dts)
    if access:
        stream.access.append((packet, pts))
    if hurt or not whole:
        stream.broken += 1
    else:
        stream.data.append(unit[head:end])


def demux(df: DataFrame, media: str = "media", key: str = "media_id") -> DataFrame:
    """One row per program and elementary stream of every medium; see SCHEMA."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, data in zip(part.column("media_id").to_pylist(), part.column("media").to_pylist()):
            found, dropped = demux_one(data or b"")
            for s in found:
                rows.append((k, s.program, s.pid, s.kind, s.n_packets, s.errors, dropped, s.n_pes, s.broken, s.pts, s.dts, [{"packet": a, "pts": b} for a, b in s.access], s.pcr[0] if s.pcr else None, s.pcr[-1] if s.pcr else None, b"".join(s.data)))
        i32, i64 = pa.int32(), pa.int64()
        kinds = [i64, i32, i32, i32, i32, i32, i32, i32, i32, pa.list_(i64), pa.list_(i64), pa.list_(pa.struct([("packet", i32), ("pts", i64)])), i64, i64, pa.binary()]
        names = ["media_id", "program", "pid", "stream_type", "n_packets", "continuity_errors", "dropped_packets", "n_pes", "broken_pes", "pts", "dts", "random_access", "pcr_first", "pcr_last", "data"]
        cols = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    return df.select(F.col(key).cast("bigint").alias("media_id"), F.col(media).alias("media")).mapInArrow(tk.over_slices(make, "media"), SCHEMA)


def page_media(pages: DataFrame) -> DataFrame:
    """A media column for tables that have none: each page's html as the video of a program and its url as private data.

    One page in eight loses a packet on the way, by its id, for the continuity check to find.
    """

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        media = []
        for k, url, html in zip(*(part.column(c).to_pylist() for c in ("media_id", "url", "html"))):
            h = zlib.crc32(str(k).encode())
            data = (html or "").encode()
            media.append(mux(data, (url or "").encode(), lose=3 + (h >> 3) % max(1, len(data) // 184) if h % 8 == 0 else -1))
        return pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(media, pa.binary())], names=["media_id", "media"])

    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("media_id"), "url", "html")
    return rows.mapInArrow(tk.over_slices(make, "html"), "media_id bigint, media binary")
