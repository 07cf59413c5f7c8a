"""ZIP-packaged web archives (WACZ): directory parsing, index rows, range reads.

A WACZ file is a ZIP whose ``archive/*.warc.gz`` members are stored without
compression and hold one gzip member per WARC record (``.warc`` members hold the
records as they are), and whose ``indexes/*.cdx`` (or ``.cdx.gz``) members list every
record's offset and length, as JSON behind the key or in the classic columns that a
`` CDX `` line names. Nothing is
extracted: the end record and central directory (ZIP64 included) are read from
the file's tail, index members by their range, and records by ranges of the ZIP
itself, neighbouring ones in one read.

Work is spread by (archive, block of ``BLOCK`` bytes), so one large archive is
read by many tasks. Files are reached with ``pyarrow.fs`` by address, so any
executor that sees the shared folder can read or reread them.

Defined results: an archive without an index gives no rows; an index line that
can't be read (broken JSON, no offset, length or file name) and an index member that
can't be unpacked give a row with ``ok`` false and the fields that could be read, and so
does a file that is no ZIP (one row, all else null); a status that is no number is
null; a file name is looked up by its path under ``archive/``, then by its last part
where only one member has that; an index row whose member isn't there or that points
outside it, a record that is no gzip or no WARC, and a payload whose digest differs give
a row with ``ok`` false (and null fields where nothing could be read); blank lines and
header lines are skipped; empty archives give no rows; null urls and payloads are
written as empty ones; repeated pages are repeated records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.shared import Scratch

BLOCK, ARCHIVE_BYTES = 8 << 20, 24 << 20
#: Columns of the classic index by their letters.
CLASSIC = {"a": "url", "m": "mime", "s": "status", "k": "digest", "S": "length", "V": "offset", "g": "filename"}
INDEX = "archive string, url string, mime string, status int, digest string, member_offset bigint, member_size bigint, offset bigint, length bigint"
RECORDS = "record_id string, url string, date string, status int, mime string, n_bytes bigint, payload binary, ok boolean"


def locate(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of an address such as file:///x or hdfs://host/x."""
    if address.startswith("file:") and not address.startswith("file:///"):
        address = "file:///" + address[5:].lstrip("/")
    return pafs.FileSystem.from_uri(address)


# --- reading ---------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


def directory(f, size: int) -> list[Member]:
    """The central directory, from the end record or its ZIP64 form."""
    tail = f.read_at(min(size, 65557), max(0, size - 65557))
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) < at + 22:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = max(0, size - 65557) + at
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20:
        where = f.read_at(20, end - 20)
        if where[:4] == b"PK\6\7":
            big = f.read_at(56, struct.unpack("<Q", where[8:16])[0])
            if big[:4] != b"PK\6\6":
                raise ValueError("ZIP64 end record is missing")
            count, length, start = struct.unpack("<QQQ", big[32:56])
    raw, out, at = f.read_at(length, start), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("central directory is damaged")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, full, n, m, k = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        header = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
        extra = raw[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, span = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                body = extra[4 : 4 + span]
                values = [struct.unpack("<Q", body[i : i + 8])[0] for i in range(0, len(body) - 7, 8)]
                if full == 0xFFFFFFFF and values:
                    full = values.pop(0)
                if packed == 0xFFFFFFFF and values:
                    packed = values.pop(0)
                if header == 0xFFFFFFFF and values:
                    header = values.pop(0)
            extra = extra[4 + span :]
        out.append(Member(name, method, packed, full, header))
        at += 46 + n + m + k
    return out


def data_offset(f, m: Member) -> int:
    """Where a member's bytes begin (behind its local header)."""
    head = f.read_at(30, m.header)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{m.name}: local header is missing")
    n, k = struct.unpack("<HH", head[26:30])
    return m.header + 30 + n + k


def content(f, m: Member) -> bytes:
    """A small member's bytes (indexes)."""
    raw = f.read_at(m.packed, data_offset(f, m))
    return zlib.decompress(raw, -15) if m.method == 8 else raw


def entry_of(line: str, columns: list[str] | None) -> dict:
    """The fields of one index line; an empty dict where it can't be read."""
    if columns and not line.rstrip().endswith("}"):
        cells = line.split()
        if len(cells) != len(columns):
            return {}
        return {CLASSIC[c]: x for c, x in zip(columns, cells) if c in CLASSIC and x != "-"}
    at = line.find("{")
    try:
        found = json.loads(line[at:]) if at >= 0 else None
    except (json.JSONDecodeError, RecursionError):
        found = None
    return found if isinstance(found, dict) else {}


def whole(value, most: int = (1 << 63) - 1) -> int | None:
    """A count from 0 to ``most`` given as a number or its digits; else None."""
    text = str(value) if isinstance(value, (int, str)) and not isinstance(value, bool) else ""
    return int(text) if text.isascii() and text.isdigit() and len(text) < 20 and int(text) <= most else None


def place_of(name, stored: dict[str, tuple[int, int]], by_last: dict[str, list[str]]) -> tuple[int, int]:
    """Offset and size of the member that an index line names; size -1 where there is none."""
    path = name.removeprefix("archive/") if isinstance(name, str) else ""
    same = by_last.get(path.rsplit("/", 1)[-1], [])
    return stored.get(path) or (stored[same[0]] if len(same) == 1 else (0, -1))


def text_of(value) -> str | None:
    return value if isinstance(value, str) else None


def index_rows(address: str) -> list[tuple]:
    """Rows of INDEX for one archive; ``member_size`` is null for what could not be read."""
    fs, path = locate(address)
    lost = (address, *[None] * 8)
    with fs.open_input_file(path) as f:
        try:
            members = directory(f, f.size())
        except (ValueError, struct.error, OSError):
            return [lost]
        stored: dict[str, tuple[int, int]] = {}
        by_last: dict[str, list[str]] = {}
        for m in members:
            if m.name.startswith("archive/") and m.method == 0:
                try:
                    stored[m.name.removeprefix("archive/")] = (data_offset(f, m), m.packed)
                except (ValueError, struct.error):
                    continue
                by_last.setdefault(m.name.rsplit("/", 1)[-1], []).append(m.name.removeprefix("archive/"))
        rows = []
        for m in members:
            if not m.name.startswith("indexes/") or not m.name.endswith((".cdx", ".cdxj", ".cdx.gz")):
                continue
            try:
                text = content(f, m)
                text = gzip.decompress(text) if m.name.endswith(".gz") else text
            except (OSError, EOFError, ValueError, struct.error, zlib.error):
                rows.append(lost)
                continue
            columns = None
            for line in text.decode("utf-8", "replace").split("\n"):
                if line.lstrip().startswith("CDX ") and "{" not in line:
                    columns = line.split()[1:]
                elif line.strip() and not line.startswith("!"):
                    e = entry_of(line, columns)
                    offset, length = whole(e.get("offset")), whole(e.get("length"))
                    at, size = place_of(e.get("filename"), stored, by_last)
                    readable = offset is not None and length is not None and isinstance(e.get("filename"), str)
                    rows.append((address, text_of(e.get("url")), text_of(e.get("mime")), whole(e.get("status"), 999), text_of(e.get("digest")), at, size if readable else None, offset, length))
        return rows


def parse_record(raw: bytes, digest: str | None) -> tuple:
    """(record id, date, payload, ok) of one gzip member holding a WARC record."""
    try:
        data = raw if raw.startswith(b"WARC/") else gzip.decompress(raw)
        head, body = data.split(b"\r\n\r\n", 1)
        if not head.startswith(b"WARC/"):
            return None, None, None, False
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        block = body[: int(fields["Content-Length"])]
        payload = block.split(b"\r\n\r\n", 1)[1] if fields.get("WARC-Type") == "response" else block
    except (OSError, EOFError, zlib.error, ValueError, KeyError, IndexError):
        return None, None, None, False
    return fields.get("WARC-Record-ID"), fields.get("WARC-Date"), payload, digest is None or digest.removeprefix("sha1:") == sha1(payload).removeprefix("sha1:")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_index(archives: DataFrame) -> DataFrame:
    """Index rows of all archives; ``archives`` has one address per row in ``archive``."""

    def run(batches):
        for batch in batches:
            for address in batch.column("archive").to_pylist():
                rows = index_rows(address)
                cols = list(zip(*rows)) or [[] for _ in range(9)]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=INDEX_NAMES)

    return archives.select("archive").mapInArrow(run, INDEX)


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def inside(row: dict) -> bool:
    """Whether an index row was read and points into its member."""
    return row["member_size"] is not None and row["offset"] + row["length"] <= row["member_size"]


def read_records(index: DataFrame) -> DataFrame:
    """The records of index rows, read by range."""

    def run(batches):
        opened: tuple[str, object] | None = None
        block, base = b"", 0
        for batch in batches:
            rows = batch.to_pylist()
            out, held = [], 0
            for i, r in enumerate(rows):
                if not inside(r):
                    out.append((None, r["url"], None, r["status"], r["mime"], None, None, False))
                    continue
                if opened is None or opened[0] != r["archive"]:
                    if opened:
                        opened[1].close()
                    fs, path = locate(r["archive"])
                    opened, block = (r["archive"], fs.open_input_file(path)), b""
                at = r["member_offset"] + r["offset"]
                if not base <= at or at + r["length"] > base + len(block):
                    end = at + r["length"]
                    for s in rows[i + 1 :]:  # neighbours in the same block are read along
                        if s["archive"] != r["archive"] or not inside(s) or s["member_offset"] + s["offset"] != end or end - at > 1 << 20:
                            break
                        end += s["length"]
                    block, base = opened[1].read_at(end - at, at), at
                name, date, payload, ok = parse_record(block[at - base : at - base + r["length"]], r["digest"])
                out.append((name, r["url"], date, r["status"], r["mime"], None if payload is None else len(payload), payload, ok))
                held += len(payload or b"")
                if held > tk.SLICE_BYTES:
                    yield records(out)
                    out, held = [], 0
            yield records(out)
        if opened:
            opened[1].close()

    spread = index.repartition("archive", F.floor((F.col("member_offset") + F.col("offset")) / BLOCK)).sortWithinPartitions("archive", "member_offset", "offset")
    return spread.mapInArrow(run, RECORDS)


def records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in range(8)]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


# --- writing, for tables of pages that are not packaged yet -----------------------


def write_archive(address: str, rows: list[tuple[int, str, str]], part: str) -> int:
    """One WACZ file of (page id, url, html) rows; returns its size. A retried task writes the same file anew."""
    warc, lines = io.BytesIO(), []
    for page, url, html in rows:
        payload = (html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
        digest = sha1(payload)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: {url or ''}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: {digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        raw = gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)
        entry = {"url": url or "", "mime": "text/html", "status": 200, "digest": digest, "length": len(raw), "offset": warc.tell(), "filename": "data.warc.gz"}
        lines.append(f"{url or ''} 20240101000000 {json.dumps(entry)}")
        warc.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("archive/data.warc.gz", warc.getvalue()), ("indexes/index.cdx.gz", gzip.compress("\n".join(sorted(lines)).encode(), 1, mtime=0)), ("datapackage.json", json.dumps({"profile": "data-package", "resources": len(rows)}).encode())):
            z.writestr(zipfile.ZipInfo(name), data)
    fs, path = locate(address)
    with fs.open_output_stream(f"{path}.{part}") as f:
        f.write(out.getbuffer())
    fs.move(f"{path}.{part}", path)
    return out.tell()


def pack(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write ``pages`` as WACZ files to the shared folder; one row (archive, n_records) per file."""
    root = scratch.root + "/wacz"

    def run(batches):
        context = TaskContext.get()
        fs, path = locate(root)
        fs.create_dir(path, recursive=True)
        rows, held, k, made = [], 0, 0, []

        def flush():
            nonlocal rows, held, k
            name = f"{root}/part-{context.partitionId():06d}-{k:04d}.wacz"
            write_archive(name, rows, f"{context.taskAttemptId()}")
            made.append((name, len(rows)))
            rows, held, k = [], 0, k + 1

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                rows.append(row)
                held += len(row[2] or "")
                if held >= ARCHIVE_BYTES:
                    flush()
        if rows:
            flush()
        cols = list(zip(*made)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int64())], names=["archive", "n_records"])

    rows = pages.where("page_id is not null").selectExpr("cast(page_id as bigint) page_id", "url", "html")
    return scratch.write(rows.mapInArrow(run, "archive string, n_records bigint"), "archives")


def read_pages(archives: DataFrame) -> DataFrame:
    """One row per archived page: page_id, url, status, mime, n_bytes, html_md5, html, ok."""
    r = read_records(read_index(archives))
    return r.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("bigint").alias("page_id"), "url", "status", "mime", "n_bytes", F.md5("payload").alias("html_md5"), F.col("payload").cast("string").alias("html"), "ok")


ORACLE = "select page_id, coalesce(url, '') as url, cast(200 as integer) as status, 'text/html' as mime, octet_length(encode(coalesce(html, ''))) as n_bytes, md5(coalesce(html, '')) as html_md5, coalesce(html, '') as html, true as ok from pages where page_id is not null"
