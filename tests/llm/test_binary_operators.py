"""Transport streams and web archives: round trips, faults, and packet-by-packet or library comparisons."""

import gzip
import io
import random
import struct
import zipfile

import pyarrow.fs as pafs
import pytest

from tessera.llm import mpegts, wacz
from tessera.llm.shared import Scratch


def payload(seed, n):
    return random.Random(seed).randbytes(n)


def video(streams):
    return next(s for s in streams if s.pid == 0x100)


@pytest.mark.parametrize("n", [0, 1, 100, 150, 1400, 1401, 40_000])
def test_mux_round_trip(n):
    data = payload(n, n)
    media = mpegts.mux(data, b"http://x")
    assert len(media) % 188 == 0
    streams, dropped = mpegts.demux_one(media)
    assert [(s.program, s.pid, s.kind) for s in streams] == [(1, 0x100, 0x1B), (1, 0x101, 6)] and dropped == 0
    v = video(streams)
    assert b"".join(v.data) == data and v.errors == 0 and v.broken == 0
    assert b"".join(streams[1].data) == b"http://x" and streams[1].pts == [900]
    units = max(1, -(-n // 1400))
    assert v.pts == [3600 + 3003 * k for k in range(units)] and v.dts == [p - 1800 for p in v.pts]
    assert [p for _, p in v.access] == v.pts[::8] and v.pcr == [(p - 3600) * 300 for p in v.pts[::8]]


def slow_counters(media):
    """Continuity errors per pid, one packet at a time."""
    last, errors = {}, {}
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        pid, cc, full = (p[1] & 31) << 8 | p[2], p[3] & 15, bool(p[3] & 0x10)
        if pid in last:
            twin = last[pid][1] == p
            if not twin and cc != (last[pid][0] + full) % 16:
                errors[pid] = errors.get(pid, 0) + 1
        last[pid] = (cc, p)
    return errors


def slow_demux(media):
    """Streams of a medium, read packet by packet with a state for each pid."""
    begin = max(range(188), key=lambda k: (sum(media[i] == 0x47 for i in range(k, min(len(media), k + 20 * 188), 188)) / max(1, len(range(k, min(len(media), k + 20 * 188), 188))), -k))
    tables, maps, clocks, state, dropped = {}, {}, {}, {}, 0
    for at in range(begin, len(media) - 187, 188):
        p = media[at : at + 188]
        if p[0] != 0x47 or p[1] & 0x80:
            dropped += 1
            continue
        pid, new, control, counter = (p[1] & 0x1F) * 256 + p[2], p[1] & 0x40, p[3] // 16 % 4, p[3] % 16
        if pid == 0x1FFF:
            continue
        flags, body = 0, p[4:]
        if control in (2, 3):
            flags = p[5] if p[4] else 0
            if p[4] >= 7 and flags & 0x10:
                clocks.setdefault(pid, []).append(int(f"{int.from_bytes(p[6:12], 'big'):048b}"[:33], 2) * 300 + int(f"{int.from_bytes(p[6:12], 'big'):048b}"[39:], 2))
            body = p[5 + p[4] :]
        if control in (0, 2):
            body = b""
        s = state.setdefault(pid, {"last": None, "errors": 0, "packets": 0, "units": [], "head": False, "section": None, "seen": -1})
        s["packets"] += 1
        hurt = False
        if s["last"] is not None:
            if body and s["last"][1] == p:
                continue
            wanted = (s["last"][0] + (1 if body else 0)) % 16
            hurt = counter != wanted and not flags & 0x80
        s["errors"] += hurt
        if hurt and s["units"]:
            s["units"][-1][3] = True
        s["last"] = (counter, p)
        if new and body:
            s["units"].append([b"", bool(flags & 0x40), (at - begin) // 188, False])
        if s["units"]:
            s["units"][-1][0] += body
        elif body:
            s["head"] = True
        # tables: sections of pid 0 and of the pids that it names
        if new and body:
            whole = body[1 + body[0] :]
        elif s["section"] is not None:
            whole = s["section"] + body
        else:
            whole = None
        s["section"] = whole
        if whole is not None and len(whole) >= 3 and whole[0] in (0, 2):
            size = 3 + (whole[1] % 16) * 256 + whole[2]
            if len(whole) >= size and mpegts.crc(bytes(whole[:size])) == 0:
                tables.setdefault(pid, []).append(whole[:size])
    for t in tables.get(0, []):
        for k in range(8, len(t) - 4, 4):
            number, pmt = t[k] * 256 + t[k + 1], (t[k + 2] % 32) * 256 + t[k + 3]
            for q in tables.get(pmt, []) if number else []:
                if q[0] == 2 and q[3] * 256 + q[4] == number:
                    k2 = 12 + (q[10] % 16) * 256 + q[11]
                    while k2 < len(q) - 4:
                        pid = (q[k2 + 1] % 32) * 256 + q[k2 + 2]
                        maps[pid, number] = (q[k2], (q[8] % 32) * 256 + q[9])
                        k2 += 5 + (q[k2 + 3] % 16) * 256 + q[k2 + 4]
    out = []
    for (pid, number), (kind, clock) in sorted(maps.items()):
        s = state.get(pid, {"errors": 0, "packets": 0, "units": [], "head": False})
        pts, dts, access, data, broken = [], [], [], [], int(s["head"])
        for unit, key, packet, hurt in s["units"]:
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                broken += 1
                continue
            bits = "".join(f"{b:08b}" for b in unit[9:19])
            mark = lambda o: int(bits[o + 4 : o + 7] + bits[o + 8 : o + 23] + bits[o + 24 : o + 39], 2)
            if unit[7] & 0x80:
                pts.append(mark(0))
                dts.append(mark(40) if unit[7] & 0x40 else mark(0))
            if key:
                access.append((packet, pts[-1] if unit[7] & 0x80 else None))
            size = unit[4] * 256 + unit[5]
            if hurt or size and len(unit) < 6 + size:
                broken += 1
            else:
                data.append(unit[9 + unit[8] : 6 + size if size else None])
        pcr = clocks.get(clock) or clocks.get(pid, [])
        out.append((number, pid, kind, s["packets"], s["errors"], len(s["units"]), broken, pts, dts, access, pcr, data))
    return out, dropped


def spoilt_media():
    """Media with lost, doubled, damaged and foreign packets, and two programs."""
    g = random.Random(11)
    for k in range(60):
        media = mpegts.mux(payload(k, g.randrange(0, 60_000)), payload(k + 1, g.choice((0, 9, 3000))), g.choice((180, 1400, 5000, 70_000)), g.choice((1, 3, 8)))
        parts = [media[i : i + 188] for i in range(0, len(media), 188)]
        for _ in range(g.choice((0, 0, 1, 4))):
            i, what = g.randrange(2, len(parts) + 1), g.randrange(5)
            if what == 0 and i < len(parts):
                del parts[i]
            elif what == 1 and i < len(parts):
                parts.insert(i, parts[i])
            elif what == 2 and i < len(parts):
                parts[i] = bytes([0x46]) + parts[i][1:]
            elif what == 3:
                parts.insert(i, bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184))
            elif i < len(parts):
                parts[i] = parts[i][:1] + bytes([parts[i][1] | 0x80]) + parts[i][2:]
        yield g.choice((b"", b"torn start")) + b"".join(parts) + g.choice((b"", b"\x47torn"))


def test_demux_against_one_packet_at_a_time():
    for media in spoilt_media():
        streams, dropped = mpegts.demux_one(media)
        got = [(s.program, s.pid, s.kind, s.n_packets, s.errors, s.n_pes, s.broken, s.pts, s.dts, s.access, s.pcr, s.data) for s in streams]
        assert (got, dropped) == slow_demux(media)


@pytest.mark.parametrize("lose", range(2, 40, 3))
def test_a_lost_packet_is_found(lose):
    data = payload(5, 20_000)
    media = mpegts.mux(data, b"", lose=lose)
    v = video(mpegts.demux_one(media)[0])
    assert v.errors == slow_counters(media).get(0x100, 0)
    got = b"".join(v.data)
    if lose > 2:
        assert v.errors == 1 and 1 <= v.broken <= 2
    units = [data[i : i + 1400] for i in range(0, len(data), 1400)]
    it = iter(units)
    assert all(any(u == x for x in it) for u in v.data) and len(got) < len(data)


def test_repeats_garbage_and_torn_ends():
    data = payload(6, 5000)
    media = mpegts.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join(packets[:5] + [packets[4]] + packets[5:])
    assert b"".join(video(mpegts.demux_one(twice)[0]).data) == data and video(mpegts.demux_one(twice)[0]).errors == 0
    assert b"".join(video(mpegts.demux_one(b"junk" + media + b"\x47tail")[0]).data) == data
    bad = bytearray(media)
    bad[3 * 188] = 0
    streams, dropped = mpegts.demux_one(bytes(bad))
    assert dropped == 1 and video(streams).n_packets == len(packets) - 3
    wrong = bytearray(media)
    wrong[180] ^= 1  # in the program table, which ends its packet (stuffing comes first): a wrong checksum
    assert mpegts.demux_one(bytes(wrong))[0] == []


def test_table_over_several_packets():
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(90))
    out = mpegts.packets(0, b"\0" + mpegts.section(0, 1, b"\0\1\xf0\0"), 0) + mpegts.packets(0x1000, b"\0" + mpegts.section(2, 1, b"\xe1\x00\xf0\x00" + streams), 0)
    assert len(out) > 3 and [s.pid for s in mpegts.demux_one(b"".join(out))[0]] == [0x200 + k for k in range(90)]


@pytest.mark.parametrize("pids", [(0x1000, 0x1001), (0x1000, 0x1000)])
def test_two_programs_share_a_stream_and_a_clock_of_its_own(pids):
    pat = b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in zip((1, 2), pids))
    table = lambda *own: b"\xe3\x00\xf0\x00" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for t, p in own)
    out = mpegts.packets(0, b"\0" + mpegts.section(0, 1, pat), 0)
    for k, (n, p, own) in enumerate(zip((1, 2), pids, ([(0x1B, 0x100), (6, 0x101)], [(6, 0x101)]))):
        out += mpegts.packets(p, b"\0" + mpegts.section(2, n, table(*own)), k if pids[0] == pids[1] else 0)
    out += mpegts.packets(0x300, b"-", 0, False, 900) + mpegts.packets(0x300, b"-", 1, False, 1800)
    out += mpegts.packets(0x100, mpegts.pes(b"video", 3600, 1800), 0) + mpegts.packets(0x101, mpegts.pes(b"both", 900, stream_id=0xBD), 0)
    streams, _ = mpegts.demux_one(b"".join(out))
    assert [(s.program, s.pid, s.kind, b"".join(s.data)) for s in streams] == [(1, 0x100, 0x1B, b"video"), (1, 0x101, 6, b"both"), (2, 0x101, 6, b"both")]
    assert all(s.pcr == [900 * 300, 1800 * 300] for s in streams)


def test_demux_table(spark):
    rows = [(1, mpegts.mux(b"abc" * 999)), (2, None), (3, b""), (4, b"no stream at all" * 50), (1, mpegts.mux(b"abc" * 999)), (None, mpegts.mux(b"x"))]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, "c") for i, m in rows], "media_id bigint, media binary, program string")
    got = mpegts.demux(df).collect()
    assert sorted((r.media_id or 0, bytes(r.data)) for r in got) == [(0, b"x"), (1, b"abc" * 999), (1, b"abc" * 999)]
    assert mpegts.demux(df.limit(0)).count() == 0


def test_pages_as_media(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = mpegts.demux(mpegts.page_media(pages)).where("pid = 256").collect()
    assert len(rows) == len(html)
    for r in rows:
        if r.continuity_errors == 0 and r.broken_pes == 0 and len(r.pts) == -(-len(html[r.media_id].encode()) // 1400):
            assert bytes(r.data).decode() == html[r.media_id]
    assert sum(r.continuity_errors for r in rows) > 0


# --- web archives ------------------------------------------------------------------


def local(path):
    return pafs.LocalFileSystem().open_input_file(str(path))


def test_directory_like_the_library(tmp_path):
    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("archive/x.warc.gz", b"stored" * 100)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx"), b"line\n" * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment at the end"
    with local(p) as f, zipfile.ZipFile(p) as z:
        found = wacz.directory(f, f.size())
        assert [(m.name, m.method, m.packed, m.size, m.header) for m in found] == [(i.filename, i.compress_type, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
        assert [wacz.content(f, m) for m in found] == [z.read(i) for i in z.infolist()]


def test_zip64_directory(tmp_path):
    """A ZIP64 archive built by hand: sizes, offset and counts are all in the wide fields."""
    name, data = b"archive/data.warc.gz", b"payload" * 9
    extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
    body = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data
    wide = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    where = b"PK\6\7" + struct.pack("<IQI", 0, len(body) + len(entry), 1)
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = tmp_path / "z.zip"
    p.write_bytes(body + entry + end64 + where + end)
    with local(p) as f:
        [m] = wacz.directory(f, f.size())
        assert (m.name, m.packed, m.size, m.header) == (name.decode(), len(data), len(data), 0)
        assert wacz.content(f, m) == data


def test_no_zip_is_an_error(tmp_path):
    p = tmp_path / "n.zip"
    p.write_bytes(b"nothing")
    with local(p) as f, pytest.raises(ValueError):
        wacz.directory(f, f.size())


def test_pages_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = {(r.page_id, r.url, r.html) for r in pages.collect()}
    got = wacz.read_pages(wacz.pack(pages, Scratch(spark, "t")))
    assert {(r.page_id, r.url, r.html) for r in got.collect()} == want and got.where("not ok").count() == 0


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "http://a/ü?x=1&y", ""), (3, "http://b", "z" * 3_000_000), (3, "http://b", "z" * 3_000_000), (None, "u", "v"), (4, "http://c", "x\r\n\r\ny\0")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "page_id bigint, url string, html string, status string")
    got = wacz.read_pages(wacz.pack(df, Scratch(spark, "t"))).collect()
    assert sorted((r.page_id, r.url, r.html, r.ok) for r in got) == sorted((i, u or "", h or "", True) for i, u, h in rows if i is not None)
    assert wacz.read_pages(wacz.pack(df.limit(0), Scratch(spark, "t"))).count() == 0


def test_damage_is_marked(spark, tmp_path):
    path = tmp_path / "d.wacz"
    wacz.write_archive(f"file://{path}", [(1, "http://a", "text one"), (2, "http://b", "text two")], "x")
    raw = bytearray(path.read_bytes())
    at = raw.index(b"\x1f\x8b")
    raw[at + 40] ^= 0xFF
    path.write_bytes(raw)
    index = wacz.read_index(spark.createDataFrame([(f"file://{path}",)], "archive string"))
    rows = {r.url: r for r in wacz.read_records(index).collect()}
    assert not rows["http://a"].ok and rows["http://b"].ok and bytes(rows["http://b"].payload) == b"text two"
    far = index.withColumn("offset", index["offset"] + 10**6)
    assert {r.ok for r in wacz.read_records(far).collect()} == {False}


def record(name, text, gz=True):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + text
    raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if gz else raw


def test_damaged_index_lines_classic_lines_and_plain_members(spark, tmp_path):
    one, two, three = record(1, b"one"), record(2, b"two", gz=False), record(3, b"three")
    at = lambda raw, **more: __import__("json").dumps({"url": "u", "offset": 0, "length": len(raw)} | more)
    lines = [
        "k 1 " + at(one, filename="a/data.warc.gz", status="-", url="good one"),
        "k 1 " + at(two, filename="archive/data.warc", status="200", url="good two"),
        "k 1 " + at(three, filename="b/data.warc.gz", url="good three"),
        "k 1 " + at(one, filename="data.warc.gz", url="two members have this name"),
        "k 1 " + at(one, filename="none.warc.gz", url="no such member"),
        "k 1 " + at(one, filename="a/data.warc.gz", offset="-", url="no offset"),
        "k 1 " + at(one, filename=7, url="no file name"),
        "k 1 " + at(one, filename="a/data.warc.gz", length=10**30, url="no length"),
        "k 1 {broken", "no object at all", "[1]", "!meta {}", "",
    ]
    classic = f" CDX N b a m s k r M S V g\nkey 2024 http://classic text/html 404 - - - {len(three)} 0 b/data.warc.gz\nkey 2024 too few cells\n"
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in (("archive/a/data.warc.gz", one), ("archive/data.warc", two), ("archive/b/data.warc.gz", three), ("indexes/a.cdxj", "\n".join(lines)), ("indexes/b.cdx", classic), ("indexes/c.cdx.gz", b"no gzip")):
            z.writestr(zipfile.ZipInfo(name), data)
    (tmp_path / "no.wacz").write_bytes(b"no archive")
    (tmp_path / "empty.wacz").write_bytes(b"PK\5\6" + bytes(18))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.wacz",) for n in ("x", "no", "empty")], "archive string")
    rows = wacz.read_records(wacz.read_index(files)).collect()
    good = sorted((r.url, r.status, bytes(r.payload)) for r in rows if r.ok)
    assert good == sorted([("good one", None, b"one"), ("good two", 200, b"two"), ("good three", None, b"three"), ("http://classic", 404, b"three")], key=str)
    bad = [r.url for r in rows if not r.ok]
    assert sorted(u for u in bad if u) == sorted(["two members have this name", "no such member", "no offset", "no file name", "no length"])
    assert len(bad) == 5 + 3 + 1 + 1 + 1 and all(r.payload is None for r in rows if not r.ok)


def test_archive_is_readable_by_others(tmp_path):
    path = tmp_path / "o.wacz"
    wacz.write_archive(f"file://{path}", [(7, "http://a", "text")], "x")
    with zipfile.ZipFile(path) as z:
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        record = gzip.GzipFile(fileobj=io.BytesIO(z.read("archive/data.warc.gz"))).read()
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"text\r\n\r\n")
