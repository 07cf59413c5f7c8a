"""Adapters, mixture, validation, packing, sinks and the whole build."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import adapters, mixture, precompiled
from tessera.operators.tokenizers import ByteTokenizer
from tessera.plans.prepare import prepare
from tessera.protocol import Invalid
from tessera.sources import catalogue, readers, sinks
from tessera.sources.catalogue import SourceSpec


def adapted(name, row, **more):
    found = adapters.ADAPTERS[name](row, **more)
    return found[0] if not found[1] else found


def test_layouts():
    assert adapted("ultrachat", {"messages": [{"from": "Human", "value": "a"}, {"role": "GPT", "content": None}]}) == [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]
    assert adapted("aya", {"inputs": " q ", "targets": "a\n"})[1] == {"role": "assistant", "content": "a"}
    with pytest.raises(Invalid):
        adapted("aya", {"inputs": "q", "targets": " "})
    m, t = adapters.ADAPTERS["nemotron"]({"messages": json.dumps([{"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": '{"a":1}'}}]}]), "tools": '[{"name":"f"}]'})
    assert m[0]["tool_calls"][0] == {"id": "call_0_0", "type": "function", "function": {"name": "f", "arguments": {"a": 1}}} and t[0]["function"]["name"] == "f"


def test_tagged_calls_pair_first_in_first_out():
    row = {"conversations": [{"from": "system", "value": "<tool_call> stays"}, {"from": "gpt", "value": 'x <tool_call>{"name":"f","arguments":{}}</tool_call><tool_call>{"name":"g"}</tool_call>'}, {"from": "tool", "value": "<tool_response>{'a': 1}</tool_response><tool_response>plain</tool_response>"}]}
    m = adapted("hermes", row)
    assert [c["id"] for c in m[1]["tool_calls"]] == ["hermes_call_0", "hermes_call_1"] and m[1]["content"] == "x"
    assert [(x["tool_call_id"], x["content"]) for x in m[2:]] == [("hermes_call_0", {"a": 1}), ("hermes_call_1", "plain")]
    for bad in ("<tool_call>{", "<tool_call>nothing</tool_call>"):
        with pytest.raises(Invalid):
            adapted("hermes", {"conversations": [{"from": "gpt", "value": bad}]})
    with pytest.raises(Invalid):
        adapted("hermes", {"conversations": [{"from": "tool", "value": "orphan"}]})


def test_generations_and_scores():
    row = {"problem": "p", "answer": "42", "generations": ["no", "<think> why </think> so", "late"], "is_reasoning_complete": [True, True], "correctness_math_verify": [False, None], "correctness_llama": [False, True]}
    assert adapted("openr1", row)[1] == {"role": "assistant", "reasoning_content": "why", "content": "so"}
    assert adapted("openr1", row | {"generations": ["no", "bare"]})[1] == {"role": "assistant", "reasoning_content": "bare", "content": "42"}
    with pytest.raises(Invalid):
        adapted("openr1", row | {"is_reasoning_complete": None})
    for score, good in ((0.95, True), ("0.8", True), (0.5, False), ("nan", False), (True, False), (None, False)):
        one = {"input": "a", "output": "b", "average_test_score": score}
        if good:
            assert len(adapted("opencode", one)) == 2
        else:
            with pytest.raises(Invalid):
                adapted("opencode", one)


def test_native_layouts_equal_the_general_ones(spark):
    texts = ["plain", " \t", "quo\"te\\", "tab\tnew\nline", "\x00\x1f", "é日本", "", None, " em "]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "id int, inputs string, targets string")
    key = ("id",)
    assert sorted(map(tuple, adapters.native_pair(d, key).collect()), key=str) == sorted(map(tuple, adapters.adapt(d, "aya", key).collect()), key=str)
    g = spark.createDataFrame([(i, "p", a, [a, b], [True, True], [False, True], [i % 3 == 0]) for i, (a, b) in enumerate((a, f"<think>{b}</think> {a}") for a in texts if a is not None for b in texts)], "id int, problem string, answer string, generations array<string>, is_reasoning_complete array<boolean>, correctness_math_verify array<boolean>, correctness_llama array<boolean>")
    assert sorted(map(tuple, adapters.native_reasoning(g, key).collect()), key=str) == sorted(map(tuple, adapters.adapt(g, "openr1", key).collect()), key=str)


def test_raw_budget_and_foreign_rows(spark):
    lines = ["[1]", "{", json.dumps({"inputs": "a", "targets": "b"}), json.dumps({"inputs": "a" * 99, "targets": "b"}), json.dumps({"inputs": [[[[1]]]], "targets": "b"})]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, raw string")
    got = {r.id: r.rejection for r in adapters.adapt(d, "aya", ("id",), "raw", max_bytes=60, max_depth=3).collect()}
    assert got == {0: "invalid", 1: "invalid", 2: None, 3: "invalid", 4: "invalid"}


def slow_mix(sources, quotas):
    """The rule, row by row."""
    seen, out = set(), []
    for name, rows in sources.items():
        tokens = 0
        for pos, fp, why, n in rows:
            if quotas[name] == 0 or tokens >= quotas[name]:
                break
            if fp in seen:
                out.append((name, pos, "duplicate"))
            elif why:
                out.append((name, pos, why))
            else:
                seen.add(fp)
                tokens += n
                out.append((name, pos, "accepted"))
    return out


def test_mixture_is_the_sequential_rule(spark, tmp_path):
    import random

    g = random.Random(1)
    # a fingerprint stands for its content, so it is always good or always rejected alike
    kind = {f"f{k}": (g.choice([None, None, None, "too_long"]), g.randint(0, 9)) for k in range(60)}
    sources = {s: [(i, fp, *kind[fp]) for i, fp in enumerate(g.choice(list(kind)) for _ in range(80))] for s in "abcd"}
    quotas = {"a": 60, "b": 10**6, "c": 0, "d": 15}

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    tables = {s: spark.createDataFrame(r, "pos bigint, fingerprint string, rejection string, target_tokens bigint") for s, r in sources.items()}
    want = sorted(slow_mix(sources, quotas))
    for small in (False, True):
        got = mixture.mix(tables, quotas, save, seed=None, small=small)
        assert sorted((r.source, r.pos, r.outcome) for r in got.collect()) == want
    report = {r.source: r for r in mixture.report(got, quotas).collect()}
    assert report["a"].complete and not report["b"].complete and report["c"].complete and report["c"].rows == 0


@pytest.mark.parametrize("ids, labels, fault", [([], [], "empty"), ([1, 2], [1], "length"), ([1, 2], [1, 3], "label"), ([1, 999], [1, 999], "id_range"), ([1, 2], [-100, -100], "no_target"), ([1] * 9, [1] * 9, "too_long"), ([1, None], [1, 1], "id_range"), (None, [1], "missing"), ([1, 2], [-100, 2], None)])
def test_faults(spark, ids, labels, fault):
    d = spark.createDataFrame([(ids, labels)], "input_ids array<int>, labels array<int>")
    assert precompiled.validate(d, 267, 8, strict=False).first().fault == fault
    if fault:
        with pytest.raises(Exception, match="bad compiled row"):
            precompiled.validate(d, 267, 8).collect()
    else:
        assert precompiled.validate(d, 267, 8, full_loss=True).first().labels == ids
    with pytest.raises(Invalid):
        precompiled.validate(d.withColumn("labels", F.expr("cast(labels as array<double>)")), 267)


def test_packing_keeps_all_and_fits(spark):
    import random

    g = random.Random(2)
    rows = [(str(i), [i] * g.randint(1, 20), [i]) for i in range(300)]
    got = precompiled.pack(spark.createDataFrame(rows, "id string, input_ids array<int>, labels array<int>"), "id", 20, group_tokens=1000).collect()
    assert sorted(r.row_id for r in got) == sorted(r[0] for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(len(r.input_ids))
        assert list(r.position_ids) == list(range(len(r.input_ids)))
    assert all(sum(x) <= 20 for x in bins.values()) and len(bins) <= 1.15 * sum(len(r[1]) for r in rows) / 20 + 3


def test_packing_reports_rows_that_fit_no_bin(spark):
    rows = [("a", [1] * 5, [1] * 5), ("b", [2] * 21, [2] * 21), ("c", [3] * 30, [3] * 30), ("d", [], []), ("e", None, None), ("f", [4] * 20, [4] * 20)]
    got = precompiled.pack(spark.createDataFrame(rows, "id string, input_ids array<int>, labels array<int>"), "id", 20).collect()
    assert sorted((r.row_id, r.fault) for r in got if r.fault) == [("b", "too_long"), ("c", "too_long"), ("d", "empty"), ("e", "missing")]
    assert sorted((r.row_id, r.input_ids, r.labels) for r in got) == rows
    assert len({r.bin_id for r in got if r.row_id in "abcf"}) == 4 and all(r.bin_id is None for r in got if r.row_id in "de")


def test_every_conversation_is_in_a_bin(spark, data):
    from tessera.queries import QUERIES

    bins = QUERIES["bfd_pack"](spark, data).collect()
    assert sum(r.segments for r in bins) == spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()
    assert all((r.used > 4096) == (r.fault == "too_long") for r in bins)


def test_best_fit_against_a_plain_loop():
    import random

    g = random.Random(3)
    for _ in range(30):
        lengths, rooms, want = [g.randint(1, 12) for _ in range(40)], [], {}
        for i in sorted(range(40), key=lambda i: (-lengths[i], i)):
            fit = min((b for b in range(len(rooms)) if rooms[b] >= lengths[i]), key=lambda b: (rooms[b], b), default=None)
            if fit is None:
                fit = len(rooms)
                rooms.append(12)
            rooms[fit] -= lengths[i]
            want[i] = fit
        assert precompiled.best_fit(lengths, 12) == [want[i] for i in range(40)]


def test_packing_by_counts_is_best_fit():
    from collections import Counter

    g = __import__("random").Random(5)
    for _ in range(300):
        size = g.choice((1, 5, 12, 64))
        lengths = [g.randint(1, g.choice((size, max(1, size // 3)))) for _ in range(g.randint(0, 90))]
        pieces, bins = precompiled.fit_counts(Counter(lengths), size)
        rank, got, segs = Counter(), [], {}
        for i, n in enumerate(lengths):
            _, first, b, each, seg = [p for p in pieces if p[0] == n and p[1] <= rank[n]][-1]
            got.append(b + (rank[n] - first) // each)
            segs.setdefault(got[-1], []).append((-n, i, seg + (rank[n] - first) % each))
            rank[n] += 1
        assert got == precompiled.best_fit(lengths, size) and bins == len(set(got))
        assert all([x[2] for x in sorted(s)] == list(range(len(s))) for s in segs.values())


def test_packing_of_a_large_table_is_one_packing(spark):
    """18 million ids: the bins of the whole table, not of parts of it."""
    rows = spark.range(9000).selectExpr("id", "array_repeat(1, int(if(id % 100 = 7, 4097, 500 + id * 37 % 3001))) as input_ids", "array(1) as labels")
    got = precompiled.pack(rows, "id", 4096).selectExpr("row_id", "bin_id", "seg_no", "fault", "size(input_ids) as n", "size(position_ids) as p").collect()
    order = sorted(got, key=lambda r: r.row_id)
    fit, long = [r for r in order if r.n <= 4096], [r for r in order if r.n > 4096]
    want = precompiled.best_fit([r.n for r in fit], 4096)
    assert sum(r.n for r in got) > 16_000_000 and len(got) == 9000 and all(r.n == r.p for r in got)
    assert [r.bin_id for r in fit] == [f"0-0-{b}" for b in want] and [r.bin_id for r in long] == [f"0-0-{max(want) + 1 + i}" for i in range(90)]
    assert all(r.fault is None for r in fit) and all(r.fault == "too_long" and r.seg_no == 0 for r in long)
    assert sorted((r.bin_id, r.seg_no) for r in got) == sorted((b, i) for b, n in __import__("collections").Counter(r.bin_id for r in got).items() for i in range(n))


def test_whole_build_gate_and_refusals(spark, tmp_path):
    rows = [("a", "b"), ("a", "b"), ("x", " "), ("long", "z" * 5000)]
    spec = SourceSpec("pairs", "d", None, "train", "r", "MIT", 10**6, "aya", columns=("inputs", "targets"))
    other = SourceSpec("more", "d", None, "train", "r", "MIT", 1, "aya")

    def provide(s, source, seed):
        have = rows if source.name == "pairs" else [("n", "m"), ("o", "p")]
        return s.createDataFrame([(i, *r) for i, r in enumerate(have)], "pos bigint, inputs string, targets string")

    out = tmp_path / "table"
    done = prepare(spark, out, (spec, other), row_provider=provide)
    by = {s["name"]: s for s in done["sources"]}
    assert by["pairs"]["rows"] == 1 and by["pairs"]["rejected"] == {"duplicate": 1, "invalid": 1, "too_long": 1}
    assert by["more"]["rows"] == 1 and by["more"]["rejected"] == {} and not done["complete"] and done["total_rows"] == 2
    with pytest.raises(FileExistsError):
        prepare(spark, out, (spec,), row_provider=provide)
    with pytest.raises(Invalid):
        precompiled.load_precompiled(spark, [str(out)], None, "bytes", "1", vocab_size=267)
    good = prepare(spark, tmp_path / "good", (other,), row_provider=provide)
    assert good["complete"] and precompiled.load_precompiled(spark, [str(tmp_path / "good")], None, "bytes", "1", vocab_size=ByteTokenizer.size).count() == 1


def test_sources(spark, tmp_path):
    assert sum(s.quota for s in catalogue.DEFAULT_SOURCES) == 10_000_000 and sum(len(s.urls) for s in catalogue.DEFAULT_SOURCES) == 62
    assert catalogue.override_quotas(catalogue.DEFAULT_SOURCES, ["aya=5"])[1].quota == 5 and catalogue.dimension(spark).count() == 6
    for bad in ("aya", "aya=-1", "none=3"):
        with pytest.raises(Invalid):
            catalogue.override_quotas(catalogue.DEFAULT_SOURCES, [bad])
    (tmp_path / "a.jsonl").write_text('{"a":1,"b":2}\n\n[1]\n{bad\n{"b":3}\n')
    got = [json.loads(r.raw) if r.raw != "{bad" else r.raw for r in readers.scan(spark, [str(tmp_path / "a.jsonl")], ("a",)).collect()]
    assert got == [{"a": 1}, [1], "{bad", {"a": None}]
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, ["https://example.org/x.parquet?download=1"], str(tmp_path))
    assert readers.cached_path("https://example.org/x.parquet?download=1", "/c").suffix == ".parquet"
    shards = [spark.createDataFrame([(s, i) for i in range(n)], "s int, i int").coalesce(1) for s, n in ((0, 3), (1, 1), (2, 2))]
    assert [(r.s, r.i) for r in readers.interleave(shards).orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2)]
    with pytest.raises(Invalid):
        sinks.check_launch({"complete": True, "files": []}, None, None)


PAIRS = "inputs string, targets string"


def test_orders_do_not_depend_on_splits(spark, tmp_path):
    rows = [(f"q{i % 700}", "same" if i % 3 else f"a{i}") for i in range(2000)]
    spark.createDataFrame(rows, PAIRS).repartition(5).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/p")
    files = sorted(str(f) for f in (tmp_path / "p").glob("*.parquet"))
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"inputs": a, "targets": b}) for a, b in rows + rows[:300]))
    specs = [SourceSpec("p", "d", None, "train", "r", "MIT", 1, "aya", tuple(files), ("inputs", "targets")), SourceSpec("l", "d", None, "train", "r", "MIT", 1, "aya", f"{tmp_path}/l.jsonl", ("inputs", "targets"))]
    seen = {}
    try:
        for size in ("100000000", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for spec in specs:
                d = readers.read_source(spark, spec, 7)
                got = sorted(map(tuple, d.collect()), key=str)
                assert len({r[-1] for r in got}) == len(got) == (2000 if spec.name == "p" else 2300)
                assert seen.setdefault(spec.name, got) == got
                seen.setdefault(spec.name + " partitions", set()).add(d.rdd.getNumPartitions() if spec.name == "p" else 0)
        assert len(seen["p partitions"]) == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    turns = readers.read_source(spark, specs[0], 7, order="interleaved").orderBy("pos").limit(10).collect()
    assert len({r.pos for r in turns}) == 10 and {r.pos % 5 for r in turns[:5]} == set(range(5))
    with pytest.raises(Invalid):
        readers.read_source(spark, specs[1], 7, order="interleaved")


def test_numbering_of_equal_rows_over_salts(spark):
    d = spark.createDataFrame([("x",)] * 500 + [("y",)] * 3 + [("z",)], "c string").repartition(7)
    got = readers.numbered(d, "c", salts=5).collect()
    assert sorted((r.c, r.nth) for r in got) == [("x", i) for i in range(500)] + [("y", i) for i in range(3)] + [("z", 0)]


@pytest.mark.parametrize("quota", [50, 100_000])
def test_build_stops_at_the_quota(spark, tmp_path, quota):
    g = __import__("random").Random(4)
    rows = [(i, f"q{g.randrange(900)}", g.choice(("a", "bb", " "))) for i in range(3000)]
    specs = tuple(SourceSpec(n, "d", None, "train", "r", "MIT", quota, "aya") for n in ("one", "two"))
    provide = lambda s, spec, seed: s.createDataFrame(rows if spec.name == "one" else [(i, a, b + "c") for i, a, b in rows], "pos bigint, " + PAIRS)
    events = []
    done = prepare(spark, tmp_path / "out", specs, row_provider=provide, first_span=60, progress=events.append)
    last = {e["source"]: e for e in events}
    whole = prepare(spark, tmp_path / "whole", specs, row_provider=provide)
    assert done["output_sha256"] and done["sources"] == whole["sources"] and done["total_rows"] == whole["total_rows"]
    table = lambda n: sorted(map(str, spark.read.parquet(f"{tmp_path}/{n}").collect()))
    assert table("out") == table("whole")
    if quota == 50:
        assert all(e["compiled"] <= 300 and e["target_tokens"] >= quota for e in last.values())
        assert all(e["seen"] == e["rows"] + sum(s["rejected"].values()) for e, s in ((last[s["name"]], s) for s in done["sources"]))
    else:
        assert all(e["compiled"] == 3000 for e in last.values()) and not done["complete"]
    assert not (tmp_path / ".out.work").exists()


def test_workers_hold_little_of_a_batch(spark, monkeypatch):
    """Rows of a batch become Python values a few at a time, with the same results and order; a large row comes alone."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tessera.functions import batches
    from tessera.operators.compile import compile_rows

    monkeypatch.setattr(DataFrame, "mapInArrow", lambda d, run, schema: run)
    d = spark.createDataFrame([], "pos bigint, inputs string, targets string")
    m = spark.createDataFrame([], "pos bigint, messages_json string, tools_json string, rejection string")
    rows = [(i, f"q{i}", "a" * (400_000 if i == 777 else 1000 if i % 2 else 5)) for i in range(3000)]
    full = pa.table([pa.array(x) for x in zip(*rows)], names=["pos", "inputs", "targets"]).combine_chunks().to_batches()
    found = list(adapters.adapt(d, "aya", ("pos",))(iter(full)))
    got = pa.Table.from_batches(found).to_pylist()
    assert [(r["pos"], r["messages_json"], r["rejection"]) for r in got] == [(i, f'[{{"content":"{a}","role":"user"}},{{"content":"{b}","role":"assistant"}}]', None) for i, a, b in rows]
    assert all(x.num_rows <= batches.ROWS and (x.num_rows == 1 or x.nbytes < 2 * batches.BYTES) for x in found)
    sent = pa.Table.from_batches(found).select(["pos", "messages_json", "tools_json", "rejection"]).combine_chunks().to_batches()
    done = list(compile_rows(m, ByteTokenizer(), None, 3000)(iter(sent)))
    assert [r["pos"] for x in done for r in x.to_pylist()] == list(range(3000)) and all(n > 0 for x in done for n in x.column("target_tokens").to_pylist())
    assert all(x.num_rows == 1 or x.nbytes < 14 * batches.BYTES for x in done)
    assert not list(batches.pieces(full[0].slice(0, 0)))


def test_build_sends_small_batches_and_restores_the_setting(spark, tmp_path):
    from tessera.functions.batches import SENT

    seen, before = [], spark.conf.get(SENT)

    def provide(s, spec, seed):
        seen.append(int(s.conf.get(SENT)))
        if spec.name == "bad":
            raise ValueError("no rows")
        return s.createDataFrame([(i, f"q{i}", "a") for i in range(2000)], "pos bigint, " + PAIRS)

    specs = [SourceSpec(n, "d", None, "train", "r", "MIT", 10**6, "aya") for n in ("good", "bad")]
    assert prepare(spark, tmp_path / "a", tuple(specs[:1]), row_provider=provide)["total_rows"] == 2000
    with pytest.raises(ValueError):
        prepare(spark, tmp_path / "b", tuple(specs[1:]), row_provider=provide)
    assert seen == [512, 512] and spark.conf.get(SENT) == before == "10000"


def test_build_keeps_no_ids_of_rejected_rows(spark, tmp_path):
    """Their arrays are of any length, and a Parquet reader holds thousands of rows at a time."""
    rows = [(i, f"q{i}", "z" * (20_000 if i % 2 else 3) if i % 5 else " ") for i in range(40)]
    spec = SourceSpec("one", "d", None, "train", "r", "MIT", 10**6, "aya")
    done = prepare(spark, tmp_path / "out", (spec,), row_provider=lambda s, *_: s.createDataFrame(rows, "pos bigint, " + PAIRS), keep_work=True)
    assert done["sources"][0]["rejected"] == {"too_long": 16, "invalid": 8} and done["total_rows"] == 16
    for name in ("compiled-one-0", "outcomes-one-0"):
        work = spark.read.parquet(f"{tmp_path}/.out.work/{name}")
        assert work.count() == 40 and work.where("rejection is not null and (input_ids is not null or labels is not null)").count() == 0
        assert work.where("rejection is null and size(input_ids) = size(labels)").count() == 16 and "assistant_mask" not in work.columns
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.where("size(input_ids) = size(labels) and target_tokens > 0").count() == table.count() == 16


def test_build_of_files_is_the_same_under_two_splits(spark, tmp_path):
    rows = [(f"q{i % 50}", f"a{i % 70}") for i in range(400)]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"inputs": a, "targets": b}) for a, b in rows))
    spec = SourceSpec("l", "d", None, "train", "r", "MIT", 700, "mine", f"{tmp_path}/l.jsonl", ("inputs", "targets"))
    mine = lambda row: ([{"role": "user", "content": row["inputs"]}, {"role": "assistant", "content": row["targets"]}], [])
    digests = set()
    try:
        for k, size in enumerate(("100000000", "1000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            done = prepare(spark, f"file://{tmp_path}/o{k}.parquet", (spec,), custom={"mine": mine}, single_file=True, first_span=30)
            import hashlib

            assert done["output_sha256"] == hashlib.sha256((tmp_path / f"o{k}.parquet").read_bytes()).hexdigest()
            digests.add(str(sorted(map(str, spark.read.parquet(f"{tmp_path}/o{k}.parquet").collect()))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(digests) == 1 and done["complete"]


def test_packing_depends_on_rows_alone(spark):
    g = __import__("random").Random(6)
    rows = [(str(i), [i] * g.randint(1, 30), [i]) for i in range(400)] + [("hot", [7] * 9, [7])] * 300
    d = spark.createDataFrame(rows, "id string, input_ids array<int>, labels array<int>")
    found = []
    for parts, shuffle in ((1, "4"), (9, "64")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        found.append(sorted(map(str, precompiled.pack(d.repartition(parts), "id", 32, group_tokens=500).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == 700
    for limit in (500, 10**6):
        used, group = {}, {}
        for r in precompiled.pack(d, "id", 32, group_tokens=limit).collect():
            used[r.bin_id] = used.get(r.bin_id, 0) + len(r.input_ids)
            piece = r.bin_id.rsplit("-", 1)[0]
            group[piece] = group.get(piece, 0) + len(r.input_ids)
        assert max(used.values()) <= 32 and max(group.values()) < 2 * limit + 32
    one = precompiled.pack(d, "id", 32).collect()
    order = sorted(one, key=lambda r: (r.row_id, list(r.input_ids)))
    want = precompiled.best_fit([len(r.input_ids) for r in order], 32)
    assert len({r.bin_id for r in one}) == len(set(want)) and sorted(f"0-0-{b}" for b in want) == sorted(r.bin_id for r in one)


def test_streamed_batches_and_a_replay_follow_the_rule(spark, tmp_path):
    from tessera.streaming import ingest

    g = __import__("random").Random(9)
    kind = {f"{k:02x}fp": (g.choice([None, None, None, "too_long"]), g.randint(0, 9)) for k in range(90)}
    rows = [(i, g.choice("ab"), fp, *kind[fp]) for i, fp in enumerate(g.choice(list(kind)) for _ in range(360))]
    quotas, size = {"a": 90, "b": 10**6}, 40
    schema = "pos bigint, source string, fingerprint string, rejection string, target_tokens bigint"
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size] + [(10**6 + k, "unknown", "x", None, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/out"
    ingest.run(stream, root, f"{tmp_path}/check", quotas)
    accepted, tokens, want = set(), {"a": 0, "b": 0}, []
    for k in range(0, len(rows), size):
        for source in "ab":
            for pos, s, fp, why, n in rows[k : k + size]:
                if s != source or tokens[s] >= quotas[s]:
                    continue
                outcome = "duplicate" if fp in accepted else why or "accepted"
                want.append((fp, s, n, outcome))
                if outcome == "accepted":
                    accepted.add(fp)
                    tokens[s] += n
    read = lambda: sorted((r.fingerprint, r.source, r.target_tokens, r.outcome) for r in ingest.outcomes(spark, root).collect())
    assert read() == sorted(want)
    state = ingest.state(spark, root, 8)
    assert state["tokens"] == tokens and len(state["segments"]) <= 4
    assert {r.fingerprint for r in ingest.seen(spark, state["segments"]).collect()} == accepted
    again = spark.createDataFrame(rows[320:], schema)
    ingest.handler(root, quotas)(again, 8)  # the last batch once more, as after a failure
    assert read() == sorted(want) and ingest.state(spark, root, 8) == state
    assert len(list((tmp_path / "out/state").glob("[0-9]*.json"))) == 2


def test_tokenizers_apart_and_foreign_ones(spark):
    from tessera.operators.compile import compile_rows
    from tessera.operators.tokenizers import SECURE, IsolatedTokenizer, TokenizerFailure

    class Tokens:
        """A third-party tokenizer with the call alone."""

        eos, ids, size = 0, ByteTokenizer.ids, 267

        def __call__(self, texts, *, add_special_tokens, split_special_tokens, padding, truncation):
            assert split_special_tokens and not add_special_tokens
            if any("odd" in t for t in texts):
                raise RuntimeError("batch fails")
            return {"input_ids": ByteTokenizer().encode_batch(texts)}

        def encode(self, text, **_):
            return ByteTokenizer().encode_batch([text])[0]

    chat = lambda t: json.dumps([{"role": "user", "content": t}, {"role": "assistant", "content": "hi"}])
    d = spark.createDataFrame([(i, chat(t), "[]", None if i else False) for i, t in enumerate(("one", "odd", "three"))], "id int, messages_json string, tools_json string, preserve_thinking boolean")
    want = sorted(map(str, compile_rows(d, ByteTokenizer()).collect()))
    with IsolatedTokenizer(ByteTokenizer, 30, ByteTokenizer.ids, 0, 267) as apart:
        assert sorted(map(str, compile_rows(d, apart).collect())) == want
        assert apart.encode_batch(["a"]) == [[108]]
    with pytest.raises(TokenizerFailure):
        apart.encode_batch(["a"])
    assert sorted(map(str, compile_rows(d, Tokens()).collect())) == want
    assert ByteTokenizer()(["a"], **SECURE) == {"input_ids": [[108]]}
    with pytest.raises(Invalid):
        ByteTokenizer()(["a"], **{**SECURE, "split_special_tokens": False})


def test_serialised_tokenizer_and_strict_loading(spark, tmp_path):
    from tessera.operators.tokenizers import byte_level, from_backend_json
    from tessera.protocol import MARKERS

    vocab = {"<unk>": 0} | {c: i + 1 for i, c in enumerate(byte_level().values())} | {"the": 300, "Ġthe": 301}
    config = {"model": {"type": "WordPiece", "unk_token": "<unk>", "continuing_subword_prefix": "", "max_input_chars_per_word": 2**31 - 1, "vocab": vocab}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": False}, "normalizer": None, "added_tokens": [{"id": 400, "content": "<|endoftext|>"}, {"id": 401, "content": MARKERS["ctrl"]}]}
    t = from_backend_json(json.dumps(config), "<|endoftext|>")
    assert t.eos == 400 and t.ids[MARKERS["ctrl"]] == 401 and min(i for m, i in t.ids.items() if m != MARKERS["ctrl"]) == 402
    assert t.encode_batch(["the the"]) == [[300, 301]] and len(t.encode_batch(["<|ctrl|>"])[0]) == 8
    (tmp_path / "t.json").write_text(json.dumps(config))
    line = {"messages": json.dumps([{"role": "user", "content": "the"}, {"role": "assistant", "thinking": "why", "content": "the the"}]), "preserve_thinking": False}
    (tmp_path / "m.jsonl").write_text(json.dumps(line))
    rows = precompiled.load(spark, [f"{tmp_path}/m.jsonl"], t).collect()
    assert len(rows) == 1 and 300 in rows[0].input_ids and t.ids[MARKERS["think"]] not in rows[0].input_ids
    (tmp_path / "bad.jsonl").write_text(json.dumps({"messages": "[]"}))
    with pytest.raises(Exception, match="can't be compiled"):
        precompiled.load(spark, [f"{tmp_path}/bad.jsonl"], t).collect()
    from tessera import cli

    assert cli.main(["check", "--data", f"{tmp_path}/m.jsonl", "--tokenizer", f"{tmp_path}/t.json", "--tokenizer-timeout-seconds", "30", "--packed", f"{tmp_path}/packed"]) == 0
    assert spark.read.parquet(f"{tmp_path}/packed").count() == 1 and "<|eot|>" in (tmp_path / "packed/_chat_template.txt").read_text()


def test_command_line_build_from_a_cache(spark, tmp_path, monkeypatch):
    from tessera import cli

    spec = catalogue.DEFAULT_SOURCES[1]
    spark.createDataFrame([(f"q{i}", f"answer {i}", i) for i in range(40)], PAIRS + ", other int").coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "cache").mkdir()
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "cache" / readers.cached_path(spec.urls[0], "/").name)
    monkeypatch.setenv(readers.CACHE_VARIABLE, str(tmp_path / "cache"))
    quotas = [x for s in catalogue.DEFAULT_SOURCES for x in ("--quota", f"{s.name}={200 if s.name == 'aya' else 0}")]
    assert cli.main(["prepare", "--output", f"{tmp_path}/o.parquet", "--single-file", *quotas]) == 0
    made = json.loads((tmp_path / "o.parquet.manifest.json").read_text())
    assert made["complete"] and made["source_cache"] == str(tmp_path / "cache") and 0 < made["total_rows"] < 40
    assert cli.main(["check", "--data", f"{tmp_path}/o.parquet"]) == 0


def test_web_files_are_copied_by_the_executors(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    spark.createDataFrame([(f"q{i}", "a") for i in range(9)], PAIRS).coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "x.parquet")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spec = SourceSpec("w", "d", None, "train", "r", "MIT", 1, "aya", f"{base}/x.parquet", ("inputs", "targets"))
        assert readers.read_source(spark, spec).count() == 9
        made = sinks.fill_cache([f"{base}/x.parquet"], tmp_path / "cache")
        assert made["complete"] and made["files"][0]["size"] == (tmp_path / "x.parquet").stat().st_size
        assert readers.read_source(spark, spec, cache=str(tmp_path / "cache")).count() == 9
        with pytest.raises(Exception, match="404"):
            readers.resolve(spark, [f"{base}/none.parquet"])
    finally:
        server.shutdown()


def test_hub_snapshots_and_streams(spark, tmp_path, monkeypatch):
    from tessera.sources import hub

    chat, tools = catalogue.DEFAULT_SOURCES[0], catalogue.DEFAULT_SOURCES[3]
    assert not chat.urls and not tools.urls
    top = tmp_path / chat.dataset / chat.revision / "data"
    for split in ("train_sft", "test_sft"):
        spark.createDataFrame([([("user", "a"), ("assistant", split)],)], "messages array<struct<role string, content string>>").coalesce(1).write.parquet(f"{tmp_path}/{split}")
        top.mkdir(parents=True, exist_ok=True)
        next((tmp_path / split).glob("*.parquet")).rename(top / f"{split}-00000-of-00001.parquet")
    other = tmp_path / tools.dataset / tools.revision
    other.mkdir(parents=True)
    (other / "func-calling.json").write_text(json.dumps([{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "é"}]}, {"conversations": []}]))
    (other / "func-calling-singleturn.json").write_text("[1, 2, 3]")
    monkeypatch.setenv(hub.ROOT_VARIABLE, str(tmp_path))
    assert [m.content for m in readers.read_source(spark, chat).first().messages] == ["a", "train_sft"]
    assert "func-calling.json" in " ".join(hub.snapshot_files(spark, tools))
    done = prepare(spark, tmp_path / "out", tuple(catalogue.override_quotas(catalogue.DEFAULT_SOURCES, [f"{s.name}={int(not s.urls)}" for s in catalogue.DEFAULT_SOURCES])))
    assert {s["name"]: s["rows"] for s in done["sources"] if s["quota"]} == {"ultrachat": 1, "hermes_func_calling": 1}
    monkeypatch.delenv(hub.ROOT_VARIABLE)
    with pytest.raises(Invalid):
        readers.read_source(spark, chat)
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/datasets.py").write_text("class D:\n    n_shards = 3\n    def __init__(self, k=None): self.k = k\n    def shard(self, num_shards, index): return D(index)\n    def __iter__(self): return iter([{'messages': [{'role': 'user', 'content': str(self.k)}]}] * 2)\ndef load_dataset(name, config=None, *, split, revision, streaming):\n    assert streaming and split == 'train_sft'\n    return D()\n")
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    spark.sparkContext.addPyFile(str(tmp_path / "lib/datasets.py"))
    rows = readers.read_source(spark, chat).collect()
    assert sorted(json.loads(r.raw)["messages"][0]["content"] for r in rows) == ["0", "0", "1", "1", "2", "2"] and len({r.pos for r in rows}) == 6


def test_launchers(tmp_path):
    import subprocess
    import sys

    from tessera.plans.template import load_template

    done = subprocess.Popen([sys.executable, "-c", "pass"])
    done.wait()
    sinks.wait_for(done.pid, 0.1)
    assert sinks.prepare_command("o", max_length=8, manifest=None)[1:] == ["-m", "tessera.cli", "prepare", "--output", "o", "--max-length", "8"]
    (tmp_path / "t.jinja").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "t.jinja")
    assert load_template(tmp_path / "t.jinja") == "x" and "<|eot|>" in load_template()
    for bad in ("link", "none"):
        with pytest.raises(FileNotFoundError):
            load_template(tmp_path / bad)
    sinks.check_launch({"complete": True, "files": [1]}, {"complete": True, "target_tokens": 10**7}, tmp_path / "new")
    with pytest.raises(FileExistsError):
        sinks.check_launch(None, None, tmp_path)
    assert sinks.may_delete_cache(tmp_path / "c", {"source_cache": str(tmp_path / "c")}, tmp_path) and not sinks.may_delete_cache(tmp_path, {"source_cache": str(tmp_path)}, tmp_path)
