"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    have = [x[0] for x in cur.description]
    assert sorted(have) == cols
    want = sorted(str([r[have.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_longest_match_against_a_loop(spark, data):
    from tessera.build_queries import VOCABULARY
    import base64

    with open(VOCABULARY, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    longest = max(map(len, ids))
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["wordpiece_longest_match"](spark, data).collect():
        raw, at, want = text[r.doc_id], 0, []
        while at < len(raw):
            size = next(n for n in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + n] in ids)
            want.append(ids[raw[at : at + size]])
            at += size
        assert list(r.input_ids) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(ORACLE_SQL) <= set(entry.queries())
