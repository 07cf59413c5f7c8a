"""The pipeline: stages in order, their decisions, and the result against single steps."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tessera.llm import bpe, mixing, neardup, pii, toxicity


def test_stages(spark, data):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    step = cp.without_toxic(spark, docs, data)
    assert step.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.toxic_documents(docs, labels).where("is_toxic").collect()}
    assert {r.doc_id for r in step.collect()} == {r.doc_id for r in docs.collect()} - toxic
    labelled = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [i for i, t in labelled.items() if not t]
    assert sum(i in toxic for i in clean) <= 0.1 * len(clean)
    unique = cp.without_near_duplicates(spark, docs, data)
    groups = neardup.duplicate_groups(docs).where("not is_kept").count()
    assert unique.columns == docs.columns and unique.count() == docs.count() - groups
    masked = cp.without_pii(spark, docs, data)
    assert masked.columns == docs.columns and pii.find(masked).count() == 0 < pii.find(docs).count()
    mixed = cp.mixed(spark, docs, data)
    assert mixed.columns == docs.columns and mixed.count() == mixing.sample(docs).groupBy().sum("copies").first()[0]
    tokens = cp.tokenised(spark, docs, data)
    assert tokens.where("not round_trip").count() == 0 and tokens.count() == docs.count()
    assert {(r.doc_id, r.text) for r in bpe.decode_documents(tokens).collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_run(spark, data):
    out = cp.run(spark, data)
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows) and "tokens" in out.columns and "text" not in out.columns
    docs = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= docs


EXTRA = {"tokens": "7", "copies": "7", "root": "'r'", "group_id": "7", "row": "'x'", "is_toxic": "true", "n_tokens": "7", "__cut": "1"}


def folder(spark, path, docs, labels):
    """A data folder of (doc_id, text, lang, source) rows, with columns whose names clash with inner ones."""
    d = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.withColumns({c: F.expr(e) for c, e in EXTRA.items()}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def small_corpus():
    """Toxic and clean texts, near and exact copies, personal data, and awkward rows."""
    g = random.Random(8)
    parts = "ka lo mi ran ten ver sol pra du nek".split()
    docs, labels = [], []
    for i in range(150):
        w = ["".join(g.choices(parts, k=g.randint(1, 4))) for _ in range(g.randint(12, 90))]
        bad = i % 5 == 0
        for _ in range(1 + len(w) // 30 if bad else 0):
            w.insert(g.randrange(len(w)), g.choice(("idiot", "scum", "vermin")))
        if i % 7 == 3:
            w.insert(g.randrange(len(w)), g.choice(("jo.li@site.org", "10.0.0.1,10.0.0.2", "123-45-6789;a.b@c.com")))
        docs.append((i, " ".join(w), "en", g.choice(("src0", "src1", "elsewhere"))))
        labels.append((i, int(bad), 1))
        if i % 6 == 1:
            v = list(w)
            v[g.randrange(len(v))] = "changed"
            docs.append((1000 + i, " ".join(g.choice((w, v))), "en", "src2"))
    docs += [(2000, None, "en", "src0"), (2001, "", "en", "src0"), (2002, " \n ", None, "src1"), (2003, "...!?", "en", None), (None, "some words without an id", "en", "src0"), (2004, "two rows of one id", None, "src1"), (2004, "two rows of one id", None, "src1"), (2005, "long " * 6000 + "mail jo.li@site.org", "de", "src3")]
    return docs, labels + [(None, 1, 1), (5000, None, 0), (3, 0, 1)]


def test_run_against_brute_force(spark, tmp_path):
    docs, labels = small_corpus()
    path = folder(spark, tmp_path, docs, labels)
    read = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.Model.loads(toxicity.train_on(read, spark.read.parquet(f"{path}/labels.parquet")))

    def rejected(text):
        logit = brute.toxic_logit(model, text) if len(text or "") < 5000 else max(brute.window_logit(model, w) for w in (["long"] * 32, ["long"] * 14 + ["mail", "jo.li@site.org"]))
        return logit is not None and logit >= model.threshold

    left = [d for d in docs if not rejected(d[1])]
    assert 15 < len(docs) - len(left) < 60
    group = brute.near_groups({i: t for i, t, *_ in left if i is not None})
    left = [d for d in left if d[0] is None or group[d[0]] == d[0]]
    left = [(i, brute.masked(t), g, s) for i, t, g, s in left]
    copies = brute.copies([(i, s, None if t is None else len(t)) for i, t, _, s in left])
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    want = Counter()
    for i, t, g, s in left:
        if n := copies.get((i, s, len(t or "")), 0):
            want[i, g, s, len(t), tuple(brute.tokens(ranks, t))] += n
    out = cp.run(spark, path)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *[c for c in EXTRA if c not in ("tokens", "n_tokens")], "tokens", "n_tokens", "round_trip"]
    rows = out.collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.tokens)) for r in rows) == want and all(r.round_trip for r in rows)
    assert len(want) > 50 and max(want.values()) > 1


@pytest.mark.parametrize("docs, labels", [([], []), ([(1, None, None, None), (None, None, None, None)], [(1, 1, None)]), ([(1, "", "en", "s"), (2, "a few words", "en", "s")], [])])
def test_run_on_tables_with_nothing_to_learn(spark, tmp_path, docs, labels):
    rows = cp.run(spark, folder(spark, tmp_path, docs, labels)).collect()
    assert {r.doc_id for r in rows} <= {2} and all(r.round_trip for r in rows)


def test_registered():
    names = set(entry.queries())
    assert {"pipeline"} | {f"op{n}_" for n in range(1, 11)} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= names
