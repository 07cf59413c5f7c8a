"""The operators on texts against brute force, and on the awkward rows that every one must bear."""

import itertools
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, langid, mixing, neardup, pii, pii_table, textkit, toxicity, unitdedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, copies int, `key` string"


def frame(spark, rows):
    """Documents of (doc_id, text, source) rows, with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", 7, "k") for i, t, s in rows], DOCS)


def invented(seed, n, lo=20, hi=120):
    g = random.Random(seed)
    parts = "ka lo mi ran ten ver sol pra du nek".split()
    return [" ".join("".join(g.choices(parts, k=g.randint(1, 4))) for _ in range(g.randint(lo, hi))) for _ in range(n)]


AWKWARD = [(1, None, "s"), (2, "", "s"), (3, "  \n\t ", "s"), (4, "...!!", None), (None, "some words stand here", "s"), (5, "one", "s"), (5, "one", "s"), (6, "wort " * 30000, "s"), (7, "É" * 5000, "s")]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- 1 near duplicates ----------------------------------------------------------


def plain_words(text):
    return [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]


def shingle_set(text):
    w = plain_words(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def spoil(text, rate, g):
    return " ".join("".join(g.choices("abcdefgh", k=6)) if g.random() < rate else w for w in text.split())


def copies(seed=1):
    g = random.Random(seed)
    rows, n = [], 0
    for t in invented(seed, 60, 60, 150):
        for k in range(g.choice((1, 1, 2, 3, 9))):
            rows.append((n, t if k == 0 else spoil(t, g.choice((0, 0.01, 0.04, 0.08)), g), "s"))
            n += 1
    g.shuffle(rows)
    return rows


def brute_groups(rows, threshold):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and jaccard(sets[a], sets[b]) >= threshold]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return near, {i: find(i) for i in sets}


def test_neardup_against_all_pairs(spark):
    rows = copies()
    near, want = brute_groups(rows, neardup.THRESHOLD)
    got = {r.doc_id: r for r in neardup.duplicate_groups(frame(spark, rows)).collect()}
    found = sum(a in got and b in got and got[a].group_id == got[b].group_id for a, b in near)
    assert len(near) > 200 and found >= 0.97 * len(near)
    assert all(want[i] == want[r.group_id] for i, r in got.items())  # never joins what brute force keeps apart
    sizes = Counter(r.group_id for r in got.values())
    assert all(r.group_size == sizes[r.group_id] and r.is_kept == (r.doc_id == r.group_id) for r in got.values())
    kept = {r.doc_id for r in neardup.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, _, _ in rows} - {i for i, r in got.items() if not r.is_kept}


def templates(seed=4):
    """Documents of one form text with fillings of their own (similar, but under the threshold), and near copies of some."""
    g = random.Random(seed)
    form, rows = invented(seed, 1, 120, 120)[0].split(), []
    for i in range(70):
        own = invented(1000 + i, 1, 90, 90)[0]
        text = " ".join(form) + " " + own if i % 3 else own + " " + " ".join(form[: 100 + i % 20])
        rows += [(10 * i + k, text if not k else spoil(text, 0.05, g), "s") for k in range(g.choice((1, 1, 1, 2, 4)))]
    return rows


@pytest.mark.parametrize("rounds", [1, 3])
def test_a_hot_key_of_unlike_documents_is_resolved_exactly(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    for rows in (templates(), copies(2)):
        want = brute.near_groups({i: t for i, t, _ in rows})
        assert len(set(want.values())) > 40
        got = {r.doc_id: r.group_id for r in neardup.duplicate_groups(frame(spark, rows)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_tensored_keys_follow_the_formula():
    g = random.Random(5)
    base = invented(9, 1, 400, 400)[0]
    hits = Counter()
    for _ in range(60):
        a, b = base.split(), base.split()
        for i in g.sample(range(400), 40):
            b[i] = f"x{g.random()}"
        h, start, _, _ = neardup.shingles(pa.array([" ".join(a), " ".join(b)]))
        small = neardup.small_hashes(h, start)
        hits["any"] += bool((small[0, :9] == small[1, :9]).any() and (small[0, 9:] == small[1, 9:]).any())
    assert hits["any"] >= 55  # s is about 0.6


def test_neardup_awkward(spark, awkward, empty):
    rows = neardup.duplicate_groups(awkward.unionByName(frame(spark, [(8, "one", "x"), (9, "One!", "x")]))).collect()
    assert sorted((r.doc_id, r.group_id, r.group_size) for r in rows) == [(5, 5, 3), (8, 5, 3), (9, 5, 3)]
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert neardup.duplicate_groups(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(205, 200), (205, 203), (7, 7)]
    from tessera.llm.shared import Scratch

    got = {r.doc_id: r.root for r in neardup.components(Scratch(spark, "t"), spark.createDataFrame(edges, "u bigint, v bigint"), "cc").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))
    assert got[205] == 200 and got[203] == 200


# --- 2 fingerprints --------------------------------------------------------------


def slow_signature(text, samples):
    terms = Counter(w for w in (fingerprint.EDGE.sub("", x) for x in text.lower().split()) if w)
    out = []
    for k in range(samples):
        best = None
        for term, weight in terms.items():
            h = textkit.hash_words(pa.array([term]))
            r, c, b = fingerprint.log_gamma2(h, 5 * k)[0], fingerprint.log_gamma2(h, 5 * k + 2)[0], textkit.uniforms(h, 5 * k + 4)[0]
            n = math.floor(math.log(weight) / r + b)
            lna = math.log(c) - r * (n - b) - r
            if best is None or lna < best[0]:
                best = (lna, term, n)
        out.append(best[1:])
    return out


def test_signatures_against_the_definition():
    texts = invented(3, 6, 5, 60)
    texts.append(" ".join(texts[0].split() * 3))
    sig, count, total = fingerprint.signatures(pa.array(texts), 16)
    slow = [slow_signature(t, 16) for t in texts]
    assert total.tolist() == [len(t.split()) for t in texts] and count.tolist() == [len(set(t.split())) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert [a == b for a, b in zip(sig[i], sig[j])] == [a == b for a, b in zip(slow[i], slow[j])]


def test_collisions_estimate_generalised_jaccard():
    g = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    a, b = Counter(g.choices(words, k=200)), Counter(g.choices(words, k=150))
    exact = sum((a & b).values()) / sum((a | b).values())
    sig, _, _ = fingerprint.signatures(pa.array([" ".join(x.elements()) for x in (a, b)]), 1500)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def test_fingerprints_awkward(awkward, empty):
    rows = fingerprint.fingerprints(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].signature == [] and by[i].fingerprint is None and by[i].n_terms == 0 for i in (1, 2, 3, 4))
    assert len(by[5].signature) == fingerprint.SAMPLES and by[6].total_weight == 30000
    same = [r for r in rows if r.doc_id == 5]
    assert same[0] == same[1] and fingerprint.fingerprints(empty).count() == 0


def test_signature_does_not_depend_on_slices():
    texts = pa.array(invented(8, 30))
    whole, _, _ = fingerprint.signatures(texts, 8)
    parts = np.concatenate([fingerprint.signatures(texts.slice(i, 7), 8)[0] for i in range(0, 30, 7)])
    assert (whole == parts).all()


# --- 3 repeated lines -------------------------------------------------------------


def slow_removals(rows, least=unitdedup.MIN_WORDS):
    """(doc_id, unit, part, start, end, kept doc_id, unit, part, start), by one walk over all lines and sentences in order."""
    seen, out = {}, set()
    for i, t in sorted({(i, t) for i, t, _ in rows if i is not None and t is not None}):
        at = 0
        for no, line in enumerate(t.split("\n")):
            pieces, begin = [(0, at, line)], at
            cuts = [k + 1 for k, c in enumerate(line) if c in ".!?" and line[k + 1 : k + 2] not in tuple(".!?")]
            parts = [line[a:b] for a, b in zip([0, *cuts], [*cuts, len(line)]) if b > a]
            for k, part in enumerate(parts, 1):
                if sum(bool(x.split()) for x in parts) > 1:
                    pieces.append((k, begin, part))
                begin += len(part)
            gone = False
            for k, start, piece in pieces:
                words = piece.lower().split()
                if len(words) >= least:
                    kept = seen.setdefault(" ".join(words), (i, no, k, start))
                    if kept[:3] != (i, no, k) and not gone:
                        out.add((i, no, k, start, start + len(piece), *kept))
                        gone = k == 0
            at += len(line) + 1
    return out


def lined(seed=4):
    g = random.Random(seed)
    lines = invented(seed, 40, 4, 14)
    return [(i, "\n".join(g.choice((x, x.upper(), x.replace(" ", "  "), x + "é")) for x in g.choices(lines, k=g.randint(0, 9))), "s") for i in range(50)]


def test_removals_against_a_loop(spark):
    rows = lined()
    got = {tuple(r) for r in unitdedup.removals(frame(spark, rows + rows[:5])).collect()}
    assert got == slow_removals(rows) and len(got) > 50


def test_passage_inside_a_longer_line(spark):
    passage = "Long ago the ferry crossed the wide river twice a day. Nobody recalls who rang the old bronze bell at noon!"
    rows = [(1, passage, "a"), (2, f"Something else came first. {passage} Then it ended.", "a"), (3, f"x\n{passage}", "b"), (4, "Long ago the ferry.", "b")]
    got = {(r.doc_id, r.unit_no, r.part_no, r.kept_doc_id) for r in unitdedup.removals(frame(spark, rows)).collect()}
    assert got == {(2, 0, 2, 1), (2, 0, 3, 1), (3, 1, 0, 1)}
    text = {r.doc_id: r.text for r in unitdedup.rewrite(frame(spark, rows)).collect()}
    assert text == {1: passage, 2: "Something else came first. Then it ended.", 3: "x", 4: rows[3][1]}


def test_rewrite_cuts_what_is_removed(spark):
    rows = lined()
    cut = slow_removals(rows)
    got = {r.doc_id: r for r in unitdedup.rewrite(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        gone = {no for d, no, part, *_ in cut if d == i and part == 0}
        lines, at, left = t.split("\n"), 0, []
        for no, line in enumerate(lines):
            spans = sorted((a - at, b - at) for d, n, part, a, b, *_ in cut if d == i and n == no and part)
            for a, b in reversed(spans):
                lines[no] = lines[no][:a] + lines[no][b:]
            at += len(line) + 1
            if no not in gone:
                left.append(lines[no])
        assert got[i].text == "\n".join(left)
        spans = [(r.start, r.end) for r in got[i].removed or []]
        assert spans == sorted((a, b) for d, _, _, a, b, *_ in cut if d == i)
    assert sum(map(len, (r.text for r in got.values()))) < sum(len(t) for _, t, _ in rows)


def test_removals_awkward(spark, awkward, empty):
    assert unitdedup.removals(awkward).count() == 0 and unitdedup.removals(empty).count() == 0
    assert unitdedup.rewrite(awkward).count() == len(AWKWARD)


# --- 4 languages ---------------------------------------------------------------------


def test_langid_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.fit(train)
    rows = langid.identify(rest, model).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_backoff_by_hand():
    m = langid.Model({"aa": {"house": 10, "mouse": 5}, "bb": {"haus": 10, "maus": 5}})
    assert m.score("house")[0] > m.score("house")[1]
    assert m.score("mouses")[0] > m.score("mouses")[1]  # not listed: longest known n-grams
    size = max(n for n in range(1, 6) if any("^mouses$"[i : i + n] in m.grams[n] for i in range(9 - n)))
    known = [m.grams[size]["^mouses$"[i : i + size]] for i in range(9 - size) if "^mouses$"[i : i + size] in m.grams[size]]
    assert np.allclose(m.unseen("mouses"), sum(known) / len(known) - langid.BACKOFF * (6 - size))
    assert (m.unseen("日本") == m.unseen("中国")).all()


def test_scores_against_a_loop(spark):
    m = langid.Model({"aa": {"house": 10, "mouse": 5}, "bb": {"haus": 10, "maus": 5}})
    rows = [(1, "House maus house", "s"), (2, "xhaus! maus", "s")]
    for r, (_, t, _) in zip(langid.identify(frame(spark, rows), m).orderBy("doc_id").collect(), rows):
        words = [langid.clean(w) for w in t.lower().split()]
        assert r.lang_pred == m.langs[int(sum(m.score(w) for w in words).argmax())]
        assert (r.n_words, r.known_words) == (len(words), sum(w in m.words for w in words))


def test_langid_awkward(spark, awkward, empty):
    m = langid.Model({"aa": {"x": 1}, "bb": {"y": 1}})
    by = {r.doc_id: r for r in langid.identify(awkward, m).collect()}
    assert all(by[i].lang_pred == "und" and by[i].confidence == 0 for i in (1, 2, 3, 4))
    assert by[6].n_words == 30000 and langid.identify(empty, m).count() == 0
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(awkward, none).collect()} == {"und"}
    tie = langid.identify(frame(spark, [(1, "zz", "s")]), langid.Model({"bb": {"y": 1}, "aa": {"x": 1}})).first()
    assert tie.lang_pred == "aa"


# --- 6 toxicity ------------------------------------------------------------------------


def toxic_texts(seed, n):
    g = random.Random(seed)
    texts, y = invented(seed, n, 10, 160), []
    for i, t in enumerate(texts):
        w = t.split()
        bad = g.random() < 0.4
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(g.randrange(len(w)), g.choice(("idiot", "scum", "vequ" + g.choice(("ta", "lo", "mi", "sol")))) + g.choice(("", ".", "!")))
        texts[i] = " ".join(w)
        y.append(int(bad))
    return texts, np.array(y)


def test_toxicity_on_held_out_texts(spark):
    texts, y = toxic_texts(1, 500)
    model = toxicity.fit(texts, y)
    new, want = toxic_texts(2, 300)
    rows = toxicity.score_texts(frame(spark, [(i, t, "s") for i, t in enumerate(new)]), model.dumps()).collect()
    got = np.array([r.is_toxic for r in sorted(rows, key=lambda r: r.doc_id)])
    assert (got == want).mean() > 0.95
    assert all(r.n_windows == len(range(0, max(1, len(new[r.doc_id].split()) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)) for r in rows)


def test_scores_against_scalar_loops(spark):
    texts, y = toxic_texts(1, 160)
    model = toxicity.fit(texts, y, epochs=2)
    new = [*toxic_texts(3, 8)[0], "", "one", "ß" * 50 + " 中文 🙂 --- _x_ don't", " ".join(["idiot"] * 100), " ".join(f"w{i}" for i in range(32)), " ".join(f"w{i}" for i in range(33))]
    rows = toxicity.score_texts(frame(spark, [(i, t, "s") for i, t in enumerate(new)]), model.dumps()).collect()
    for r in rows:
        logit = brute.toxic_logit(model, new[r.doc_id])
        assert abs(r.toxic_score - (0 if logit is None else brute.squash(logit))) < 1e-4
        assert r.is_toxic == (logit is not None and logit >= model.threshold) or abs(logit - model.threshold) < 1e-4


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        start, length, row = toxicity.window_table(np.array([0, n]))
        seen = {i for s, k in zip(start, length) for i in range(s, s + k)}
        assert seen == set(range(n)) and all(b - a == toxicity.STRIDE for a, b in zip(start, start[1:]))


def test_gradient_against_differences():
    toxicity_words = ["ab", "cd", "ef"]
    m = toxicity.Model.fresh(toxicity_words, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    vocab = pa.array(["ab", "cd", "xyz"])
    tri, start = toxicity.trigram_codes(vocab)
    rows = m.word_ids(vocab)
    at = np.array([[0, 2], [1, 1], [2, 3]])
    at[2, 1] = -1
    n, y, wt = np.array([3, 2]), np.array([1.0, 0.0]), np.array([1.0, 1.0])

    def vectors():
        return np.add.reduceat(m.p["Ec"][tri], start[:-1], axis=0) / np.diff(start)[:, None] + m.p["Ew"][rows]

    def loss():
        return m.gradient((vectors(), rows, tri, start), at, n, y, wt)[1]

    g, _ = m.gradient((vectors(), rows, tri, start), at, n, y, wt)
    for name in ("Uf", "Ub", "Wf", "Wb", "Bf", "A", "a", "v", "o", "c"):
        flat, grad = m.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - grad[i]) < 2e-3, name
    i = int(g["Ew"][0][0])
    m.p["Ew"][i, 0] += 1e-3
    up = loss()
    m.p["Ew"][i, 0] -= 2e-3
    down = loss()
    assert abs((up - down) / 2e-3 - g["Ew"][1][g["Ew"][0] == i, 0].sum()) < 2e-3


def test_toxicity_awkward(spark, awkward, empty):
    texts, y = toxic_texts(1, 120)
    model = toxicity.fit(texts, y, epochs=2)
    rows = toxicity.score_texts(awkward, model.dumps()).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.toxic_score == 0 and not r.is_toxic and r.n_windows == 0 for r in rows if r.doc_id in (1, 2, 3, 4))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    kept = toxicity.reject_toxic(awkward, labels)  # one class only: nothing is rejected
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert toxicity.toxic_documents(empty, labels).count() == 0
    assert toxicity.toxic_documents(awkward, labels.limit(0)).where("is_toxic").count() == 0


# --- 7 PII ------------------------------------------------------------------------------


def test_decoding_is_viterbi():
    model = pii.trained()
    table = pii_table.sentences(120, 77)
    codes = [[pii.signature(t) for t in tokens] for tokens, _ in table]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    sigs = [s for c in codes for s in c]
    e = model.emissions(sigs, np.arange(len(sigs)), offsets)
    got = model.decode(e, offsets)
    noisy = e + np.random.default_rng(1).normal(0, 3, e.shape)
    got2 = model.decode(noisy, offsets)
    for lo, hi in zip(offsets, offsets[1:]):
        if hi > lo:
            assert got[lo:hi].tolist() == brute.viterbi(model, e[lo:hi]) and got2[lo:hi].tolist() == brute.viterbi(model, noisy[lo:hi])


def test_pii_held_out_accuracy():
    model, wrong, n = pii.trained(), 0, 0
    for tokens, tags in pii_table.sentences(400, 123):
        sigs = [pii.signature(t) for t in tokens]
        off = np.array([0, len(sigs)])
        got = model.decode(model.emissions(sigs, np.arange(len(sigs)), off), off)
        wrong += sum(pii.TAGS[a] != b for a, b in zip(got, tags))
        n += len(tags)
    assert wrong <= 0.01 * n


def test_spans_and_masks(spark):
    text = "mail bob.7@site.example.com, call +1 (203) 555-8282 or\n10.1.22.4; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end"
    docs = frame(spark, [(1, text, "s"), (2, "nothing 2019 here at 3.5 or 12:30", "s"), (3, None, "s")])
    spans = [(r.doc_id, text[r.start : r.end], r.kind) for r in pii.find(docs).orderBy("start").collect()]
    assert spans == [(1, "bob.7@site.example.com", "EMAIL"), (1, "+1 (203) 555-8282", "PHONE"), (1, "10.1.22.4", "IP"), (1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "SECRET")]
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert rows[1].text == 'mail [EMAIL], call [PHONE] or\n[IP]; token = "[SECRET]" end' and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "nothing 2019 here at 3.5 or 12:30" and rows[3].text is None


HEXA = "24be64439e3e49cf46b2d7c90f3602a3"
FIELDS = ",".join(f'"item{i}":"value{i}"' for i in range(30))
LONG_TOKENS = [
    ("{" + FIELDS + f',"mail":"bob.7@site.example.com","phone":"203-555-8282","ip":"10.1.22.4","token":"{HEXA}"' + "}", [("bob.7@site.example.com", "EMAIL"), ("203-555-8282", "PHONE"), ("10.1.22.4", "IP"), (HEXA, "SECRET")]),
    ("7,Ann;" * 60 + "bob.7@site.example.com,\\n203-555-8282", [("bob.7@site.example.com", "EMAIL"), ("203-555-8282", "PHONE")]),
    ("https://www.example.org/" + "a1/" * 70 + f"?user=bob.7@site.example.com&ip=10.1.22.4&password={HEXA[:16]}", [("bob.7@site.example.com", "EMAIL"), ("10.1.22.4", "IP"), (f"password={HEXA[:16]}", "SECRET")]),
    ("我的名字" * 60 + "邮箱是bob.7@site.example.com，电话203-555-8282。" + "谢谢" * 30, [("bob.7@site.example.com", "EMAIL"), ("203-555-8282", "PHONE")]),
    ("first {" + FIELDS + ',"phone":"+1 (203) 555-8282","x":"' + "y" * 300 + '"} last', [("+1 (203) 555-8282", "PHONE")]),
    ("x" * 250 + "@example.com", [("x" * 250 + "@example.com", "EMAIL")]),
    (FIELDS + " " + "y" * 5000 + " " + '"' * 300, []),
]


@pytest.mark.parametrize("text,want", LONG_TOKENS)
def test_pii_behind_the_200th_character_of_a_token(text, want):
    model = pii.trained()
    for t, n in ((text, 0), (f"one {text}\nten", 4)):
        got = [(a, b, t[a:b], kind) for _, spans in pii.tag_slice(model, pa.array(["short", t])) for a, b, kind in spans]
        assert [x[2:] for x in got] == want
        assert all(a == n + text.index(x) and b == a + len(x) for a, b, x, _ in got)


JOINED = [
    ("write a.b@c.com;d@e.org now", [("a.b@c.com", "EMAIL"), ("d@e.org", "EMAIL")], "write [EMAIL];[EMAIL] now"),
    ("...,foo.bar@example.com,123-45-6789", [("foo.bar@example.com", "EMAIL"), ("123-45-6789", "SSN")], "...,[EMAIL],[SSN]"),
    ("请联系foo.bar@example.com谢谢大家", [("foo.bar@example.com", "EMAIL")], "请联系[EMAIL]谢谢大家"),
    ('{"email":"a@b.com","ip":"10.2.3.4"}', [("a@b.com", "EMAIL"), ("10.2.3.4", "IP")], '{"email":"[EMAIL]","ip":"[IP]"}'),
    ("x" * 250 + "@example.com,10.0.0.1,10.0.0.2", [("x" * 250 + "@example.com", "EMAIL"), ("10.0.0.1", "IP"), ("10.0.0.2", "IP")], "[EMAIL],[IP],[IP]"),
    ("we paid 1,200 or 20,000.50 on 2/3 and 2001/02, don't ask; see http://www.example.org/a1", [], None),
]


def test_several_spans_of_one_token(spark):
    docs = frame(spark, [(i, t, "s") for i, (t, _, _) in enumerate(JOINED)])
    found = {i: [] for i in range(len(JOINED))}
    for r in pii.find(docs).orderBy("doc_id", "start").collect():
        found[r.doc_id].append((JOINED[r.doc_id][0][r.start : r.end], r.kind))
    assert list(found.values()) == [want for _, want, _ in JOINED]
    assert {r.doc_id: r.text for r in pii.mask(docs).collect()} == {i: t if m is None else m for i, (t, _, m) in enumerate(JOINED)}


def test_pii_awkward(awkward, empty):
    assert pii.find(awkward).count() == 0 and pii.find(empty).count() == 0
    assert sorted(map(str, pii.mask(awkward).collect())) == sorted(map(str, awkward.collect()))


# --- 8 byte-level BPE ------------------------------------------------------------------------


STRINGS = ["", " ", "Hello world, it's 2024!", "naïve café — ünïcödé", "日本語のテキスト", "🙂👩‍👩‍👧", "a" * 3000, "\n\n\t  x  ", "тест 123abc...", "�\u0000\u007f", "lorem" * 400]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


def test_transducer_is_merging_by_rank(ranks):
    machine = bpe.Transducer(ranks)
    g = random.Random(3)
    pieces = [x.encode() for x in STRINGS if len(x) < 500] + [bytes(g.choices(range(256), k=g.randint(1, 12))) for _ in range(400)] + [t.encode() for t in " ".join(invented(4, 40)).split()] + [bytes(g.choices(b"abt hein", k=g.randint(5, 40))) for _ in range(200)]
    for p in pieces:
        assert machine.encode(p) == bpe.merge_by_rank(ranks, p)
    small = bpe.Transducer(ranks, max_states=50)  # starting afresh changes nothing
    assert all(small.encode(p) == machine.encode(p) for p in pieces[:100])


def test_texts_against_another_implementation(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder = bpe.machines(bpe.VOCABULARY)
    for t in STRINGS + invented(6, 50):
        ids = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert ids == other.encode_ordinary(t)
        assert decoder.feed(ids) + decoder.end() == t


def test_streaming_decoder_in_any_portions(ranks):
    encoder, decoder = bpe.machines(bpe.VOCABULARY)
    ids = np.frombuffer(encoder.encode("".join(STRINGS)), np.int32).tolist()
    g = random.Random(1)
    out, at = "", 0
    while at < len(ids):
        k = g.randint(1, 4)
        out += decoder.feed(ids[at : at + k])
        at += k
    assert out + decoder.end() == "".join(STRINGS)


def test_utf8_machine_like_the_codec():
    g = random.Random(2)
    for _ in range(3000):
        data = bytes(g.choices([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0], k=g.randint(0, 7)))
        text, held = bpe.Utf8Machine.step(b"", data)
        assert text + ("�" if held else "") == data.decode("utf-8", "replace")
        cut = g.randint(0, len(data))
        a, h = bpe.Utf8Machine.step(b"", data[:cut])
        b, h = bpe.Utf8Machine.step(h, data[cut:])
        assert (a + b, h) == (text, held)


def test_bpe_documents(spark, awkward, empty):
    docs = bpe.encode_documents(awkward)
    rows = docs.collect()
    assert len(rows) == len(AWKWARD) and all(r.round_trip and r.n_tokens == len(r.tokens) for r in rows)
    assert [c for c in docs.columns if c not in ("tokens", "n_tokens", "round_trip")] == [c for c in awkward.columns if c != "text"]
    back = {(r.doc_id, r.text) for r in bpe.decode_documents(docs).collect()}
    assert back == {(i, t or "") for i, t, _ in AWKWARD}
    assert bpe.encode_documents(empty).count() == 0 and bpe.decode_documents(bpe.encode_documents(empty)).count() == 0


# --- 9 mixing ------------------------------------------------------------------------------


def sized(seed=3):
    g = random.Random(seed)
    return [(i, "x" * g.choice((1, 50, 500, 3000)), g.choice("aaaaab") if i % 9 else "c") for i in range(3000)]


def test_mixture_by_one_sort(spark):
    rows, weights, rate = sized(), {"a": 1.0, "b": 3.0, "c": 8.0}, 0.7
    got = {r.doc_id: r.copies for r in mixing.sample(frame(spark, rows), weights, rate).collect()}
    import hashlib

    total = sum(len(t) for _, t, _ in rows)
    for s, w in weights.items():
        own = [(i, len(t), 1000 * len(t) // (len(t) + 500) + 1) for i, t, x in rows if x == s]
        mx, target = sum(n * m for _, n, m in own), rate * total * w / 12.0
        ranked, certain, units = [], {}, 0
        for i, _, m in own:
            e = target * m / mx
            certain[i] = math.floor(e)
            p = math.floor((e - math.floor(e)) * mixing.SCALE)
            units += p
            if p:
                u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
                q = p / mixing.SCALE
                ranked.append((u / (1 - u) / (q / (1 - q)), i))
        more = {i for _, i in sorted(ranked)[: (units + mixing.SCALE // 2) // mixing.SCALE]}
        want = {i: certain[i] + (i in more) for i in certain if certain[i] + (i in more)}
        assert {i: n for i, n in got.items() if i in certain} == want
        reached = sum(n * m for i, n, _ in own for m in [got.get(i, 0)])
        e = [(n, target * m / mx % 1) for _, n, m in own]
        spread = math.sqrt(sum(q * (1 - q) * n * n for n, q in e))  # of independent draws; order sampling has less
        assert abs(reached - target) < 4 * spread + max(n for n, _ in e)
    assert max(got.values()) > 1


def test_mix_repeats_rows_and_keeps_columns(spark, awkward, empty):
    rows = sized()[:200] + [(10_000, None, "a"), (10_001, "", "a"), (10_002, "xyz", None), (10_003, "xyz", "unknown"), (None, "xyz", "a")]
    docs = frame(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.sample(docs, {"a": 5.0, "c": 1.0}, 1.5).collect()}
    mixed = mixing.mix(docs, {"a": 5.0, "c": 1.0}, 1.5)
    assert mixed.columns == docs.columns and mixed.schema.simpleString() == docs.schema.simpleString()
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    assert not {10_000, 10_001, 10_002, 10_003, None} & set(copies)
    assert mixing.mix(empty).count() == 0 and mixing.sample(awkward, {"nobody": 1.0}).count() == 0


def test_parts_and_joins_do_not_change_the_sample(spark, monkeypatch):
    rows, weights = sized(5), {"a": 1.0, "b": 3.0, "c": 8.0}
    want = sorted(map(str, mixing.sample(frame(spark, rows), weights, 0.7).collect()))
    for fine, few in ((1, 0), (3, 1), (100_000, 3)):
        monkeypatch.setattr(mixing, "FINE", fine)
        monkeypatch.setattr(mixing, "FEW", few)
        assert sorted(map(str, mixing.sample(frame(spark, rows), weights, 0.7).collect())) == want


def test_sources_without_a_name_in_the_weights_stay(spark):
    docs = frame(spark, [(i, "x" * 900, ("src0", "src1", "src20", "blog")[i % 4]) for i in range(400)])
    copies = Counter()
    for r in mixing.sample(docs).collect():
        copies[r.source] += r.copies
    assert set(copies) == {"src0", "src1", "src20", "blog"}
    assert all(abs(n - 200 * (3 if s == "src1" else 1) / 6) < 2 for s, n in copies.items())
    assert {r.source for r in mixing.mix(docs).collect()} == set(copies)


def test_pareto_inclusion_is_near_its_target(spark):
    """Over many seeds each document is drawn about as often as its odds say."""
    p = np.array([0.1, 0.3, 0.5, 0.8, 0.9, 0.4])
    g, hits = np.random.default_rng(1), np.zeros(6)
    for _ in range(4000):
        u = g.random(6)
        hits[np.argsort(u / (1 - u) / (p / (1 - p)))[: round(p.sum())]] += 1
    assert np.abs(hits / 4000 - p).max() < 0.06
