"""Toxicity, quality and language: methods against brute force, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillgraph.llm import langid, quality, queries, toxicity
from quillgraph.llm.calibrate import fit_logistic, logistic
from quillgraph.llm.common import labelled_sample

DOC = "doc_id bigint, text string, score string, Segments int, lang string"


def odd_rows():
    """Null id, null and empty text, repeated rows, a very long text, columns that clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(None, "plain words", "x", 1, "en"), (1, None, None, None, None), (2, "", "y", 2, "en"), (3, "same row", "z", 3, "en"), (3, "same row", "z", 3, "en"), (4, long, "l", 4, "en"), (5, "123 !?", "d", 5, "en")]


# --- toxicity


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=12))
def test_segments_are_the_maximal_ones(values):
    """By definition: take the best segment (of equal ones the shortest), then recurse to its left and right."""
    drift = 0.5
    listed = [(i, float(x)) for i, x in enumerate(values) if x]
    score = [(x if x else 0.0) - drift for x in map(float, values)]

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += score[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-12 or total > top[2] - 1e-12 and j - i < top[1] - top[0]):
                    top = (i, j, total)
        return top

    def take(a, b):
        top = best(a, b)
        return [] if top is None else [*take(a, top[0]), top, *take(top[1] + 1, b)]

    got = toxicity.segments(listed, len(values), drift)
    want = take(0, len(values))
    assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in want), abs_tol=1e-9)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(sum(score[a : b + 1]) - s) < 1e-9 for a, b, s in got)


def test_lambda_solves_its_equation():
    s, p = np.array([5.0, 2.0]), np.array([0.001, 0.01])
    lam = toxicity.solve_lambda(s, p, 0.4)
    assert (p * np.exp(lam * (s - 0.4))).sum() + (1 - p.sum()) * np.exp(-lam * 0.4) == pytest.approx(1, abs=1e-6)


def made_labels(spark, n=400):
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = random.choices(words, k=60)
        if i % 5 == 0:
            for at in sorted(random.sample(range(60), 4)):
                text[at] = random.choice(["vile", "scum", "idiot"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_finds_passages(spark):
    docs, labels = made_labels(spark)
    model = toxicity.fit(docs.where("doc_id % 4 != 1"), labels)
    assert {"vile", "scum", "idiot"} <= set(model.scores)
    out = toxicity.score(docs.where("doc_id % 4 = 1"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in out)
    assert all(bool(r.segments) == (r.doc_id % 5 == 0) for r in out)
    first = next(r for r in out if r.segments)
    words = toxicity.tokens(first.text)
    assert any(w in {"vile", "scum", "idiot"} for s in first.segments for w in words[s.from_token : s.to_token + 1])


def test_toxic_passages_count_wherever_they_stand():
    bad = [f"bad{i}" for i in range(6)]
    model = toxicity.Model(dict.fromkeys(bad, 4.0), 1.0, 0.01, np.zeros(3))
    found = lambda text: toxicity.evidence(model, *toxicity.find(model, " ".join(text)))[1]
    clean = [f"w{i % 977}" for i in range(60_000)]
    for i in range(54):
        clean[1000 * i] = bad[i % 6]
    assert found(clean) == []
    alone, late = found([*["w"] * 60_000, *bad]), found([*clean, *bad])
    assert [p[:2] for p in late] == [(60_000, 60_005)] and late[0][2] == pytest.approx(alone[0][2])
    twice = found([*bad, *["w"] * 200, *bad])
    assert [p[:2] for p in twice] == [(0, 5), (206, 211)] and twice[0][2] == pytest.approx(twice[1][2])
    # inside one passage repeats still count less
    assert found([*bad, *bad])[0][2] == pytest.approx(6 * 4 * 1.5 - 12 * toxicity.DRIFT)


def test_toxicity_odd_rows(spark):
    docs, labels = made_labels(spark)
    model = toxicity.fit(docs, labels)
    rows = spark.createDataFrame(odd_rows(), DOC)
    out = toxicity.score(rows, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out}) == 1
    assert set(toxicity.score(rows, model).columns) == {"doc_id", "text", "lang", "score", "segments"}
    assert toxicity.score(rows.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(rows, nothing).collect()} == {0.5}
    only = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.score(rows, only).collect())
    assert toxicity.fit(docs.limit(0), labels).scores == {}


def test_toxicity_query_on_held_out(spark, sf):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    toxic, told = [r for r in rows if r.toxic == 1], [r for r in rows if r.predicted == 1]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.6 and sum(r.toxic for r in told) / len(told) >= 0.9
    assert out.count() == 1000


def test_toxicity_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    told = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    hit, missed, false = (told.get(k, 0) for k in ((1, 1), (1, 0), (0, 1)))
    assert hit + missed > 50 and hit / (hit + missed) >= 0.85 and hit / (hit + false) >= 0.97


def test_weights_follow_the_formula(spark):
    """Log-odds and their deviations from counts by hand, over every token of made labels."""
    docs, labels = made_labels(spark, 60)
    texts, of = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    sample = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))
    n = [sum(v == k for v in of.values()) for k in (0, 1)]
    want = {}
    for token in {w for t in texts.values() for w in toxicity.tokens(t)}:
        y = [sum(of[k] == c and token in toxicity.tokens(t) for k, t in texts.items()) for c in (0, 1)]
        a = sum(y) * 0.02
        odds = [np.log((y[c] + a) / (n[c] + 0.02 * sum(n) - y[c] - a)) for c in (0, 1)]
        z = abs(odds[1] - odds[0]) / np.sqrt(1 / (y[0] + a) + 1 / (y[1] + a))
        if z >= 1.0:
            want[token] = odds[1] - odds[0]
    got = {r.token: r.score for r in toxicity.weigh(toxicity.count_tokens(sample), n[1], n[0], 0.02, 1.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    score, share = np.array([2.0, -1.0]), np.array([0.05, 0.3])
    lam = toxicity.solve_lambda(score, share, 0.4)
    assert 0.05 * np.exp(lam * 1.6) + 0.3 * np.exp(lam * -1.4) + 0.65 * np.exp(-lam * 0.4) == pytest.approx(1, abs=1e-6)


# --- quality


def test_quality_query_on_held_out(spark):
    out = queries.op2_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93
    assert out.count() == 1000


def test_quality_features_by_plain_compression(spark):
    """Features and scores of the operator against zstandard called by hand on the same dictionaries."""
    docs = spark.createDataFrame([(i, ("good sentence number %d. " % i if i % 2 else "### junk *** %d %%%% " % i) * (3 + i % 40 * 8)) for i in range(240)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(docs, model).collect():
        blocks = [r.text[a : a + quality.BLOCK] for a in range(0, len(r.text), quality.BLOCK)]
        sizes = [[len(p.compress(b.encode())) for p in packers] for b in blocks]
        g, b = map(sum, zip(*sizes, strict=True))
        least = min((y - x) / (x + y) for k, ((x, y), block) in enumerate(zip(sizes, blocks, strict=True)) if k == 0 or len(block) >= quality.BLOCK // 2)
        x = np.array([20 * (b - g) / (b + g), 20 * least, 4 * min((g + b) / (2 * len(r.text)), 1.0)])
        assert r.gain == pytest.approx((b - g) / (b + g)) and r.score == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + x @ model.weights[1:]))), abs=1e-9)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("good sentence number %d. " % i if i % 2 else "### junk *** %d %%%% " % i) * 20) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    rows = spark.createDataFrame(odd_rows(), DOC).withColumnRenamed("Segments", "Gain")
    out = quality.score(rows, model)
    assert out.count() == 7 and set(out.columns) == {"doc_id", "text", "lang", "score", "gain"}
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert quality.score(rows.limit(0), model).count() == 0
    assert {r.score for r in quality.score(rows, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert all(r.score > 0.99 for r in quality.score(rows, quality.fit(docs, labels.where("quality = 1"))).collect())
    assert quality.score(rows, quality.fit(docs.limit(0), labels)).count() == 7
    few = quality.fit(docs.limit(4), labels)
    assert quality.score(docs, few).count() == 200
    blank = spark.createDataFrame([(0, ""), (1, "")], "doc_id bigint, text string")
    assert quality.score(blank, quality.fit(blank, labels.limit(2))).count() == 2


def test_shared_lines_do_not_tell():
    assert quality.apart(["a\nshared"], ["b\nshared"]) == [b"a"]


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x)))
    w = fit_logistic(x, y.astype(float))
    assert w == pytest.approx([1, 2], abs=0.2) and logistic(w, np.array([0.0]))[0] == pytest.approx(0.73, abs=0.05)


# --- language


def brute_bits(grams, order, min_visits, text, lang):
    """Code length of a text by walking contexts one byte at a time, from the definition."""
    counts = {}
    for k in range(order + 1):
        for l, ctx, sym, n in grams:
            c = ctx[len(ctx) - k :] if k else b""
            by = counts.setdefault(c, {})
            by.setdefault(l, {}).setdefault(sym, 0)
            by[l][sym] += n
    kept = {c for c, by in counts.items() if c == b"" or sum(sum(x.values()) for x in by.values()) >= min_visits}

    def p(ctx, sym):
        if ctx is None:
            return 1 / 256
        shorter = ctx[1:] if ctx else None
        own = counts.get(ctx, {}).get(lang, {})
        n, d = sum(own.values()), len(own)
        if n == 0:
            return p(shorter, sym)
        if sym in own:
            return own[sym] / (n + d)
        return d / (n + d) * p(shorter, sym) / max(1 - sum(p(shorter, s) for s in own), 1e-9)

    data, bits = b"\n" * order + text, 0.0
    for i in range(order, len(data)):
        ctx = b""
        for k in range(1, order + 1):
            c = data[i - k : i]
            if c not in kept:
                break
            ctx = c
        bits -= math.log2(p(ctx, data[i]))
    return bits


def test_code_lengths_are_exact():
    order, texts = 2, {"a": [b"abracadabra abra", b"cab"], "b": [b"hello yellow", b"\xc3\xa9t\xc3\xa9"]}
    grams = []
    for lang, own in texts.items():
        for t in own:
            data = b"\n" * order + t
            grams += [(lang, data[i - order : i], data[i], 1) for i in range(order, len(data))]
    table = {}
    for lang, ctx, sym, n in grams:
        key = ("ab".index(lang), int.from_bytes(ctx + bytes([sym]), "big"))
        table[key] = table.get(key, 0) + n
    model = langid.build(["a", "b"], [2, 2], np.array([k for k, _ in table]), np.array([g for _, g in table]), np.array(list(table.values())), order, 2)
    asked = [b"abra", b"yellow \xc3\xa9", b"", b"zzz\xff", b"cab hello"]
    got = langid.code_lengths(model, asked)
    for i, t in enumerate(asked):
        for j, lang in enumerate("ab"):
            assert got[i, j] == pytest.approx(brute_bits(grams, order, 2, t, lang), rel=1e-4, abs=1e-4)


def test_code_lengths_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    grams = np.array([rng.randrange(97, 101) << 16 | rng.randrange(97, 101) << 8 | rng.randrange(97, 101) for _ in range(300)])
    model = langid.build(["x"], [1], np.zeros(300, int), grams, np.ones(300, int), 2, 1)
    texts = [bytes(rng.choices(range(97, 103), k=n)) for n in (0, 1, 7, 30, 3, 0)]
    whole = langid.code_lengths(model, texts)
    monkeypatch.setattr(langid, "STEP", 5)
    assert langid.code_lengths(model, texts) == pytest.approx(whole)


def test_language_query(spark):
    out = queries.op9_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = out.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.99
    assert out.count() == docs.count()


def test_language_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), DOC)
    model = langid.fit(rows)
    out = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(rows, model).collect()}
    assert out[(1, "und")] == 0 and out[(2, "und")] == 0 and out[(5, "und")] == 0 and out[(4, "en")] == 1.0
    assert langid.identify(rows, model).count() == 7
    assert langid.identify(rows.limit(0), model).count() == 0
    none = langid.fit(rows.where("lang is null"))
    assert none is None and {r.lang_pred for r in langid.identify(rows, none).collect()} == {"und"}
    clash = langid.identify(rows.withColumnRenamed("lang", "Lang_Pred"), model)
    assert sorted(clash.columns) == sorted(["doc_id", "text", "Segments", "lang_pred", "score", "bits_per_byte"])


def test_samples_do_not_depend_on_files(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    drawn = lambda parts: {r.text for r in labelled_sample(docs.repartition(parts), labels.repartition(parts), "quality", 20, 5)[0].collect()}
    assert drawn(1) == drawn(7) and 10 <= len(drawn(3)) <= 90
    models = [langid.fit(docs.repartition(k), per_lang=15) for k in (1, 7)]
    assert (models[0].bits == models[1].bits).all() and len(models[0].child) == len(models[1].child)


def test_language_model_stays_within_its_bound(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "MODEL_BYTES", whole.bits.nbytes // 4)
    less = langid.fit(docs)
    assert less.bits.nbytes + less.child.nbytes <= langid.MODEL_BYTES
    told = langid.identify(docs, less).where("lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in told) / len(told) > 0.95
