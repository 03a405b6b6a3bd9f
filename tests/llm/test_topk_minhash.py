"""Top-k and near-duplicates against brute force."""

import random
import re

import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import minhash, queries, topk
from quillgraph.llm.components import components


def brute_top(rows, asked, k):
    out = set()
    for q, v in rows:
        if q is None or not asked(q):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block,shelf,queries_", [(4, 16, 3), (256, 10_000, 1000)])
def test_topk_with_ties(spark, block, shelf, queries_):
    rng = random.Random(block)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(5)]) for i in range(120)] + [(500 + i, [1, 1, 1, 1, 1]) for i in range(30)] + [(900, [2, 2]), (905, [3, 1]), (910, [1 << 31] * 5)]
    df = spark.createDataFrame([*rows, (None, [1] * 5), (7000, None)], "vec_id bigint, q array<bigint>")
    out = topk.top_k(df, F.col("vec_id") % 5 == 0, block=block, shelf=shelf, queries=queries_)
    got = {tuple(r) for r in out.collect()}
    assert got == brute_top(rows, lambda q: q % 5 == 0, 5)


def test_topk_odd_vectors(spark):
    rows = [(0, [0.5, -0.001]), (50, [1.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (5, [float("inf"), 0.0]), (6, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("q", topk.quantised("embedding"))
    assert {r.vec_id: r.q for r in df.collect()}[0] == [128, -1]
    out = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in out} == {(0, 50), (0, 6), (50, 0), (50, 6)}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_query(spark, sf):
    con = oracle.connection(sf)
    assert oracle.spark_rows(queries.op4_topk(spark, sf)) == oracle.sql_rows(con, queries.oracle_sql()["op4_topk"])


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingle_set(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(docs, threshold=0.8):
    """Components of all links between different texts, and of copies."""
    rep, parent = {}, {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for k in sorted(docs):
        join(k, rep.setdefault(docs[k] or "", k))
    sets = {k: shingle_set(t) for t, k in rep.items()}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                join(a, b)
    return {k: find(k) for k in docs}


def made_docs(n=25, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)] + ["été", "straße"]
    docs = {}
    for g in range(n):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 120, 300]))
        for c in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs[g * 10 + c] = " ".join(text)
    docs |= {1000: "", 1001: "", 1002: None, 1003: "!!! ???", 1004: "!!! ???", 1005: "One two", 1006: "one, TWO!", 1007: "long text here " * 20_000}
    return docs


def test_classes_equal_brute_force(spark):
    docs = made_docs()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    out = minhash.classes(df).collect()
    assert {r.doc_id: r.class_id for r in out} == brute_classes(docs)
    kept = [r for r in out if r.kept]
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in out})


def test_followers_of_a_leader_lose_no_link(spark):
    """A chain whose ends are not alike: classes only close through links between followers."""
    words = [f"w{i}" for i in range(2000)]
    docs = {k: " ".join(words[k * 4 : k * 4 + 80]) for k in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(df, many=60, rows=2).collect()}
    assert got == brute_classes(docs)


def test_repeated_passages_lose_no_link(spark):
    """Pairs at and above the threshold on sets, where one text has a passage 20 to 100 times."""
    rng = random.Random(8)
    docs = {}
    for k in range(120):
        own = [f"p{k}w{i}" for i in range(200)]
        passage = own[-50:]
        other = own if k % 3 == 0 else [*own[: 185 - k % 2 * 15], *[f"q{k}w{i}" for i in range(8)]]
        docs[2 * k], docs[2 * k + 1] = " ".join(own[:150] + passage * rng.choice([20, 50, 100])), " ".join(other)
    want = brute_classes(docs)
    assert sum(want[2 * k + 1] == 2 * k for k in range(120)) >= 80
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == want


def test_templates_make_no_pairs(spark, monkeypatch):
    """Texts of one long template below the threshold fill buckets; pairs that do reach it are found among them."""
    rng = random.Random(9)
    template = [f"t{k}" for k in range(170)]
    docs = {k: " ".join(template[:90] + [f"o{k}w{i}" for i in range(28 + k % 9)] + template[90:]) for k in range(900)}
    docs |= {2000 + k: docs[k].replace(f"o{k}w3 ", f"x{k} ") for k in range(0, 900, 30)}
    seen = []
    counted = minhash.counted
    monkeypatch.setattr(minhash, "counted", lambda df, what: (lambda out: seen.append((what, out[1])) or out)(counted(df, what)))
    df = spark.createDataFrame(rng.sample(sorted(docs.items()), len(docs)), "doc_id bigint, text string").repartition(3)
    out = minhash.classes(df, many=60, rows=2).collect()
    assert {r.doc_id: r.class_id for r in out} == {k: k if k < 2000 else k - 2000 for k in docs}
    linked = {r.doc_id for r in out if r.n_links}
    assert linked == {k for k in docs if k >= 2000} | {k - 2000 for k in docs if k >= 2000}
    assert max(n for what, n in seen if what == "pairs") < 60 * len(docs)


def test_minhash_odd_rows(spark):
    rows = [(None, "lonely text of some words here now"), (None, "lonely text of some words here now"), (7, "lonely text of some words here now"), (7, "lonely text of some words here now"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).withColumn("Class_Id", F.lit(1))
    out = minhash.classes(df).collect()
    assert len(out) == 5 and {(r.doc_id, r.class_id) for r in out} == {(None, 7), (7, 7), (8, 8)}
    assert minhash.classes(df.limit(0)).count() == 0
    nobody = minhash.classes(df.where("doc_id is null")).collect()
    assert len(nobody) == 2 and all(r.class_id is None and r.kept for r in nobody)


def test_minhash_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in queries.op7_minhash(spark, sf).collect()} == brute_classes(docs)


def test_registers_estimate_probability_jaccard():
    """Share of equal registers against the definition of the probability Jaccard similarity."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    names = rng.integers(1, 2**63, 60).astype(np.uint64)
    sets = [(names[v > 0], v[v > 0]) for v in (x, y)]
    sig = minhash.signatures(sets, 4000)
    wx, wy = (np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0.0) for v in (x, y))
    want = sum(1 / np.maximum(wx / wx[i], wy / wy[i]).sum() for i in range(60) if wx[i] > 0 and wy[i] > 0)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)
    alone = minhash.signatures([sets[1]], 4000)
    assert (alone[0] == sig[1]).all()


def test_shingles_follow_words():
    a, b, c = minhash.shingles(["One two, THREE four five six", "one two three four five six", ""])
    assert (a[0] == b[0]).all() and len(a[0]) == 2 and len(c[0]) == 0
    assert minhash.shingles(["x y"])[0][1].tolist() == [1]
    repeated = minhash.shingles(["a b c d e " * 3])[0]
    assert repeated[1].sum() == 11 and len(repeated[0]) == 5


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint"), len(links)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 26)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), 0).count() == 0


def test_topk_bounds_and_hot_vectors(spark):
    """Clustered vectors: few blocks travel; one vector that many rows share; products beyond 2**53."""
    rng = random.Random(4)
    rows = [(i, [rng.randrange(50) + (400 if j == i % 12 else 0) for j in range(12)]) for i in range(900)] + [(1000 + i, [7] * 12) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, q array<bigint>").withColumn("id", F.lit("clash")).withColumn("Block", F.lit(1))
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=16, shelf=4, queries=8).collect()}
    assert got == brute_top(rows, lambda q: q % 50 == 0, 5)
    big = [(i, [(1 << 30) + rng.randrange(1 << 20), rng.randrange(-(1 << 29), 1 << 29), i]) for i in range(60)]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(big, "vec_id bigint, q array<bigint>"), F.col("vec_id") % 7 == 0, block=8, shelf=2, queries=4).collect()}
    assert got == brute_top(big, lambda q: q % 7 == 0, 5)
    q, mats = np.array([[400, 1], [1, 400]]), [np.array([[300, 0], [350, 2]]), np.array([[0, 300], [1, 310]])]
    asks = pd.DataFrame([[0, 0, [1, 2], q.ravel(), [120_000, 120_000]]], columns=["group", "shelf", "asked", "q", "floor"])
    maxima = pd.DataFrame([[b, m.max(axis=0), m.min(axis=0)] for b, m in enumerate([*mats, np.array([[1, 1]])])], columns=["block", "top", "low"])
    assert topk.live_blocks(asks, maxima)["block"].tolist() == [0, 1]
