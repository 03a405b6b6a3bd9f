"""Ranked search, whitening and document fingerprints against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import queries, spotsigs, vbmw, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k):
    bags = [(d, Counter(TERM.findall(t.translate(LOWER)))) for d, t in docs if d is not None and t]
    bags = [(d, b) for d, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n) // total
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if b[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def test_block_borders_are_the_cheapest():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9):
        s = rng.integers(0, 100, size)

        def price(ends, s=s):
            return sum(40 + (e - a) * s[a:e].max() for a, e in zip([0, *ends[:-1]], ends, strict=True))

        cuts = [[*c, size] for r in range(size) for c in itertools.combinations(range(1, size), r)]
        allowed = [c for c in cuts if max(np.diff([0, *c])) <= 4]
        got = vbmw.borders([s], 40, 4)[0].tolist()
        assert price(got) == min(map(price, allowed)) and max(np.diff([0, *got])) <= 4
    long = rng.integers(0, 10**6, 3000)
    ends, tops = vbmw.blocks([long])[0]
    assert ends[-1] == 3000 and all(long[a:e].max() == t for a, e, t in zip([0, *ends[:-1]], ends, tops, strict=True))


@pytest.mark.parametrize("shard,group,named", [(7, 3, 10**6), (10_000, 1000, 0)])
def test_ranks(spark, monkeypatch, shard, group, named):
    monkeypatch.setattr(vbmw, "NAMED_TERMS", named)
    monkeypatch.setattr(vbmw, "SHARD_DOCS", shard)
    rng = random.Random(shard)
    vocabulary = ["the", "of", "Ünïco", "é", "x1", *[f"w{k}" for k in range(40)]]
    docs = [(k, " ".join(rng.choices(vocabulary, weights=[200, 100, *[5] * 43], k=rng.randrange(1, 60)))) for k in range(300)]
    docs += [(k, docs[5][1]) for k in range(400, 420)] + [(500, None), (501, ""), (502, "?!"), (None, "w1 w2"), (503, "w7 " * 30_000), (503, "w7")]
    items = [(k, " ".join(rng.choices(vocabulary, k=9))) for k in range(12)] + [(20, None), (21, "absent"), (22, "W1\x00w2"), (22, "w3"), (23, docs[5][1])]
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit(1))
    right = spark.createDataFrame(items, "item_id bigint, text string").withColumn("w", F.lit(1))
    monkeypatch.setattr(vbmw, "GROUP", group)
    got = Counter(tuple(r) for r in vbmw.ranked(left, right, k=10).collect())
    assert got == brute_ranks(docs, items, 10)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert vbmw.ranked(none, right).count() == 0 and vbmw.ranked(left, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_search_skips_blocks():
    rng = np.random.default_rng(2)
    lists = []
    for w, many in ((9000, 30), (4000, 400), (300, 4000)):
        docs = np.sort(rng.choice(5000, many, replace=False))
        impact = rng.integers(100_000, 900_000, many)
        lists.append((w, docs, impact, *vbmw.blocks([impact])[0]))
    full = np.zeros(5000, np.int64)
    for w, docs, impact, _, _ in lists:
        full[docs] += w * impact
    lists.sort(key=lambda x: x[0] * int(x[4].max()))
    want = sorted(((-s, d) for d, s in enumerate(full.tolist()) if s))[:10]
    assert vbmw.best_of(lists, np.arange(5000), 5000, 10, 0) == [(d, -s) for s, d in want]
    # with the tenth score as floor the outcome is the same
    assert vbmw.best_of(lists, np.arange(5000), 5000, 10, -want[-1][0]) == [(d, -s) for s, d in want]


def test_ranked_query(spark, sf):
    assert oracle.spark_rows(queries.op11_ranked(spark, sf)) == oracle.sql_rows(oracle.connection(sf), queries.oracle_sql()["op11_ranked"])


def brute_whitening(rows, k=4):
    """Exact sums in Python's numbers, rounded once."""
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dims in {len(x) for _, x in own}:
        listed = sorted({tuple(x) for _, x in own if len(x) == dims})
        n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
        y = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in listed]
        v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(dims)] for i in range(dims)])
        values, directions = np.linalg.eigh(v)
        values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
        for i, x in own:
            if len(x) == dims:
                d = [n * a - s for a, s in zip(x, sums, strict=True)]
                for c in range(min(k, dims)):
                    w = float(np.array(d, float) @ directions[:, c]) / n / math.sqrt(values[c]) if values[c] > 1e-12 * np.trace(v) else None
                    out[i, c + 1] = (n, sum(e * e for e in d), w, values[c] / np.trace(v) if np.trace(v) else 0.0)
    return out


def test_whitening(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies count once in the fit
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 2.5]), (3002, [7.0, 9.0])]
    rows += [(4000, [1.0, 2.0, 3.0])]  # nothing varies
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n", F.lit(1)).withColumn("x", F.lit(2)).repartition(5)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    want = brute_whitening(rows)
    assert got.keys() == want.keys()
    signs = {}
    for key, (n, deviation, w, share) in want.items():
        r = got[key]
        assert (r.n, int(r.deviation)) == (n, deviation) and abs(r.explained - share) <= 1e-9 and r.identity_error < 1e-9
        if w is None:
            assert r.whitened is None
        elif abs(w) > 1e-6:
            sign = signs.setdefault((n, key[1]), math.copysign(1, w * r.whitened))
            assert abs(r.whitened * sign - w) < 1e-9
    none = whitening.whiten(df.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_gram_is_exact_at_any_size():
    rng = np.random.default_rng(4)
    for bits in (3, 19, 20, 21, 40, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        y[0, 0], y[1, 1] = -(1 << bits), (1 << bits) - 1
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.gram(y).tolist() == want and whitening.gram(y.astype(object) * 3**50)[0, 0] == want[0][0] * 9**50
    top = np.full((whitening.ROWS, 2), (1 << whitening.LIMB) - 1)
    assert whitening.gram(top)[0, 1] == whitening.ROWS * ((1 << whitening.LIMB) - 1) ** 2
    for v in (0, 5, -(7**80), 1 << 200):
        assert sum(d << whitening.DIGIT * k for k, d in enumerate(whitening.digits(v))) == v


def test_whitening_of_huge_entries(spark):
    rows = [(k, [float(v), float(v * v % 97) * 1e12]) for k, v in enumerate(range(-40, 40))]
    got = {(r.vec_id, r.component): int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert all(got[k] == v[1] for k, v in brute_whitening(rows).items())


def test_whitening_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_whitening(rows)
    got = queries.op12_whitening(spark, sf).collect()
    assert len(got) == len(want) and got[0].identity_error <= 1e-4
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(w)) < 1e-8 and abs(r.explained / share - 1) < 1e-9


def brute_signatures(text, chain=3):
    own = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]
    content = [k for k, w in enumerate(own) if w not in spotsigs.ANCHORS]
    out = {(own[k - 1], *[own[j] for j in content[at : at + chain]]) for at, k in enumerate(content) if k > 0 and own[k - 1] in spotsigs.ANCHORS}
    return out or {tuple(own[k : k + chain]) for k in range(len(own))}


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_fingerprints(rows):
    """By (doc_id, text), in descending order of id."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        own = brute_signatures(text)
        out[i, text] = (len(text), edited, len(own), brute_likeness(own, brute_signatures(edited)), brute_likeness(own, brute_signatures(after)))
    return out


def test_fingerprints(spark):
    rng = random.Random(5)
    vocabulary = [*spotsigs.ANCHORS[:12], *[f"w{k}é" for k in range(60)]]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 80)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "?!"), (203, "the of and"), (204, "alone"), (205, "one two three four five six"), (206, "x" * 200_000), (207, "the 😀😀 cat, the cat 𝄞𝄞𝄞"), (208, rows[3][1]), (209, "the big cat sat " * 5000)]
    rows += [(300, "the same id again and more"), (300, "another text of that id is here"), (None, "the null id has words too"), (301, "the twin rows are equal"), (301, "the twin rows are equal")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("x")).withColumn("own", F.lit(1)).withColumn("id", F.lit(7))
    got = spotsigs.fingerprints(df.repartition(6)).withColumn("print", spotsigs.fingerprint(F.col("own"))).collect()
    want = brute_fingerprints(rows)
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        mine = [v for (i, _), v in want.items() if i == r.doc_id and v[:3] == (r.n_chars, r.edited, len(r.own))]
        assert len(mine) == 1, r
        assert abs(r.near_edited - mine[0][3]) < 1e-12 and abs(r.near_next - mine[0][4]) < 1e-12
        texts.setdefault(r.print, set()).add(tuple(r.own))
    assert all(len(v) == 1 for v in texts.values())
    alone = spotsigs.fingerprints(spark.createDataFrame([(1, "the cat sat")], "doc_id bigint, text string")).collect()
    assert (alone[0].edited, alone[0].near_next) == ("the cat the", 1.0)
    assert spotsigs.fingerprints(df.where("false")).count() == 0


def test_likeness_is_pruned_without_loss(spark):
    rng = random.Random(6)
    rows = [([*range(a)], [*range(b, b + c)]) for a, b, c in [(0, 0, 0), (5, 0, 0), (10, 0, 9), (10, 0, 8), (10, 2, 8), (100, 1, 99), (3, 3, 3)]]
    rows += [(sorted(rng.sample(range(40), rng.randrange(1, 40))), sorted(rng.sample(range(40), rng.randrange(1, 40)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for least in (0.0, 0.5, 0.8):
        got = df.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), least).alias("x")).collect()
        for r in got:
            exact = brute_likeness(set(r.a), set(r.b))
            assert abs(r.x - (exact if exact >= least else 0.0)) < 1e-12


def test_spotsigs_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: v for (i, _), v in brute_fingerprints(rows).items()}
    got = queries.op13_spotsigs(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, edited, size, near, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint.split(":")[0]) == (n, hashlib.sha256(edited.encode()).hexdigest(), str(size))
        assert abs(r.near_edited - near) < 1e-12 and abs(r.near_next - after) < 1e-12
