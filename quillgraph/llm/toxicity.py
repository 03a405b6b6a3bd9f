"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning counts, over a bounded sample of labelled documents, in how many toxic and
clean documents each token occurs.  A token's score is its log-odds under a Dirichlet
prior in proportion to all documents, kept where it is ``MIN_Z`` standard deviations
from none, and zero otherwise; every token also pays ``DRIFT``, so that chance text
scores below zero.  Since words repeat, the k-th time in a stretch a token counts a
k-th; a stretch ends where its sum falls to zero, which no segment reaches across, so
what a passage scores does not depend on text far before it.  One linear scan finds all maximal-scoring segments of a text.  A
segment of score s has E-value K * tokens * exp(-lambda * s), where lambda solves
sum p * exp(lambda * score) = 1 over clean text and K is the rate of segments there;
the evidence of a text is the sum of -log E over its significant segments, and a
logistic curve fitted on the sample turns evidence into a score.

Defined results: null and empty texts have no segment and get the score of no
evidence; a token is a run of letters, digits or underscores, in lower case; without
learned rows, or with one class only, every score is the share of that class (0.5
without rows); tied segments are listed by place; texts of any length are read whole;
repeated rows each get a row, and repeated labelled texts teach once; an empty table
gives no row; other columns pass through unless a result has their name, which replaces
them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.calibrate import fit_logistic, logistic
from quillgraph.llm.common import labelled_sample, lean

#: Labelled documents of each class that are learned from, about.
PER_CLASS = 8000
#: Weight of the prior against all documents of the sample.
PRIOR = 0.02
MIN_Z = 3.0
DRIFT = 0.4
#: E-value up to which a segment is significant.
MAX_E = 0.05
TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    scores: dict[str, float]  # log-odds of the tokens that tell, before the drift
    lam: float
    k: float
    weights: np.ndarray


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(values: list[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from token, to token, score) by one scan; ``values`` holds the tokens, by place, that score other than ``-drift``."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum with
    total, at = 0.0, 0
    for place, value in values:
        total -= drift * (place - at)
        at = place + 1
        before = total
        total += value - drift
        if total <= before:
            continue
        first, last, low, high = place, place, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((first, last, low, high))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def find(model: Model, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the segments of a text."""
    words = tokens(text)
    scores = model.scores
    if scores.keys().isdisjoint(words):
        return len(words), []
    times: Counter[str] = Counter()
    values = []
    run, at = 0.0, 0
    for i, w in enumerate(words):
        s = scores.get(w)
        if s is not None:
            run -= DRIFT * (i - at)
            at = i + 1
            if run <= 0:
                run = 0.0
                times.clear()
            times[w] += 1
            values.append((i, s / times[w]))
            run += s / times[w] - DRIFT
    return len(words), segments(values, len(words), DRIFT)


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Sum of -log E over significant segments, and those segments with their E-values."""
    told, kept = 0.0, []
    for a, b, s in found:
        e = model.k * max(n, 1) * np.exp(-model.lam * s)
        if e <= MAX_E:
            kept.append((a, b, s, float(e)))
            told += -np.log(max(e, 1e-300))
    return told, kept


def count_tokens(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each class with the token; ``sample`` has (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[label].update(set(tokens(text or "")))
            words = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([by[1][w] for w in words], pa.int64()), pa.array([by[0][w] for w in words], pa.int64())],
                names=["token", "toxic", "clean"],
            )

    return sample.mapInArrow(lean(run), "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weigh(counts: DataFrame, toxic_docs: int, clean_docs: int, prior: float = PRIOR, min_z: float = MIN_Z) -> DataFrame:
    """(token, score, clean): log-odds with Dirichlet prior of the tokens that tell."""
    total = toxic_docs + clean_docs
    share = lambda y, n: F.log((F.col(y) + F.col("a")) / (F.lit(n * 1.0 + prior * total) - F.col(y) - F.col("a")))
    rows = counts.withColumn("a", (F.col("toxic") + F.col("clean")) * F.lit(prior))
    rows = rows.withColumn("score", share("toxic", toxic_docs) - share("clean", clean_docs))
    z = F.abs("score") / F.sqrt(1 / (F.col("toxic") + F.col("a")) + 1 / (F.col("clean") + F.col("a")))
    return rows.where(z >= min_z).select("token", "score", "clean")


def solve_lambda(score: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive root of sum p * exp(lambda * (score - drift)) = 1; ``share`` leaves the rest to tokens of score 0."""
    rest = max(1 - share.sum(), 0.0)
    f = lambda lam: float((share * np.exp(np.minimum(lam * (score - drift), 700))).sum() + rest * np.exp(-lam * drift)) - 1
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, seed: int = 11, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from about ``per_class`` documents of each label 0 and 1; rows of null label teach nothing."""
    sample, sizes = labelled_sample(docs, labels, label, per_class, seed, key, text)
    sample = sample.dropDuplicates(["text", "label"])
    if len(sizes) < 2:
        y = np.array([*sizes.keys()], float)
        return Model({}, 1.0, 1.0, np.r_[fit_logistic(np.zeros((len(y), 1)), y)[0], 0.0, 0.0])
    taken = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    told = weigh(count_tokens(sample), taken.get(1, 0), taken.get(0, 0)).toPandas()
    scores = dict(zip(told["token"], told["score"].astype(float), strict=True))
    model = Model(scores, 1.0, 1.0, np.zeros(3))

    # tokens and chance segments of clean text
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [find(model, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([[s for *_, s in f] for _, f in out], pa.list_(pa.float64()))],
                names=["label", "n", "found"],
            )

    seen = sample.mapInArrow(lean(scan), "label int, n long, found array<double>").toPandas()
    clean = seen[seen["label"] == 0]
    length = max(float(clean["n"].sum()), 1.0)
    # a token's share of clean text: its documents over all tokens, at least
    share = told["clean"].to_numpy(float) / length
    model.lam = solve_lambda(told["score"].to_numpy(float), np.minimum(share, 1.0), DRIFT) if len(told) else 1.0
    chance = np.concatenate([np.asarray(x, float) for x in clean["found"]] or [np.empty(0)])
    model.k = max(float(np.exp(np.minimum(model.lam * chance, 50)).clip(max=1e6).mean()) if len(chance) else 1.0, 1.0) * max(len(chance), 1) / length
    x = np.array([features(model, n, [(0, 0, s) for s in f]) for n, f in zip(seen["n"], seen["found"], strict=True)])
    model.weights = fit_logistic(x, seen["label"].to_numpy(float))
    # the sample has its own balance of classes; shift to that of the rows
    drawn, real = taken.get(1, 0) / max(taken.get(0, 0), 1), sizes[1] / sizes[0]
    model.weights[0] += np.log(real / drawn) if drawn else 0.0
    return model


def features(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    told, kept = evidence(model, n, found)
    return float(np.log1p(told)), min(told / max(n, 1), 2.0)


SEGMENT = "array<struct<from_token:int,to_token:int,score:double,e_value:double>>"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and segments (the significant passages, as token ranges)."""
    new = ["score", "segments"]
    kept = [c for c in docs.columns if c.lower() not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__scored"))
    schema = T.StructType([*rows.drop("__scored").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("segments", T._parse_datatype_string(SEGMENT))])
    kind = pa.list_(pa.struct([("from_token", pa.int32()), ("to_token", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x, passages = [], []
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    n, found = find(m, t or "")
                    x.append(features(m, n, found))
                    passages.append([dict(zip(("from_token", "to_token", "score", "e_value"), p, strict=True)) for p in evidence(m, n, found)[1]])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(logistic(m.weights, np.array(x))), pa.array(passages, kind)],
                    names=[*batch.schema.names[:-1], *new],
                )

    return rows.mapInArrow(lean(run), schema)
