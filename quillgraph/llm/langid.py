"""Language ID: prediction by partial matching over bytes.

For each language a context tree of up to ``order`` bytes holds how often each byte
followed each context in a bounded sample.  Under these frozen statistics a byte
costs -log2 p bits: a byte seen in the context has c/(n+d) (n visits, d different
bytes); an unseen one pays the escape d/(n+d) and is coded in the next shorter
context, with the bytes already ruled out excluded; below order 0 all 256 bytes are
equal.  A context that a language never saw costs it nothing and passes on.  All
trees share one table of contexts, so a text is scored exactly, for all languages at
once, by following its contexts through arrays.

Defined results: a null text, or one without a letter, gives ``und`` with score 0
(so does every text if nothing was learned); rows of null lang or text teach
nothing; ties go to the language first in order; texts of any length are scored
whole; repeated rows each get a row and are learned from once; an empty table gives no
row; other columns pass through unless they have the name of a result, which replaces
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import drawn_by, lean

#: Documents of each language that are learned from, about.
PER_LANG = 400
ORDER = 3
#: A context is kept from so many visits on, over all languages.
MIN_VISITS = 8
#: The model is sent to every executor; where it would be larger, contexts need more visits.
MODEL_BYTES = 64 << 20
#: Bytes scored at a time.
STEP = 1 << 18
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # natural logarithms
    classes: np.ndarray  # byte -> class; bytes that no language saw share class 0
    width: int
    child: np.ndarray  # [contexts * width]: the context longer by one byte, or 0
    bits: np.ndarray  # [contexts * width, languages]
    order: int


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each byte followed each context of ``order`` bytes; line ends come before and after a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                data = np.frombuffer((b"\n" * order).join([b"", *texts, b""]), np.uint8).astype(np.int64)
                n = len(data) - order
                if n <= 0:
                    continue
                gram = np.zeros(n, np.int64)
                for k in range(order + 1):
                    gram = gram << 8 | data[k : k + n]
                codes, counts = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return sample.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def table_bytes(gram: np.ndarray, n: np.ndarray, order: int, min_visits: int, langs: int) -> int:
    """How large the tables of the contexts of at least so many visits are, at most."""
    kept = 1
    for k in range(1, order + 1):
        _, at = np.unique(gram >> 8 & ((1 << 8 * k) - 1), return_inverse=True)
        kept += int((np.bincount(at, n) >= min_visits).sum())
    different = np.unique(np.concatenate([np.unique(gram >> 8 * k & 255) for k in range(order + 1)]))
    return kept * (len(different) + 1) * 4 * (langs + 1)


def build(langs: list[str], docs: list[int], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, min_visits: int) -> Model:
    """The shared table of contexts from (language index, gram, count) rows."""
    seen = np.unique(gram & 255)
    seen = np.union1d(seen, np.unique(np.concatenate([gram >> 8 * k & 255 for k in range(1, order + 1)] or [seen])))
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, many = len(seen) + 1, len(langs)
    child_parts, prob_parts = [], []
    above_ctx, above_at, above_p, total = None, None, None, 0
    for k in range(order + 1):
        key = gram & ((1 << 8 * (k + 1)) - 1)
        ctx, at = np.unique(key >> 8, return_inverse=True)
        count = np.zeros((len(ctx), width, many))
        visits = np.bincount(at, n, len(ctx))
        keep = visits >= (min_visits if k else 0)
        new = np.cumsum(keep) - 1
        ok = keep[at]
        count = np.zeros((int(keep.sum()), width, many))
        np.add.at(count, (new[at[ok]], classes[key[ok] & 255], lang[ok]), n[ok])
        ctx = ctx[keep]
        if k == 0:
            parent_p = np.full((len(ctx), width, many), 1 / 256)
        else:
            up = np.searchsorted(above_ctx, ctx & ((1 << 8 * (k - 1)) - 1))
            parent_p = above_p[up]
            child_parts[-1][up, classes[ctx >> 8 * (k - 1)]] = total + np.arange(len(ctx))
        visited, different = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        unruled = np.maximum(1 - (parent_p * (count > 0)).sum(axis=1, keepdims=True), 1e-9)
        base = np.maximum(visited + different, 1)
        p = np.where(count > 0, count / base, different / base * parent_p / unruled)
        p = np.where(visited > 0, p, parent_p)
        child_parts.append(np.zeros((len(ctx), width), np.int32))
        prob_parts.append(-np.log2(np.maximum(p, 1e-30)).astype(np.float32).reshape(-1, many))
        above_ctx, above_p, above_at = ctx, p, total
        total += len(ctx)
    share = np.array(docs, float)
    return Model(langs, np.log(share / share.sum()), classes, width, np.concatenate([c.ravel() for c in child_parts]), np.concatenate(prob_parts), order)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, order: int = ORDER, min_visits: int = MIN_VISITS, seed: int = 7) -> Model | None:
    """Learn from about ``per_lang`` documents of each language; None if there is none to learn from."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # equal texts are drawn together, and one of them is learned from
    sample = rows.where(drawn_by(F.col("text"), seed, F.col("lang"), {k: per_lang / v for k, v in sizes.items()})).dropDuplicates(["lang", "text"])
    langs = sorted(sizes)
    counts = count_grams(sample, order).toArrow()
    if not counts.num_rows:
        return None
    at = {k: i for i, k in enumerate(langs)}
    index = np.array([at[x] for x in counts["lang"].to_pylist()], np.int64)
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    while table_bytes(gram, n, order, min_visits, len(langs)) > MODEL_BYTES:
        min_visits *= 2
    return build(langs, [sizes[k] for k in langs], index, gram, n, order, min_visits)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language: [texts, languages]."""
    out = np.zeros((len(texts), len(model.langs)))
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + model.order)
    data = (b"\n" * model.order).join([b"", *texts])
    own = model.classes[np.frombuffer(data, np.uint8)]
    for at in range(0, len(own) - model.order, STEP):
        upto = min(at + STEP, len(own) - model.order)
        symbol = own[at + model.order : upto + model.order]
        node = np.zeros(upto - at, np.int32)
        alive = np.ones(upto - at, bool)
        for k in range(1, model.order + 1):
            longer = model.child[node * model.width + own[at + model.order - k : upto + model.order - k]]
            alive &= longer > 0
            node = np.where(alive, longer, node)
        cost = model.bits[node * model.width + symbol]
        # a separator's own bytes cost nothing
        first, last = np.searchsorted(ends, at + model.order, "right"), np.searchsorted(ends, upto + model.order - 1, "right")
        for i in range(first, min(last + 1, len(texts))):
            start, stop = ends[i] - lengths[i] - model.order, ends[i] - model.order
            a, b = max(start, at), min(stop, upto)
            if a < b:
                out[i] += cost[a - at : b - at].sum(axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (of the predicted language, given the text and how common languages are) and bits_per_byte."""
    new = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c.lower() not in new]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNDETERMINED).alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(0.0).alias(new[2]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__scored"))
    schema = T.StructType([*rows.drop("__scored").schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                data = [(t or "").encode() for t in texts]
                bits = code_lengths(m, data)
                nats = m.prior - bits * np.log(2)
                best = nats.argmax(axis=1)
                top = nats[np.arange(len(best)), best]
                score = 1 / np.exp(nats - top[:, None]).sum(axis=1)
                rate = bits[np.arange(len(best)), best] / np.maximum([len(d) for d in data], 1)
                told = [t is not None for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i) for i in range(batch.num_columns - 1)],
                        pa.array([m.langs[b] if ok else UNDETERMINED for b, ok in zip(best, told, strict=True)], pa.string()),
                        pa.array(np.where(told, score, 0.0)),
                        pa.array(np.where(told, rate, 0.0)),
                    ],
                    names=[*batch.schema.names[:-1], *new],
                )

    return rows.mapInArrow(lean(run), schema)
