"""Vector search: exact scans, index semantics, hashing with exact re-ranking, embedding upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine, norm, seeded_vector
from quillgraph.storage import settled, spread


def exact_scan(vectors: DataFrame, question: list[float], k: int, min_score: float = -1.0, key: str = "chunk_id") -> DataFrame:
    """The k best of at least ``min_score``; ties by key.  A partial top-k in each task, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in question])
    scored = vectors.select(key, F.round(cosine(F.col("vector"), q), 6).alias("score")).where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(max(k, 0))


def indexed_scan(vectors: DataFrame, question: list[float], k: int, min_score: float, key: str = "chunk_id", now: DataFrame | None = None) -> DataFrame:
    """The k nearest first, then without those below ``min_score``, or whose hash is not that of ``now`` (key, content_hash): fewer than k may come."""
    best = exact_scan(vectors, question, k, -1.0, key).where(F.col("score") >= min_score)
    if now is None:
        return best
    own = best.join(vectors.select(key, "content_hash").distinct(), key)
    return own.join(now.select(key, "content_hash"), [key, "content_hash"], "left_semi").select(key, "score")


def first_source(sources: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The first of the named tables of vectors that holds any row, else the last."""
    for name, rows in sources:
        if not rows.isEmpty():
            return name, rows
    return sources[-1]


def semantic_search(sources: list[tuple[str, DataFrame]], question: list[float], k: int = 10, min_score: float = 0.25, key: str = "chunk_id") -> DataFrame:
    """The k best of the first source that holds vectors: an ``index`` drops what is below ``min_score`` after its k, other sources before; ``source`` names it."""
    name, rows = first_source(sources)
    out = indexed_scan(rows, question, k, min_score, key) if name == "index" else exact_scan(rows, question, k, min_score, key)
    return out.withColumn("source", F.lit(name))


def search(vectors: DataFrame, question: list[float], dimensions: int, k: int, min_score: float, key: str = "chunk_id") -> DataFrame:
    """Nothing for k = 0, no question or other dimensions; else the exact scan."""
    if k <= 0 or not question or len(question) != dimensions:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    return exact_scan(vectors, question, k, min_score, key)


#: Questions that go to all tasks at once, and vectors that are multiplied with them together.
BLOCK, TILE = 4096, 512


def best_in_tasks(vectors: DataFrame, asked: DataFrame, k: int, key: str, size: int, how: dict | None = None) -> DataFrame:
    """(question_id, key, score): of each task those that can be among the k best for one of at most BLOCK questions (question_id, __q).

    All vectors are finite, of one size and no zeros.  Tiles of vectors are multiplied with the questions as matrices; only
    what reaches a question's k-th rounded score leaves the task, so neither vectors nor pairs are shuffled.  With ``how``,
    the arguments of ``buckets``, only pairs that share a bucket count.
    """
    # at most BLOCK rows
    block = asked.collect()
    names = np.array([r["question_id"] for r in block], np.int64)
    matrix = np.array([r["__q"] for r in block], float).reshape(len(block), size)
    matrix /= np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    tile, hashed = TILE, how is not None
    tables, planes, normal, looks = 0, 0, None, None
    if hashed:
        tables, planes = how.get("tables", 8), how.get("planes", 10)
        normal = normals(size, tables, planes, how.get("seed", 5))
        looks = np.zeros((tables, 1 << planes, len(block)), bool)
        own = probed(matrix @ normal.T, tables, planes, how.get("probes", 1))
        for t in range(tables):
            looks[t, own[:, t].ravel(), np.repeat(np.arange(len(block)), own.shape[2])] = True
    kind = vectors.schema[key].dataType.simpleString()
    types = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    out_type = types[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        least, last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # the k-th: its rounded score in millionths, its key
        q, ids, x = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

        def cut() -> None:
            """Only what can be among the k best stays; scores so near to a half that rounding may go either way count as both."""
            nonlocal q, ids, x
            low, high = np.ceil(x * 1e6 - 0.5 - 1e-6), np.floor(x * 1e6 + 0.5 + 1e-6)
            order = np.lexsort((ids, -low, q))
            first = np.flatnonzero(np.diff(q[order], prepend=-1))
            at = first + k - 1
            full = at < np.append(first[1:], len(order))
            kth = order[at[full]]
            least[q[kth]], last[q[kth]] = low[kth], ids[kth]
            stay = (high > least[q]) | ((high == least[q]) & (ids <= last[q]))
            q, ids, x = q[stay], ids[stay], x[stay]

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            grid = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
            order = np.argsort(keys, kind="stable")
            keys, grid = keys[order], grid[order]
            grid = grid / np.sqrt((grid**2).sum(axis=1, keepdims=True))
            for at in range(0, len(keys), tile):
                part, own = grid[at : at + tile], keys[at : at + tile]
                scores = part @ matrix.T
                good = scores >= (least - 0.5 - 1e-5) / 1e6
                good &= own[:, None] != names
                if hashed:
                    side = (part @ normal.T).reshape(len(part), tables, planes)
                    codes = ((side >= 0) << np.arange(planes)).sum(axis=2)
                    shared = looks[0, codes[:, 0]]
                    for t in range(1, tables):
                        shared |= looks[t, codes[:, t]]
                    good &= shared
                row, col = np.nonzero(good)
                value = scores[row, col]
                high = np.floor(value * 1e6 + 0.5 + 1e-6)
                stay = (high > least[col]) | ((high == least[col]) & (own[row] <= last[col]))
                q, ids, x = np.append(q, col[stay]), np.append(ids, own[row[stay]]), np.append(x, value[stay])
                if len(q) > 2 * k * n + 10_000 or not np.isfinite(least).any():
                    cut()
        if len(q):
            cut()
        yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids).cast(out_type), pa.array(x, pa.float64())], names=["question_id", key, "score"])

    return vectors.select(key, "vector").mapInArrow(run, f"question_id long, {key} {kind}, score double")


def ranked_pairs(vectors: DataFrame, questions: DataFrame, k: int, key: str, size: int | None, pairs: Callable[[DataFrame, DataFrame], DataFrame], how: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(question_id, key, score, rank) of the k best for each question: regular vectors in tiles, ``pairs`` for the rest.

    Rows that repeat an id are one question.  Vectors that are null, hold nulls or no finite number, are zero or of
    another size than most questions, and keys that are no integers, are scored pair by pair with native expressions.
    """
    asked = settled(questions.select("question_id", F.col("vector").alias("__q")).dropDuplicates(["question_id"]))
    if size is None:
        common = asked.groupBy(F.size("__q").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common["n"] if common else 0
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for df, c in ((vectors, key), (asked, "question_id")))
    sound = lambda c: F.coalesce((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100)) & (norm(F.col(c)) > 1e-100), F.lit(False)) if whole and size and size > 0 else F.lit(False)
    good, odd = asked.where(sound("__q") & F.col("question_id").isNotNull()), asked.where(~sound("__q") | F.col("question_id").isNull())
    own, strange = vectors.where(sound("vector") & F.col(key).isNotNull()), vectors.where(~sound("vector") | F.col(key).isNull())
    type_ = asked.schema["question_id"].dataType
    scored = lambda rows: rows.select(F.col("question_id").cast(type_).alias("question_id"), key, F.round("score", 6).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    top = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found, n = [], good.count()
    blocks = max(1, -(-n // block))
    place = lambda m: F.pmod(F.xxhash64("question_id"), F.lit(m)).cast("int")
    # a hash deals the questions out; more blocks until none holds more than ``block``
    while blocks > 1 and good.groupBy(place(blocks).alias("block")).count().agg(F.max("count")).first()[0] > block:
        blocks += -(-blocks // 4)
    if n and k > 0:
        for at in range(blocks):
            best = scored(best_in_tasks(spread(own), good.where(place(blocks) == at), k, key, size, how))
            found.append(best if blocks == 1 else settled(top(best).drop("rank")))
    if not strange.isEmpty():
        found.append(pairs(strange, asked))
    if not odd.isEmpty():
        found.append(pairs(own, odd))
    if not found:
        found.append(pairs(own, asked))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return top(out)


def batch_scan(vectors: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id", block: int = BLOCK) -> DataFrame:
    """(question_id, key, score, rank): the exact k best for each question (question_id, vector), itself left out; ties by key.

    Questions go to all tasks in blocks of so many at most; a block is one pass over the vectors, which are never shuffled.
    """

    def pairs(some: DataFrame, asked: DataFrame) -> DataFrame:
        met = some.join(asked, F.col(key) != F.col("question_id"))
        return met.select("question_id", key, F.round(cosine(F.col("vector"), F.col("__q")), 6).alias("score"))

    return ranked_pairs(vectors, questions, k, key, None, pairs, block=block)


def normals(dimensions: int, tables: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * planes, dimensions))


def probed(sides: np.ndarray, tables: int, planes: int, probes: int) -> np.ndarray:
    """[n, tables, probes]: the bucket of each vector in each table, and the nearest others."""
    side = sides.reshape(len(sides), tables, planes)
    codes = ((side >= 0) << np.arange(planes)).sum(axis=2)[:, :, None]
    if probes <= 1:
        return codes
    flips = np.arange(1 << planes)
    cost = (side**2) @ ((flips[:, None] >> np.arange(planes)) & 1).T
    return codes ^ np.argsort(cost, axis=2, kind="stable")[:, :, :probes]


def buckets(vectors: DataFrame, dimensions: int, tables: int = 8, planes: int = 10, probes: int = 1, seed: int = 5) -> DataFrame:
    """Vectors with their buckets in each table: the signs against random hyperplanes, and the ``probes`` - 1 nearest others."""
    normal = np.random.default_rng(seed).standard_normal((tables * planes, dimensions))

    @F.pandas_udf("array<int>")
    def signs(column: pd.Series) -> pd.Series:
        side = (np.stack(column).astype(float) @ normal.T).reshape(len(column), tables, planes)
        codes = ((side >= 0) << np.arange(planes)).sum(axis=2)
        if probes > 1:
            flips = np.arange(1 << planes)
            # how far a vector is from the buckets that differ in the bits of ``flips``
            cost = (side**2) @ ((flips[:, None] >> np.arange(planes)) & 1).T
            codes = codes[:, :, None] ^ np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        else:
            codes = codes[:, :, None]
        return pd.Series((codes + (np.arange(tables) << planes)[None, :, None]).reshape(len(column), -1).tolist())

    return vectors.where(F.size("vector") == dimensions).withColumn("buckets", signs("vector"))


def candidates(vectors: DataFrame, questions: DataFrame, dimensions: int, key: str = "chunk_id", probes: int = 1, **how: int) -> DataFrame:
    """(question_id, key): pairs that share a bucket; only questions, which are few, look into several buckets of a table."""
    there = buckets(vectors, dimensions, **how).select(key, F.explode("buckets").alias("bucket"))
    asked = buckets(questions, dimensions, probes=probes, **how).select("question_id", F.explode("buckets").alias("bucket"))
    return asked.join(there, "bucket").where(F.col(key) != F.col("question_id")).select("question_id", key).distinct()


def bucketed_search(vectors: DataFrame, questions: DataFrame, dimensions: int, k: int, key: str = "chunk_id", **how: int) -> DataFrame:
    """Approximate top-k: candidates share a bucket with the question, then are ranked exactly; buckets meet inside the tasks, so pairs are never rows."""

    def pairs(some: DataFrame, asked: DataFrame) -> DataFrame:
        own = candidates(some, asked.withColumnRenamed("__q", "vector"), dimensions, key, **how)
        met = own.join(asked, "question_id").join(some.select(key, "vector"), key)
        return met.select("question_id", key, F.round(cosine(F.col("vector"), F.col("__q")), 6).alias("score"))

    return ranked_pairs(vectors, questions, k, key, dimensions, pairs, how)


def missing(chunks: DataFrame, embeddings: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks without a vector of their content hash for the model and dimensions."""
    have = embeddings.where((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("chunk_id", "content_hash")
    return chunks.join(have, ["chunk_id", "content_hash"], "left_anti")


def embed(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Vectors of chunks by the deterministic stand-in for a provider."""
    return spread(chunks).select("chunk_id", F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), "content_hash", seeded_vector(F.col("content"), dimensions).alias("vector"))


def batches(chunks: DataFrame, size: int = 96, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """(batch, position, key, text): requests to a provider of at most ``size`` texts, formed in each partition alone.

    Blank texts are no request; texts stay where they are, so the last batch of a
    partition may be smaller.
    """
    rows = chunks.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key, text, F.monotonically_increasing_id().alias("__at"))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.select(F.concat_ws(":", part, F.floor(place / size)).alias("batch"), (place % size).cast("int").alias("position"), key, text)


def reembedded(chunks: DataFrame, embeddings: DataFrame, model: str, dimensions: int, old_model: str | None = None) -> DataFrame:
    """All chunks anew for the model; vectors of other models stay, but for the old model's and those of no chunk."""
    kept = embeddings.where(F.col("model") != model).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    if old_model is not None:
        kept = kept.where(F.col("model") != old_model)
    return kept.unionByName(embed(chunks, model, dimensions).select(*kept.columns))


def confidence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", F.when(F.col("score") > 0.85, "grounded").otherwise("partial"))
