"""Exact top-k by block-at-a-time pruning.

Vectors are cut into document-range blocks (ranges of a locality key, then of the id).  A
block is one row: a forward index (its vectors as a matrix) and, for each term
(dimension), its greatest and least value.  A block's bound for a query is the sum over
the query's terms of weight times the maximum (the minimum for negative weights).

Queries are cut into groups by the same key.  Bounds are taken from the maxima alone,
which are a few hundredths of the vectors: each query first scores the block of its
highest bound, which gives a k-th score over the whole table; a block then only travels
to the groups in which some query's bound reaches its k-th score, and there the blocks
are scored, highest bound first, until a bound falls below the k-th score so far.  A
task holds one group and one shelf of blocks, both of fixed size; the rest is a partial
top-k merge.  Nothing is broadcast.

Defined results: a vector that is null, empty, or holds a null or non-finite component
takes no part; nor does one whose number of components differs from the query's; ties go
to the smaller id; a row never answers itself, but equal vectors of other ids do; repeated
ids stay rows of their own, except that they never answer their own id; null ids take no
part; fewer than k candidates give fewer rows; an empty table gives none; other columns do
not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import counted, stored

#: Vectors of a document block, blocks of a shelf, and queries of a group.
BLOCK, SHELF, QUERIES = 256, 64, 1024


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null for vectors that take no part."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale))
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(whole, x)


def in_blocks(rows: DataFrame, size: int, parts: int, of_queries: bool) -> DataFrame:
    """(part, dims, ids, flat, top, low): ranges of (dims, locality key, id) of at most ``size`` rows (id, v), with maxima and minima unless they are queries; made in so many tasks."""
    # the locality key: the strongest component, so that a block's maxima are high in few terms
    near = F.array_position("v", F.array_max("v"))
    keyed = rows.select(F.size("v").alias("dims"), near.alias("near"), "id", "v")
    keyed = keyed.repartitionByRange(parts, "dims", "near", "id").sortWithinPartitions("dims", "near", "id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(columns=["dims", "near", "id", "v"])
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            while len(held):
                same = int((held["dims"] == held["dims"].iloc[0]).to_numpy().argmin()) or len(held)
                take = min(same, size)
                if take == len(held) < size:
                    break
                yield packed(held[:take])
                held = held[take:]
        if len(held):
            yield packed(held)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(part["v"].to_numpy()).astype(np.int64)
        ends = [[], []] if of_queries else [matrix.max(axis=0), matrix.min(axis=0)]
        return pd.DataFrame([[matrix.shape[1], part["id"].to_numpy(np.int64), matrix.ravel(), *ends]], columns=["dims", "ids", "flat", "top", "low"])

    made = keyed.mapInPandas(cut, "dims int, ids array<bigint>, flat array<bigint>, top array<bigint>, low array<bigint>")
    return made.withColumn("part", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "q", k: int = 5, block: int = BLOCK, shelf: int = SHELF, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, key, score): the k best inner products of each query over all rows but its own."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    asks = rows.where("asks")
    # as few groups as the queries fill, since a block travels to each
    groups = stored(in_blocks(asks, queries, max(1, -(-asks.count() // queries)), True), "groups")
    groups = groups.select(F.col("part").alias("group"), "dims", F.col("ids").alias("asked"), F.col("flat").alias("q"))
    blocks, n = counted(in_blocks(rows, block, rows.sparkSession.sparkContext.defaultParallelism, False), "blocks")
    shelves = max(1, -(-n // shelf))
    blocks = blocks.withColumnRenamed("part", "block").withColumn("shelf", F.pmod(F.xxhash64("block"), F.lit(shelves)).cast("int"))

    # bounds: maxima meet every group, vectors do not
    # stored, so that nothing meets a table that it comes from
    names = stored(groups.select("group", "dims"), "names")
    maxima = blocks.select("shelf", "block", "dims", "top", "low").join(names, "dims")
    spread = groups.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    first = spread.groupBy("group", "shelf").cogroup(maxima.groupBy("group", "shelf")).applyInPandas(best_block, "group long, at int, block long, bound double")
    first = first.groupBy("group", "at").agg(F.max(F.struct("bound", "block")).alias("x")).select("group", "at", F.col("x.block").alias("block"))

    # the k-th score of each query in its best block: the result's is no less
    single = groups.select("group", "dims", "q", F.posexplode("asked").alias("at", "name"))
    single = single.select("group", "at", "name", F.expr("slice(q, at * dims + 1, dims)").alias("q"))
    # a row: the queries of one group, so of a bounded number, that begin with one block
    pairs = first.join(single, ["group", "at"]).groupBy("group", "block").agg(F.collect_list(F.struct("at", "name", "q")).alias("asks"))
    met = pairs.join(blocks.select("block", "ids", "flat"), "block").select("group", "asks.at", "asks.name", "asks.q", "ids", "flat")
    floors = met.mapInPandas(lambda parts: kth_scores(parts, k), "group long, at int, floor long")
    told = floors.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("f"))
    floored = stored(groups.join(told.select("group", F.col("f.at").alias("at"), F.col("f.floor").alias("floor")), "group"), "floors")

    # blocks that can still hold an answer for some query of the group
    spread = floored.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    live = stored(spread.groupBy("group", "shelf").cogroup(maxima.groupBy("group", "shelf")).applyInPandas(live_blocks, "group long, shelf int, block long"), "live")
    shipped = live.join(blocks.drop("shelf", "dims"), "block")
    best = spread.groupBy("group", "shelf").cogroup(shipped.groupBy("group", "shelf")).applyInPandas(lambda a, b: search(a, b, k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def exact_kind(q: np.ndarray, *rows: np.ndarray) -> type:
    """Products of integers are exact in doubles up to 2**53; larger ones are summed as whole numbers."""
    size = float(np.abs(q).max(initial=0)) * max(float(np.abs(r).max(initial=0)) for r in rows) * q.shape[1]
    return np.float64 if size < 2**53 else object if size >= 2**62 else np.int64


def as_kind(kind: type, *arrays: np.ndarray) -> list[np.ndarray]:
    return [x.astype(object) if kind is object else x.astype(kind) for x in arrays]


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """[queries, blocks]: no inner product of a query with a block's vectors is larger."""
    q, top, low = as_kind(exact_kind(q, top, low), q, top, low)
    zero = q * 0
    return np.maximum(q, zero) @ top.T + np.minimum(q, zero) @ low.T


def _asked(row: object) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(row.asked, np.int64), np.asarray(row.q).reshape(len(row.asked), -1)


def best_block(asks: pd.DataFrame, maxima: pd.DataFrame) -> pd.DataFrame:
    """The block of highest bound of a shelf for each query of a group, by its place there."""
    out = pd.DataFrame(columns=["group", "at", "block", "bound"])
    if not len(asks) or not len(maxima):
        return out
    row = next(asks.itertuples())
    _, q = _asked(row)
    bound = bounds(q, np.stack(maxima["top"]), np.stack(maxima["low"])).astype(float)
    best = bound.argmax(axis=1)
    return pd.DataFrame({"group": row.group, "at": np.arange(len(q)), "block": maxima["block"].to_numpy()[best], "bound": bound.max(axis=1)})


def kth_scores(parts: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k-th score of queries in one block, their own row left out; the least long where there are fewer."""
    for part in parts:
        for row in part.itertuples():
            at, names, ids = np.asarray(row.at), np.asarray(row.name), np.asarray(row.ids)
            scores = _scores(np.stack(row.q), np.asarray(row.flat).reshape(len(ids), -1))
            floor = []
            for name, score in zip(names, scores, strict=True):
                own = np.sort(score[ids != name])
                floor.append(int(own[-k]) if len(own) >= k else -(1 << 63))
            yield pd.DataFrame({"group": row.group, "at": at, "floor": floor})


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    q, rows = as_kind(exact_kind(q, rows), q, rows)
    return q @ rows.T


def live_blocks(asks: pd.DataFrame, maxima: pd.DataFrame) -> pd.DataFrame:
    """Blocks of a shelf whose bound reaches the k-th score of some query of a group."""
    out = pd.DataFrame(columns=["group", "shelf", "block"])
    if not len(asks) or not len(maxima):
        return out
    row = next(asks.itertuples())
    _, q = _asked(row)
    on = (bounds(q, np.stack(maxima["top"]), np.stack(maxima["low"])) >= np.asarray(row.floor, np.int64)[:, None]).any(axis=0)
    return pd.DataFrame({"group": row.group, "shelf": row.shelf, "block": maxima["block"].to_numpy()[on]})


def search(asks: pd.DataFrame, stock: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a shelf's live blocks for each query of a group."""
    out: list[tuple] = []
    if len(asks) and len(stock):
        row = next(asks.itertuples())
        names, q = _asked(row)
        held = [(np.asarray(r.ids), np.asarray(r.flat).reshape(len(r.ids), -1)) for r in stock.itertuples()]
        bound = bounds(q, np.stack(stock["top"]), np.stack(stock["low"]))
        kind = exact_kind(q, *[m for _, m in held])
        q, *mats = as_kind(kind, q, *[m for _, m in held])
        for i, floor in enumerate(np.asarray(row.floor, np.int64)):
            score, answer = np.empty(0, kind), np.empty(0, np.int64)
            for b in np.argsort(-bound[i].astype(float), kind="stable"):
                least = max(int(floor), int(score[-1])) if len(score) == k else int(floor)
                if bound[i, b] < least:
                    break
                s, ids = mats[b] @ q[i], held[b][0]
                on = (s >= least) & (ids != names[i])
                score, answer = np.concatenate([score, s[on]]), np.concatenate([answer, ids[on]])
                best = np.lexsort((answer, -score.astype(float) if kind is np.float64 else -score))[:k]
                score, answer = score[best], answer[best]
            out += [(names[i], x, int(v)) for x, v in zip(answer, score, strict=True)]
    return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")
