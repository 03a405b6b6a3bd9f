"""Ranked lexical search: an index of variable blocks with maxima, searched shard by shard.

Each task cuts its documents into shards of bounded size and writes an inverted index of
each: a row is one term of one shard, with the documents that hold it, their impacts
(the score apart from the term's weight), and blocks.  Block borders are placed by dynamic
programming: a block costs ``BLOCK_COST`` and each posting in it as much as the block's
maximum is above its own impact, and of all cuts into blocks of at most ``LONGEST``
postings the cheapest is taken.

A search gives each document range between block borders the sum of the weighted maxima
of the asked terms' blocks there, a bound of every score inside.  Ranges are taken from the
highest bound down; ranges, and blocks that lie in no live range, are skipped once bounds
fall below the k-th score.  Of what is left, terms whose list maxima together stay below
the k-th score cannot bring a document in by themselves, so documents come from the other
lists (the pivot), and the rest is only looked up for them.  A few shards are searched
first, and their k-th score, which holds for the whole table, is where all begin.  Nothing
is approximate.

Scores are whole numbers: a term that df of N documents hold weighs
floor(1000 * ln((2 N + 2) / (2 df + 1))); with n terms in a document and L in all, m is
10 + (90 n N) div L and the impact (10^9 tf) div (1000 tf + 8 m).

Defined results: terms are runs of ASCII letters and digits or non-ASCII characters,
only A-Z lowered; null and empty texts, and texts without a term, have none and are no
answers; rows without an id take no part at all; rows that repeat an id are documents of
their own; equal scores go by id; each row of questions is a question of its own, also
where ids repeat; a question without a known term gets no row; texts and questions are
read whole; empty tables give no row; other columns do not take part, whatever their
names.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import lean, observed, stored

#: A term, for Spark; ``SPLIT`` does the same to UTF-8: letters lowered, ASCII characters that are in no term blank.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: A shard holds at most so many documents, and is closed at so many postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Cost of a block in units of impact, and postings of a block at most.
BLOCK_COST, LONGEST = 3_000_000, 64
#: Postings of a piece of a list whose borders are found together.
PIECE = 512
#: So many different terms may be named to every task; beyond that, the index holds all terms.
NAMED_TERMS = 200_000
#: Questions of a group, and one of how many shards is searched first.
GROUP, FIRST = 1024, 16
#: Documents scored in the first round of a search, and how much larger the next ones are.
ROUND, GROWTH = 256, 8


class Index(NamedTuple):
    """Rows (shard, term, df, docs, impacts, ends, tops), where the empty term bears a shard's ids; the corpus sizes; and how many documents hold each term."""

    rows: DataFrame
    n: int
    total: int
    df: DataFrame


def terms(text: str) -> list[bytes]:
    return text.encode().translate(SPLIT).split()


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    m = 10 + (90 * length * n) // total
    return (10**9 * tf) // (1000 * tf + 8 * m)


def borders(scores: list[np.ndarray], cost: int = BLOCK_COST, longest: int = LONGEST) -> list[np.ndarray]:
    """For each list of impacts the ends of its blocks: the cut of least cost, found for many lists in step."""
    ends: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    size = np.array([len(s) for s in scores])
    for low in 2 ** np.arange(PIECE.bit_length()):  # lists of like length together
        own = np.flatnonzero((size >= low) & (size < 2 * low))
        wide = int(size[own].max(initial=0))
        for rows in np.array_split(own, -(-len(own) * wide // 400_000) or 1):
            if len(rows):
                grid = np.zeros((len(rows), wide), np.int64)
                for k, r in enumerate(rows):
                    grid[k, : size[r]] = scores[r]
                for r, e in zip(rows, _cut(grid, size[rows], cost, longest), strict=True):
                    ends[r] = e
    return ends


def _cut(grid: np.ndarray, size: np.ndarray, cost: int, longest: int) -> list[np.ndarray]:
    rows, wide = grid.shape
    longest = min(longest, wide)
    many = np.arange(1, longest + 1)
    best = np.full((rows, longest + wide + 1), 1 << 60, np.int64)  # best[:, longest + j]: the least cost of the first j
    best[:, longest] = 0
    top = np.zeros((rows, longest), np.int64)  # of the last 1, 2, ... postings
    last = np.zeros((rows, wide + 1), np.int32)
    for j in range(1, wide + 1):
        top[:, 1:] = top[:, :-1].copy()
        top[:, 0] = 0
        np.maximum(top, grid[:, j - 1 : j], out=top)
        # the sum of all impacts is the same for every cut
        price = top * many + best[:, j : longest + j][:, ::-1]
        last[:, j] = price.argmin(axis=1)
        best[:, longest + j] = np.take_along_axis(price, last[:, j : j + 1].astype(np.int64), 1)[:, 0] + cost
    out = []
    for r in range(rows):
        at, own = int(size[r]), []
        while at:
            own.append(at)
            at -= int(last[r, at]) + 1
        out.append(np.array(own[::-1], np.int64))
    return out


def blocks(scores: list[np.ndarray], cost: int = BLOCK_COST, longest: int = LONGEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ends, maxima) of the blocks of each list; long lists are cut into pieces of ``PIECE`` first."""
    pieces = [s[k : k + PIECE] for s in scores for k in range(0, len(s), PIECE)]
    found = iter(borders(pieces, cost, longest))
    out = []
    for s in scores:
        ends = np.concatenate([next(found) + k for k in range(0, len(s), PIECE)])
        out.append((ends, np.maximum.reduceat(s, np.concatenate([[0], ends[:-1]]))))
    return out


class Shard:
    """Collects documents; ``rows`` are the index of what it holds."""

    def __init__(self, wanted: set[bytes] | None):
        self.wanted = wanted
        self.words: dict[bytes, int] = {}
        self.ids, self.lengths = array("q"), array("q")
        self.term, self.doc, self.tf = array("i"), array("i"), array("i")

    def add(self, key: int, text: str) -> None:
        found = terms(text)
        if not found:
            return
        counts = Counter(found)
        wanted = counts if self.wanted is None else self.wanted.intersection(counts)
        at = len(self.ids)
        self.ids.append(key)
        self.lengths.append(len(found))
        self.term.extend([self.words.setdefault(w, len(self.words)) for w in wanted])
        self.tf.extend([counts[w] for w in wanted])
        self.doc.extend([at] * len(wanted))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def rows(self, n: int, total: int) -> list[tuple]:
        term, doc, tf = (np.frombuffer(x, np.int32) for x in (self.term, self.doc, self.tf))
        order = np.argsort(term, kind="stable")
        doc, tf = doc[order], tf[order].astype(np.int64)
        score = impacts(tf, np.frombuffer(self.lengths, np.int64)[doc], n, total)
        ends = np.cumsum(np.bincount(term, minlength=len(self.words)))
        cut = np.split(score, ends[:-1])
        out = [("", len(self.ids), self.ids.tobytes(), b"", b"", b"")]
        docs = np.split(doc, ends[:-1])
        for w, d, s, (e, top) in zip(self.words, docs, cut, blocks(cut) if self.words else [], strict=False):
            out.append((w.decode(errors="surrogateescape"), len(d), *(x.astype("<i4").tobytes() for x in (d, s, e, top))))
        return out


_ROW = {"term": pa.string(), "df": pa.int64(), "docs": pa.binary(), "impacts": pa.binary(), "ends": pa.binary(), "tops": pa.binary()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have a term, and how many terms they have."""
    n = total = 0
    for batch in batches:
        for t in batch.column(0):
            many = len(terms(t.as_py()))
            n, total = n + (many > 0), total + many
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: list[str] | None = None) -> Index:
    """The stored index of (key, text) rows: of all terms, or of the wanted ones."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    sizes = own.select("text").mapInArrow(lean(_counted), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = sizes["n"] or 0, sizes["total"] or 0
    only = None if wanted is None else {w.encode() for w in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place = Shard(only), 0

        def done() -> Iterator[pa.RecordBatch]:
            rows = shard.rows(n, total)
            for k in range(0, len(rows), 2000):
                columns = list(zip(*rows[k : k + 2000], strict=True))
                data = [pa.array(c, t) for c, t in zip(columns, _ROW.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(columns[0]), pa.int32()), *data], names=["place", *_ROW])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(i.as_py(), t.as_py())
                if shard.full():
                    yield from done()
                    shard, place = Shard(only), place + 1
        if len(shard.ids):
            yield from done()

    made = own.mapInArrow(lean(run), "place int, term string, df long, docs binary, impacts binary, ends binary, tops binary")
    # a shard is named by its task and its place there
    rows = made.select((F.spark_partition_id().cast("long") * (1 << 32) + F.col("place")).alias("shard"), *_ROW)
    kept = stored(rows, "index")
    return Index(kept, n, total, stored(kept.where("term != ''").groupBy("term").agg(F.sum("df").alias("df")), "terms"))


def weight(n: int, df: str = "df"):
    return F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col(df) + 1))).cast("long")


def groups_of(index: Index, asked: DataFrame, key: str, text: str, group: int) -> tuple[DataFrame, int]:
    """(group, at, name, words, weights) of questions with a known term, ``group`` of them in each group, and how many groups."""
    each = F.array_distinct(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)))
    rows = stored(asked.select(F.monotonically_increasing_id().alias("q"), F.col(key).alias("name"), each.alias("words")), "questions")
    known = rows.select("q", F.explode("words").alias("term")).join(index.df, "term").withColumn("w", weight(index.n)).where("w > 0")
    known = known.groupBy("q").agg(F.collect_list("term").alias("words"), F.collect_list("w").alias("weights"))
    many = known.count()
    groups = max(1, -(-many // group))
    return rows.drop("words").join(known, "q").withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")), groups


def search(shard: dict[str, tuple], questions: list[tuple], k: int) -> Iterator[tuple]:
    """(place of the question, id, score): the k best of a shard for questions (words, weights, floor)."""
    ids = shard[""]
    n = len(ids)
    for place, (words, weights, floor) in enumerate(questions):
        lists = [(int(w), *shard[t]) for t, w in zip(words, weights, strict=True) if t in shard]
        # ascending list maxima, as the pivot wants them
        lists.sort(key=lambda x: x[0] * int(x[4].max()))
        yield from ((place, int(ids[d]), s) for d, s in best_of(lists, ids, n, k, floor))


def best_of(lists: list[tuple], ids: np.ndarray, n: int, k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (document, score) above 0 and not below ``floor``; lists are (weight, docs, impacts, ends, maxima)."""
    if not lists:
        return []
    slope = np.zeros(n + 1, np.int64)
    for w, docs, _, ends, tops in lists:
        starts = np.concatenate([[0], ends[:-1]])
        np.add.at(slope, docs[starts], w * tops)
        np.subtract.at(slope, docs[ends - 1] + 1, w * tops)
    bound = np.cumsum(slope)[:n]
    reach = np.cumsum([w * int(tops.max()) for w, _, _, _, tops in lists])
    least, size = max(floor, 1), ROUND
    score, answer = np.empty(0, np.int64), np.empty(0, np.int64)
    open_ = bound >= least
    while True:
        left = int(open_.sum())
        if not left:
            break
        # the documents of highest bounds; all that are left once rounds are wide enough
        if left > size:
            edge = np.partition(bound[open_], left - size)[left - size]
            live = open_ & (bound >= edge)
        else:
            live = open_
        found, got = scored(lists, reach, live, n, least)
        keep = got >= least
        score, answer = np.concatenate([score, got[keep]]), np.concatenate([answer, found[keep]])
        best = np.lexsort((ids[answer], -score))[:k]
        score, answer = score[best], answer[best]
        if len(score) == k:
            least = max(least, int(score[-1]))
        open_ = open_ & ~live & (bound >= least)
        size *= GROWTH
    return list(zip(answer.tolist(), score.tolist(), strict=True))


def scored(lists: list[tuple], reach: np.ndarray, live: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents among the live ones that can reach ``least``, and their scores."""
    pivot = int(np.searchsorted(reach, least))
    before = np.concatenate([[0], np.cumsum(live)])
    total, seen = np.zeros(n, np.int64), np.zeros(n, bool)
    for place in range(len(lists) - 1, -1, -1):
        w, docs, impact, ends, _ = lists[place]
        if place == pivot - 1:  # from here on lists only add to documents that others brought
            live = live & seen
            before = np.concatenate([[0], np.cumsum(live)])
        starts = np.concatenate([[0], ends[:-1]])
        on = before[docs[ends - 1] + 1] > before[docs[starts]]
        if on.all():
            d, s = docs, impact
        else:  # other blocks are skipped
            many = (ends - starts)[on]
            at = np.repeat(starts[on] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            d, s = docs[at], impact[at]
        hit = live[d]
        d = d[hit]
        total[d] += w * s[hit]
        if place >= pivot:
            seen[d] = True
    found = np.flatnonzero(seen)
    return found, total[found]


def _arrays(row) -> tuple:
    if not row.term:
        return np.frombuffer(row.docs, "<i8")
    docs, impact, ends, tops = (np.frombuffer(x, "<i4").astype(np.int64) for x in (row.docs, row.impacts, row.ends, row.tops))
    return docs, impact, ends, tops


def searched(rows: DataFrame, groups: DataFrame, many: int, k: int) -> DataFrame:
    """(group, at, id, score): the k best of each shard for each question of (group, ask)."""
    met = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    # each shard meets each group of questions: a bounded number of rows in a task's hands
    asks = rows.where("term = ''").select("shard").join(groups, F.lit(True))

    def run(key: tuple, stock: pd.DataFrame) -> pd.DataFrame:
        ask = [a for asked in stock["ask"] if asked is not None for a in asked]
        shard = {r.term: _arrays(r) for r in stock.itertuples() if r.term is not None}
        found = search(shard, [(a["words"], a["weights"], a["floor"]) for a in ask], k) if ask and shard else ()
        return pd.DataFrame([(key[0], ask[p]["q"], i, s) for p, i, s in found], columns=["group", "q", "id", "score"])

    return met.unionByName(asks, allowMissingColumns=True).groupBy("group", "shard").applyInPandas(run, "group int, q long, id long, score long")


def packed(questions: DataFrame) -> DataFrame:
    """(group, ask): a row a group, which holds a bounded number of questions."""
    return questions.groupBy("group").agg(F.collect_list(F.struct("q", "words", "weights", "floor")).alias("ask"))


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query(index: Index, asked: DataFrame, key: str = "item_id", text: str = "text", k: int = 10, doc: str = "doc_id", group: int = GROUP) -> DataFrame:
    """(key, rank, doc, score): the k best documents of each question."""
    questions, many = groups_of(index, asked, key, text, group)
    questions = stored(questions.withColumn("floor", F.lit(0).cast("long")), "asked")
    # the k-th score of a part of the shards is no more than that of all
    part = index.rows.where(F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0)
    floors = top(searched(part, stored(packed(questions), "groups"), many, k), k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    floored = stored(questions.join(floors, "q", "left").withColumn("floor", F.coalesce("least", "floor")).drop("least"), "floors")
    best = top(searched(index.rows, stored(packed(floored), "groups"), many, k), k)
    return best.join(floored.select("q", "name"), "q").select(F.col("name").alias(key), "rank", F.col("id").alias(doc), "score")


def ranked(docs: DataFrame, asked: DataFrame, k: int = 10, key: str = "item_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best of ``docs`` for each of ``asked``, by an index of the asked terms where they are few enough to name, of all terms otherwise."""
    each = asked.select(F.explode(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    words, told = observed(each, "terms", {"n": F.count(F.lit(1))})
    wanted = [r["term"] for r in words.collect()] if told["n"] <= NAMED_TERMS else None
    return query(build(docs, doc, text, wanted), asked, key, text, k, doc)
