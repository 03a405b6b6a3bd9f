"""Near-duplicates: ProbMinHash signatures of shingles, banding, verification.

A text's shingles (``WORDS`` words each, weight 1 + ln of a count) send arrivals of a
Poisson process of their weight to random registers; each register keeps its earliest
arrival, and a shingle stops as soon as its next arrival comes after the latest register
(early termination).  Two texts agree in a register with the probability Jaccard of
their weights.  Links are defined on sets, so banding counts every shingle once however
often it occurs: registers then agree with the very similarity that is verified.
Registers are hashed in bands, texts that share a band meet in a bucket,
and pairs count as links when the exact Jaccard similarity of their sets of shingles is
at least ``THRESHOLD``.  Classes are the connected components of links and exact copies.

Only one text of each group of exact copies takes part.  A bucket is led by its central
text, the one that meets most texts in its buckets, and every text of the bucket is
compared with it; classes are contracted over these links.  Texts of buckets that still hold
several classes are joined by an exact filter instead of by their buckets, since texts
that share a long template fill buckets without being alike.  A shingle that no other
class has among these texts cannot be common, so each text keeps s of its n shingles.
Two texts of n and m shingles need threshold / (1 + threshold) * (n + m) common ones: so one of
them can only meet partners of a range of sizes that follows from n and s, and both have one of their
s - threshold * n + 1 rarest kept shingles in common.  Pairs are made of texts that
share such a shingle in a cell of sizes that both allow, and dropped where the places of
the shingle leave too few common ones behind it.  These bounds are exact, so no pair that
shares a bucket is left out, and a run takes the same few steps however many texts a
bucket holds.

Defined results: null text counts as empty; a word is a run of ASCII letters and digits
or non-ASCII characters, in lower case; a text of fewer than ``WORDS`` words is one
shingle; texts without a word only match exact copies; a class is named by its least
id (null if all are null); links are between different texts, so exact copies have the links of their text; repeated ids or rows are documents of their own; an empty
table gives no row; other columns do not take part; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import counted, lean, sized, stored
from quillgraph.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Pairs that a task verifies, about.
PAIRS = 4_000
#: So many texts (16 bytes each, and their ids) may be named to every executor at most.
BROADCAST_TEXTS = 400_000
#: Ratio of the sizes that share a cell.
CELL = 1.02
#: Bytes of text hashed at a time.
STEP = 400_000

_U = np.uint64
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted different shingle hashes of each text, and how often each occurs."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    if not len(first):
        return [none] * len(texts)
    length = last - first
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(length.max()), _BASE))])
    place = np.arange(len(data)) - np.repeat(first, length)[np.maximum(np.cumsum(inside) - 1, 0)]
    value = (data.astype(np.uint64) + _U(1)) * power[np.where(inside, place, 0)]
    value[~inside] = 0
    word = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    bounds = np.searchsorted(first, starts)
    out = []
    n = np.diff(bounds)
    many = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    stop = np.repeat(bounds[1:], many)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        total = mix(total + np.where(at + k < stop, word[np.minimum(at + k, len(word) - 1)], _U(0)) + _U(k + 1))
    ends = np.cumsum(many)
    for k in range(len(texts)):
        out.append(np.unique(total[ends[k] - many[k] : ends[k]], return_counts=True) if many[k] else none)
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: in each of ``size`` registers the shingle that arrives first; [texts, size]."""
    count = np.array([len(e) for e, _ in sets])
    signature = np.zeros((len(sets), size), np.uint64)
    for k in np.flatnonzero(count == 1):
        signature[k] = sets[k][0][0]
    several = np.flatnonzero(count > 1)
    if not len(several):
        return signature
    element = np.concatenate([sets[k][0] for k in several])
    weight = 1 + np.log(np.concatenate([sets[k][1] for k in several]).astype(float))
    doc = np.repeat(np.arange(len(several)), count[several])
    when = np.zeros(len(element))
    register = np.full(len(several) * size, np.inf)
    winner = np.zeros(len(several) * size, np.uint64)
    step = 0
    while len(element):
        step += 1
        bits = mix(element + _U(step * int(_BASE) % 2**64))
        when = when - np.log(((bits >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight
        to = doc * size + (mix(bits ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(size)).astype(np.int64)
        np.minimum.at(register, to, when)
        won = when == register[to]
        winner[to[won]] = element[won]
        latest = register.reshape(-1, size).max(axis=1)
        on = when < latest[doc]
        element, weight, doc, when = element[on], weight[on], doc[on], when[on]
    signature[several] = winner.reshape(-1, size)
    return signature


def bands(signature: np.ndarray, many: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band; [texts, many]."""
    cut = signature.reshape(len(signature), many, rows)
    out = np.tile(np.arange(1, many + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        out = mix(out * _BASE + cut[:, :, k])
    return out.view(np.int64)


def _slices(texts: list[str], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``step`` characters together."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= step or k - at >= 400:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketch(docs: DataFrame, key: str, text: str = "text", many: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, n, bands): of each document its text's key, number of different shingles and band hashes."""
    source = docs.select(F.col(key).alias("id"), text_key(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(1), batch.column(2).to_pylist()
            for a, b in _slices(texts):
                own = list(dict.fromkeys(texts[a:b]))  # copies are hashed once
                at = {t: k for k, t in enumerate(own)}
                sets = shingles(own)
                once = [(e, np.ones_like(c)) for e, c in sets]
                hashed = bands(signatures(once, many * rows), many, rows)
                lists = [hashed[k].tolist() if len(sets[k][0]) else [] for k in range(len(own))]
                pick = [at[t] for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), nodes.slice(a, b - a), pa.array([len(sets[k][0]) for k in pick], pa.int32()), pa.array([lists[k] for k in pick], pa.list_(pa.int64()))],
                    names=["id", "node", "n", "bands"],
                )

    return source.mapInArrow(lean(run), f"id {kind}, node binary, n int, bands array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text) rows: sorted different hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                sets = [e.view(np.int64) for e, _ in shingles(texts[a:b])]
                flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, flat)], names=["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles array<bigint>")


def verify(pairs: DataFrame, rows: int, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of about ``rows`` pairs (u, v, nu, nv, ...) whose shingles have at least the Jaccard similarity ``threshold``.

    ``sets`` may lack shingles that cannot be common to a pair; nu and nv count them all.
    """
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    joined = sized(sized(pairs.join(one, "u"), rows, PAIRS).join(two, "v"), rows, PAIRS)
    joined = joined.withColumn("common", F.size(F.array_intersect("a", "b")))
    return joined.where(enough(F.col("common"), F.col("nu"), F.col("nv"), threshold)).select(*pairs.columns)


def enough(common: Column, nu: Column, nv: Column, threshold: float) -> Column:
    """Whether sets of nu and nv shingles with so many common ones reach the threshold."""
    return common >= threshold * (nu + nv - common)


def led_members(members: DataFrame, rows: int) -> DataFrame:
    """Members (bucket, node, n, k) of buckets of k texts, each with its bucket's leader (lead, lead_n); leaders leave."""
    weight = members.groupBy("node").agg(F.sum("k").alias("w"))
    ranked = sized(members.join(weight, "node"), rows)
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("w", "node", "n")).alias("x"))
    led = members.join(lead.select("bucket", F.col("x.node").alias("lead"), F.col("x.n").alias("lead_n")), "bucket")
    return sized(led.where(F.col("node") != F.col("lead")), rows)


def star_pairs(led: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Pairs (u, v, nu, nv) of texts and leaders whose numbers of shingles allow the threshold."""
    near = led.where(enough(F.least("n", "lead_n"), F.col("n"), F.col("lead_n"), threshold))
    return sized(near.select(F.col("lead").alias("u"), F.col("node").alias("v"), F.col("lead_n").alias("nu"), F.col("n").alias("nv")).distinct(), rows)


def unsettled(led: DataFrame, comps: DataFrame, rows: int) -> DataFrame:
    """Members, with their class c, of buckets that hold several classes besides the leader."""
    named = sized(led.where("k > 2").join(comps, "node", "left"), rows).withColumn("c", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("bucket")
    return sized(named.join(several, "bucket", "left_semi").select("bucket", "node", "n", "c", "lead"), rows)


def common_sets(left: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(node, shingles) without the shingles that only one class of ``left`` has."""
    own = sets.join(sized(left.select("node", "c").distinct(), rows), "node").select("node", "c", F.explode("shingles").alias("x"))
    lone = own.groupBy("x").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 = c1").select("x")
    return own.join(lone, "x", "left_anti").groupBy("node").agg(F.collect_list("x").alias("shingles"))


def rarest(left: DataFrame, kept: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(x, at, node, n, c, s): for each (node, n, c) that can have a link, its rarest kept shingles with their places, as many as any link must touch.

    The best partner has exactly the s shingles that are kept.
    """
    nodes = sized(left.select("node", "n", "c").distinct(), rows)
    own = sized(nodes.join(kept.select("node", "shingles", F.size("shingles").alias("s")), "node"), rows, PAIRS).where(F.col("s") >= threshold * F.col("n"))
    each = own.select("node", F.explode("shingles").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("df"))
    order = each.join(often, "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("order"))
    ranked = order.join(own.select("node", "n", "c", "s"), "node")
    many = (F.col("s") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    return ranked.select(F.posexplode(F.slice("order", F.lit(1), many)).alias("at", "o"), "node", "n", "c", "s").select(F.col("o.x").alias("x"), "at", "node", "n", "c", "s")


def cell(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(CELL))).cast("int")


def cross_pairs(front: DataFrame, threshold: float) -> DataFrame:
    """Pairs across classes, once each, that share one of their rarest shingles and whose counts and places allow the threshold; u is the larger."""
    share = threshold / (1 + threshold)
    # the most shingles that a partner of a text can have, and of that the larger text's partner at most as many as itself
    reach = F.col("s") / share - F.col("n")
    asks = front.where(F.least("n", reach) >= threshold * F.col("n")).withColumn("cell", F.explode(F.sequence(cell(threshold * F.col("n") - 1e-6), cell(F.least("n", reach) + 1e-6))))
    one = asks.select("x", "cell", F.col("node").alias("u"), *[F.col(c).alias(f"{c}u") for c in ("at", "n", "c", "s")])
    two = front.select("x", cell(F.col("n")).alias("cell"), F.col("node").alias("v"), *[F.col(c).alias(f"{c}v") for c in ("at", "n", "c", "s")])
    need = share * (F.col("nu") + F.col("nv")) - 1e-9
    first = (F.col("nu") > F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    # behind the first shingle that they share, no more are common than either has left
    rest = F.least(F.col("su") - F.col("atu"), F.col("sv") - F.col("atv"))
    met = one.join(two, ["x", "cell"]).where(first & (F.col("cu") != F.col("cv")) & (rest >= need))
    return met.select("u", "v", "nu", "nv", "cu", "cv").distinct()


def link_copies(texts: Callable[[DataFrame, int], DataFrame], nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[list[DataFrame], list[DataFrame]]:
    """(node, component) tables: a text's class is what the first gives for its node, what the second gives for that, and so on; and the links (u, v) that made them.

    ``nodes`` has (node, n, bands), ``texts`` gives (node, text) for a set of nodes and its
    size; a node that a table lacks stays as it is.
    """
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members, rows = counted(spread.join(full, "bucket"), "buckets")
    if not rows:
        return [], []
    wanted, size = counted(sized(members.select("node").distinct(), rows), "wanted")
    sets, got = counted(shingle_sets(texts(wanted, size)), "shingles")
    if got > size:  # the same row twice
        sets = stored(sets.dropDuplicates(["node"]), "shingles")
    led = stored(led_members(members, rows), "led")
    pairs, many = counted(star_pairs(led, rows, threshold), "pairs")
    links, found = counted(verify(pairs, many, sets, threshold), "links")
    out, all_ = ([components(links.select("u", "v"), found)], [links.select("u", "v")]) if found else ([], [])
    comps = out[0] if found else links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    left, rows = counted(unsettled(led, comps, rows), "left")
    if not rows:
        return out, all_
    kept = stored(common_sets(left, sets, rows), "kept")
    front, rows = counted(rarest(left, kept, rows, threshold), "front")
    if not rows:
        return out, all_
    pairs, many = counted(cross_pairs(front, threshold), "pairs")
    if not many:
        return out, all_
    links, found = counted(verify(pairs, many, kept, threshold), "links")
    if found:
        out.append(components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), found))
        all_.append(links.select("u", "v"))
    return out, all_


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, many: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, node, class_id, kept, n_links) a row: the text's key, the class's least id, whether this document is the one of its class to keep, and how many links of its text were verified."""
    # null ids come last, so a class is named by a real id where it has one
    grouped = sketch(docs, key, text, many, rows).groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(grouped.select(F.col("node").alias("text_key"), "id", "n", "bands", F.monotonically_increasing_id().alias("node")), "texts")

    def texts_of(wanted: DataFrame, size: int) -> DataFrame:
        own = nodes.select("node", "text_key", "id").join(wanted, "node", "left_semi")
        own = F.broadcast(own) if size <= BROADCAST_TEXTS else own
        source = docs.select(F.col(key).alias("__id"), text_key(text).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return source.join(own, (F.col("__key") == F.col("text_key")) & F.col("__id").eqNullSafe(F.col("id"))).select("node", "text")

    steps, links = link_copies(texts_of, nodes.select("node", "n", "bands"), threshold)
    named = nodes.select("text_key", "id", F.col("node").alias("c"), F.lit(0).cast("long").alias("n_links"))
    if links:
        ends = [found.select(F.explode(F.array("u", "v")).alias("node")) for found in links]
        many = reduce(DataFrame.unionByName, ends).groupBy("node").agg(F.count("*").alias("k"))
        named = named.join(many, F.col("c") == F.col("node"), "left").select("text_key", "id", "c", F.coalesce("k", "n_links").alias("n_links"))
    for step in steps:
        named = named.join(step, F.col("c") == F.col("node"), "left").select("text_key", "id", F.coalesce("component", "c").alias("c"), "n_links")
    best = named.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best"))
    named = named.join(best, "c").select("text_key", F.col("best.id").alias("class_id"), F.col("best.text_key").alias("keeper"), "n_links")
    out = docs.select(F.col(key).alias("id"), text_key(text).alias("text_key")).join(named, "text_key")
    kept = (F.col("text_key") == F.col("keeper")) & F.col("id").eqNullSafe(F.col("class_id"))
    return out.select(F.col("id").alias(key), F.col("text_key").alias("node"), "class_id", kept.alias("kept"), "n_links")
