"""Document fingerprints: signatures at common words (SpotSigs).

Native: DataFrame functions only.  A text's words are read in order; where a content word
follows an anchor (a common word), the anchor and the chain of the next ``CHAIN`` content
words, further common words skipped, are one signature.  Running text has many anchors
and lists, navigation and boilerplate few, so signatures stand where the prose is.  A
text's signatures are a set of hashes; its fingerprint is their number and the digest of the set.

Sets are partitioned by length: ``length_class`` puts lengths into ranges of ratio
``ratio``, so that sets whose Jaccard similarity reaches the ratio are in the same class or
in neighbouring ones.  ``likeness`` compares only sets whose lengths allow the wanted
similarity, and nothing is counted where they cannot.  ``edited_pairs`` gives each document
its copy with an end taken from the document that follows in descending order, found by a
range partition of ids: only ids, lengths and the ends themselves travel for it, never a
window over texts.

Defined results: null text counts as empty; a word is a run of ASCII letters and digits
or non-ASCII characters, in lower case; a text with words but without a chain after an
anchor takes a chain at every word; a text without words has the empty set; two empty sets are alike
(1.0), an empty and another are not (0.0); repeated words and passages count once; null
ids come last in the order; rows that repeat id and text are one document in the order
and keep a row each; a single document is its own next one; texts are read whole,
however long; an empty table gives no row; other columns do not take part, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import observed, stored

# Common words of English, French, German and Spanish, the anchors.
ANCHORS = [
    "a", "all", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "his", "in", "is", "it", "its", "not", "of", "on", "or", "said", "she", "that", "the", "their", "there", "they", "this", "to", "was", "were", "which", "will", "with", "you",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "se", "sur", "un", "une",
    "als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "como", "con", "del", "el", "es", "las", "los", "lo", "no", "para", "por", "su", "y",
]
#: Content words of a chain.
CHAIN = 3
#: What separates words: ASCII characters that are neither letters nor digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a range of the order, about.
RANGE_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def with_signatures(rows: DataFrame, text: str, name: str, anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """``rows`` with an array<int>, the sorted different signatures of a text."""
    taken = set(rows.columns)
    own, content = (next(c for c in (f"__{name}_{what}{'_' * k}" for k in range(len(taken) + 1)) if c not in taken) for what in ("words", "content"))
    listed = ANCHORS if anchors is None else anchors
    out = rows.withColumn(own, words(F.col(text)))
    # content words with their places among all words
    placed = F.transform(F.col(own), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    out = out.withColumn(content, F.filter(placed, lambda x: ~x["word"].isin(listed)))

    def chained(x: Column, k: Column) -> list[Column]:
        return [x["word"], *[F.get(F.col(content), k + j)["word"] for j in range(1, chain)]]

    # an anchor stands before a content word that does not follow the content word before it directly
    after = lambda x, k: (x["at"] > 0) & F.coalesce(F.get(F.col(content), k - 1)["at"] < x["at"] - 1, F.lit(True))
    at_anchors = F.transform(F.col(content), lambda x, k: F.when(after(x, k), F.hash(F.get(F.col(own), x["at"] - 1), *chained(x, k))))
    everywhere = F.transform(F.col(own), lambda w, k: F.hash(w, *[F.get(F.col(own), k + j) for j in range(1, chain)]))
    found = F.array_sort(F.array_distinct(F.filter(at_anchors, lambda s: s.isNotNull())))
    out = out.withColumn(name, found)
    return out.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array_sort(F.array_distinct(everywhere)))).drop(own, content)


def fingerprint(signatures: Column) -> Column:
    """The number of signatures and the digest of their set."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.md5(F.array_join(F.transform(signatures, lambda s: F.hex(s.cast("bigint"))), ",").cast("binary")))


def length_class(n: Column, ratio: float) -> Column:
    """Ranges of lengths: sets whose similarity reaches ``ratio`` are in the same one or in neighbouring ones; the empty set has its own."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / math.log(1 / ratio) + 1e-9)).otherwise(-2).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of signatures, 0 where it is below ``least``: sets whose lengths rule that out are not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    if least > 0:
        near = F.abs(length_class(F.size(a), least) - length_class(F.size(b), least)) <= 1
        possible = near & (small >= least * large)
    else:
        possible = small > 0
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(large == 0, 1.0).when(a == b, 1.0).when(possible, F.when(exact >= least, exact).otherwise(0.0)).otherwise(0.0)


def following(documents: DataFrame, rows: int) -> DataFrame:
    """(node, id, next, need) of about ``rows`` documents (node, id, n_chars), each once: the one that follows in descending order of id, after the last the first, and how many characters it lends.

    Documents are dealt by ranges; a range's last document is followed by the first of the
    next range that has any, so only one row a range is looked at by a single task.
    """
    order = [F.col("id").desc_nulls_last(), F.col("node").desc()]
    ranges = max(1, -(-rows // RANGE_ROWS), documents.sparkSession.sparkContext.defaultParallelism)
    dealt = stored(documents.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part").orderBy(*order)
    inside = dealt.withColumn("next", F.lead("node").over(w)).withColumn("first", F.row_number().over(w) == 1)
    # one row that names the first document of each range
    turn = inside.where("first").agg(F.sort_array(F.collect_list(F.struct("part", F.col("node").alias("head")))).alias("heads"))
    later = F.filter("heads", lambda h: h["part"] > F.col("part"))
    after = F.coalesce(F.get(later, F.lit(0))["head"], F.get("heads", F.lit(0))["head"])
    named = inside.join(F.broadcast(turn), F.lit(True)).withColumn("next", F.when(F.col("next").isNull(), after).otherwise(F.col("next")))
    return named.select("node", "id", "next", F.floor(F.col("n_chars") / 3).cast("int").alias("need"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """(key, n_chars, text, edited, own, next_own): each document, its edited text, its signatures and the next document's.

    The edited text has the last floor(n_chars / 3) characters replaced by as many of the next document's first ones.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    node = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(whole.cast("binary")))
    rows = docs.select(F.col(key).alias("id"), whole.alias("text"), node.alias("node"))
    ids = rows.select("node", "id", F.length("text").alias("n_chars")).groupBy("node", "id", "n_chars").agg(F.count("*").alias("k"))
    known, told = observed(ids, "ids", {"n": F.count(F.lit(1)), "most": F.max("k")})
    turn = stored(following(known.select("node", "id", "n_chars"), told["n"]), "turn")
    # both sides of the last join read this alone, so that texts are shuffled once
    signed = with_signatures(rows.drop("id"), "text", "own", anchors, chain)
    source = signed
    if (told["most"] or 0) > 1:  # rows that repeat id and text lend once
        source = source.dropDuplicates(["node"])
    lent = source.join(turn.select(F.col("next").alias("node"), F.col("node").alias("to"), "id", "need"), "node")
    lent = lent.select(F.col("to").alias("node"), "id", "need", F.expr("substring(text, 1, need)").alias("end"), F.col("own").alias("next_own"))
    joined = signed.join(lent, "node")
    edited = F.expr("concat(substring(text, 1, length(text) - need), end)")
    return joined.select(F.col("id").alias(key), F.length("text").alias("n_chars"), "text", edited.alias("edited"), "own", "next_own")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """(key, n_chars, edited, own, edited_own, next_own, near_edited, near_next) of each document."""
    pairs = with_signatures(edited_pairs(docs, key, text, anchors, chain), "edited", "edited_own", anchors, chain)
    out = pairs.withColumn("near_edited", likeness(F.col("own"), F.col("edited_own"))).withColumn("near_next", likeness(F.col("own"), F.col("next_own")))
    return out.select(key, "n_chars", "edited", "own", "edited_own", "next_own", "near_edited", "near_next")
