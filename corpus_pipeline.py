"""From raw documents to packed training sequences, as stages that are each a Spark job.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of ``documents``; each drops whole documents and changes none.

Defined results: null text counts as empty and has no language, so the first stage
drops it; documents without labels teach the quality stage nothing; without any label
it keeps all; texts of any length are judged and packed whole; rows of the same id and
text are one document, of which the near-duplicate stage keeps one row, and of texts that
tie the one of least id stays (null last); columns besides these five pass through the
filters unchanged, whatever their names; an empty table goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import langid, minhash, packing, quality
from quillgraph.llm.common import observed, relieved, ship, stored, table
from quillgraph.llm.queries import END_ID, GOOD_AT, WORD_BPE, vocabulary

#: A text of at least so many bytes that costs more bits a byte under its best language is in none of them: clean
#: texts of that length cost up to 4, letters or digits at random 6 (shorter ones may be half keys and numbers).
FOREIGN_BYTES, FOREIGN_BITS = 200, 5.0


def where(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], keep: Column) -> DataFrame:
    """Rows of ``docs`` that ``keep`` holds for, of the columns that ``judge`` adds; other columns are set aside under names of their own."""
    private = docs.toDF(*[f"__in{k}" for k in range(len(docs.columns))])
    text = private.columns[docs.columns.index("text")]
    return judge(private, text).where(keep).select(*private.columns).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in one of the languages that the table names."""
    ship(spark)
    relieved(spark)
    model = langid.fit(docs)
    known = F.col("lang_pred") != langid.UNDETERMINED
    told = (F.col("bits_per_byte") <= FOREIGN_BITS) | (F.col("n_bytes") < FOREIGN_BYTES)
    return where(docs, lambda rows, text: langid.identify(rows, model, text).withColumn("n_bytes", F.octet_length(text)), known & told)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a quality score of at least 0.3."""
    ship(spark)
    relieved(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return where(docs, lambda rows, text: quality.score(rows, model, text), F.col("score") >= GOOD_AT)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, the one of least id."""
    ship(spark)
    relieved(spark)
    kept = minhash.classes(docs.select("doc_id", "text")).where("kept").groupBy("doc_id", "node").agg(F.count("*").alias("k"))
    own, told = observed(kept.select(F.col("doc_id").alias("__id"), F.col("node").alias("__keep"), "k"), "kept", {"most": F.max("k")})
    rows = docs.toDF(*[f"__in{k}" for k in range(len(docs.columns))])
    key, text = (rows.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = rows.withColumn("__key", minhash.text_key(text))
    out = rows.join(own.drop("k"), (F.col("__key") == F.col("__keep")) & F.col(key).eqNullSafe(F.col("__id")), "left_semi")
    if (told["most"] or 0) > 1:  # copies with the same id are one document
        out = out.dropDuplicates([key, "__key"])
    return out.drop("__key").toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    ship(spark)
    relieved(spark)
    return packing.pack_texts(docs.select("doc_id", "text"), vocabulary(WORD_BPE), END_ID, keep_ids=False)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("packing", packed)]

#: SQL cannot train and apply these models; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
