"""The pipeline: each stage on its own input, and the whole."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillgraph.llm.common import stored
from test_topk_minhash import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert after.subtract(before).count() == 0, name


def test_languages_keep_clean_documents(stages):
    _, before, after = stages[0]
    labels = before.sparkSession.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    gone = before.join(after, "doc_id", "left_anti")
    assert gone.count() <= before.count() // 100 and gone.join(labels, "doc_id", "left_semi").count() == 0


def test_languages_drop_what_is_in_none(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    odd = [noise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2000), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300)), noise("ЖЩЫЭЮЯбгджз ", 1500), "12 34 56", ""]
    junk = spark.createDataFrame([(10_000 + k, t, None, "odd", len(t)) for k, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(junk), SF).collect()}
    assert not kept & set(range(10_000, 10_005)) and len(kept) >= 0.99 * docs.count()


def test_filters_leave_columns_with_names_of_results_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    named = docs.withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7), "gain": F.lit(True), "bits_per_byte": F.array(F.lit("x")), "n_bytes": F.lit(None).cast("int"), "__node": F.lit(1), "k": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, SF)
        assert out.schema.simpleString() == named.schema.simpleString()
        assert {(r.score, r.lang_pred, r.gain, r.n_bytes, r["__node"], r.k) for r in out.collect()} == {("mine", 7, True, None, 1, 2)}


def test_quality_drops_bad_documents(spark, stages):
    _, before, after = stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in after.collect()}
    rows = before.join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.doc_id in kept for r in good) / len(good) > 0.97
    assert sum(r.doc_id in kept for r in bad) / len(bad) < 0.4


def test_one_document_of_each_class_stays(stages):
    _, before, after = stages[2]
    classes = brute_classes({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_packing_holds_what_is_left(stages):
    _, before, after = stages[3]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[3][2].columns and out.count() == stages[3][2].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_that_stages_drop_or_keep(spark):
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(3).collect()]
    rows = [(1, base[0], "en", "s", 1), (1, base[0], "en", "s", 1), (2, base[1], "en", None, None), (None, base[2], None, "s", 1), (4, None, "en", "s", 1), (5, "12 34", "en", "s", 1)]
    df = spark.createDataFrame(rows, cols)
    assert {r.doc_id for r in corpus_pipeline.language(spark, df, SF).collect()} == {1, 2, None}
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.distinct(spark, df, SF).collect()) == [0, 1, 2, 4, 5]
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
