"""The thin ``opN_<name>`` queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, langid, media, minhash, packing, quality, spotsigs, topk, toxicity, urlfilter, vbmw, warc, whitening
from quillgraph.llm.common import held_out, observed, scratch, ship, table

#: The rules of op5: host, path, action.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


#: Vocabulary files of the installed tokenizers, and the id that ends a packed document.
BYTE_BPE, WORD_BPE, END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 1
#: Documents at or above this score are predicted toxic, or good.
TOXIC_AT, GOOD_AT = 0.5, 0.3


def vocabulary(name: str) -> str:
    """The path of a vocabulary file, the same on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def open_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out(5, 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 0).alias("held_out"))
    model = toxicity.fit(docs, open_labels(spark, sf_dir))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("segments").alias("segments"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 0).alias("held_out"))
    model = quality.fit(docs, open_labels(spark, sf_dir))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"), "gain")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.read_media(media.store_payload(docs))
    feature = F.concat_ws(
        ":",
        F.size("fp_time").cast("string"),
        F.md5(F.to_json(F.struct("fp_time", "fp_code")).cast("binary")),
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fp_time", "fp_code")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("q"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = vocabulary(BYTE_BPE)
    read = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_texts(docs, vocabulary(WORD_BPE), END_ID, keep_ids=False)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(3, 1).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    to = scratch(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"), files=True), to)
    return read_back(spark, to)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return vbmw.ranked(docs, asked, k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("own")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_own")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``; each row tells how many byte gaps were quarantined, which are logged beside the records."""
    read, told = observed(warc.read_archives(spark, path, payloads=False), "records", {"gaps": F.count_if(F.col("error").isNotNull())})
    return read.where(F.col("error").isNull()).select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
        F.lit(told["gaps"]).alias("gaps"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality": op2_quality,
        "op3_media": op3_media,
        "op4_topk": op4_topk,
        "op5_url_filter": op5_url_filter,
        "op6_bpe": op6_bpe,
        "op7_minhash": op7_minhash,
        "op8_packing": op8_packing,
        "op9_langid": op9_langid,
        "op10_warc": op10_warc,
        "op11_ranked": op11_ranked,
        "op12_whitening": op12_whitening,
        "op13_spotsigs": op13_spotsigs,
    }


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    return {
        "op4_topk": """
            WITH parts AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            scored AS (
                SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                       CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
                FROM parts a JOIN parts b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
        """,
        "op11_ranked": r"""
            WITH found AS (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM documents),
            lengths AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
            corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
            uses AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY doc_id, term),
            weights AS (
                SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM uses, corpus GROUP BY term, docs),
            asked AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark),
            scored AS (
                SELECT item_id, u.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
                FROM asked JOIN weights USING (term) JOIN uses u USING (term) JOIN lengths l ON u.doc_id = l.doc_id, corpus
                GROUP BY item_id, u.doc_id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
        """,
        "op5_url_filter": f"""
            WITH rules(rh, rp, action) AS (VALUES {rules}),
            cut AS (
                SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            split AS (
                SELECT page_id,
                       translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            addresses AS (SELECT DISTINCT host, path FROM split),
            fits AS (
                SELECT host, path, rh || rp AS rule, action,
                       row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, action DESC, rh || rp) AS k
                FROM addresses JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
            SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
            FROM split s LEFT JOIN fits f ON s.host = f.host AND s.path = f.path AND f.k = 1
        """,
    }
