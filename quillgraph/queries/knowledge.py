"""Search, vectors, extraction, linking, incremental plans, evidence and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import views as v
from quillgraph.functions import text as tx
from quillgraph.functions.vectors import cosine
from quillgraph.operators import aggregates, evidence, extract, fts, incremental, joins, link, sessions, vector, windows
from quillgraph.plans import answer
from quillgraph.registry import query
from quillgraph.streaming import telemetry as streams

TERMS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
TITLED_SQL = "titled AS (SELECT chunk_id, chunks.file_id, rel_path AS title, content FROM chunks JOIN files USING (file_id))"
SEARCH_SQL = v.FILES_SQL + "," + TITLED_SQL + """,
words AS (SELECT chunk_id, TERMS_T || TERMS_C AS w FROM titled),
tf AS (SELECT chunk_id, len(w) AS length, t AS term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS t FROM words) GROUP BY chunk_id, len(w), t),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM words),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id AS question_id, unnest(TERMS_Q) AS term FROM benchmark),
needed AS (SELECT question_id, count(*) AS needed FROM asked GROUP BY question_id),
scored AS (
    SELECT question_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score, count(*) AS found
    FROM tf JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY question_id, chunk_id),
ranked AS (
    SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored JOIN needed USING (question_id) WHERE found = needed)""".replace(
    "TERMS_C", TERMS_SQL.format("content")
).replace("TERMS_T", TERMS_SQL.format("title")).replace("TERMS_Q", TERMS_SQL.format("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item, with all its terms."""
    return v.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def titled(spark: SparkSession, d: str) -> DataFrame:
    return v.titled_chunks(spark, d)


#: Indexes of this application by folder of the tables: written by the first query that searches, read by all.
INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, d: str) -> fts.TextIndex:
    """The stored index of titles and contents of the chunks of ``d``, whose tables do not change."""
    at = (spark.sparkContext.applicationId, d)
    if at not in INDEXES:
        INDEXES[at] = fts.write_index(titled(spark, d), title="title").path
    return fts.open_index(spark, INDEXES[at])


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL) + "SELECT term, df FROM df")
def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks hold each term, from the stored index, which this query writes if none has yet."""
    return text_index(spark, d).terms.select("term", "df")


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL) + "SELECT question_id, chunk_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return fts.ask(text_index(spark, d), questions(spark, d), 10)


FORMS_SQL = """
w AS (SELECT item_id, TERMS_Q AS w FROM benchmark),
forms AS (SELECT item_id AS q, item_id % 7 AS form, coalesce(w[1], 'x') AS a, coalesce(w[2], 'x') AS b, coalesce(w[3], 'x') AS c FROM w),
spots AS (SELECT chunk_id, length, unnest(w) AS term, unnest(range(0, len(w))) AS i, heads FROM (SELECT chunk_id, TERMS_T || TERMS_C AS w, len(TERMS_T || TERMS_C) AS length, len(TERMS_T) AS heads FROM titled)),
tokens AS (SELECT chunk_id, length, term, i - heads - CASE WHEN i < heads THEN 1 ELSE 0 END AS spot FROM spots),
leaves AS (
    SELECT q, 0 AS leaf, CASE form WHEN 1 THEN substr(a, 1, 3) WHEN 4 THEN ['en', 'fr', 'de', 'es'][CAST(q % 4 + 1 AS INTEGER)] ELSE a END AS x, CASE form WHEN 0 THEN b END AS y, form = 1 AS prefix, CASE form WHEN 4 THEN 'title' WHEN 5 THEN 'content' END AS col FROM forms WHERE form < 6
    UNION ALL SELECT q, 1, CASE form WHEN 4 THEN a ELSE b END, NULL, false, CASE form WHEN 5 THEN 'content' END FROM forms WHERE form IN (2, 3, 4, 5) UNION ALL SELECT q, 2, c, NULL, false, NULL FROM forms WHERE form IN (2, 5)),
inst AS (
    SELECT q, leaf, t.chunk_id, t.length, t.spot FROM leaves JOIN tokens t ON NOT prefix AND t.term = x LEFT JOIN tokens u ON y IS NOT NULL AND u.chunk_id = t.chunk_id AND u.spot = t.spot + 1 AND u.term = y
    WHERE (y IS NULL OR u.term IS NOT NULL) AND (col IS NULL OR (col = 'title') = (t.spot < 0))
    UNION ALL SELECT q, leaf, chunk_id, length, spot FROM leaves JOIN tokens ON prefix AND starts_with(term, x)),
counts AS (SELECT q, leaf, chunk_id, length, count(*) AS tf FROM inst GROUP BY ALL),
often AS (SELECT q, leaf, count(*) AS df FROM counts GROUP BY ALL),
near AS (SELECT DISTINCT i.q, i.chunk_id FROM inst i JOIN inst j ON i.q = j.q AND i.chunk_id = j.chunk_id AND i.leaf = 0 AND j.leaf = 1 AND (i.spot < 0) = (j.spot < 0) AND abs(i.spot - j.spot) - 1 <= 4 WHERE i.q % 7 = 3),
held AS (SELECT q, form, chunk_id, list(leaf) AS held FROM counts JOIN forms USING (q) GROUP BY ALL),
good AS (SELECT * FROM held WHERE CASE form WHEN 2 THEN list_contains(held, 0) OR (list_contains(held, 1) AND NOT list_contains(held, 2)) WHEN 3 THEN EXISTS (SELECT 1 FROM near WHERE near.q = held.q AND near.chunk_id = held.chunk_id)
    WHEN 4 THEN list_contains(held, 0) AND list_contains(held, 1) WHEN 5 THEN (list_contains(held, 0) OR list_contains(held, 1)) AND list_contains(held, 2) ELSE true END),
size AS (SELECT count(*) AS n, avg(length) AS avg_length FROM (SELECT DISTINCT chunk_id, len(TERMS_T || TERMS_C) AS length FROM titled)),
scores AS (SELECT q AS question_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
    FROM good JOIN counts USING (q, chunk_id) JOIN often USING (q, leaf), size GROUP BY q, chunk_id)
SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scores) WHERE rank <= 10""".replace(
    "TERMS_C", TERMS_SQL.format("content")
).replace("TERMS_T", TERMS_SQL.format("title")).replace("TERMS_Q", TERMS_SQL.format("text"))


@query(v.with_(v.CHUNKS_SQL, v.FILES_SQL, TITLED_SQL, FORMS_SQL))
def fts_syntax(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each benchmark item as a phrase, a prefix, OR and NOT, NEAR, a column, brackets in a column, and a question that is refused."""
    words = fts.terms(F.col("text"))
    a, b, c = (F.coalesce(F.get(words, F.lit(k)), F.lit("x")) for k in range(3))
    form, lang = F.col("item_id") % 7, F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    text = (
        F.when(form == 0, F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')))
        .when(form == 1, F.concat(F.substring(a, 1, 3), F.lit("*")))
        .when(form == 2, F.concat(a, F.lit(" OR "), b, F.lit(" NOT "), c))
        .when(form == 3, F.concat(F.lit("NEAR("), a, F.lit(" "), b, F.lit(", 4)")))
        .when(form == 4, F.concat(F.lit("title : "), lang, F.lit(" AND "), a))
        .when(form == 5, F.concat(F.lit("content: ("), a, F.lit(" OR "), b, F.lit(") "), c))
        .otherwise(F.concat(a, F.lit(" AND")))
    )
    asked = v.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), text.alias("question"))
    return fts.match(text_index(spark, d), asked, 10)


def question_vector(spark: SparkSession, d: str) -> list[float]:
    row = v.table(spark, d, "embeddings").where("vec_id = 3").select("embedding").first()
    return [float(x) for x in row[0]]


COSINE = "round(list_cosine_similarity(CAST(vector AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6)"


@query(v.with_(v.EMBEDDINGS_SQL) + f"SELECT chunk_id, {COSINE} AS score FROM vecs WHERE {COSINE} >= -0.2 ORDER BY score DESC, chunk_id LIMIT 25")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.search(v.embeddings(spark, d), question_vector(spark, d), 64, 25, -0.2)


@query(v.with_(v.EMBEDDINGS_SQL) + f"SELECT chunk_id, score FROM (SELECT chunk_id, {COSINE} AS score FROM vecs ORDER BY score DESC, chunk_id LIMIT 25) WHERE score >= 0.2")
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.indexed_scan(v.embeddings(spark, d), question_vector(spark, d), 25, 0.2)


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + f"""
SELECT chunk_id, rel_path, score, CASE WHEN score > 0.85 THEN 'grounded' ELSE 'partial' END AS confidence FROM (
    SELECT chunk_id, rel_path, {COSINE} AS score FROM vecs JOIN files ON chunk_id = file_id AND vecs.content_hash = files.content_hash WHERE deleted_at_unix_ms IS NULL AND model = 'm1' ORDER BY score DESC, chunk_id LIMIT 15)""")
def semantic_join(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    chunks = files.select(F.col("file_id").alias("chunk_id"), "file_id", "content_hash")
    own = joins.fresh_embeddings(v.embeddings(spark, d), chunks, files, "m1", 64)
    best = vector.exact_scan(own, question_vector(spark, d), 15)
    return vector.confidence(best.join(own.select("chunk_id", "rel_path"), "chunk_id")).select("chunk_id", "rel_path", "score", "confidence")


@query("""
WITH q AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT question_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q WHERE vec_id <> question_id)
SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_batch(spark: SparkSession, d: str) -> DataFrame:
    vectors = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id")
    return vector.batch_scan(vectors, asked, 10)


@query()
def bucketed_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: compared with the exact scan in tests."""
    vectors = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id")
    return vector.bucketed_search(vectors, asked, 64, 10, tables=8, planes=10, probes=100)


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + "SELECT file_id AS chunk_id FROM files WHERE NOT EXISTS (SELECT 1 FROM vecs WHERE chunk_id = file_id AND vecs.content_hash = files.content_hash AND model = 'm1' AND dimensions = 64)")
def chunks_to_embed(spark: SparkSession, d: str) -> DataFrame:
    chunks = v.files(spark, d).select(F.col("file_id").alias("chunk_id"), "content_hash")
    return vector.missing(chunks, v.embeddings(spark, d), "m1", 64).select("chunk_id")


@query()
def seeded_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Of whole texts; a test makes the same vectors by hand."""
    made = vector.embed(v.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content")), "seeded", 8)
    return made.select(F.col("chunk_id").alias("doc_id"), "model", "content_hash", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@query(v.with_(v.CHUNKS_SQL) + "SELECT chunk_id, line_start, line_end, sha256(content) AS content_hash FROM chunks")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return v.chunks(spark, d).select("chunk_id", "line_start", "line_end", F.sha2("content", 256).alias("content_hash"))


@query(v.with_(v.CHUNKS_SQL) + "SELECT sha256(content) AS content_hash, min(chunk_id) AS chunk_id, count(*) AS copies FROM chunks GROUP BY 1")
def chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return extract.deduped(v.chunks(spark, d).withColumn("content_hash", F.sha2("content", 256)))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS by_chars, CAST(greatest(1, octet_length(encode(text)) // 4) AS INTEGER) AS by_bytes,
CAST(greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS INTEGER) AS by_words FROM documents""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return v.table(spark, d, "documents").select("doc_id", tx.tokens_by_chars(t).alias("by_chars"), tx.tokens_by_bytes(t).alias("by_bytes"), tx.tokens_by_words(t).alias("by_words"))


@query(v.with_(v.LINKS_SQL) + r"""
SELECT page_id, seq, CASE WHEN trim(href) = '' THEN 'empty' WHEN regexp_matches(href, '[`$]') THEN 'dynamic' WHEN regexp_matches(href, '^\.\.?(/|$)') THEN 'relative' WHEN starts_with(href, '/') THEN 'absolute' ELSE 'package' END AS kind FROM links""")
def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    return v.links(spark, d).select("page_id", "seq", link.specifier_kind(F.col("href")).alias("kind"))


@query(v.with_(v.FILES_SQL) + """
, asked AS (SELECT f.file_id, f.rel_path, f.root_id, '../' || split_part(g.rel_path, '/', 2) || '/' || regexp_replace(split_part(g.rel_path, '/', 3), '\\.(ts|js)$', '') AS specifier,
    split_part(f.rel_path, '/', 1) || '/' || split_part(g.rel_path, '/', 2) || '/' || regexp_replace(split_part(g.rel_path, '/', 3), '\\.(ts|js)$', '') AS wanted
    FROM files f JOIN files g ON g.file_id = f.file_id + 20),
hit AS (SELECT a.file_id, a.specifier, min(CASE WHEN h.rel_path = wanted THEN 0 WHEN h.rel_path = wanted || '.ts' THEN 1 WHEN h.rel_path = wanted || '.js' THEN 3 END) AS o
    FROM asked a JOIN files h ON h.rel_path IN (wanted, wanted || '.ts', wanted || '.js') GROUP BY a.file_id, a.specifier)
SELECT a.file_id, a.specifier, CASE WHEN o IS NULL THEN 'missing' ELSE 'resolved' END AS status, h.file_id AS target_file_id,
    CASE WHEN o IS NULL THEN 0.0 WHEN h.root_id <> a.root_id THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence
FROM asked a LEFT JOIN hit ON a.file_id = hit.file_id AND a.specifier = hit.specifier LEFT JOIN files h ON h.rel_path = wanted || CASE o WHEN 0 THEN '' WHEN 1 THEN '.ts' WHEN 3 THEN '.js' END""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d).select("file_id", "rel_path", "root_id")
    other = F.split("other", "/")
    ahead = files.select((F.col("file_id") - 20).alias("file_id"), F.col("rel_path").alias("other"))
    asked = files.join(ahead, "file_id").select("file_id", "rel_path", "root_id", F.concat_ws("/", F.lit(".."), other[1], F.regexp_replace(other[2], r"\.(ts|js)$", "")).alias("specifier"))
    return link.resolve_imports(asked, files).select("file_id", "specifier", "status", "target_file_id", F.col("confidence").cast("double").alias("confidence"))


#: Specifiers of aliases: each source by its name, a longer pattern for one language, and files that two roots have under one path.
ALIASED_SQL = """
twice AS (SELECT file_id, rel_path, root_id FROM files UNION ALL SELECT file_id + 1000000, rel_path, 1 - root_id FROM files WHERE file_id % 7 = 0),
asked AS (SELECT f.file_id, f.root_id, CASE WHEN f.file_id % 11 = 0 THEN 'npm-' || f.file_id ELSE '@' || regexp_replace(g.rel_path, '\\.(ts|js)$', '') END AS specifier,
    CASE WHEN f.file_id % 11 <> 0 AND NOT contains(g.rel_path, '/de/') THEN regexp_replace(g.rel_path, '\\.(ts|js)$', '') END AS wanted FROM files f JOIN files g ON g.file_id = f.file_id + 20),
hit AS (SELECT a.file_id, min(CASE WHEN h.rel_path = wanted THEN 0 WHEN h.rel_path = wanted || '.ts' THEN 1 ELSE 3 END) AS o FROM asked a JOIN twice h ON h.rel_path IN (wanted, wanted || '.ts', wanted || '.js') GROUP BY a.file_id),
ends AS (SELECT a.file_id, count(h.file_id) AS n, min(h.file_id) AS target, min(h.root_id) AS target_root FROM asked a JOIN hit USING (file_id) JOIN twice h ON h.rel_path = wanted || CASE o WHEN 0 THEN '' WHEN 1 THEN '.ts' ELSE '.js' END GROUP BY a.file_id)"""


@query(v.with_(v.FILES_SQL, ALIASED_SQL) + """
SELECT file_id, specifier, CASE WHEN starts_with(specifier, 'npm-') THEN 'package' ELSE 'alias' END AS kind, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'resolved' WHEN starts_with(specifier, 'npm-') THEN 'external' ELSE 'missing' END AS status,
    CASE WHEN n = 1 THEN target END AS target_file_id, CAST(CASE WHEN n > 1 THEN 0.4 WHEN n = 1 THEN CASE WHEN target_root <> root_id THEN 0.9 ELSE 1.0 END ELSE 0 END AS DOUBLE) AS confidence
FROM asked LEFT JOIN ends USING (file_id)""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d).select("file_id", "rel_path", "root_id")
    twice = files.unionByName(files.where("file_id % 7 = 0").select((F.col("file_id") + 1_000_000).alias("file_id"), "rel_path", (1 - F.col("root_id")).alias("root_id")))
    ahead = files.select((F.col("file_id") - 20).alias("file_id"), F.regexp_replace("rel_path", r"\.(ts|js)$", "").alias("other"))
    specifier = F.when(F.col("file_id") % 11 == 0, F.concat(F.lit("npm-"), "file_id")).otherwise(F.concat(F.lit("@"), "other"))
    asked = files.join(ahead, "file_id").select("file_id", "rel_path", "root_id", specifier.alias("specifier"))
    source, lang = (F.split_part("rel_path", F.lit("/"), F.lit(k)) for k in (1, 2))
    whole = files.select(F.concat(F.lit("@"), source, F.lit("/*")).alias("pattern"), F.concat(source, F.lit("/*")).alias("target")).distinct()
    # the longer pattern wins, and leads nowhere
    away = files.where(lang == "de").select(F.concat(F.lit("@"), source, F.lit("/de/*")).alias("pattern"), F.lit("gone/*").alias("target")).distinct()
    out = link.resolve_imports(asked, twice, whole.unionByName(away))
    return out.select("file_id", "specifier", "kind", "status", "target_file_id", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT p_partkey AS file_id, split_part(p_brand, '#', 1) AS name, 'packages/' || split_part(p_brand, '#', 1) || '/' || CASE WHEN p_size % 2 = 0 THEN 'index' ELSE replace(p_type, ' ', '/') END AS path FROM part WHERE p_partkey % 3 = 0")
def workspace_packages(spark: SparkSession, d: str) -> DataFrame:
    """Imports of packages by name, with or without a path inside, plain and scoped."""
    part = v.table(spark, d, "part")
    brand = F.split_part("p_brand", F.lit("#"), F.lit(1))
    packages = part.select(brand.alias("name"), F.concat(F.lit("packages/"), brand).alias("root_path")).distinct()
    inner = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("/"), F.regexp_replace("p_type", " ", "/")))
    known, foreign = F.concat(brand, inner), F.concat(F.lit("@else/where"), inner)
    imports = part.select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_partkey") % 3 == 0, known).otherwise(foreign).alias("specifier"))
    return link.resolve_packages(imports, packages).select("file_id", "name", "path")


LINKED_SQL = """
, asked AS (SELECT f.file_id, f.root_id, g.file_id AS target, (['red', 'ns', 'blue'])[f.file_id % 3 + 1] AS loc, (['red', '*', 'default'])[f.file_id % 3 + 1] AS imported, f.file_id % 5 = 0 AS re, CAST(f.file_id % 50 AS INTEGER) AS line
    FROM files f LEFT JOIN files g ON g.file_id = f.file_id + 20),
exps AS (SELECT file_id, name, count(*) AS n, min(symbol_id) AS s FROM symbols WHERE exported GROUP BY file_id, name),
uses AS (SELECT CASE WHEN l_linenumber < 4 THEN 'calls' ELSE 'references' END AS kind, l_orderkey * 10 + l_linenumber AS use_id, l_orderkey % docs AS file_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS caller_id,
    (['red', 'blue', 'green', 'nothing'])[l_partkey % 4 + 1] AS name, (['red', 'blue', 'ns.green', 'a.b.nothing'])[l_partkey % 4 + 1] AS qualified, CAST(l_quantity AS INTEGER) AS line FROM lineitem, sizes),
cands AS (SELECT DISTINCT file_id, name, qualified, symbol_id FROM (
    SELECT u.file_id, u.name, u.qualified, s.symbol_id FROM uses u JOIN asked b ON b.file_id = u.file_id AND target IS NOT NULL AND loc = u.name AND imported <> '*' JOIN symbols s ON s.file_id = target AND s.exported AND s.name IN (CASE imported WHEN 'default' THEN loc ELSE imported END, CASE imported WHEN 'default' THEN 'default' END)
    UNION ALL SELECT u.file_id, u.name, u.qualified, s.symbol_id FROM uses u JOIN asked b ON b.file_id = u.file_id AND target IS NOT NULL AND imported = '*' AND u.qualified = 'ns.green' JOIN symbols s ON s.file_id = target AND s.exported AND s.name = 'green')),
loc AS (SELECT name, file_id, count(*) AS n1, min(symbol_id) AS s1 FROM symbols GROUP BY name, file_id),
near AS (SELECT file_id, name, qualified, count(*) AS n2, min(symbol_id) AS s2 FROM cands GROUP BY file_id, name, qualified),
ws AS (SELECT name, count(*) AS n3, min(symbol_id) AS s3 FROM symbols GROUP BY name),
told AS (SELECT u.*, CASE WHEN n1 = 1 THEN s1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN s2 WHEN n2 > 1 THEN NULL WHEN n3 = 1 THEN s3 END AS sym,
    CASE WHEN n1 = 1 THEN 'local' WHEN n1 > 1 THEN 'local_ambiguous' WHEN n2 = 1 THEN 'imported' WHEN n2 > 1 THEN 'imported_ambiguous' WHEN n3 = 1 THEN 'workspace' WHEN n3 > 1 THEN 'workspace_ambiguous' ELSE 'missing' END AS reason
    FROM uses u LEFT JOIN loc ON u.file_id = loc.file_id AND u.name = loc.name LEFT JOIN near ON u.file_id = near.file_id AND u.name = near.name AND u.qualified = near.qualified LEFT JOIN ws ON u.name = ws.name)
SELECT CASE WHEN re THEN 're_exports' ELSE 'imports' END AS kind, 'file' AS from_kind, a.file_id AS from_id, 'file' AS to_kind, coalesce(target, a.file_id) AS to_id, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution,
    CASE WHEN target IS NULL THEN 'best_effort' ELSE 'direct' END AS confidence, line, CASE WHEN target IS NULL THEN 'missing' ELSE 'resolved_path_matched_indexed_file' END AS reason, CASE WHEN n = 1 THEN s END AS symbol_id
FROM asked a LEFT JOIN exps ON exps.file_id = target AND exps.name = imported
UNION ALL SELECT kind, CASE WHEN caller_id IS NULL THEN 'file' ELSE 'symbol' END, coalesce(caller_id, file_id), CASE WHEN sym IS NOT NULL OR caller_id IS NOT NULL THEN 'symbol' ELSE 'file' END, coalesce(sym, caller_id, file_id),
    CASE WHEN sym IS NULL THEN 'unresolved' ELSE 'resolved' END, CASE WHEN sym IS NULL THEN 'best_effort' ELSE 'direct' END, line, reason, NULL FROM told"""


def workspace(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Files, symbols, imports (each file imports the file 20 ids on, by its whole path), calls and references (line items)."""
    files = v.files(spark, d).select("file_id", "rel_path", "root_id")
    k = F.col("file_id") % 3
    ahead = files.select((F.col("file_id") - 20).alias("file_id"), F.concat(F.lit("/"), "rel_path").alias("specifier"))
    local, imported = (F.when(k == 0, names[0]).when(k == 1, names[1]).otherwise(names[2]) for names in (("red", "ns", "blue"), ("red", "*", "default")))
    imports = files.join(ahead, "file_id", "left").select("file_id", F.coalesce("specifier", F.lit("./gone")).alias("specifier"), local.alias("local_name"), imported.alias("imported_name"), (F.col("file_id") % 5 == 0).alias("is_reexport"), (F.col("file_id") % 50).cast("int").alias("line"))
    n, pick = F.col("l_linenumber"), (F.col("l_partkey") % 4 + 1).cast("int")
    uses = v.table(spark, d, "lineitem").join(v.sizes(spark, d), F.lit(True)).select(
        n.alias("n"), (F.col("l_orderkey") * 10 + n).alias("use_id"), (F.col("l_orderkey") % F.col("docs")).alias("file_id"), F.when(n % 2 == 0, F.col("l_partkey")).alias("caller_id"),
        F.element_at(F.array(*map(F.lit, ("red", "blue", "green", "nothing"))), pick).alias("name"), F.element_at(F.array(*map(F.lit, ("red", "blue", "ns.green", "a.b.nothing"))), pick).alias("qualified"), F.col("l_quantity").cast("int").alias("line"),
    )
    return files, v.symbols(spark, d), imports, uses.where("n < 4").drop("n"), uses.where("n >= 4").drop("n")


def told_edges(edges: DataFrame) -> DataFrame:
    told = edges.withColumn("p", F.from_json("payload_json", "reason string, resolved_symbol_id bigint"))
    return told.select("kind", "from_kind", "from_id", "to_kind", "to_id", "resolution", "confidence", "line", "p.reason", F.col("p.resolved_symbol_id").alias("symbol_id"))


@query(v.with_(v.FILES_SQL, v.SYMBOLS_SQL, v.EDGES_SQL) + LINKED_SQL)
def linked_workspace(spark: SparkSession, d: str) -> DataFrame:
    return told_edges(link.link_workspace(*workspace(spark, d)))


@query(v.with_(v.FILES_SQL, v.SYMBOLS_SQL, v.EDGES_SQL) + LINKED_SQL)
def relinked_workspace(spark: SparkSession, d: str) -> DataFrame:
    """The same edges by way of an older state: every fortieth file was absent, and those beside them had other symbols and no imports."""
    files, symbols, imports, calls, references = workspace(spark, d)
    gone, other = F.col("file_id") % 40 == 7, F.col("file_id") % 40 == 11
    old_files, old_symbols = files.where(~gone), symbols.where(~gone).withColumn("name", F.when(other, F.lit("green")).otherwise(F.col("name")))
    old = link.with_origins(imports.where(~gone & ~other), calls.where(~gone), references.where(~gone))
    before = {"files": old_files, "symbols": old_symbols, "imports": old[0], "uses": old[1]}
    new = link.with_origins(imports, calls, references)
    now = {"files": files, "symbols": symbols, "imports": new[0], "uses": new[1]}
    edges = link.linked(old_files, old_symbols, *old)
    return told_edges(link.relinked(edges, before, now, files.where(gone | other)))


@query(v.with_(v.SYMBOLS_SQL, v.EDGES_SQL) + """
, uses AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, l_orderkey % docs AS file_id, (['red', 'blue', 'small', 'nothing'])[l_linenumber % 4 + 1] AS name
    FROM lineitem, sizes),
imp AS (SELECT DISTINCT from_id AS file_id, to_id AS target_file_id FROM edges WHERE kind = 'imports'),
loc AS (SELECT name, file_id, count(*) AS n1, min(symbol_id) AS s1 FROM symbols GROUP BY name, file_id),
near AS (SELECT imp.file_id, name, count(DISTINCT symbol_id) AS n2, min(symbol_id) AS s2 FROM imp JOIN symbols ON target_file_id = symbols.file_id WHERE exported GROUP BY imp.file_id, name),
ws AS (SELECT name, count(*) AS n3, min(symbol_id) AS s3 FROM symbols GROUP BY name)
SELECT use_id, u.file_id, u.name, CASE WHEN n1 = 1 THEN s1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN s2 WHEN n2 > 1 THEN NULL WHEN n3 = 1 THEN s3 END AS symbol_id,
    CASE WHEN n1 = 1 THEN 'local' WHEN n1 > 1 THEN 'local_ambiguous' WHEN n2 = 1 THEN 'imported' WHEN n2 > 1 THEN 'imported_ambiguous' WHEN n3 = 1 THEN 'workspace' WHEN n3 > 1 THEN 'workspace_ambiguous' ELSE 'missing' END AS reason
FROM uses u LEFT JOIN loc ON u.file_id = loc.file_id AND u.name = loc.name LEFT JOIN near ON u.file_id = near.file_id AND u.name = near.name LEFT JOIN ws ON u.name = ws.name""")
def symbol_ladder(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("red", "blue", "small", "nothing")))
    uses = v.table(spark, d, "lineitem").join(v.sizes(spark, d), F.lit(True)).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), (F.col("l_orderkey") % F.col("docs")).alias("file_id"), F.element_at(names, F.col("l_linenumber") % 4 + 1).alias("name")
    )
    imported = v.edges(spark, d).where("kind = 'imports'").select(F.col("from_id").alias("file_id"), F.col("to_id").alias("target_file_id"))
    return link.resolve_names(uses, v.symbols(spark, d), imported).select("use_id", "file_id", "name", "symbol_id", "reason")


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files before, and as found now: of each ten one is gone, one has other content, and one in a hundred is new."""
    base = v.files(spark, d).withColumn("mtime_unix_ms", F.col("file_id") * 1000)
    k = F.col("file_id") % 10
    now = base.where(k != 3).withColumn("content_hash", F.when(k == 4, "changed").otherwise(F.col("content_hash"))).withColumn("mtime_unix_ms", F.when(k.isin(4, 5), F.col("mtime_unix_ms") + 1).otherwise(F.col("mtime_unix_ms")))
    new = base.where("file_id % 100 = 0").withColumn("rel_path", F.concat("rel_path", F.lit(".new"))).withColumn("deleted_at_unix_ms", F.lit(None).cast("bigint"))
    return base, now.unionByName(new)


SNAPSHOTS_SQL = """
before AS (SELECT *, file_id * 1000 AS mtime FROM files WHERE deleted_at_unix_ms IS NULL),
scanned AS (
    SELECT root_id, rel_path, CASE WHEN file_id % 10 = 4 THEN 'changed' ELSE content_hash END AS content_hash, size_bytes, file_id * 1000 + CASE WHEN file_id % 10 IN (4, 5) THEN 1 ELSE 0 END AS mtime FROM files WHERE file_id % 10 <> 3
    UNION ALL SELECT root_id, rel_path || '.new', content_hash, size_bytes, file_id * 1000 FROM files WHERE file_id % 100 = 0),
both_sides AS (
    SELECT coalesce(b.root_id, s.root_id) AS root_id, coalesce(b.rel_path, s.rel_path) AS rel_path, b.rel_path IS NOT NULL AS was, s.rel_path IS NOT NULL AS is_, b.content_hash AS h0, s.content_hash AS h1, b.mtime AS m0, s.mtime AS m1, b.size_bytes AS z0, s.size_bytes AS z1
    FROM before b FULL JOIN scanned s ON b.root_id = s.root_id AND b.rel_path = s.rel_path)"""


@query(v.with_(v.FILES_SQL, SNAPSHOTS_SQL) + "SELECT root_id, rel_path, CASE WHEN NOT is_ THEN 'deleted' ELSE 'content_only' END AS level FROM both_sides WHERE NOT is_ OR NOT was OR h0 <> h1")
def dirty_plan(spark: SparkSession, d: str) -> DataFrame:
    return incremental.dirty_plan(*snapshots(spark, d))


@query(v.with_(v.FILES_SQL, SNAPSHOTS_SQL) + "SELECT root_id, rel_path FROM both_sides WHERE is_ AND (NOT was OR m0 <> m1 OR z0 <> z1)")
def files_to_hash(spark: SparkSession, d: str) -> DataFrame:
    return incremental.to_hash(*snapshots(spark, d))


@query(v.with_(v.FILES_SQL, SNAPSHOTS_SQL) + """
SELECT 'changed' AS status, count_if(is_ AND (NOT was OR h0 <> h1)) AS n, count_if(NOT is_) AS removed, (SELECT count(*) FROM (SELECT 1 FROM both_sides WHERE is_ AND (NOT was OR h0 <> h1) LIMIT 50)) AS listed FROM both_sides""")
def workspace_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.workspace_changes(*snapshots(spark, d)).select("status", "n", "removed", F.size("paths").cast("bigint").alias("listed"))


@query("SELECT p_partkey AS file_id, p_size % 2 = 0 AS structure_changed, p_size % 3 = 0 AS api_changed FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, false, false FROM part WHERE p_partkey % 5 = 0")
def confirmed_delta(spark: SparkSession, d: str) -> DataFrame:
    part = v.table(spark, d, "part")
    after = part.select(F.col("p_partkey").alias("file_id"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "x").otherwise("")).alias("structure_hash"), F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "x").otherwise("")).alias("public_api_hash"))
    before = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("structure_hash"), F.col("p_brand").alias("public_api_hash"))
    return incremental.confirmed_delta(before, after)


@query(v.with_(v.FILES_SQL) + "SELECT file_id, CASE WHEN file_id % 6 = 1 THEN 'refreshed_current' WHEN freshness_state IN ('refreshed_current', 'retained_current') THEN 'retained_current' ELSE freshness_state END AS freshness_state FROM files")
def retained_files(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    return incremental.refreshed(files, files.where("file_id % 6 = 1"), "run").select("file_id", "freshness_state")


@query(v.with_(v.FILES_SQL) + """
, stored AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN '/repo/' || rel_path WHEN 1 THEN './' || rel_path WHEN 2 THEN rel_path ELSE 'gone/' || rel_path END AS file_path, rel_path FROM files)
SELECT file_id, CASE file_id % 4 WHEN 3 THEN 'unresolved' WHEN 2 THEN 'canonical' ELSE 'convertible' END AS status FROM stored""")
def historical_paths(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    k = F.col("file_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/repo/"), "rel_path")).when(k == 1, F.concat(F.lit("./"), "rel_path")).when(k == 2, F.col("rel_path")).otherwise(F.concat(F.lit("gone/"), "rel_path"))
    return incremental.classify_paths(files.select("file_id", path.alias("file_path")), files.select("rel_path"), "/repo").select("file_id", "status")


HYBRID_SQL = """
cand AS (
    SELECT question_id, 0 AS source_seq, chunk_id AS k, 'storage' AS source, chunk_id, score / 20 AS score, 'partial' AS confidence FROM ranked WHERE rank <= 10
    UNION ALL SELECT item_id, 1, doc_id * 10000, 'graph', doc_id * 10000, 0.9, 'grounded' FROM benchmark JOIN documents ON doc_id = item_id * 5
    UNION ALL SELECT item_id, 2, vec_id * 10000, 'semantic', vec_id * 10000, 0.5, 'partial' FROM benchmark JOIN embeddings ON vec_id % 40 = item_id),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY source_seq, k) AS r FROM cand) WHERE r = 1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY source_seq, k) AS seq FROM once) WHERE seq <= 12),
hyb AS (
    SELECT *, round(CASE source WHEN 'storage' THEN 0.35 WHEN 'graph' THEN 0.40 ELSE 0.25 END * score + CASE confidence WHEN 'grounded' THEN 0.1 ELSE 0 END, 6) AS hybrid FROM kept)"""


def hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of three sources for each benchmark item: full text, its own file, vectors."""
    text = fts.ask(text_index(spark, d), questions(spark, d), 10)
    items = v.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    docs = v.table(spark, d, "documents").select("doc_id")
    own = items.join(docs, F.col("doc_id") == F.col("question_id") * 5)
    near = items.join(v.table(spark, d, "embeddings").select("vec_id"), F.col("vec_id") % 40 == F.col("question_id"))
    part = lambda df, seq, key, source, score, confidence: df.select("question_id", F.lit(seq).alias("source_seq"), key.alias("k"), F.lit(source).alias("source"), key.alias("chunk_id"), score.alias("score"), F.lit(confidence).alias("confidence"))
    rows = (
        part(text, 0, F.col("chunk_id"), "storage", F.col("score") / 20, "partial")
        .unionByName(part(own, 1, F.col("doc_id") * 10_000, "graph", F.lit(0.9).cast("double"), "grounded"))
        .unionByName(part(near, 2, F.col("vec_id") * 10_000, "semantic", F.lit(0.5).cast("double"), "partial"))
    )
    return evidence.ranked(evidence.capped(rows, ["chunk_id"], ["source_seq", "k"], 12))


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL, HYBRID_SQL) + "SELECT question_id, chunk_id, source, hybrid, row_number() OVER (PARTITION BY question_id ORDER BY hybrid DESC, seq) AS rank FROM hyb")
def hybrid_evidence(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_rows(spark, d).select("question_id", "chunk_id", "source", "hybrid", "rank")


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL, HYBRID_SQL) + """
, c AS (SELECT question_id, count(*) AS n, count_if(confidence <> 'grounded') AS weak FROM hyb GROUP BY question_id)
SELECT item_id AS question_id, CASE WHEN contains(lower(text), 'trace') THEN 'unsupported' WHEN coalesce(n, 0) = 0 THEN 'insufficient' WHEN weak > 0 OR n >= 12 THEN 'partial' ELSE 'grounded' END AS answer_state, coalesce(n, 0) AS evidence
FROM benchmark LEFT JOIN c ON item_id = question_id""")
def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    asked = v.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), tx.unsupported_class(F.col("text")).alias("unsupported"))
    rows = hybrid_rows(spark, d).join(v.chunks(spark, d).select("chunk_id", "file_id", "content"), "chunk_id", "left").withColumn("file_id", F.coalesce("file_id", F.floor(F.col("chunk_id") / 10_000)))
    return evidence.packets(asked, rows, 12).select("question_id", "answer_state", F.size("evidence").cast("bigint").alias("evidence"))


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL) + """
, all_rows AS (SELECT file_id, chunk_id % 7 AS symbol, score, chunk_id AS seq, question_id FROM ranked JOIN chunks USING (chunk_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seq) AS r FROM (SELECT *, row_number() OVER (PARTITION BY question_id, file_id, symbol ORDER BY score DESC, seq) AS k FROM all_rows) WHERE k = 1)
SELECT question_id, file_id, symbol, score FROM best WHERE r <= 12""")
def rerank_dedupe(spark: SparkSession, d: str) -> DataFrame:
    chunks = v.chunks(spark, d)
    found = fts.ask(text_index(spark, d), questions(spark, d), 2**31 - 1).join(chunks.select("chunk_id", "file_id"), "chunk_id")
    rows = found.select("question_id", "file_id", (F.col("chunk_id") % 7).alias("symbol"), "score", F.col("chunk_id").alias("seq"))
    return windows.dedupe_by_score(rows, ["file_id", "symbol"], 12, by=["question_id"]).select("question_id", "file_id", "symbol", "score")


@query("""
SELECT item_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) > 2)[1:8]) AS seeds,
CASE WHEN contains(lower(text), 'trace') THEN 'runtime_trace' WHEN contains(lower(text), 'impact') THEN 'impact_analysis' WHEN contains(lower(text), 'everything') THEN 'unbounded_scope' END AS unsupported FROM benchmark""")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return v.table(spark, d, "benchmark").select("item_id", F.size(tx.seed_terms(t)).cast("bigint").alias("seeds"), tx.unsupported_class(t).alias("unsupported"))


@query(r"""
WITH q AS (SELECT event_id, event_type, event_type || (CASE event_id % 4 WHEN 0 THEN ' trace the path' WHEN 1 THEN ' what would break' WHEN 2 THEN ' has a bug' ELSE ' where is it' END) AS question FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'trace_flow' WHEN 1 THEN 'impact_analysis' ELSE CASE WHEN event_type = 'error' OR event_id % 4 = 2 THEN 'bug_investigation' ELSE 'find_definition' END END AS intent,
CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN event_type = 'error' OR event_id % 4 = 2 THEN 2 ELSE 1 END END AS tools FROM q""")
def question_intents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    asked = F.concat("event_type", F.when(k == 0, " trace the path").when(k == 1, " what would break").when(k == 2, " has a bug").otherwise(" where is it"))
    intent = answer.intent_of(asked)
    return v.table(spark, d, "events").select("event_id", intent.alias("intent"), F.size(answer.tools_of(intent)).alias("tools"))


@query(r"""
WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'git log | grep x' WHEN 1 THEN 'ls; grep -r y .' WHEN 2 THEN 'cat src/main.ts' WHEN 3 THEN 'find . -name a' WHEN 4 THEN 'sed -i s/a/b/ f && ls' ELSE 'echo hi' END AS command FROM events)
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'content-search' WHEN 2 THEN 'file-read' WHEN 3 THEN 'file-discovery' WHEN 4 THEN 'file-edit' END AS category FROM c""")
def command_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    command = F.when(k == 0, "git log | grep x").when(k == 1, "ls; grep -r y .").when(k == 2, "cat src/main.ts").when(k == 3, "find . -name a").when(k == 4, "sed -i s/a/b/ f && ls").otherwise("echo hi")
    return v.table(spark, d, "events").select("event_id", tx.command_category(command).alias("category"))


@query(r"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN k > 50 WHEN 1 THEN false ELSE true END AS allowed FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AS k50, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    rows, m = v.telemetry(spark, d), F.col("event_id") % 3
    question = F.when(m == 0, "who calls this").when(m == 1, "what depends on that").otherwise("hello")
    return rows.select("event_id", tx.evidence_allowed(question, F.array(F.lit("Call-Hierarchy")), F.col("k") / 100, 0.505).alias("allowed"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)bearer\s+[a-z0-9._:-]+|sk-[a-z0-9._:-]+') THEN '[REDACTED_SECRET]' WHEN doc_id % 4 = 1 THEN '[REDACTED_COMMAND]' WHEN doc_id % 4 = 2 THEN '[REDACTED_FILE_CONTENT]' ELSE sha256(text) END AS value FROM documents""")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    key = F.when(k == 1, "shellLine").when(k == 2, "fileBody").otherwise("note")
    value = tx.redacted(key, F.col("text"), ["/home/"])
    return v.table(spark, d, "documents").select("doc_id", F.when(value == F.col("text"), F.sha2(value, 256)).otherwise(value).alias("value"))


@query("SELECT event_id, CAST(least(500 * pow(2, greatest(user_id % 7, 1) - 1), 8000) AS BIGINT) AS delay_ms FROM events")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").select("event_id", tx.retry_delay(F.col("user_id") % 7).alias("delay_ms"))


@query("SELECT file_id, length(snippet) AS chars, sha256(snippet) AS hash FROM (SELECT doc_id AS file_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS snippet FROM documents)")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    s = tx.snippet(F.col("text"))
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.length(s).cast("bigint").alias("chars"), F.sha2(s, 256).alias("hash"))


@query(v.with_(v.FILES_SQL) + """
, langs AS (SELECT CASE WHEN ext = 'ts' THEN 'typescript' WHEN ext = 'js' THEN 'javascript' WHEN ext = 'py' THEN 'python' WHEN ext = 'rs' THEN 'rust' ELSE 'unknown' END AS language, count(*) AS n FROM files WHERE deleted_at_unix_ms IS NULL GROUP BY 1),
states AS (SELECT capability, n, CASE WHEN language = 'unknown' THEN CASE WHEN capability IN ('search', 'embedding') THEN 'best_effort' ELSE 'unsupported' END WHEN capability = 'trace' THEN 'unsupported' WHEN capability IN ('parsing', 'definitions', 'search', 'embedding') THEN 'supported' WHEN language IN ('typescript', 'tsx', 'javascript', 'jsx') THEN 'supported' ELSE 'partial' END AS state
      FROM langs, (SELECT unnest(['parsing', 'definitions', 'references', 'imports', 'calls', 'entry_points', 'impact', 'trace', 'search', 'embedding']) AS capability))
SELECT capability, CASE min(CASE state WHEN 'unsupported' THEN 0 WHEN 'best_effort' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) WHEN 0 THEN 'unsupported' WHEN 1 THEN 'best_effort' WHEN 2 THEN 'partial' ELSE 'supported' END AS weakest,
    CAST(sum(n) AS BIGINT) AS files, CAST(coalesce(sum(n) FILTER (WHERE state = 'supported'), 0) AS BIGINT) AS supported FROM states GROUP BY capability""")
def capability_summary(spark: SparkSession, d: str) -> DataFrame:
    """The weakest state of each capability over the languages of the given files that are there, and for how many files it is supported."""
    present = v.files(spark, d).where("deleted_at_unix_ms is null").groupBy(F.coalesce(tx.language_of(F.col("rel_path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))
    rows = evidence.capability_matrix(spark).join(present, "language")
    counts = rows.groupBy("capability").agg(F.sum("n").alias("files"), F.coalesce(F.sum(F.when(F.col("state") == "supported", F.col("n"))), F.lit(0)).alias("supported"))
    return aggregates.weakest(rows, "state", ["unsupported", "best_effort", "partial", "supported"]).join(counts, "capability")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 AND user_id % 5 > 0 THEN least(user_id % 5 * 700, 8000) WHEN event_id % 4 IN (0, 1) AND event_id % 3 = 0 THEN least(CAST(floor((user_id % 9) * 1500) AS BIGINT), 8000)
    WHEN event_id % 4 IN (0, 1) AND event_id % 3 = 1 THEN least(greatest(0, (user_id % 20 - 8) * 1000), 8000) ELSE CAST(least(500 * pow(2, greatest(user_id % 7, 1) - 1), 8000) AS BIGINT) END AS delay_ms,
CASE WHEN event_id % 6 = 0 THEN true WHEN event_type = 'error' THEN false ELSE event_type = 'click' END AS retry FROM events""")
def retry_hints(spark: SparkSession, d: str) -> DataFrame:
    """Waits that a server names in milliseconds, seconds or as a date, before the usual ones; errors that say that they may be tried again."""
    e, u = F.col("event_id"), F.col("user_id")
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + (u % 20 - 8)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    after = F.when(e % 4 < 2, F.when(e % 3 == 0, F.concat(F.lit(" "), (u % 9 * F.lit(1.5)).cast("decimal(9,1)").cast("string"))).when(e % 3 == 1, date).otherwise("soon"))
    kind = F.when(F.col("event_type") == "error", "semantic").when(F.col("event_type") == "click", "network").otherwise("other")
    wait = tx.retry_delay(u % 7, after_ms=F.when(e % 4 == 0, u % 5 * 700), after=after, now=now)
    return v.table(spark, d, "events").select("event_id", wait.alias("delay_ms"), tx.retryable(kind, F.lit(None).cast("int"), e % 6 == 0).alias("retry"))


@query("""
SELECT s_suppkey AS server_id, score FROM (SELECT s_suppkey, s_nationkey + CASE WHEN s_nationkey % 3 = 0 THEN 20 ELSE -25 END AS score FROM supplier WHERE s_acctbal > 0) ORDER BY score DESC, server_id LIMIT 4""")
def server_routing(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.when(F.col("s_nationkey") % 3 == 0, "graph").otherwise("other"))
    servers = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("server_id"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("s_nationkey").alias("priority"), tags.alias("tags"))
    return evidence.route(servers, F.array(F.lit("graph"))).select("server_id", "score")


@query("""
WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type FROM events)
SELECT user_id AS run_id, CASE WHEN count_if(event_type = 'error') > 0 THEN 'block' ELSE 'allow' END AS decision, coalesce(min(CASE WHEN event_type = 'error' THEN seq END), max(seq)) AS ran FROM p GROUP BY user_id""")
def hook_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.numbered(v.table(spark, d, "events"), "user_id", ["ts", "event_id"], "seq")
    return sessions.first_block(rows.select(F.col("user_id").alias("run_id"), F.col("seq").cast("bigint").alias("seq"), F.col("event_type").alias("hook"), F.when(F.col("event_type") == "error", "block").otherwise("allow").alias("decision"))).select("run_id", "decision", "ran")


@query("""
WITH t AS (SELECT doc_id, text AS a, replace(text, chr(10), chr(10) || 'x') AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN contains(a, chr(10)) THEN len(string_split(a, chr(10))) - 1 ELSE 0 END AS INTEGER) AS additions, CAST(CASE WHEN contains(a, chr(10)) THEN len(string_split(a, chr(10))) - 1 ELSE 0 END AS INTEGER) AS deletions FROM t""")
def line_diffs(spark: SparkSession, d: str) -> DataFrame:
    more, less = sessions.line_diff(F.col("text"), F.replace("text", F.lit("\n"), F.lit("\nx")))
    return v.table(spark, d, "documents").select("doc_id", more.alias("additions"), less.alias("deletions"))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_event_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = streams.rolled_up(rows)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return streams.sessions(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(v.with_(v.FILES_SQL, SNAPSHOTS_SQL) + """
SELECT f.root_id, f.rel_path, CASE WHEN s.rel_path IS NULL THEN 'deleted' ELSE 'content_only' END AS level
FROM (SELECT *, file_id * 1000 AS mtime FROM files) f LEFT JOIN scanned s ON f.root_id = s.root_id AND f.rel_path = s.rel_path
WHERE (s.rel_path IS NULL AND f.deleted_at_unix_ms IS NULL) OR (s.rel_path IS NOT NULL AND (f.deleted_at_unix_ms IS NOT NULL OR f.mtime <> s.mtime OR f.size_bytes <> s.size_bytes OR f.content_hash = ''))""")
def metadata_dirty(spark: SparkSession, d: str) -> DataFrame:
    return incremental.metadata_dirty(*snapshots(spark, d))


@query(v.with_(v.FILES_SQL, SNAPSHOTS_SQL) + """
, planned AS (SELECT DISTINCT root_id, rel_path FROM both_sides WHERE is_ AND h0 <> h1)
SELECT b.root_id, b.rel_path, CASE WHEN s.rel_path IS NULL THEN 'not_current' ELSE 'refresh' END AS action FROM before b LEFT JOIN scanned s ON b.root_id = s.root_id AND b.rel_path = s.rel_path
WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.root_id = b.root_id AND p.rel_path = b.rel_path)""")
def resolution_scope(spark: SparkSession, d: str) -> DataFrame:
    """As if each changed file were a configuration."""
    before, now = snapshots(spark, d)
    both = incremental.compare(before, now)
    planned = both.where("was and is and old_hash != new_hash").select("root_id", "rel_path", F.lit("resolution_scope").alias("level"))
    return incremental.resolution_scope(before, now, planned)


@query(v.with_(v.EDGES_SQL, v.FILES_SQL) + """
, loose AS (SELECT file_id AS f, './' || regexp_replace(split_part(rel_path, '/', 3), '\\.[a-z]+$', '') AS specifier, (file_id + 37) % docs AS other FROM files, sizes WHERE file_id % 3 = 0),
guessed AS (SELECT l.f, h.file_id AS t FROM loose l JOIN files o ON o.file_id = l.other JOIN files h ON regexp_replace(h.rel_path, '\\.[a-z]+$', '') = regexp_replace(o.rel_path, '\\.[a-z]+$', '') OR ends_with(regexp_replace(h.rel_path, '\\.[a-z]+$', ''), '/' || regexp_replace(split_part(o.rel_path, '/', 3), '\\.[a-z]+$', '')) WHERE h.file_id % 100 = 0),
imp AS (SELECT from_id AS f, to_id AS t FROM edges WHERE kind = 're_exports' AND resolution = 'unresolved' UNION SELECT f, t FROM guessed),
up(id, depth) AS (SELECT file_id, 0 FROM files WHERE file_id % 100 = 0 UNION SELECT f, depth + 1 FROM up JOIN imp ON t = id WHERE depth < 30)
SELECT id AS file_id, min(depth) AS depth FROM up GROUP BY id""")
def invalidation(spark: SparkSession, d: str) -> DataFrame:
    """Re-exports as imports; every third file also names another file by its last path segment alone."""
    files = v.files(spark, d)
    edges = v.edges(spark, d).where("kind = 're_exports' and resolution = 'unresolved'")
    asks = files.where("file_id % 3 = 0").join(v.sizes(spark, d), F.lit(True)).select(F.col("file_id").alias("f"), ((F.col("file_id") + 37) % F.col("docs")).alias("other"))
    loose = asks.join(files.select(F.col("file_id").alias("other"), F.concat(F.lit("./"), F.element_at(F.split("rel_path", "/"), -1)).alias("specifier")), "other").select(F.col("f").alias("file_id"), "specifier")
    return incremental.invalidation(edges, loose, files, files.where("file_id % 100 = 0"))


@query("SELECT p_partkey AS file_id FROM part WHERE p_partkey % 5 = 0 OR (p_size % 2 = 1 AND p_size % 3 <> 0)")
def reusable_edges(spark: SparkSession, d: str) -> DataFrame:
    return incremental.reusable_edges(confirmed_delta(spark, d))


@query(v.with_(v.FILES_SQL) + "SELECT file_id, CASE WHEN rel_path IN (SELECT rel_path FROM files WHERE file_id IN (1, 5, 20, 33)) THEN 'not_current' ELSE freshness_state END AS freshness_state FROM files")
def invalidated_paths(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    paths = [r.rel_path for r in files.where("file_id in (1, 5, 20, 33)").select("rel_path").collect()]
    return incremental.invalidated(files, paths).select("file_id", "freshness_state")


@query(v.with_(v.EMBEDDINGS_SQL) + """
SELECT model, count(*) AS vectors, count(DISTINCT chunk_id) AS chunks FROM (
    SELECT model, chunk_id FROM vecs WHERE model NOT IN ('m0', 'm2') AND chunk_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'm2', doc_id FROM documents) GROUP BY model""")
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    chunks = v.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"))
    out = vector.reembedded(chunks, v.embeddings(spark, d), "m2", 8, "m0")
    return out.groupBy("model").agg(F.count("*").alias("vectors"), F.count_distinct("chunk_id").alias("chunks"))


@query("SELECT doc_id, true AS full_or_last FROM documents WHERE trim(text) <> ''")
def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each text with whether its batch is full or the last of its partition: positions run from 0 without a gap."""
    texts = v.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    made = vector.batches(texts)
    part = F.split_part("batch", F.lit(":"), F.lit(1))
    sizes = made.groupBy("batch").agg(F.count("*").alias("n"), (F.max("position") + 1).alias("top"), F.first(part).alias("part"), F.max(F.split_part("batch", F.lit(":"), F.lit(2)).cast("int")).alias("at"))
    last = sizes.groupBy("part").agg(F.max("at").alias("last"))
    good = sizes.join(last, "part").select("batch", ((F.col("n") <= 96) & (F.col("n") == F.col("top")) & ((F.col("n") == 96) | (F.col("at") == F.col("last")))).alias("full_or_last"))
    return made.join(good, "batch").select(F.col("chunk_id").alias("doc_id"), "full_or_last")


POSTINGS_SQL = "WORDS AS (SELECT chunk_id, title_terms || content_terms AS w FROM (SELECT chunk_id, TT AS title_terms, TC AS content_terms FROM FROM_)), POST AS (SELECT chunk_id, t AS term, count(*) AS tf, CAST(len(w) AS INTEGER) AS length FROM (SELECT chunk_id, w, unnest(w) AS t FROM WORDS) GROUP BY ALL)"


def postings_sql(source: str, name: str) -> str:
    made = POSTINGS_SQL.replace("TT", TERMS_SQL.format("title")).replace("TC", TERMS_SQL.format("content"))
    return made.replace("FROM_", source).replace("WORDS", f"{name}_words").replace("POST", name)


@query(v.with_(v.CHUNKS_SQL, v.FILES_SQL, TITLED_SQL, postings_sql("titled", "posts")) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, bit_xor(CAST(chunk_id * 31 + tf * 7 + length AS BIGINT)) AS mark FROM posts GROUP BY term")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """By term: chunks, uses, and a mark over every posting of title and content."""
    rows = fts.index(titled(spark, d), title="title")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.bit_xor(F.col("chunk_id") * 31 + F.col("tf") * 7 + F.col("length")).alias("mark"))


@query(v.with_(v.CHUNKS_SQL, v.FILES_SQL, TITLED_SQL, "now AS (SELECT chunk_id, title, content FROM titled WHERE file_id % 10 <> 3 UNION ALL SELECT chunk_id, 'moved/' || title, 'fresh words ' || file_id FROM titled WHERE file_id % 20 = 3)", postings_sql("now", "posts")) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, bit_xor(CAST(chunk_id * 31 + tf * 7 + length AS BIGINT)) AS mark FROM posts GROUP BY term")
def fts_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every tenth file leave; half of them come back with other text."""
    chunks = titled(spark, d)
    gone = chunks.where("file_id % 10 = 3").select("chunk_id")
    added = chunks.where("file_id % 20 = 3").select("chunk_id", F.concat(F.lit("moved/"), "title").alias("title"), F.concat(F.lit("fresh words "), "file_id").alias("content"))
    rows = fts.maintained(fts.index(chunks, title="title"), gone, added, title="title")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.bit_xor(F.col("chunk_id") * 31 + F.col("tf") * 7 + F.col("length")).alias("mark"))


@query(v.with_(v.CHUNKS_SQL, v.FILES_SQL) + "SELECT chunk_id, coalesce(rel_path, '') AS title, sha256(content) AS content FROM chunks LEFT JOIN (SELECT * FROM files WHERE file_id % 7 <> 0) USING (file_id) WHERE file_id % 5 = 0")
def fts_deletes(spark: SparkSession, d: str) -> DataFrame:
    out = fts.deletes(v.chunks(spark, d).where("file_id % 5 = 0"), v.files(spark, d).where("file_id % 7 != 0"))
    return out.select("chunk_id", "title", F.sha2("content", 256).alias("content"))


@query(r"SELECT item_id AS question_id, regexp_full_match(text, '\s*[\p{L}\p{N}_]+(\s+[\p{L}\p{N}_]+)*\s*') AS plain FROM benchmark UNION ALL SELECT page_id + 100000, regexp_full_match(url, '\s*[\p{L}\p{N}_]+(\s+[\p{L}\p{N}_]+)*\s*') FROM pages WHERE url IS NOT NULL UNION ALL SELECT p_partkey + 10000000, true FROM part")
def fts_plain(spark: SparkSession, d: str) -> DataFrame:
    """Which questions a strict parser takes: part names are words, addresses are not."""
    asked = v.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    asked = asked.unionByName(v.table(spark, d, "pages").where("url is not null").select((F.col("page_id") + 100_000).alias("question_id"), F.col("url").alias("text")))
    asked = asked.unionByName(v.table(spark, d, "part").select((F.col("p_partkey") + 10_000_000).alias("question_id"), F.col("p_name").alias("text")))
    return asked.select("question_id", fts.plain(F.col("text")).alias("plain"))


@query(v.with_(v.CHUNKS_SQL, SEARCH_SQL) + """
, modes AS (SELECT unnest(['symbol', 'content']) AS mode),
hits AS (SELECT mode, question_id, chunk_id, rank, CASE WHEN question_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS score FROM ranked, modes WHERE rank <= 20)
SELECT mode, item_id AS question_id, CASE WHEN count(chunk_id) = 0 THEN 'insufficient' WHEN mode <> 'symbol' OR item_id % 3 <> 0 THEN 'partial' ELSE 'grounded' END AS answer_state, count(chunk_id) AS entries,
    CASE WHEN count(chunk_id) = 0 THEN 'no_matches' WHEN mode <> 'symbol' THEN 'retrieval_only' WHEN item_id % 3 <> 0 THEN 'lower_confidence' END AS gap
FROM benchmark JOIN modes ON true LEFT JOIN hits USING (mode) WHERE hits.question_id IS NULL OR hits.question_id = item_id GROUP BY mode, item_id
UNION ALL SELECT mode, item_id, 'insufficient', 0, 'no_matches' FROM benchmark, modes WHERE item_id NOT IN (SELECT question_id FROM hits) AND EXISTS (SELECT 1 FROM hits)""")
def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    hits = fts.ask(text_index(spark, d), asked, 30).withColumn("score", F.when(F.col("question_id") % 3 == 0, 1.0).otherwise(0.5))
    out = None
    for mode in ("symbol", "content"):
        one = evidence.search_states(asked, evidence.search_entries(hits, mode), mode).select(F.lit(mode).alias("mode"), "question_id", "answer_state", "entries", "gap")
        out = one if out is None else out.unionByName(one)
    return out


@query(v.with_(v.SYMBOLS_SQL, v.FILES_SQL, v.EDGES_SQL) + """
, asks AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 11 = 0 THEN 'trace' ELSE 'explain' END AS intent, CASE WHEN c_custkey % 13 = 0 THEN 'unbounded_scope' END AS unsupported,
    CASE WHEN c_custkey % 7 = 0 THEN [] ELSE [split_part((SELECT min(p_name) FROM part WHERE p_partkey = c_custkey % parts), ' ', 1), 'doc_' || (c_custkey % docs)] END AS names FROM customer, sizes),
targets AS (SELECT question_id, i AS target_seq, names[i + 1] AS target FROM (SELECT *, unnest(range(0, len(names))) AS i FROM asks)),
defs AS (SELECT name AS target, symbol_id AS k, row_number() OVER (PARTITION BY name ORDER BY symbol_id) AS row_seq FROM symbols),
paths AS (SELECT regexp_replace(split_part(rel_path, '/', 3), '\\.[a-z]+$', '') AS target, file_id AS k, 1 AS row_seq FROM files),
cand AS (SELECT question_id, target_seq, 0 AS source_seq, row_seq, 'storage' AS source, 's' || k AS key, 1.0 AS score, 'grounded' AS confidence FROM targets JOIN defs USING (target)
    UNION ALL SELECT question_id, target_seq, 1, row_seq, 'query', 'f' || k, 0.8, 'partial' FROM targets JOIN paths USING (target)),
ok AS (SELECT question_id FROM asks WHERE len(names) > 0 AND intent = 'explain' AND unsupported IS NULL),
once AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY target_seq, source_seq, row_seq) AS r FROM cand JOIN ok USING (question_id)),
n AS (SELECT question_id, count(*) AS n, count_if(confidence <> 'grounded') AS weak FROM once WHERE r = 1 GROUP BY question_id)
SELECT question_id, CASE WHEN len(names) = 0 THEN 'insufficient' WHEN intent <> 'explain' OR unsupported IS NOT NULL THEN 'unsupported' WHEN coalesce(n, 0) = 0 THEN 'insufficient' WHEN weak > 0 THEN 'partial' ELSE 'grounded' END AS answer_state,
    coalesce(n, 0) AS evidence FROM asks LEFT JOIN n USING (question_id)""")
def built_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two targets of each customer's question, a symbol's name and a file's, with all definitions and files of those names as sources."""
    k = F.col("c_custkey")
    names = v.table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.substring_index("p_name", " ", 1).alias("word"))
    asks = v.table(spark, d, "customer").join(v.sizes(spark, d), F.lit(True)).withColumn("p", k % F.col("parts")).join(names, "p", "left")
    asks = asks.select(
        k.alias("question_id"), F.when(k % 11 == 0, "trace").otherwise("explain").alias("intent"), F.when(k % 13 == 0, "unbounded_scope").alias("unsupported"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("word", F.concat(F.lit("doc_"), k % F.col("docs")))).alias("names"),
    )
    targets = asks.select("question_id", F.posexplode("names").alias("target_seq", "target"))
    # definitions come by id
    defined = v.symbols(spark, d).withColumn("row_seq", F.col("symbol_id"))
    grounded = lambda rows, target, key, score, confidence: rows.select(target.alias("target"), "row_seq", key.alias("key"), F.lit(score).alias("score"), F.lit(confidence).alias("confidence"))
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[a-z]+$", "")
    sources = [
        ("storage", grounded(defined, F.col("name"), F.concat(F.lit("s"), "symbol_id"), 1.0, "grounded")),
        ("query", grounded(v.files(spark, d).withColumn("row_seq", F.lit(1).cast("bigint")), stem, F.concat(F.lit("f"), "file_id"), 0.8, "partial")),
    ]
    questions_ = asks.select("question_id", "intent", "unsupported", F.size("names").alias("targets"))
    return evidence.judged(questions_, targets, sources)


@query(v.with_(v.FILES_SQL) + """
SELECT file_id, CASE file_id % 4 WHEN 3 THEN 'gone/' || rel_path ELSE rel_path END AS file_path FROM files""")
def converted_paths(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    k = F.col("file_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/repo/"), "rel_path")).when(k == 1, F.concat(F.lit("./"), "rel_path")).when(k == 2, F.col("rel_path")).otherwise(F.concat(F.lit("gone/"), "rel_path"))
    return incremental.converted_paths(files.select("file_id", path.alias("file_path")), files.select("rel_path"), "/repo")


LEDGER_SQL = """
WITH mentions AS (SELECT c_custkey % 100 AS q, 1 AS behind, 1 AS o, 'src' || (c_custkey % 20) || '/en/doc_' || c_custkey || '.ts' AS path FROM customer),
known AS (SELECT source || '/' || lang || '/' || CASE WHEN doc_id % 9 = 0 THEN 'test_' ELSE 'doc_' END || doc_id || '.' || (['ts', 'js', 'py', 'rs'])[doc_id % 4 + 1] AS path FROM documents),
cand AS (SELECT user_id AS q, 0 AS behind, event_id AS o, CAST(event_id % 9 AS VARCHAR) AS path, CAST(event_id % 2 AS INTEGER) AS a, CAST(event_id % 2 + 5 AS INTEGER) AS b, event_type AS source, (event_id % 13) / 10.0 AS score FROM events
    UNION ALL SELECT q, behind, o, path, 1, 80, 'file_mention', 1.0 FROM mentions JOIN known USING (path)),
once AS (SELECT *, row_number() OVER (PARTITION BY q, path, a, b, source ORDER BY score DESC, behind, o) AS r FROM cand),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, behind, o, path) AS seq FROM once WHERE r = 1),
total AS (SELECT q, count(*) AS there FROM placed GROUP BY q)"""


def ledger_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as results, and customers' questions that name a file."""
    e = F.col("event_id")
    rows = v.table(spark, d, "events").select(
        F.col("user_id").alias("question_id"), (e % 9).cast("string").alias("path"), (e % 2).cast("int").alias("line_start"), (e % 2 + 5).cast("int").alias("line_end"),
        F.col("event_type").alias("source"), (e % 13 / F.lit(10.0)).alias("score"), e.alias("order"),
    )
    c = F.col("c_custkey")
    asked = v.table(spark, d, "customer").select((c % 100).alias("question_id"), F.concat(F.lit("why does ./src"), c % 20, F.lit("/en/doc_"), c, F.lit(".ts call gone/x.ts?")).alias("question"))
    return rows, evidence.file_mentions(asked, v.files(spark, d))


@query(LEDGER_SQL + "".join(f"""
{start} SELECT '{mode}' AS mode, q AS question_id, least(there, {most}) AS entries, there > {most} AS budget_reached FROM total""" for start, mode, most in (("", "small", 4), ("UNION ALL", "usual", 12), ("UNION ALL", "large", 24))))
def ledger_modes(spark: SparkSession, d: str) -> DataFrame:
    rows, mentions = ledger_rows(spark, d)
    out = None
    for mode in ("small", "usual", "large"):
        one = evidence.ledger(rows, mode, mentions)[1].select(F.lit(mode).alias("mode"), "question_id", "entries", F.array_contains("warnings", "budget_reached").alias("budget_reached"))
        out = one if out is None else out.unionByName(one)
    return out


@query(LEDGER_SQL + "SELECT q AS question_id, CAST(seq AS INTEGER) AS seq, path, a AS line_start, b AS line_end, source, CAST(score AS DOUBLE) AS score FROM placed WHERE seq <= 12")
def ledger_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by score, keyed by path, lines and source, with the files that questions name."""
    return evidence.ledger(*ledger_rows(spark, d)[:1], "usual", ledger_rows(spark, d)[1])[0].select("question_id", "seq", "path", "line_start", "line_end", "source", "score")


@query("""
WITH r AS (SELECT s_suppkey AS server_id, CASE WHEN s_suppkey % 5 = 0 THEN 'contract_version_mismatch' WHEN s_acctbal < 0 THEN 'entry_missing' WHEN s_suppkey % 7 = 0 THEN 'lane_mismatch' WHEN s_suppkey % 11 = 0 THEN 'role_mismatch' WHEN s_suppkey % 13 = 0 THEN 'capability_denied' END AS reason,
    s_nationkey + CASE WHEN s_nationkey % 3 = 0 THEN 20 ELSE -25 END AS score FROM supplier),
k AS (SELECT server_id, row_number() OVER (ORDER BY score DESC, server_id) AS rank FROM r WHERE reason IS NULL)
SELECT server_id, reason, CASE WHEN reason IS NULL THEN score END AS score, CAST(rank AS INTEGER) AS rank, coalesce(rank <= 4, false) AS selected FROM r LEFT JOIN k USING (server_id)""")
def routing_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = lambda name, bad: F.array(F.when(bad, "other").otherwise(name))
    servers = v.table(spark, d, "supplier").select(
        k.alias("server_id"), F.when(k % 5 == 0, "v0").otherwise("v1").alias("version"), F.when(F.col("s_acctbal") >= 0, "run").alias("entry"), one("lane", k % 7 == 0).alias("lanes"), one("role", k % 11 == 0).alias("roles"),
        one("read", k % 13 == 0).alias("capabilities"), F.col("s_nationkey").alias("priority"), F.array(F.when(F.col("s_nationkey") % 3 == 0, "graph").otherwise("other")).alias("tags"),
    )
    return evidence.routed(servers, "lane", "role", F.array(F.lit("graph")), ["read"], ["v1"])


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + f"""
SELECT chunk_id, score FROM (SELECT chunk_id, content_hash, {COSINE} AS score FROM vecs ORDER BY score DESC, chunk_id LIMIT 40) b WHERE score >= 0.1 AND EXISTS (SELECT 1 FROM files f WHERE f.file_id = b.chunk_id AND f.content_hash = b.content_hash)""")
def fresh_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest first, then without stale ones."""
    now = v.files(spark, d).select(F.col("file_id").alias("chunk_id"), "content_hash")
    return vector.indexed_scan(v.embeddings(spark, d), question_vector(spark, d), 40, 0.1, now=now)


@query(v.with_(v.EMBEDDINGS_SQL) + f"SELECT chunk_id, score, 'stored' AS source FROM (SELECT chunk_id, {COSINE} AS score FROM vecs WHERE {COSINE} >= 0.25 ORDER BY score DESC, chunk_id LIMIT 10)")
def semantic_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Neither index nor cache holds anything, so the stored vectors are scanned."""
    rows = v.embeddings(spark, d)
    none = rows.where("false")
    return vector.semantic_search([("index", none), ("cache", none), ("stored", rows)], question_vector(spark, d))


@query("""
WITH c AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS word FROM part)
SELECT 'app' || id || '/tsconfig.json' AS config, CASE WHEN id % 3 = 0 THEN 'base/tsconfig.json' END AS extends, '@' || word || '/*' AS pattern, 'app' || id || '/src/' || word || '/*' AS target FROM c WHERE id % 5 <> 0
UNION ALL SELECT 'app' || id || '/tsconfig.json', CASE WHEN id % 3 = 0 THEN 'base/tsconfig.json' END, 'exact', 'app' || id || '/one.ts' FROM c WHERE id % 5 <> 0
UNION ALL SELECT 'app' || id || '/tsconfig.json', NULL, NULL, NULL FROM c WHERE id % 5 = 0""")
def config_texts(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with comments, commas too many, a parent for every third, and no JSON in every fifth."""
    k, word = F.col("p_partkey"), F.substring_index("p_name", " ", 1)
    parts = ['{ // aliases\n  ', F.when(k % 3 == 0, '"extends": "../base/tsconfig",').otherwise("/* none */"), '\n  "compilerOptions": { "baseUrl": "./src", "paths": { "@', word, '/*": ["./', word, '/*", "//x"], "exact": ["../one.ts",], }, },\n}']
    text = F.when(k % 5 == 0, "not a configuration").otherwise(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return link.read_configs(v.table(spark, d, "part").select(F.concat(F.lit("app"), k, F.lit("/tsconfig.json")).alias("rel_path"), text.alias("content")))
