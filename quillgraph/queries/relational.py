"""Lookups, joins, aggregates, windows and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import views as v
from quillgraph.functions import text as tx
from quillgraph.operators import aggregates, joins, lookup, sessions, windows
from quillgraph.registry import query
from quillgraph.sources import sinks

FRESH = ["refreshed_current", "retained_current"]


@query(v.with_(v.SYMBOLS_SQL) + """
SELECT symbol_id, name, qualified_name, exported FROM symbols WHERE name = 'red' OR qualified_name = 'red' ORDER BY exported DESC, symbol_id LIMIT 20""")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_symbols(v.symbols(spark, d), "red", 20).select("symbol_id", "name", "qualified_name", "exported")


@query(v.with_(v.SYMBOLS_SQL, v.FILES_SQL) + """
SELECT symbol_id, kind, rel_path FROM (SELECT * FROM symbols WHERE name = 'blue' OR qualified_name = 'blue' ORDER BY exported DESC, symbol_id LIMIT 40) JOIN files USING (file_id)
WHERE kind IN ('economy', 'promo', 'small') AND contains(lower(rel_path), '/en/')""")
def symbol_lookup_refined(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.find_symbols(v.symbols(spark, d), "blue", 40)
    return lookup.refine_symbols(found, v.files(spark, d), ["economy", "promo", "small"], "/en/").select("symbol_id", "kind", "rel_path")


@query(v.with_(v.SYMBOLS_SQL, v.FILES_SQL) + """
SELECT symbol_id, qualified_name, rel_path, line_start FROM (SELECT * FROM symbols WHERE name = 'small' ORDER BY exported DESC, symbol_id LIMIT 8) JOIN files USING (file_id)
ORDER BY exported DESC, symbol_id LIMIT 1""")
def goto_definition(spark: SparkSession, d: str) -> DataFrame:
    return lookup.goto_definition(v.symbols(spark, d), v.files(spark, d), "small").select("symbol_id", "qualified_name", "rel_path", "line_start")


@query(v.with_(v.FILES_SQL) + """
SELECT file_id, rel_path, CAST(0.9 AS DOUBLE) AS score FROM files WHERE contains(lower(rel_path), 'src3/fr') ORDER BY rel_path, file_id LIMIT 20""")
def path_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_paths(v.files(spark, d), "SRC3/fr", 50).select("file_id", "rel_path", F.col("score").cast("double").alias("score"))


@query(v.with_(v.FILES_SQL) + "SELECT file_id, rel_path FROM files WHERE NOT contains(lower(rel_path), 'test') AND freshness_state IN ('refreshed_current', 'retained_current')")
def current_sources(spark: SparkSession, d: str) -> DataFrame:
    return lookup.without_tests(v.files(spark, d)).where(lookup.is_current(F.col("freshness_state"))).select("file_id", "rel_path")


@query(v.with_(v.FILES_SQL) + """
SELECT file_id, rel_path, CASE ext WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' END AS language
FROM files WHERE regexp_matches(rel_path, '^src1[0-9]*/(?:.*/)?doc_[^/]*\\.ts$')""")
def glob_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = v.files(spark, d).where(F.col("rel_path").rlike(tx.glob_pattern("src1*/**/doc_*.ts")))
    return rows.select("file_id", "rel_path", tx.scanned_language(F.col("rel_path")).alias("language"))


@query(v.with_(v.SYMBOLS_SQL) + """
, hit AS (SELECT symbol_id, name FROM symbols WHERE contains(name, 'ed') OR contains(name, 'green') ORDER BY symbol_id LIMIT 8)
SELECT symbol_id, name, CAST(round(0.98 - 0.06 * (row_number() OVER (ORDER BY symbol_id) - 1), 6) AS DOUBLE) AS score FROM hit""")
def seed_definitions(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_seed(v.symbols(spark, d).select("symbol_id", "name"), "name", ["ed", "green"], "symbol_id", False, 0.98, 0.06)


@query(v.with_(v.SYMBOLS_SQL) + """
, hit AS (SELECT symbol_id, name FROM symbols WHERE starts_with(name, 's') OR starts_with(name, 'bl') ORDER BY symbol_id LIMIT 8)
SELECT symbol_id, name, CAST(round(0.88 - 0.05 * (row_number() OVER (ORDER BY symbol_id) - 1), 6) AS DOUBLE) AS score FROM hit""")
def seed_references(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_seed(v.symbols(spark, d).select("symbol_id", "name"), "name", ["s", "bl"], "symbol_id", True, 0.88, 0.05)


@query(v.with_(v.FILES_SQL) + """
SELECT file_id, rel_path, CAST(round(greatest(0.3, 0.95 - 0.08 * (row_number() OVER (ORDER BY file_id) - 1)), 6) AS DOUBLE) AS score
FROM (SELECT * FROM files ORDER BY file_id LIMIT 5)""")
def seed_files_fallback(spark: SparkSession, d: str) -> DataFrame:
    return lookup.seed_files(v.files(spark, d).select("file_id", "rel_path"), ["no such path"])


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT event_id, session_id, kind, timestamp FROM telemetry WHERE role = 'coder' AND envelope_id = 'env3' AND timestamp >= '2024-01-05' AND timestamp <= '2024-01-20'
ORDER BY timestamp DESC, event_id DESC LIMIT 25""")
def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.audit_filter(v.telemetry(spark, d), role="coder", envelope="env3", since="2024-01-05", until="2024-01-20")
    return rows.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(lookup.audit_limit(-1)).select("event_id", "session_id", "kind", "timestamp")


@query(v.with_(v.TELEMETRY_SQL) + "SELECT count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM telemetry WHERE timestamp >= '2024-01-10T00:00:00.000' AND timestamp <= '2024-01-12T00:00:00.000'")
def telemetry_window(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.in_window(v.telemetry(spark, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    return rows.agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query(v.with_(v.EDGES_SQL) + "SELECT kind, from_id, to_id FROM edges WHERE kind IN ('calls', 'imports')")
def edges_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    return lookup.of_kinds(v.edges(spark, d), ["call", "imports"]).select("kind", "from_id", "to_id")


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + """
SELECT chunk_id, model, rel_path FROM vecs JOIN files ON chunk_id = file_id AND vecs.content_hash = files.content_hash WHERE deleted_at_unix_ms IS NULL""")
def fresh_embeddings(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    chunks = files.select(F.col("file_id").alias("chunk_id"), "file_id", "content_hash")
    return joins.fresh_embeddings(v.embeddings(spark, d), chunks, files).select("chunk_id", "model", "rel_path")


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + "SELECT chunk_id, model FROM vecs WHERE NOT EXISTS (SELECT 1 FROM files WHERE file_id = chunk_id)")
def orphan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    chunks = v.files(spark, d).select(F.col("file_id").alias("chunk_id"))
    return joins.orphans(v.embeddings(spark, d), chunks).select("chunk_id", "model")


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + """
SELECT chunk_id, CASE WHEN file_id IS NULL THEN 'no_chunk' WHEN vecs.content_hash IS DISTINCT FROM files.content_hash THEN 'hash' ELSE 'deleted' END AS why
FROM vecs LEFT JOIN files ON chunk_id = file_id WHERE file_id IS NULL OR vecs.content_hash IS DISTINCT FROM files.content_hash OR deleted_at_unix_ms IS NOT NULL""")
def stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    chunks = files.select(F.col("file_id").alias("chunk_id"), "file_id", "content_hash")
    return joins.stale(v.embeddings(spark, d), chunks, files).select("chunk_id", "why")


@query(v.with_(v.FILES_SQL) + """
, roots AS (SELECT DISTINCT split_part(rel_path, '/', 1) AS path FROM files UNION SELECT DISTINCT split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) FROM files WHERE file_id % 3 = 0)
SELECT path FROM roots a WHERE NOT EXISTS (SELECT 1 FROM roots b WHERE starts_with(b.path, a.path || '/'))""")
def leaf_roots(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("rel_path", "/")
    files = v.files(spark, d)
    roots = files.select(parts[0].alias("path")).union(files.where("file_id % 3 = 0").select(F.concat_ws("/", parts[0], parts[1]))).distinct()
    return joins.leaf_roots(roots)


@query(v.with_(v.FILES_SQL) + """
, asked AS (SELECT file_id AS ask, split_part(rel_path, '/', 2) || '/' || regexp_replace(split_part(rel_path, '/', 3), '\\.[a-z]+$', '') AS wanted FROM files)
SELECT ask, file_id FROM asked JOIN files ON ends_with(regexp_replace(rel_path, '\\.[a-z]+$', ''), '/' || wanted) OR regexp_replace(rel_path, '\\.[a-z]+$', '') = wanted""")
def importers_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("rel_path", "/")
    files = v.files(spark, d)
    asked = files.select(F.col("file_id").alias("ask"), F.concat(F.lit("./"), parts[1], F.lit("/"), parts[2]).alias("specifier"))
    return joins.suffix_matches(asked, files).select("ask", "file_id")


@query(v.with_(v.SYMBOLS_SQL) + """
, points AS (SELECT DISTINCT file_id, p FROM symbols, (SELECT unnest([5, 20, 33, 47]) AS p))
SELECT points.file_id, p, min_by(symbol_id, CAST(line_end - line_start AS BIGINT) * 1000000000 + symbol_id) AS symbol_id
FROM points LEFT JOIN symbols ON points.file_id = symbols.file_id AND line_start <= p AND p <= line_end GROUP BY points.file_id, p""")
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    s = v.symbols(spark, d)
    points = s.select("file_id").distinct().select("file_id", F.explode(F.array(*map(F.lit, (5, 20, 33, 47)))).alias("p"))
    return joins.enclosing(points, s, "file_id", "p", "line_start", "line_end", "symbol_id")


@query(v.with_(v.FILES_SQL) + """
SELECT count_if(freshness_state = 'refreshed_current') AS refreshed_current, count_if(freshness_state = 'retained_current') AS retained_current,
count_if(freshness_state = 'degraded_partial') AS degraded_partial, count_if(freshness_state = 'not_current') AS not_current FROM files""")
def freshness_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.freshness_counts(v.files(spark, d))


PARTS = {"all": "true", "recent": "freshness_state <> 'not_current'", "sound": "freshness_state NOT IN ('not_current', 'degraded_partial')", "none": "false"}


@query(v.with_(v.FILES_SQL) + ", counts AS (" + " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n, count_if(freshness_state = 'not_current') AS old, count_if(freshness_state = 'degraded_partial') AS weak FROM files WHERE {w}" for k, w in PARTS.items()) + """)
SELECT part, run, CASE WHEN n = 0 OR run = 'missing' THEN 'cold' WHEN run <> 'completed' OR old > 0 THEN 'stale' WHEN weak > 0 THEN 'partial' ELSE 'current' END AS freshness
FROM counts, (SELECT unnest(['completed', 'failed', 'running', 'missing']) AS run)""")
def graph_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Of several parts of the files, after runs of different outcome."""
    files, out = v.files(spark, d), None
    for run in ("completed", "failed", "running", "missing"):
        rows = [] if run == "missing" else [("completed" if run == "running" else run, "r7" if run == "running" else None)]
        state = spark.createDataFrame(rows, "status string, active_run_id string")
        for part, where in PARTS.items():
            one = aggregates.index_freshness(files.where(where), state).select(F.lit(part).alias("part"), F.lit(run).alias("run"), "freshness")
            out = one if out is None else out.unionByName(one)
    return out


@query(v.with_(v.EMBEDDINGS_SQL, v.FILES_SQL) + """
SELECT model, dimensions, count(*) AS vectors, count_if(vecs.content_hash = files.content_hash AND deleted_at_unix_ms IS NULL) AS fresh
FROM vecs LEFT JOIN files ON chunk_id = file_id GROUP BY model, dimensions""")
def embedding_counts(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d).select(F.col("file_id").alias("chunk_id"), F.col("content_hash").alias("now"), "deleted_at_unix_ms")
    both = v.embeddings(spark, d).join(files, "chunk_id", "left")
    return both.groupBy("model", "dimensions").agg(F.count("*").alias("vectors"), F.count_if((F.col("content_hash") == F.col("now")) & F.col("deleted_at_unix_ms").isNull()).alias("fresh"))


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT kind, count(*) AS runs, sum(k) AS total_tokens, round(sum(duration_ms), 2) AS total_ms, round(avg(duration_ms), 6) AS avg_ms FROM telemetry GROUP BY kind""")
def telemetry_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.telemetry_summary(v.telemetry(spark, d))


@query(v.with_(v.TELEMETRY_SQL) + "SELECT strategy, count(*) AS n FROM telemetry WHERE kind = 'click' GROUP BY strategy")
def strategy_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.strategy_breakdown(v.telemetry(spark, d), "click").select(F.explode("by_strategy").alias("strategy", "n"))


@query(v.with_(v.TELEMETRY_SQL) + "SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM telemetry WHERE k IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_buckets(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.buckets(v.telemetry(spark, d).withColumn("model", F.col("k").cast("string")), "model", 10)


@query(v.with_(v.TELEMETRY_SQL) + "SELECT value, count(session_id) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'refund']) AS value) LEFT JOIN telemetry ON kind = value AND session_id = 7 GROUP BY value")
def audit_status_counts(spark: SparkSession, d: str) -> DataFrame:
    own = lookup.audit_filter(v.telemetry(spark, d), session=7)
    return aggregates.count_by_domain(own, "kind", ["click", "error", "purchase", "refund"])


@query("""SELECT count_if(quality = 1) AS pass, count_if(quality = 0 AND toxic = 0) AS fail, count_if(quality = 0 AND toxic = 1) AS not_run,
CAST(0 AS BIGINT) AS unavailable, CAST(0 AS BIGINT) AS not_configured FROM labels""")
def quality_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 0, "fail").otherwise("not_run")
    return sessions.gate_counts(v.table(spark, d, "labels").withColumn("status", status))


@query(v.with_(v.TELEMETRY_SQL) + """
, r AS (SELECT kind, duration_ms, row_number() OVER (PARTITION BY kind ORDER BY duration_ms) AS k, count(*) OVER (PARTITION BY kind) AS n FROM telemetry WHERE duration_ms IS NOT NULL)
SELECT kind, max(CASE WHEN k = round(0.5 * (n - 1)) + 1 THEN duration_ms END) AS p50, max(CASE WHEN k = round(0.95 * (n - 1)) + 1 THEN duration_ms END) AS p95 FROM r GROUP BY kind""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.nearest_rank_of(v.telemetry(spark, d), "duration_ms", [50, 95], ["kind"])


def hash_tree(source: str, by: str) -> str:
    """The fingerprints of ``source`` (BY, line), as the operator forms them."""
    join = lambda part: f"string_agg({part}, chr(10) ORDER BY {part})"
    return f"""
leaves AS (SELECT {by}, sha256(line) AS h, count(*) AS n FROM ({source}) GROUP BY ALL),
sixes AS (SELECT {by}, substr(h, 1, 6) AS pre, sha256({join("h || ':' || n")}) AS h, sum(n) AS n FROM leaves GROUP BY {by}, substr(h, 1, 6)),
threes AS (SELECT {by}, substr(pre, 1, 3) AS pre, sha256({join("pre || ':' || h")}) AS h, sum(n) AS n FROM sixes GROUP BY {by}, substr(pre, 1, 3))
SELECT {by}, sha256({join("pre || ':' || h")}) AS fingerprint, CAST(sum(n) AS BIGINT) AS lines FROM threes GROUP BY {by}"""


@query(v.with_(v.FILES_SQL) + "," + hash_tree("SELECT root_id, rel_path || ':' || size_bytes || ':' || content_hash AS line FROM files", "root_id"))
def workspace_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.fingerprint(v.files(spark, d), F.concat_ws(":", "rel_path", "size_bytes", "content_hash"), ["root_id"])


@query(v.with_(v.SYMBOLS_SQL) + "," + hash_tree("SELECT file_id, kind || '|' || qualified_name || '|' || symbol_id AS line FROM symbols WHERE exported", "file_id"))
def public_api_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.fingerprint(v.symbols(spark, d).where("exported"), F.concat_ws("|", "kind", "qualified_name", "symbol_id"), ["file_id"])


@query(v.with_(v.EDGES_SQL, v.FILES_SQL) + """
SELECT count_if(kind = 'imports' AND resolution = 'resolved') AS linked_imports, count_if(kind = 'imports' AND resolution <> 'resolved') AS unresolved_imports,
count_if(kind = 'calls' AND resolution = 'resolved') AS linked_calls, count_if(kind = 'calls' AND resolution <> 'resolved') AS unresolved_calls,
count_if(kind = 'references' AND resolution = 'resolved') AS linked_references, count_if(kind = 'references' AND resolution <> 'resolved') AS unresolved_references,
count_if(kind = 're_exports' AND resolution = 'resolved') AS linked_re_exports, count_if(kind = 're_exports' AND resolution <> 'resolved') AS unresolved_re_exports,
count_if(from_kind = 'file' AND resolution = 'resolved' AND a.root_id <> b.root_id) AS across_roots
FROM edges LEFT JOIN files a ON from_kind = 'file' AND from_id = a.file_id LEFT JOIN files b ON to_kind = 'file' AND to_id = b.file_id""")
def link_report(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.link_report(v.edges(spark, d), v.files(spark, d))


@query("""
SELECT fact, CASE WHEN sum(greatest(e, a)) > 0 THEN round(100.0 * (sum(greatest(e, a)) - sum(abs(e - a))) / sum(greatest(e, a)), 6) ELSE 100.0 END AS parity
FROM (SELECT p_type AS fact, p_size AS e, p_size - CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS a FROM part) GROUP BY fact""")
def extraction_parity(spark: SparkSession, d: str) -> DataFrame:
    counts = v.table(spark, d, "part").select(F.col("p_type").alias("fact"), F.col("p_size").alias("expected"), (F.col("p_size") - F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("actual"))
    return aggregates.parity(counts)


@query(v.with_(v.TELEMETRY_SQL) + "SELECT session_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rn FROM telemetry) WHERE rn = 1")
def latest_event_per_session(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_value(v.telemetry(spark, d), ["session_id"], F.struct("ts", "event_id"), ["event_id", "kind"])


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN envelope_id = 'env2' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM telemetry WHERE kind = 'error') WHERE rn = 1""")
def latest_hook_decision(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("envelope_id") == "env2", 0).otherwise(1)
    return windows.latest(v.telemetry(spark, d).where("kind = 'error'"), ["session_id"], [first, F.desc("ts"), F.desc("event_id")]).select("session_id", "event_id")


@query(v.with_(v.CHUNKS_SQL) + """
SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY file_id ORDER BY line_start) AS prev_id, lead(chunk_id) OVER (PARTITION BY file_id ORDER BY line_start) AS next_id FROM chunks""")
def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return windows.neighbours(v.chunks(spark, d), "file_id", ["line_start"], "chunk_id").select("chunk_id", "prev_id", "next_id")


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT session_id, event_id, kind, lag(kind) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS previous, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS sequence FROM telemetry""")
def stage_history(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.stage_history(v.telemetry(spark, d), "session_id", ["ts", "event_id"], "kind")
    return windows.numbered(rows, "session_id", ["ts", "event_id"]).select("session_id", "event_id", "kind", "previous", "sequence")


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM telemetry) WHERE n <= 6""")
def session_tail(spark: SparkSession, d: str) -> DataFrame:
    return windows.tail(v.telemetry(spark, d), "session_id", ["ts", "event_id"], 6).select("session_id", "event_id")


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT session_id, event_id, max(k) OVER w AS files_changed, sum(k) OVER w AS additions, last_value(CASE WHEN k % 4 = 0 THEN kind END IGNORE NULLS) OVER w AS stage
FROM telemetry WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def session_summary_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = v.telemetry(spark, d).select("session_id", "event_id", F.col("k").alias("files_changed"), F.col("k").alias("additions"), F.when(F.col("k") % 4 == 0, F.col("kind")).alias("stage"))
    return windows.running(rows, "session_id", ["event_id"])


@query(v.with_(v.EDGES_SQL) + """
SELECT to_kind, to_id, from_id FROM (SELECT *, row_number() OVER (PARTITION BY to_kind, to_id ORDER BY kind, from_id) AS n FROM edges) WHERE n <= 3 AND kind = 'references'""")
def capped_references(spark: SparkSession, d: str) -> DataFrame:
    return windows.cap_each(v.edges(spark, d), ["to_kind", "to_id"], ["kind", "from_id"], 3).where("kind = 'references'").select("to_kind", "to_id", "from_id")


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT kind, id, timestamp FROM (
    SELECT kind, event_id AS id, timestamp FROM telemetry
    UNION ALL SELECT 'turn:' || role, conv_id * 1000 + turn, '2024-01-' || lpad(CAST(1 + conv_id % 30 AS VARCHAR), 2, '0') FROM conversations)
ORDER BY timestamp DESC, kind, id LIMIT 50""")
def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    turns = v.table(spark, d, "conversations").select(
        F.concat(F.lit("turn:"), "role").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("conv_id") % 30).cast("string"), 2, "0")).alias("timestamp")
    )
    return sessions.timeline([v.telemetry(spark, d).select("kind", F.col("event_id").alias("id"), "timestamp"), turns], 50)


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT s.session_id, count_if(kind = 'click') AS clicks, count_if(kind = 'error') AS errors, count_if(kind = 'purchase' AND k > 50) AS large
FROM (SELECT DISTINCT session_id FROM telemetry) s JOIN telemetry t ON s.session_id = t.session_id GROUP BY s.session_id""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    t = v.telemetry(spark, d)
    return sessions.session_counts(t, {"clicks": t.where("kind = 'click'"), "errors": t.where("kind = 'error'"), "large": t.where("kind = 'purchase' and k > 50")})


@query("""
SELECT conv_id AS session_id, count(*) AS entries, count(*) > 4 OR sum(octet_length(encode(text))) > 2000 AS overflow,
CASE WHEN count(*) > 4 OR sum(octet_length(encode(text))) > 2000 THEN greatest(count(*) - 4, 0) ELSE 0 END AS dropped,
array_to_string(list_slice(list(turn ORDER BY turn), CAST(greatest(count(*) - 3, 1) AS BIGINT), count(*)), ',') AS tail FROM conversations GROUP BY conv_id""")
def session_compaction(spark: SparkSession, d: str) -> DataFrame:
    turns = v.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    done = sessions.compacted(turns, 4, 2000)
    tails = windows.tail(turns, "session_id", ["seq"], 4).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("tail"))
    return done.drop("tail", "blockers").join(tails, "session_id")


@query(v.with_(v.FILES_SQL) + """
SELECT file_id, freshness_state, deleted_at_unix_ms FROM (
    SELECT file_id, CASE WHEN file_id % 50 = 3 THEN 'deleted' ELSE freshness_state END AS freshness_state, CASE WHEN file_id % 50 = 3 THEN coalesce(deleted_at_unix_ms, 99) ELSE deleted_at_unix_ms END AS deleted_at_unix_ms FROM files)""")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import incremental

    files = v.files(spark, d)
    return incremental.tombstoned(files, files.where("file_id % 50 = 3"), 99).select("file_id", "freshness_state", "deleted_at_unix_ms")


@query(v.with_(v.FILES_SQL) + """
, fresh AS (SELECT file_id, size_bytes + 1 AS size_bytes, content_hash, CAST(2 AS BIGINT) AS version FROM files WHERE file_id % 4 = 1 UNION ALL SELECT file_id + 1000000, size_bytes, content_hash, 1 FROM files WHERE file_id % 100 = 0)
SELECT file_id, size_bytes, version FROM fresh UNION ALL SELECT file_id, size_bytes, 1 FROM files WHERE file_id NOT IN (SELECT file_id FROM fresh)""")
def upserted_files(spark: SparkSession, d: str) -> DataFrame:
    old = v.files(spark, d).select("file_id", "size_bytes", F.lit(1).cast("bigint").alias("version"))
    new = old.where("file_id % 4 = 1").select("file_id", (F.col("size_bytes") + 1).alias("size_bytes"), F.lit(2).cast("bigint").alias("version")).unionByName(old.where("file_id % 100 = 0").withColumn("file_id", F.col("file_id") + 1_000_000))
    return sinks.upserted(old, new, ["file_id"], "version")


@query(v.with_(v.SYMBOLS_SQL) + """
SELECT symbol_id, file_id, name FROM symbols WHERE file_id % 10 <> 0 UNION ALL SELECT symbol_id, file_id, upper(name) FROM symbols WHERE file_id % 10 = 0 AND exported AND file_id IN (SELECT file_id FROM symbols WHERE exported)
UNION ALL SELECT symbol_id, file_id, name FROM symbols s WHERE file_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM symbols x WHERE x.file_id = s.file_id AND x.exported)""")
def replaced_facts(spark: SparkSession, d: str) -> DataFrame:
    s = v.symbols(spark, d).select("symbol_id", "file_id", "name", "exported")
    facts = s.where("file_id % 10 = 0 and exported").withColumn("name", F.upper("name"))
    return sinks.replaced(s, facts).select("symbol_id", "file_id", "name")


@query(v.with_(v.CHUNKS_SQL, v.FILES_SQL) + "SELECT chunk_id FROM chunks JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d)
    return sinks.cascaded({"chunks": v.chunks(spark, d)}, files.where("deleted_at_unix_ms is not null"))["chunks"].select("chunk_id")


AUDIT_SQL = """
tool AS (SELECT event_id AS id, timestamp, (['called', 'succeeded', 'failed', 'other'])[k % 4 + 1] AS status FROM telemetry WHERE kind = 'click' ORDER BY timestamp DESC, event_id LIMIT 300),
skill AS (SELECT event_id AS id, timestamp FROM telemetry WHERE kind = 'purchase' ORDER BY timestamp DESC, event_id LIMIT 300),
mcp AS (SELECT conv_id * 1000 + turn AS id, '2024-01-' || lpad(CAST(1 + conv_id % 30 AS VARCHAR), 2, '0') AS timestamp FROM conversations ORDER BY timestamp DESC, id LIMIT 300),
gate AS (SELECT doc_id AS id, '2024-02-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS timestamp, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS result, CASE WHEN toxic = 1 THEN 'unavailable' ELSE 'available' END AS availability FROM labels ORDER BY timestamp DESC, id LIMIT 300),
hook AS (SELECT event_id AS id, timestamp, (['allow', 'block', 'allow'])[k % 3 + 1] AS decision FROM telemetry WHERE kind = 'error' ORDER BY timestamp DESC, event_id LIMIT 300)"""
#: The values of each kind's columns.
AUDIT_DOMAINS = {
    ("tool", "status"): ["called", "succeeded", "failed", "required_but_missing"],
    ("hook", "decision"): ["allow", "block", "modify"],
    ("gate", "result"): ["pass", "fail", "not_run"],
    ("gate", "availability"): ["available", "unavailable", "not_configured"],
}


def audit_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = v.telemetry(spark, d).withColumnRenamed("event_id", "id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    day = lambda month, by, n: F.concat(F.lit(f"2024-{month}-"), F.lpad((1 + by % n).cast("string"), 2, "0"))
    turns, labels = v.table(spark, d, "conversations"), v.table(spark, d, "labels")
    return {
        "tool": t.where("kind = 'click'").select("id", "timestamp", pick(("called", "succeeded", "failed", "other"), F.col("k") % 4).alias("status")),
        "skill": t.where("kind = 'purchase'").select("id", "timestamp"),
        "mcp": turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), day("01", F.col("conv_id"), 30).alias("timestamp")),
        "gate": labels.select(F.col("doc_id").alias("id"), day("02", F.col("doc_id"), 28).alias("timestamp"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("result"), F.when(F.col("toxic") == 1, "unavailable").otherwise("available").alias("availability")),
        "hook": t.where("kind = 'error'").select("id", "timestamp", pick(("allow", "block", "allow"), F.col("k") % 3).alias("decision")),
    }


@query(v.with_(v.TELEMETRY_SQL, AUDIT_SQL) + " UNION ALL ".join([f"SELECT 'size' AS measure, '{k}' AS value, count(*) AS n FROM {k}" for k in ("tool", "skill", "mcp", "gate", "hook")] + [f"SELECT '{k}.{c}', value, count({c}) FROM (SELECT unnest({values}) AS value) LEFT JOIN {k} ON {c} = value GROUP BY value" for (k, c), values in AUDIT_DOMAINS.items()]))
def audit_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return sessions.audit_snapshot(audit_parts(spark, d), AUDIT_DOMAINS, 300)


@query(v.with_(v.TELEMETRY_SQL, AUDIT_SQL) + "SELECT kind, id, timestamp FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, id, timestamp FROM {k}" for k in ("tool", "skill", "mcp", "gate", "hook")) + ") ORDER BY timestamp DESC, kind, id LIMIT 100")
def audit_timeline(spark: SparkSession, d: str) -> DataFrame:
    return sessions.timeline([rows.select(F.lit(k).alias("kind"), "id", "timestamp") for k, rows in audit_parts(spark, d).items()], 100)


@query(v.with_(v.TELEMETRY_SQL) + """
, lanes AS (SELECT session_id, strategy AS lane, max(ts) AS updated, min(ts) AS created FROM telemetry GROUP BY ALL)
SELECT lane, session_id FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY updated DESC, created DESC, session_id) AS k FROM lanes) WHERE k = 1""")
def latest_session_by_lane(spark: SparkSession, d: str) -> DataFrame:
    lanes = v.telemetry(spark, d).groupBy("session_id", F.col("strategy").alias("lane")).agg(F.max("ts").alias("updated"), F.min("ts").alias("created"))
    return windows.latest(lanes, ["lane"], [F.desc("updated"), F.desc("created"), F.col("session_id")]).select("lane", "session_id")


@query(v.with_(v.TELEMETRY_SQL) + """
SELECT session_id, count_if(kind = 'click') AS clicks, count_if(kind = 'error') AS errors, arg_max(CASE WHEN k % 5 = 0 THEN kind || ':' || k END, CASE WHEN k % 5 = 0 THEN {'a': timestamp, 'b': kind || ':' || k} END) AS summary
FROM telemetry GROUP BY session_id""")
def session_show(spark: SparkSession, d: str) -> DataFrame:
    t = v.telemetry(spark, d)
    summaries = t.where("k % 5 = 0").select("session_id", F.col("timestamp").alias("updated"), F.concat_ws(":", "kind", "k").alias("text"))
    return sessions.shown(t, {"clicks": t.where("kind = 'click'"), "errors": t.where("kind = 'error'")}, summaries)


@query(v.with_(v.TELEMETRY_SQL) + """
, lines AS (SELECT session_id, count(*) AS entries, sum(octet_length(encode(kind || ' ' || k))) AS bytes FROM telemetry GROUP BY session_id),
late AS (SELECT session_id, sum(octet_length(encode('{"seq":' || event_id || ',"event":"' || timestamp || '"}'))) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS r FROM telemetry) WHERE r <= 5 GROUP BY session_id)
SELECT session_id, entries, entries > 40 OR bytes + extra > 420 AS overflow, CASE WHEN entries > 40 OR bytes + extra > 420 THEN greatest(entries - 20, 0) ELSE 0 END AS dropped FROM lines JOIN late USING (session_id)""")
def session_compaction_with_events(spark: SparkSession, d: str) -> DataFrame:
    t = v.telemetry(spark, d)
    lines = t.select("session_id", F.col("event_id").alias("seq"), F.concat_ws(" ", "kind", "k").alias("line"))
    events = t.select("session_id", F.col("event_id").alias("seq"), F.col("timestamp").alias("event"))
    return sessions.compacted(lines, 40, 420, events, 5).select("session_id", "entries", "overflow", F.col("dropped").cast("bigint").alias("dropped"))


@query(v.with_(v.FILES_SQL) + """
, asks AS (SELECT file_id AS question_id, CASE WHEN file_id % 3 = 0 THEN 1 - root_id ELSE root_id END AS root_id, rel_path FROM files)
SELECT question_id, f.file_id FROM asks a LEFT JOIN files f ON a.root_id = f.root_id AND a.rel_path = f.rel_path""")
def files_by_key(spark: SparkSession, d: str) -> DataFrame:
    """By root and path; every third asks in the other root."""
    files = v.files(spark, d)
    asks = files.select(F.col("file_id").alias("question_id"), F.when(F.col("file_id") % 3 == 0, 1 - F.col("root_id")).otherwise(F.col("root_id")).alias("root_id"), "rel_path")
    return lookup.by_keys(files.select("root_id", "rel_path", "file_id"), asks, ["root_id", "rel_path"]).select("question_id", "file_id")
