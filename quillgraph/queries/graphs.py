"""Graph queries: batches of seeds through frontier loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import views as v
from quillgraph.operators import graph, joins
from quillgraph.registry import query


def seeds(rows: DataFrame, key: str, kind: str, every: int = 100) -> DataFrame:
    """Every row whose id is divisible by 100 as a seed: the questions of a batch, at any size."""
    return rows.where(F.col(key) % every == 0).select(F.col(key).alias("seed"), F.lit(kind).alias("node_kind"), F.col(key).alias("node_id"))


def walk_sql(seed: str, step: str, hops: int) -> str:
    """Nodes by least depth, by a recursion that drops repeated (seed, node, depth)."""
    return f"""
walk(seed, nk, id, depth) AS (
    {seed} UNION SELECT w.seed, s.bk, s.b, w.depth + 1 FROM walk w JOIN steps s ON w.nk = s.ak AND w.id = s.a WHERE w.depth < {hops}),
near AS (SELECT seed, nk AS node_kind, id AS node_id, min(depth) AS depth FROM walk GROUP BY seed, nk, id)""".replace("steps", step)


OUT = "outs AS (SELECT DISTINCT from_kind AS ak, from_id AS a, to_kind AS bk, to_id AS b FROM edges)"
BOTH = "boths AS (SELECT from_kind AS ak, from_id AS a, to_kind AS bk, to_id AS b FROM edges UNION SELECT to_kind, to_id, from_kind, from_id FROM edges)"
CALLS_IN = "callers AS (SELECT DISTINCT to_kind AS ak, to_id AS a, from_kind AS bk, from_id AS b FROM edges WHERE kind = 'calls')"
CALLS_OUT = "callees AS (SELECT DISTINCT from_kind AS ak, from_id AS a, to_kind AS bk, to_id AS b FROM edges WHERE kind = 'calls')"
SYMBOL_SEEDS = "SELECT symbol_id, 'symbol', symbol_id, 0 FROM symbols WHERE symbol_id % {} = 0"
FILE_SEEDS = "SELECT file_id, 'file', file_id, 0 FROM files WHERE file_id % {} = 0"


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + """
, live AS (SELECT symbol_id FROM symbols JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL)
SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM symbols) AS nodes, (SELECT count(*) FROM edges) AS persisted_edges, 2 * (SELECT count(*) FROM live) AS synthetic_edges""")
def hydration_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.hydration_stats(v.edges(spark, d), v.symbols(spark, d), v.files(spark, d))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + """
, every_edge AS (
    SELECT kind, from_kind, from_id, to_kind, to_id, resolution, line FROM edges
    UNION ALL SELECT 'contains', 'file', file_id, 'symbol', symbol_id, 'resolved', line_start FROM symbols JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL
    UNION ALL SELECT 'definition', 'symbol', symbol_id, 'file', file_id, 'resolved', line_start FROM symbols JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL)
SELECT * FROM every_edge""")
def hydrated_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.hydrated(v.edges(spark, d), v.symbols(spark, d), v.files(spark, d))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL) + """
, n AS (SELECT symbol_id AS node_id FROM symbols),
o AS (SELECT node_id, count(from_id) AS c FROM n LEFT JOIN edges ON from_kind = 'symbol' AND from_id = node_id GROUP BY node_id),
i AS (SELECT node_id, count(to_id) AS c FROM n LEFT JOIN edges ON to_kind = 'symbol' AND to_id = node_id GROUP BY node_id)
SELECT node_id, least(o.c, 3) AS n_out, least(i.c, 3) AS n_in, o.c >= 3 OR i.c >= 3 AS truncated FROM o JOIN i USING (node_id)""")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes = v.symbols(spark, d).select(F.lit("symbol").alias("node_kind"), F.col("symbol_id").alias("node_id"))
    return graph.neighbours(v.edges(spark, d), nodes, 3).drop("node_kind")


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, CALLS_IN, walk_sql(SYMBOL_SEEDS.format(100), "callers", 2)) + "SELECT seed, node_id, depth FROM near WHERE depth > 0")
def callers_2hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_closure(v.edge_rows(spark, d), seeds(v.symbols(spark, d), "symbol_id", "symbol"), 2, "incoming").select("seed", "node_id", "depth")


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, CALLS_OUT, walk_sql(SYMBOL_SEEDS.format(100), "callees", 3)) + "SELECT seed, node_id, depth FROM near WHERE depth > 0")
def callees_3hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_closure(v.edge_rows(spark, d), seeds(v.symbols(spark, d), "symbol_id", "symbol"), 3, "outgoing").select("seed", "node_id", "depth")


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, CALLS_IN, walk_sql(SYMBOL_SEEDS.format(100), "callers", 3)) + """
, named AS (SELECT seed, node_id, 'src1/' AS mark, rel_path, name FROM near JOIN symbols ON node_id = symbol_id JOIN files USING (file_id) WHERE depth > 0)
SELECT seed, node_id, CASE WHEN contains('api/' || rel_path, 'routes/') OR contains(replace(rel_path, 'src1/', 'api/'), 'api/') THEN 'api_route'
    WHEN starts_with('cli_' || name, 'cli_red') THEN 'cli_command' ELSE 'event_handler' END AS entry_kind FROM named
WHERE contains(rel_path, 'src1/') OR name IN ('red', 'green')""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Files of one source stand for routes, red symbols for commands, green ones for handlers."""
    callers = graph.call_closure(v.edge_rows(spark, d), seeds(v.symbols(spark, d), "symbol_id", "symbol"), 3, "incoming")
    files = v.files(spark, d).withColumn("rel_path", F.replace("rel_path", F.lit("src1/"), F.lit("api/")))
    name = F.when(F.col("name") == "red", "cli_red").when(F.col("name") == "green", "green_handler").otherwise(F.col("name"))
    return graph.entry_points(callers, v.symbols(spark, d).withColumn("name", name), files).select("seed", "node_id", "entry_kind")


@query(v.with_(v.EDGES_SQL, v.FILES_SQL, BOTH, walk_sql(FILE_SEEDS.format(100), "boths", 2)) + """
SELECT seed, node_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node_kind, node_id) AS k FROM near) WHERE k <= 30""")
def undirected_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(v.edge_rows(spark, d), seeds(v.files(spark, d), "file_id", "file"), 2, 30).select("seed", "node_id", "depth")


@query(v.with_(v.EDGES_SQL, v.FILES_SQL, OUT, walk_sql(FILE_SEEDS.format(100), "outs", 3)) + "SELECT seed, node_id, depth FROM near")
def outgoing_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.frontier(v.edge_rows(spark, d), seeds(v.files(spark, d), "file_id", "file"), 3, "outgoing").select("seed", "node_id", "depth")


@query(v.with_(v.EDGES_SQL, v.FILES_SQL, BOTH, walk_sql(FILE_SEEDS.format(100), "boths", 3)) + """
SELECT seed, node_id, CASE WHEN depth <= 1 THEN 'direct' ELSE 'transitive' END AS category, CASE WHEN depth <= 1 THEN 1 ELSE 2 END AS distance FROM near""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(v.edge_rows(spark, d), seeds(v.files(spark, d), "file_id", "file"), 3).select("seed", "node_id", "category", "distance")


def paths_sql(pairs: str, hops: int, steps: str = "edges") -> str:
    """The least shortest path of each (pair, a, b) of ``pairs``: distances to its end, then the least next node at each step."""
    return f"""
asked AS ({pairs}),
steps AS (SELECT DISTINCT from_kind || ':' || from_id AS a, to_kind || ':' || to_id AS b FROM {steps}),
back(pair, node, dist) AS (
    SELECT pair, 'symbol:' || b, 0 FROM asked UNION SELECT k.pair, s.a, k.dist + 1 FROM back k JOIN steps s ON s.b = k.node WHERE k.dist < {hops}),
far AS (SELECT pair, node, min(dist) AS dist FROM back GROUP BY pair, node),
trail(pair, node, togo, path) AS (
    SELECT pair, 'symbol:' || a, dist, ['symbol:' || a] FROM asked JOIN far USING (pair) WHERE node = 'symbol:' || a
    UNION ALL SELECT t.pair, min(s.b), t.togo - 1, list_append(t.path, min(s.b)) FROM trail t JOIN steps s ON s.a = t.node JOIN far f ON f.pair = t.pair AND f.node = s.b AND f.dist = t.togo - 1
        WHERE t.togo > 0 GROUP BY t.pair, t.node, t.togo, t.path)"""


#: Each hundredth symbol to another one.
PAIRS_SQL = "SELECT symbol_id AS pair, symbol_id AS a, (symbol_id * 7 + 10) % (SELECT parts FROM sizes) AS b FROM symbols WHERE symbol_id % 100 = 0"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    s = v.symbols(spark, d).join(v.sizes(spark, d), F.lit(True)).where("symbol_id % 100 = 0")
    return s.select(F.col("symbol_id").alias("pair"), F.lit("symbol").alias("from_kind"), F.col("symbol_id").alias("from_id"), F.lit("symbol").alias("to_kind"), ((F.col("symbol_id") * 7 + 10) % F.col("parts")).alias("to_id"))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, paths_sql(PAIRS_SQL, 5)) + "SELECT pair, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, ' ') AS path FROM trail WHERE togo = 0")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(v.edge_rows(spark, d), pairs(spark, d), 5).select("pair", "hops", F.array_join("path", " ").alias("path"))


HYDRATED_SQL = """
walkable AS (
    SELECT from_kind, from_id, to_kind, to_id FROM edges
    UNION ALL SELECT 'file', file_id, 'symbol', symbol_id FROM symbols JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL
    UNION ALL SELECT 'symbol', symbol_id, 'file', file_id FROM symbols JOIN files USING (file_id) WHERE deleted_at_unix_ms IS NULL)"""


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, HYDRATED_SQL, paths_sql(PAIRS_SQL, 4, "walkable")) + "SELECT pair, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, ' ') AS path FROM trail WHERE togo = 0")
def hydrated_path(spark: SparkSession, d: str) -> DataFrame:
    """Over stored and synthetic edges."""
    edges = graph.hydrated(v.edge_rows(spark, d), v.symbols(spark, d), v.files(spark, d))
    return graph.shortest_paths(edges, pairs(spark, d), 4).select("pair", "hops", F.array_join("path", " ").alias("path"))


#: From each hundredth symbol's name to another symbol's, and to a name that nothing has.
TRACES_SQL = """
firsts AS (SELECT name, min(symbol_id) AS id FROM symbols GROUP BY name),
names AS (SELECT s.symbol_id AS pair, s.name AS n1, CASE WHEN s.symbol_id % 500 = 0 THEN 'nothing' ELSE o.name END AS n2 FROM symbols s JOIN sizes ON true JOIN symbols o ON o.symbol_id = (s.symbol_id * 3 + 11) % parts WHERE s.symbol_id % 100 = 0),
ends AS (SELECT pair, x.id AS a, y.id AS b FROM names LEFT JOIN firsts x ON x.name = n1 LEFT JOIN firsts y ON y.name = n2)"""
TRACE_SQL = (
    TRACES_SQL
    + ","
    + paths_sql("SELECT pair, a, b FROM ends WHERE a IS NOT NULL AND b IS NOT NULL", 4)
    + """,
done AS (SELECT pair, path, len(path) - 1 AS hops FROM trail WHERE togo = 0),
hop AS (SELECT pair, i AS hop, path[i + 1] AS x, path[i + 2] AS y FROM (SELECT pair, path, unnest(range(0, hops)) AS i FROM done)),
step AS (SELECT pair, hop, x, y, min({'weak': resolution <> 'resolved', 'kind': kind, 'resolution': resolution, 'line': line}) AS e
    FROM hop JOIN edges ON from_kind || ':' || from_id = x AND to_kind || ':' || to_id = y GROUP BY ALL),
label AS (SELECT 'file:' || file_id AS node, rel_path AS label, rel_path AS file FROM files UNION ALL SELECT 'symbol:' || symbol_id, qualified_name, rel_path FROM symbols LEFT JOIN files USING (file_id))"""
)


def traces(spark: SparkSession, d: str) -> DataFrame:
    s = v.symbols(spark, d)
    other = s.select(F.col("symbol_id").alias("o"), F.col("name").alias("n2"))
    asked = s.join(v.sizes(spark, d), F.lit(True)).where("symbol_id % 100 = 0").withColumn("o", (F.col("symbol_id") * 3 + 11) % F.col("parts")).join(other, "o")
    asked = asked.select(F.col("symbol_id").alias("pair"), F.col("name").alias("from_name"), F.when(F.col("symbol_id") % 500 == 0, "nothing").otherwise(F.col("n2")).alias("to_name"))
    return graph.trace_paths(v.edge_rows(spark, d), s, asked, 4)


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, TRACE_SQL) + """
SELECT pair, CAST(hop AS INTEGER) AS hop, coalesce(p.label, x) AS from_label, coalesce(q.label, y) AS to_label, p.file AS from_file, q.file AS to_file, e.kind AS edge_kind, e.resolution AS resolution, e.line AS line,
    CASE WHEN e.weak THEN 'partial' ELSE 'grounded' END AS confidence
FROM step LEFT JOIN label p ON p.node = x LEFT JOIN label q ON q.node = y""")
def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace_hops(traces(spark, d), v.edges(spark, d), v.symbols(spark, d), v.files(spark, d))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, TRACE_SQL) + """
, weak AS (SELECT pair, count_if(e.weak) AS weak FROM step GROUP BY pair)
SELECT pair, CASE WHEN a IS NULL OR b IS NULL OR hops IS NULL THEN 'insufficient' WHEN weak > 0 THEN 'partial' ELSE 'grounded' END AS answer_state,
    CASE WHEN a IS NULL OR b IS NULL THEN 'missing_endpoint' WHEN hops IS NULL THEN 'path_not_found' END AS stop_reason, CAST(coalesce(hops, 0) AS INTEGER) AS hop_count
FROM ends LEFT JOIN done USING (pair) LEFT JOIN weak USING (pair)""")
def trace_states(spark: SparkSession, d: str) -> DataFrame:
    paths = traces(spark, d)
    return graph.trace_states(paths, graph.trace_hops(paths, v.edges(spark, d), v.symbols(spark, d), v.files(spark, d)))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + "".join(f"""
{start} every_{name} AS (
    SELECT {near}_kind AS nk, {near}_id AS id, 0 AS late, kind, {far}_kind AS other_kind, {far}_id AS other_id, resolution FROM edges
    UNION ALL SELECT 'file', file_id, 1, '{k1}', 'symbol', symbol_id, 'resolved' FROM symbols
    UNION ALL SELECT 'symbol', symbol_id, 1, '{k2}', 'file', file_id, 'resolved' FROM symbols)""" for start, name, near, far, k1, k2 in ((",", "out", "from", "to", "contains", "definition"), (",", "in", "to", "from", "definition", "contains"))) + """
SELECT direction, nk AS node_kind, id AS node_id, CAST(seq AS INTEGER) AS seq, kind, other_kind, other_id, resolution FROM (
    SELECT *, row_number() OVER (PARTITION BY direction, nk, id ORDER BY late, kind, other_kind, other_id) AS seq FROM (SELECT 'outgoing' AS direction, * FROM every_out UNION ALL SELECT 'incoming', * FROM every_in)) WHERE seq <= 8 AND id % 100 = 0""")
def direct_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = seeds(v.files(spark, d), "file_id", "file").unionByName(seeds(v.symbols(spark, d), "symbol_id", "symbol"))
    both = None
    for way in ("outgoing", "incoming"):
        one = graph.direct_edges(v.edges(spark, d), v.symbols(spark, d), nodes, 8, way).select(F.lit(way).alias("direction"), "node_kind", "node_id", "seq", "kind", "other_kind", "other_id", "resolution")
        both = one if both is None else both.unionByName(one)
    return both


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + """
SELECT to_id AS symbol_id, qualified_name AS from_name, rel_path, line FROM edges JOIN symbols ON from_id = symbol_id JOIN files USING (file_id)
WHERE edges.kind = 'references' AND NOT contains(lower(rel_path), 'test')""")
def references(spark: SparkSession, d: str) -> DataFrame:
    return graph.references(v.edges(spark, d), v.symbols(spark, d), v.files(spark, d)).select(F.col("to_id").alias("symbol_id"), "from_name", "rel_path", "line")


@query(v.with_(v.EDGES_SQL) + """
SELECT DISTINCT to_kind AS node_kind, to_id AS node_id, from_id FROM edges WHERE (to_kind = 'file' AND kind IN ('imports', 're_exports')) OR (to_kind = 'symbol' AND kind = 'references')""")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    files = v.files(spark, d).select(F.lit("file").alias("node_kind"), F.col("file_id").alias("node_id"))
    symbols = v.symbols(spark, d).select(F.lit("symbol").alias("node_kind"), F.col("symbol_id").alias("node_id"))
    return graph.dependents(v.edges(spark, d), files.unionByName(symbols)).select("node_kind", "node_id", "from_id")


@query(v.with_(v.EDGES_SQL, v.FILES_SQL) + "SELECT from_id, coalesce(rel_path, resolution) AS label, kind FROM edges LEFT JOIN files ON to_id = file_id WHERE kind IN ('imports', 're_exports')")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(v.edges(spark, d), v.files(spark, d), v.symbols(spark, d)).select("from_id", "label", "kind")


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + """
, n AS (SELECT from_kind AS node_kind, from_id AS node_id FROM edges UNION SELECT 'chunk', file_id FROM files)
SELECT node_kind, node_id, coalesce(CASE WHEN node_kind = 'file' THEN rel_path WHEN node_kind = 'symbol' THEN qualified_name END, node_kind || ':' || node_id) AS label
FROM n LEFT JOIN files ON node_kind = 'file' AND node_id = file_id LEFT JOIN symbols ON node_kind = 'symbol' AND node_id = symbol_id""")
def node_labels(spark: SparkSession, d: str) -> DataFrame:
    files, symbols = v.files(spark, d), v.symbols(spark, d)
    nodes = v.edges(spark, d).select(F.col("from_kind").alias("node_kind"), F.col("from_id").alias("node_id")).distinct()
    nodes = nodes.unionByName(files.select(F.lit("chunk").alias("node_kind"), F.col("file_id").alias("node_id")))
    return joins.labelled_nodes(nodes, files, symbols).select("node_kind", "node_id", "label")


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL) + """
, best AS (SELECT file_id FROM files ORDER BY size_bytes DESC, file_id LIMIT 5),
o AS (SELECT to_id, row_number() OVER (PARTITION BY from_id ORDER BY kind, to_id) AS k FROM edges JOIN best ON from_kind = 'file' AND from_id = file_id),
f AS (SELECT file_id, min(symbol_id) AS symbol_id FROM symbols GROUP BY file_id)
SELECT DISTINCT to_id AS file_id, symbol_id, CAST(0.62 AS DOUBLE) AS score FROM o LEFT JOIN f ON to_id = f.file_id WHERE k <= 2""")
def expanded_results(spark: SparkSession, d: str) -> DataFrame:
    results = v.files(spark, d).select("file_id", F.col("size_bytes").alias("score"))
    out = graph.expand_results(results, v.edges(spark, d), v.symbols(spark, d))
    return out.withColumn("score", F.col("score").cast("double"))


@query("""
WITH RECURSIVE items AS (SELECT o_orderkey AS item FROM orders), needs AS (
    SELECT item, item // 3 AS needs FROM items WHERE item % 2 = 0 AND item >= 6
    UNION SELECT item, CASE WHEN item % 97 = 0 THEN item + 1 ELSE item - 1 END FROM items WHERE item % 97 IN (0, 1) AND item > 1
    UNION SELECT item, -item FROM items WHERE item % 101 = 0),
stuck(item) AS (
    SELECT item FROM needs WHERE needs NOT IN (SELECT item FROM items)
    UNION SELECT a.item FROM needs a JOIN needs b ON a.needs = b.item AND b.needs = a.item
    UNION SELECT n.item FROM stuck s JOIN needs n ON n.needs = s.item),
depth(item, k) AS (
    SELECT item, 0 FROM items WHERE item NOT IN (SELECT item FROM stuck)
    UNION SELECT n.item, d.k + 1 FROM depth d JOIN needs n ON n.needs = d.item WHERE n.item NOT IN (SELECT item FROM stuck))
SELECT item, max(k) AS layer FROM depth GROUP BY item UNION ALL SELECT DISTINCT item, NULL FROM stuck""")
def work_layers(spark: SparkSession, d: str) -> DataFrame:
    """Orders that wait for others: chains, cycles of two, and needs that are not there."""
    items = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    return graph.layers(items, order_needs(items))


def order_needs(items: DataFrame) -> DataFrame:
    k = F.col("item")
    return (
        items.where((k % 2 == 0) & (k >= 6)).select("item", F.floor(k / 3).alias("needs"))
        .unionByName(items.where((k % 97).isin(0, 1) & (k > 1)).select("item", F.when(k % 97 == 0, k + 1).otherwise(k - 1).alias("needs")))
        .unionByName(items.where(k % 101 == 0).select("item", (-k).alias("needs")))
    )


@query("""
WITH RECURSIVE items AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN 'done' WHEN o_orderkey % 7 = 0 THEN 'in_progress' ELSE 'pending' END AS status FROM orders), needs AS (
    SELECT item, item // 3 AS needs FROM items WHERE item % 2 = 0 AND item >= 6
    UNION SELECT item, CASE WHEN item % 97 = 0 THEN item + 1 ELSE item - 1 END FROM items WHERE item % 97 IN (0, 1) AND item > 1
    UNION SELECT item, -item FROM items WHERE item % 101 = 0),
lost AS (SELECT DISTINCT n.item FROM needs n JOIN items i ON n.item = i.item AND i.status = 'pending' WHERE n.needs NOT IN (SELECT item FROM items)),
able AS (SELECT item FROM items WHERE status = 'pending' AND item NOT IN (SELECT item FROM lost)),
free AS (SELECT * FROM needs WHERE item IN (SELECT item FROM able) AND needs IN (SELECT item FROM able)),
stuck(item) AS (SELECT a.item FROM free a JOIN free b ON a.needs = b.item AND b.needs = a.item UNION SELECT n.item FROM stuck s JOIN free n ON n.needs = s.item),
depth(item, k) AS (SELECT item, 0 FROM able WHERE item NOT IN (SELECT item FROM stuck) UNION SELECT n.item, d.k + 1 FROM depth d JOIN free n ON n.needs = d.item WHERE n.item NOT IN (SELECT item FROM stuck)),
placed AS (SELECT item, max(k) AS layer FROM depth GROUP BY item)
SELECT item, CASE WHEN layer = 0 THEN 'ready' ELSE 'waiting' END AS state, NULL AS reason, layer, CASE WHEN item % 4 = 0 THEN 'serial:' || item WHEN item % 4 = 1 THEN 'solo:' || item ELSE 'batch' || (item % 10) END AS batch FROM placed
UNION ALL SELECT DISTINCT item, 'blocked', 'cycle', NULL, NULL FROM stuck UNION ALL SELECT item, 'blocked', 'missing_need', NULL, NULL FROM lost""")
def work_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as work items: some are done or under way, a quarter runs alone, a quarter has no batch."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "done").when(k % 7 == 0, "in_progress").otherwise("pending")
    items = v.table(spark, d, "orders").select(k.alias("item"), status.alias("status"), (k % 4 != 0).alias("parallel"), F.when(k % 4 != 1, F.concat(F.lit("batch"), k % 10)).alias("batch"))
    return graph.planned(items, order_needs(items.select("item")))


@query(v.with_(v.EDGES_SQL, v.FILES_SQL) + """
, imp AS (SELECT from_id, to_id FROM edges WHERE kind = 'imports'),
up(id, depth) AS (SELECT file_id, 0 FROM files WHERE file_id % 100 = 0 UNION SELECT from_id, depth + 1 FROM up JOIN imp ON to_id = id WHERE depth < 4)
SELECT id AS file_id, min(depth) AS depth FROM up GROUP BY id""")
def dependent_closure(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import incremental

    return incremental.dependents_of(v.edges(spark, d).where("kind = 'imports'"), v.files(spark, d).where("file_id % 100 = 0"), 4)


@query(v.with_(v.EDGES_SQL, v.FILES_SQL) + """
SELECT DISTINCT from_id AS file_id FROM edges JOIN files ON to_id = file_id WHERE kind = 'imports' AND file_id % 100 = 0 AND from_id NOT IN (SELECT file_id FROM files WHERE file_id % 100 = 0)""")
def structural_invalidation(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import incremental

    return incremental.direct_dependents(v.edges(spark, d).where("kind = 'imports'"), v.files(spark, d).where("file_id % 100 = 0"))


CAPPED_SQL = """
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_kind, from_id ORDER BY kind, to_kind, to_id) AS k FROM edges) WHERE k <= 6),
cap_outs AS (SELECT DISTINCT from_kind AS ak, from_id AS a, to_kind AS bk, to_id AS b FROM capped)"""


@query(v.with_(v.EDGES_SQL, v.FILES_SQL, CAPPED_SQL, walk_sql(FILE_SEEDS.format(100), "cap_outs", 2)) + """
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node_kind, node_id) AS k FROM near) WHERE k <= 25),
lines AS (SELECT DISTINCT seed, kind, from_kind, from_id, to_kind, to_id FROM kept JOIN capped ON node_kind = from_kind AND node_id = from_id WHERE depth < 2)
SELECT seed, least(count(*), 25) AS nodes, (SELECT count(*) FROM lines l WHERE l.seed = near.seed) AS edges, count(*) >= 25 OR max(depth) = 2 AS truncated FROM near GROUP BY seed""")
def bounded_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounded_neighbourhood(v.edges(spark, d), seeds(v.files(spark, d), "file_id", "file"), 2, 25, 6)[2]


@query(v.with_(v.EDGES_SQL, v.FILES_SQL, CAPPED_SQL, walk_sql(FILE_SEEDS.format(100), "cap_outs", 2)) + """
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node_kind, node_id) AS k FROM near) WHERE k <= 25)
SELECT DISTINCT seed, kind, from_id, to_id FROM kept JOIN capped ON node_kind = from_kind AND node_id = from_id WHERE depth < 2""")
def bounded_neighborhood_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounded_neighbourhood(v.edges(spark, d), seeds(v.files(spark, d), "file_id", "file"), 2, 25, 6)[1].select("seed", "kind", "from_id", "to_id")


ALL_SQL = """
every_edge AS (SELECT from_kind, from_id, to_kind, to_id FROM edges UNION ALL SELECT 'file', file_id, 'symbol', symbol_id FROM symbols),
mixed AS (SELECT from_kind AS ak, from_id AS a, to_kind AS bk, to_id AS b FROM every_edge UNION SELECT to_kind, to_id, from_kind, from_id FROM every_edge)"""


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, ALL_SQL, walk_sql(FILE_SEEDS.format(100), "mixed", 2)) + """
SELECT seed, node_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node_id) AS k FROM near WHERE node_kind = 'file') WHERE k <= 20""")
def file_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Over edges of all kinds and what files contain; only files stay."""
    edges, symbols = v.edges(spark, d), v.symbols(spark, d)
    inside = symbols.select(F.lit("contains").alias("kind"), F.lit("file").alias("from_kind"), F.col("file_id").alias("from_id"), F.lit("symbol").alias("to_kind"), F.col("symbol_id").alias("to_id"))
    rows = edges.select(*inside.columns).unionByName(inside)
    return graph.neighbourhood(rows, seeds(v.files(spark, d), "file_id", "file"), 2, 20, "both", "file").select("seed", "node_id", "depth")


FOUND_SQL = """
firsts AS (SELECT name, min(symbol_id) AS id FROM symbols GROUP BY name),
asks AS (SELECT symbol_id AS question_id, CASE WHEN symbol_id % 200 = 0 THEN symbol_id ELSE id END AS sid FROM symbols LEFT JOIN firsts USING (name) WHERE symbol_id % 100 = 0
    UNION ALL SELECT -1, NULL),
refs AS (SELECT question_id, sid AS symbol_id, from_id, qualified_name AS from_name, rel_path, line, row_number() OVER (PARTITION BY question_id ORDER BY rel_path, line, from_id) AS seq
    FROM asks JOIN edges ON to_id = sid AND edges.kind = 'references' JOIN symbols ON from_id = symbols.symbol_id JOIN files USING (file_id) WHERE NOT contains(lower(rel_path), 'test'))"""


def asked_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth symbol, half of them by id and half by name alone, and a name that nothing has."""
    s = v.symbols(spark, d).where("symbol_id % 100 = 0")
    asks = s.select(F.col("symbol_id").alias("question_id"), F.when(F.col("symbol_id") % 200 == 0, F.col("symbol_id")).alias("symbol_id"), "name")
    return asks.unionByName(spark.createDataFrame([(-1, None, "nothing")], "question_id bigint, symbol_id bigint, name string"))


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, FOUND_SQL) + "SELECT question_id, CAST(seq AS INTEGER) AS seq, symbol_id, from_id, from_name, rel_path, line FROM refs WHERE seq <= 7")
def found_references(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_references(v.edges(spark, d), v.symbols(spark, d), v.files(spark, d), asked_symbols(spark, d), 7)[0]


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, v.FILES_SQL, FOUND_SQL) + """
SELECT a.question_id, CASE WHEN count(seq) = 0 THEN 'insufficient' WHEN count(seq) >= 7 THEN 'partial' ELSE 'grounded' END AS answer_state, count(seq) AS n FROM asks a LEFT JOIN refs r ON a.question_id = r.question_id AND seq <= 7 GROUP BY a.question_id""")
def found_reference_states(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_references(v.edges(spark, d), v.symbols(spark, d), v.files(spark, d), asked_symbols(spark, d), 7)[1]


@query(v.with_(v.EDGES_SQL, v.SYMBOLS_SQL, CALLS_IN, CALLS_OUT, walk_sql(SYMBOL_SEEDS.format(100), "callers", 2).replace("walk", "walk_in").replace("near", "near_in"), walk_sql(SYMBOL_SEEDS.format(100), "callees", 2).replace("walk", "walk_out").replace("near", "near_out")) + """
SELECT seed, side, CAST(seq AS INTEGER) AS seq, node_id, depth FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY depth, node_id) AS seq FROM (SELECT 'callers' AS side, * FROM near_in UNION ALL SELECT 'callees', * FROM near_out) WHERE depth > 0) WHERE seq <= 9""")
def call_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_hierarchy(v.edges(spark, d), seeds(v.symbols(spark, d), "symbol_id", "symbol"), 2, 9).select("seed", "side", "seq", "node_id", "depth")
