"""Operators on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F
from quillgraph import schema
from quillgraph.functions import text as tx
from quillgraph.functions.vectors import cosine, seeded_vector
from quillgraph.operators import aggregates, evidence, extract, graph, incremental, joins, link, lookup, sessions, vector, windows
from quillgraph.plans import answer
from quillgraph.sources import sinks, workspace
from quillgraph.streaming import telemetry


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.fixture(scope="module")
def small(spark):
    """Two files, two symbols: run in main calls and references helper in util."""
    files = spark.createDataFrame(
        [(1, 1, "src/main.ts", "refreshed_current", None), (2, 1, "src/util.ts", "refreshed_current", None)],
        "file_id bigint, root_id bigint, rel_path string, freshness_state string, deleted_at_unix_ms bigint",
    )
    symbols = spark.createDataFrame(
        [(10, 1, "function", "run", "run", True, 1, 3), (11, 2, "function", "helper", "helper", True, 1, 2)],
        "symbol_id bigint, file_id bigint, kind string, name string, qualified_name string, exported boolean, line_start int, line_end int",
    )
    edges = spark.createDataFrame(
        [("imports", "file", 1, "file", 2, "resolved", 1), ("references", "symbol", 10, "symbol", 11, "resolved", 2), ("calls", "symbol", 10, "symbol", 11, "resolved", 2)],
        schema.EDGES,
    )
    return files, symbols, edges


def seeds(spark, *rows):
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(rows)], "seed bigint, node_kind string, node_id bigint")


def test_two_file_graph(spark, small):
    files, symbols, edges = small
    assert lookup.goto_definition(symbols, files, "helper").first().rel_path == "src/util.ts"
    assert [r.rel_path for r in graph.references(edges, symbols, files).collect()] == ["src/main.ts"]
    assert [r.label for r in graph.dependencies(edges, files, symbols).collect()] == ["src/util.ts"]
    target = spark.createDataFrame([("file", 2)], "node_kind string, node_id bigint")
    assert [r.from_id for r in graph.dependents(edges, target).collect()] == [1]
    assert [r.node_id for r in graph.call_closure(edges, seeds(spark, ("symbol", 10)), 2, "outgoing").collect()] == [11]
    assert graph.hydrated(edges, symbols, files).count() == 3 + 4
    assert graph.hydration_stats(edges, symbols, files).first().asDict() == {"nodes": 4, "persisted_edges": 3, "synthetic_edges": 4}


def test_answers(spark, small):
    t = answer.Tables(*small)
    assert answer.answer("where is `helper` defined", t).first().detail == "src/util.ts:1"
    assert [r.label for r in answer.answer("what does it import in `src/main.ts`", t).collect()] == ["src/util.ts"]
    assert [r.label for r in answer.answer("which files depend on `src/util.ts`", t).collect()] == ["src/main.ts"]
    assert [r.label for r in answer.answer("who uses `helper`", t).collect()] == ["run"]


def test_kinds_do_not_collide(spark):
    edges = spark.createDataFrame([("imports", "file", 1, "symbol", 2, "resolved", 1), ("calls", "symbol", 1, "symbol", 3, "resolved", 1)], schema.EDGES)
    near = graph.frontier(edges, seeds(spark, ("file", 1)), 3)
    assert sorted((r.node_kind, r.node_id, r.depth) for r in near.collect()) == [("file", 1, 0), ("symbol", 2, 1)]


def test_shortest_path_and_directions(spark):
    edges = spark.createDataFrame([("calls", "symbol", a, "symbol", b, "resolved", 1) for a, b in ((1, 2), (2, 3), (1, 3), (3, 4), (4, 1))], schema.EDGES)
    pairs = spark.createDataFrame([(0, "symbol", 1, "symbol", 4), (1, "symbol", 2, "symbol", 2), (2, "symbol", 4, "symbol", 9)], "pair bigint, from_kind string, from_id bigint, to_kind string, to_id bigint")
    got = {r.pair: (r.hops, list(r.path)) for r in graph.shortest_paths(edges, pairs, 5).collect()}
    assert got == {0: (2, ["symbol:1", "symbol:3", "symbol:4"]), 1: (0, ["symbol:2"])}
    assert graph.directed(edges, "sideways").count() == 0
    assert graph.frontier(edges, seeds(spark, ("symbol", 1)), 9, "incoming").count() == 4


def test_layers_with_cycle(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "item bigint")
    needs = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3)], "item bigint, needs bigint")
    assert {r["item"]: r.layer for r in graph.layers(items, needs).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None}


def test_vector_fixture(spark):
    rows = [(999, [1.0, 0.0, 0.0]), (1000, [0.0, 1.0, 0.0]), (1001, [0.7, 0.7, 0.0]), (1002, [0.2, 0.8, 0.0]), (1003, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>")
    got = [(r.chunk_id, round(r.score, 4)) for r in vector.exact_scan(df, [0.6, 0.8, 0.0], 4).collect()]
    assert got == [(1001, 0.9899), (1002, 0.9216), (1000, 0.8), (999, 0.6)]
    assert vector.search(df, [1.0], 3, 4, -1.0).count() == 0
    assert [r.chunk_id for r in vector.indexed_scan(df, [0.6, 0.8, 0.0], 3, 0.9).collect()] == [1001, 1002]
    bad = one(spark, a=cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), b=cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    assert (bad.a, bad.b) == (0.0, 0.0)


def test_seeded_vectors(spark):
    r = one(spark, a=seeded_vector(F.lit("x"), 8), b=seeded_vector(F.lit("x"), 8), c=seeded_vector(F.lit("y"), 8))
    assert r.a == r.b != r.c and abs(sum(x * x for x in r.a) - 1) < 1e-9


def test_token_estimates(spark):
    r = one(spark, a=tx.tokens_by_chars(F.lit("")), b=tx.tokens_by_chars(F.lit("abcd")), c=tx.tokens_by_chars(F.lit("x" * 100)), d=tx.tokens_by_bytes(F.lit("")), e=tx.tokens_by_words(F.lit(" a  b ")))
    assert tuple(r) == (0, 1, 25, 1, 2)


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 71))), (2, "a"), (3, " \n ")], "file_id bigint, content string")
    got = sorted((r.file_id, r.line_start, r.line_end) for r in extract.window_chunks(df).collect())
    assert got == [(1, 1, 60), (1, 53, 70), (2, 1, 1)]


def test_symbol_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 16)))], "file_id bigint, content string")
    s = spark.createDataFrame([(1, 5, 3, 10)], "file_id bigint, symbol_id bigint, line_start int, line_end int")
    got = sorted((r.line_start, r.line_end, r.symbol_id) for r in extract.symbol_chunks(df, s).collect())
    assert got == [(1, 2, None), (3, 10, 5), (11, 15, None)]
    assert extract.header_chunks(df, s).first().content == "l1\nl2"


SOURCE = """import { a } from './a'
import './side'
export { b } from "../b"
const lazy = import('./lazy')
export class Box {
  open() { return helper(this.size) }
}
export async function run(x) {
  const y = new Box()
  return y.open()
}
type Id = string
"""


def test_extraction(spark):
    rows = [(1, "typescript", SOURCE), (2, "python", "from os import path\nimport re\n\nclass A:\n    def _b(self):\n        return re.sub('a', 'b', path)\n"), (3, "go", 'package x\nimport "fmt"\nfunc Run() { fmt.Println(1) }\ntype T struct{}\n'), (4, "rust", "use std::fs;\npub fn read() {}\nstruct S;\n")]
    files = spark.createDataFrame(rows, "file_id bigint, language string, content string")
    found = {(r.file_id, r.kind, r.name, r.exported) for r in extract.symbols(files).collect()}
    assert {(1, "class", "Box", True), (1, "function", "run", True), (1, "type", "Id", False), (2, "class", "A", True), (2, "function", "_b", False), (3, "function", "Run", True), (3, "type", "T", True), (4, "function", "read", True), (4, "struct", "S", False)} <= found
    imports = {(r.file_id, r.kind, r.specifier) for r in extract.imports(files).collect()}
    assert {(1, "esm", "./a"), (1, "side_effect", "./side"), (1, "reexport", "../b"), (1, "dynamic", "./lazy"), (2, "from", "os"), (2, "import", "re"), (3, "import", "fmt"), (4, "use", "std::fs")} <= imports
    calls = {(r.file_id, r.name, r.call_kind) for r in extract.calls(files).collect()}
    assert {(1, "helper", "direct"), (1, "open", "method"), (2, "sub", "method"), (3, "Println", "method")} <= calls and (1, "run", "direct") not in calls
    refs = {(r.file_id, r.name, r.reference_kind) for r in extract.references(files).collect()}
    assert {(1, "Box", "type"), (1, "y", "write"), (2, "path", "read")} <= refs


def test_grep(spark):
    files = spark.createDataFrame([("src/a.ts", "Foo\nbar foo"), ("src/b.py", "foo"), ("c.ts", "x\0foo")], "rel_path string, content string")
    got = extract.grep(files, "foo", "src/**/*.ts", 1).collect()
    assert [(r.rel_path, r.line, r.truncated) for r in got] == [("src/a.ts", 1, True)]


def test_module_resolution(spark):
    files = spark.createDataFrame([(1, 1, "a/main.ts"), (2, 1, "a/util.ts"), (3, 2, "lib/index.ts"), (4, 1, "a/b/c.js")], "file_id bigint, root_id bigint, rel_path string")
    asked = [(1, "./util"), (1, "../lib"), (1, "./b/../b/c"), (1, "./nope"), (1, "react"), (1, ""), (1, "`x`"), (1, "@lib/index")]
    imports = spark.createDataFrame(asked, "file_id bigint, specifier string").join(files, "file_id")
    aliases = spark.createDataFrame([("@lib/*", "lib/*")], "pattern string, target string")
    got = {r.specifier: (r.status, r.target_file_id, float(r.confidence)) for r in link.resolve_imports(imports, files, aliases).collect()}
    assert got == {"./util": ("resolved", 2, 1.0), "../lib": ("resolved", 3, 0.9), "./b/../b/c": ("resolved", 4, 1.0), "./nope": ("missing", None, 0.0), "react": ("external", None, 0.0), "": ("empty", None, 0.0), "`x`": ("dynamic", None, 0.0), "@lib/index": ("resolved", 3, 0.9)}
    name, inner = link.package_of(F.lit("@a/b/c/d"))
    assert tuple(one(spark, n=name, i=inner)) == ("@a/b", "c/d")


def test_relink(spark):
    symbols = spark.createDataFrame([(1, "x", 5, True)], "symbol_id bigint, name string, file_id bigint, exported boolean")
    edges = spark.createDataFrame([(7, 5, None, "unresolved", '{"name":"x"}'), (8, 5, 3, "resolved", "{}")], "edge_id bigint, file_id bigint, symbol_id bigint, status string, payload_json string")
    imported = spark.createDataFrame([], "file_id bigint, target_file_id bigint")
    assert sorted((r.edge_id, r.symbol_id, r.status) for r in link.relink(edges, symbols, imported).collect()) == [(7, 1, "resolved"), (8, 3, "resolved")]


def test_dirty_plan_levels(spark):
    cols = "root_id bigint, rel_path string, content_hash string, size_bytes bigint, mtime_unix_ms bigint"
    before = spark.createDataFrame([(1, "a.ts", "h", 1, 1), (1, "b.ts", "h", 1, 1), (1, "tsconfig.json", "h", 1, 1), (2, "a.ts", "h", 1, 1)], cols).withColumn("deleted_at_unix_ms", F.lit(None).cast("bigint"))
    now = spark.createDataFrame([(1, "a.ts", "h", 1, 2), (1, "tsconfig.json", "x", 1, 1), (2, "a.ts", "z", 1, 1), (1, "n.ts", "n", 1, 1)], cols)
    plan = {(r.root_id, r.rel_path): r.level for r in incremental.dirty_plan(before, now).collect()}
    assert plan == {(1, "b.ts"): "deleted", (1, "tsconfig.json"): "resolution_scope", (2, "a.ts"): "content_only", (1, "n.ts"): "content_only"}
    touched = now.where("rel_path = 'a.ts' and root_id = 1")
    assert incremental.dirty_plan(before, now, touched=touched).count() == 5
    assert {r.level for r in incremental.dirty_plan(before, now, forced=True).collect()} == {"deleted", "resolution_scope"}
    assert incremental.to_hash(before, now).count() == 2
    assert incremental.workspace_changes(before.limit(0), now).first().status == "first_run"
    assert incremental.workspace_changes(now.withColumn("deleted_at_unix_ms", F.lit(None).cast("bigint")), now).first().status == "fresh"


def test_freshness_ladder(spark):
    files = spark.createDataFrame([("refreshed_current",), ("degraded_partial",)], "freshness_state string")
    state = lambda s, a: spark.createDataFrame([(s, a)], "status string, active_run_id string")
    said = lambda f, s: aggregates.index_freshness(f, s).first().freshness
    assert said(files.limit(0), state("completed", None)) == "cold"
    assert said(files, state("completed", None).limit(0)) == "cold"
    assert said(files, state("completed", "r")) == "stale"
    assert said(files, state("completed", None)) == "partial"
    assert said(files.limit(1).where("freshness_state like 'refreshed%'"), state("completed", None)) == "current"


def test_percentile_and_parity(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (5, 1, 3, 2)] + [(2, None)], "g int, x double")
    assert {r.g: (r.p50, r.p100) for r in aggregates.nearest_rank_of(df, "x", [50, 100], ["g"]).collect()} == {1: (3.0, 5.0)}
    counts = spark.createDataFrame([("s", 4, 3), ("s", 1, 2), ("t", 0, 0)], "fact string, expected int, actual int")
    assert {r.fact: r.parity for r in aggregates.parity(counts).collect()} == {"s": 66.666667, "t": 100.0}


def test_text_rules(spark):
    assert tx.glob_pattern("a/**/b?.*") == r"^a/(?:.*/)?b[^/]\.[^/]*$"
    r = one(spark, a=tx.subject_terms(F.lit("How does the Parser.parse work with parser.parse and lib/x?")), b=tx.unsupported_class(F.lit("Could break it?")), c=tx.command_category(F.lit("  ")), d=tx.command_category(F.lit("cat a.PY")), e=tx.retry_delay(F.lit(9)), f=tx.retryable(F.lit("network"), F.lit(None).cast("int")), g=tx.retryable(F.lit("x"), F.lit(503)), h=tx.scanned_language(F.lit("web/node_modules/x.ts")), i=tx.scanned_language(F.lit("tsconfig.base.json")))
    assert tuple(r) == (["Parser.parse", "lib/x"], "impact_analysis", None, "file-read", 8000, True, True, None, "unknown")


def test_sessions(spark):
    rows = [("s1", i, "blocker: x" if i % 5 == 0 else f"line {i}") for i in range(1, 15)] + [("s2", 1, "only")]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, line string")
    got = {r.session_id: r for r in sessions.compacted(df).collect()}
    assert got["s1"].overflow and got["s1"].dropped == 8 and got["s1"].tail[-1] == "line 14" and len(got["s1"].blockers) == 2
    assert not got["s2"].overflow and got["s2"].tail == ["only"]
    messages = spark.createDataFrame([("s1", 1, "apiToken", "x"), ("s1", 2, "note", "see s1"), ("s1", 3, "path", "/home/me/a")], "session_id string, seq bigint, key string, value string")
    out = sessions.exported(messages, ["/home/"])
    assert [m["value"] for m in out.first().messages] == ["[REDACTED_SECRET]", "see s1", "[REDACTED_PATH]"]
    assert sessions.imported(out).count() == 3
    assert {r.value for r in sessions.forked(messages, "s1", "s9").collect()} == {"x", "see s9", "/home/me/a"}
    more, less = sessions.line_diff(F.lit("a\nb\nc"), F.lit("a\nx\ny\nc"))
    assert tuple(one(spark, a=more, b=less)) == (2, 1)
    history = spark.createDataFrame([("s", 1, "plan", "pass"), ("s", 2, "code", "fail"), ("s", 3, "review", "pass")], "session_id string, seq int, stage string, gate string")
    assert [r.valid for r in sessions.valid_steps(history, ["plan", "code", "review"]).orderBy("seq").collect()] == [True, True, False]


def test_evidence_cap_before_sort(spark):
    rows = spark.createDataFrame([(1, i, f"k{i}", "storage", i / 10, "partial") for i in range(5)], "question_id int, o int, k string, source string, score double, confidence string")
    kept = evidence.capped(rows, ["k"], ["o"], 3)
    assert {r.k for r in kept.collect()} == {"k0", "k1", "k2"}
    asked = spark.createDataFrame([(1, None), (2, None), (3, "trace")], "question_id int, unsupported string")
    assert {r.question_id: r.state for r in evidence.verdicts(asked, kept, 5).collect()} == {1: "partial", 2: "insufficient", 3: "unsupported"}
    assert evidence.budget("files", 99) == 20 and evidence.budget("files") == 5


def test_stale_and_enclosing(spark):
    points = spark.createDataFrame([(1, 5), (1, 99)], "file_id bigint, p int")
    spans = spark.createDataFrame([(1, 7, 0, 70), (1, 8, 4, 6)], "file_id bigint, symbol_id bigint, line_start int, line_end int")
    got = {r.p: r.symbol_id for r in joins.enclosing(points, spans, "file_id", "p", "line_start", "line_end", "symbol_id").collect()}
    assert got == {5: 8, 99: None}


def test_domain_check(spark):
    df = spark.createDataFrame([("current?",)], "freshness_state string")
    with pytest.raises(Exception, match="invalid value"):
        schema.decoded(df, "freshness_state", schema.FRESHNESS).collect()


def test_scan_and_telemetry(spark, tmp_path):
    for name, body in (("src/a.ts", "export const x = 1"), ("src/b.md", "no"), ("node_modules/z.js", "no"), ("lib/c.py", "y = 2")):
        (tmp_path / "ws" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "ws" / name).write_text(body)
    files = workspace.scan(spark, str(tmp_path / "ws"))
    assert [(r.rel_path, r.language) for r in files.collect()] == [("lib/c.py", "python"), ("src/a.ts", "typescript")]
    assert workspace.scan_report(files).first().files == 2
    (tmp_path / "log").mkdir()
    good = {"kind": "semantic_search", "timestamp": "2024-01-01T00:00:00Z", "metrics": {"durationMs": 1.5, "strategy": "flat"}}
    (tmp_path / "log" / "t.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    read = workspace.read_telemetry(spark, str(tmp_path / "log"))
    assert [r.kind for r in read.collect()] == ["semantic_search"]
    workspace.append_telemetry(read, str(tmp_path / "log2"))
    assert workspace.read_telemetry(spark, str(tmp_path / "log2")).count() == 1


def test_bucketed_overwrite(spark, tmp_path):
    path = str(tmp_path / "facts")
    sinks.write_bucketed(spark.createDataFrame([(1, 0), (2, 1)], "x int, bucket int"), path)
    sinks.write_bucketed(spark.createDataFrame([(9, 1)], "x int, bucket int"), path)
    assert sorted(r.x for r in sinks.read_bucketed(spark, path).collect()) == [1, 9]


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = telemetry.read_events(spark, str(tmp_path / "in"), table, "40 days", 1)
    done = telemetry.rolled_up(stream).writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    done.awaitTermination(120)
    batch = telemetry.rolled_up(table.withColumn("at", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_dirty_plan(spark, tmp_path):
    cols = "root_id bigint, rel_path string, content_hash string, size_bytes bigint, mtime_unix_ms bigint"
    before = spark.createDataFrame([(1, "a.ts", "h", 1, 1)], cols).withColumn("deleted_at_unix_ms", F.lit(None).cast("bigint"))
    spark.createDataFrame([(1, "a.ts", "new", 1, 2)], cols).write.parquet(str(tmp_path / "in"))
    seen = []
    changes = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    telemetry.apply_changes(changes, lambda df, _: seen.extend(r.level for r in incremental.dirty_plan(before, df).collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == ["content_only"]


def test_window_helpers(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (2, 3, 0.9)], "k int, seq int, score double")
    assert [r.seq for r in windows.dedupe_by_score(df, ["k"], 5).collect()] == [2, 3]
    assert sinks.upserted(df, spark.createDataFrame([(1, 9, 0.1)], df.schema), ["k"], "seq").count() == 2
