"""Nothing is cut: beyond former bounds, large groups, and methods against brute force."""

import hashlib
import math
import random
from collections import Counter, deque

import numpy as np
import oracle
import pytest
import quillgraph.queries  # noqa: F401
from pyspark.sql import functions as F
from quillgraph.functions.vectors import seeded_vector
from quillgraph.operators import aggregates, evidence, extract, fts, graph, incremental, joins, link, sessions, vector
from quillgraph.registry import QUERIES, SQL
from quillgraph.sources import workspace


def test_paths_of_any_length_and_depth(spark):
    long = "/".join(f"part{k}" for k in range(900)) + "/x.ts"
    deep = "a/" * 60 + "../" * 59 + "b//./c/"
    rows = [(1, long), (2, deep), (3, "../../x/../y"), (4, "./"), (5, "a/../../b")]
    df = spark.createDataFrame(rows, "k int, p string").select("k", link.normalised(F.col("p")).alias("n"))
    assert {r.k: r.n for r in df.collect()} == {1: long, 2: "a/b/c", 3: "../../y", 4: "", 5: "../b"}
    files = spark.createDataFrame([(7, long, 1)], "file_id bigint, rel_path string, root_id bigint")
    imports = spark.createDataFrame([(1, "m.ts", 1, "/" + long[:-3])], "file_id bigint, rel_path string, root_id bigint, specifier string")
    assert link.resolve_imports(imports, files).first().target_file_id == 7
    chunks = spark.createDataFrame([("/repo/" + long,), ("./" + long,)], "file_path string")
    assert {r.status for r in incremental.classify_paths(chunks, files, "/repo/").collect()} == {"convertible"}


def test_aliases_beyond_a_thousand(spark):
    aliases = spark.createDataFrame([(f"@p{k}/*", f"lib{k}/*") for k in range(1500)] + [("@p7/deep/*", "other/*"), ("*", "all/*"), ("@x/*/end", "mid/*")], "pattern string, target string")
    files = spark.createDataFrame([(k, f"lib{k}/a.ts", 1) for k in range(1500)] + [(5000, "other/a.ts", 1), (5001, "all/solo.ts", 1), (5002, "mid/m.ts", 2), (5003, "lib3/b.ts", 1), (5004, "lib3/b.ts", 2)], "file_id bigint, rel_path string, root_id bigint")
    asked = [(1, f"@p{k}/a") for k in (0, 999, 1000, 1499)] + [(1, "@p7/deep/a"), (1, "solo"), (1, "@x/m/end"), (1, "@p3/b")]
    imports = spark.createDataFrame([(f, "m.ts", 1, s) for f, s in asked], "file_id bigint, rel_path string, root_id bigint, specifier string")
    out = {r.specifier: (r.target_file_id, r.status) for r in link.resolve_imports(imports, files, aliases).collect()}
    assert out == {**{f"@p{k}/a": (k, "resolved") for k in (0, 999, 1000, 1499)}, "@p7/deep/a": (5000, "resolved"), "solo": (5001, "resolved"), "@x/m/end": (5002, "resolved"), "@p3/b": (None, "ambiguous")}


def test_closures_and_layers_of_any_depth(spark):
    edges = spark.createDataFrame([("imports", "file", k + 1, "file", k) for k in range(54)], "kind string, from_kind string, from_id bigint, to_kind string, to_id bigint")
    roots = spark.createDataFrame([(0,)], "file_id bigint")
    assert {r.file_id: r.depth for r in incremental.dependents_of(edges, roots).collect()} == {k: k for k in range(55)}
    items = spark.range(24).select(F.col("id").alias("item"))
    needs = items.where("item > 0").select("item", (F.col("item") - 1).alias("needs"))
    assert {r.item: r.layer for r in graph.layers(items, needs).collect()} == {k: k for k in range(24)}


def test_fingerprints_follow_content_alone(spark):
    lines = [(k % 2, f"line {k % 70}") for k in range(900)]
    df = spark.createDataFrame(lines, "g int, line string")
    told = lambda d: {r.g: (r.fingerprint, r.lines) for r in aggregates.fingerprint(d, F.col("line"), ["g"]).collect()}
    base = told(df.repartition(1))
    assert base == told(df.orderBy(F.desc("line")).repartition(7)) and base[0][1] == 450
    assert told(df.where("line != 'line 4'"))[0] != base[0] and told(df.where("line != 'line 4'"))[1] == base[1]
    # a repeat counts
    assert told(df.unionByName(df.where("line = 'line 4'").limit(1)))[0] != base[0]


def test_suffixes_meet_only_what_ends_alike(spark):
    files = spark.createDataFrame([(k, f"d{k}/index.ts") for k in range(50)] + [(99, "a/d7/index.js")], "file_id bigint, rel_path string")
    asks = spark.createDataFrame([(1, "../d7/index"), (2, "./index.ts"), (3, "nothing")], "ask int, specifier string")
    out = joins.suffix_matches(asks, files).groupBy("ask").agg(F.collect_set("file_id").alias("f")).collect()
    assert {r.ask: len(r.f) for r in out} == {1: 2, 2: 51}


@pytest.mark.parametrize("lookups", [0, 10**6])
def test_search_by_rarest_term_equals_brute_force(spark, monkeypatch, lookups):
    monkeypatch.setattr(fts, "BROADCAST_LOOKUPS", lookups)
    monkeypatch.setattr(fts, "SEGMENT", 10)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(25)]
    docs = {k: [rng.choice(words[: 4 + k % 22]) for _ in range(rng.randrange(1, 30))] for k in range(150)}
    asks = {k: rng.sample(words, rng.choice([1, 2, 3])) for k in range(30)} | {90: ["w1", "absent"], 91: []}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    want = {}
    for q, ts in asks.items():
        for k, d in docs.items():
            if ts and all(t in d for t in ts):
                want[q, k] = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in ts)
    chunks = spark.createDataFrame([(k, " ".join(d)) for k, d in docs.items()], "chunk_id int, content string")
    questions = spark.createDataFrame([(q, "; ".join(ts)) for q, ts in asks.items()], "question_id int, question string")
    out = {(r.question_id, r.chunk_id): r.score for r in fts.search(chunks, questions, 1000).collect()}
    assert out.keys() == want.keys() and all(out[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    strict = {r.question_id for r in fts.search(chunks, questions, 1000, strict=True).collect()}
    assert strict == {q for q, _ in want if len(asks[q]) == 1}
    best = {}
    for (q, k), s in sorted(want.items(), key=lambda x: (x[0][0], -round(x[1], 6), x[0][1])):
        best.setdefault(q, []).append(k)
    top = fts.search(chunks, questions, 2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id) for r in top] == [(q, k) for q in best for k in best[q][:2]]


def test_scan_in_blocks_equals_one_block(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    rows = lambda block: {tuple(r) for r in vector.batch_scan(vectors, asked, 5, block=block).collect()}
    assert rows(3) == rows(1000) and len(rows(1000)) == 5 * asked.count()


def test_buckets_leave_most_pairs_out_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    data = [(int(k), (centres[k % 40] + 0.3 * rng.standard_normal(32)).tolist()) for k in range(1600)]
    df = spark.createDataFrame(data, "chunk_id bigint, vector array<double>")
    asked = df.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id")
    how = {"tables": 8, "planes": 10, "probes": 4}
    exact = {(r.question_id, r.chunk_id) for r in vector.batch_scan(df, asked, 10).collect()}
    near = {(r.question_id, r.chunk_id) for r in vector.bucketed_search(df, asked, 32, 10, **how).collect()}
    share = vector.candidates(df, asked, 32, **how).count() / (asked.count() * 1600)
    assert len(exact & near) / len(exact) >= 0.9 and share < 0.2


def test_seeded_embeddings_of_whole_texts(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["seeded_embeddings"](spark, sf).collect()}
    again = spark.createDataFrame([(k, docs[k]) for k in list(docs)[:20]], "k bigint, t string").select("k", F.transform(seeded_vector(F.col("t"), 8), lambda x: F.round(x.cast("double"), 5)).alias("v"))
    for r in again.collect():
        assert out[r.k].vector == r.v and out[r.k].content_hash == hashlib.sha256(docs[r.k].encode()).hexdigest()
        assert sum(x * x for x in r.v) == pytest.approx(1, abs=1e-3)
    # texts that differ only at their ends differ
    ends = spark.createDataFrame([("x " * 400 + "a",), ("x " * 400 + "b",)], "t string").select(seeded_vector(F.col("t"), 8).alias("v")).collect()
    assert ends[0].v != ends[1].v


def test_paths_equal_a_breadth_first_search(spark):
    rng = random.Random(6)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    edges = spark.createDataFrame([("calls", "symbol", a, "symbol", b, rng.choice(["resolved", "unresolved"]), 1) for a, b in sorted(pairs)], "kind string, from_kind string, from_id bigint, to_kind string, to_id bigint, resolution string, line int")

    def hops(a, b):
        far, queue = {a: 0}, deque([a])
        while queue:
            x = queue.popleft()
            for y in [t for s, t in pairs if s == x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        return far.get(b)

    asked = [(k, "symbol", k, "symbol", (k * 7 + 3) % 40) for k in range(40)]
    out = {r.pair: r for r in graph.shortest_paths(edges, spark.createDataFrame(asked, "pair bigint, from_kind string, from_id bigint, to_kind string, to_id bigint"), 40).collect()}
    for k, *_, to in asked:
        want = hops(k, to)
        assert (want is None) == (k not in out)
        if want is not None:
            steps = [int(x.split(":")[1]) for x in out[k].path]
            assert out[k].hops == want == len(steps) - 1 and steps[0] == k and steps[-1] == to and set(zip(steps, steps[1:], strict=False)) <= pairs


def test_edges_of_a_node_in_order_up_to_the_limit(spark):
    edges = spark.createDataFrame([("imports", "file", 1, "file", k, "resolved") for k in (5, 3, 4)], "kind string, from_kind string, from_id bigint, to_kind string, to_id bigint, resolution string")
    symbols = spark.createDataFrame([(10, 1), (11, 1)], "symbol_id bigint, file_id bigint")
    nodes = spark.createDataFrame([("file", 1), ("symbol", 10), ("chunk", 1)], "node_kind string, node_id bigint")
    out = lambda n, way: [(r.node_kind, r.kind, r.other_id) for r in graph.direct_edges(edges, symbols, nodes, n, way).orderBy("node_kind", "seq").collect()]
    assert out(4, "outgoing") == [("file", "imports", 3), ("file", "imports", 4), ("file", "imports", 5), ("file", "contains", 10), ("symbol", "definition", 1)]
    assert out(1, "incoming") == [("file", "definition", 10), ("symbol", "contains", 1)]


def test_scopes_bindings_and_status_of_scripts(spark):
    code = "\n".join([
        "import d, { a as b, type c } from './m'", 'import * as ns from "pkg"', "export class Box<T> {", "  private items: T[] = [];", "  static async make(n) {", "    if (n) {",
        '      function deep() { return "}" }', "    }", "    return 1", "  }", "}", "export { x as y, z }", "exports.helper = 1", "function open() {",
    ])
    files = spark.createDataFrame([(1, "typescript", code), (2, "go", "}"), (3, None, "x"), (4, "python", None)], "file_id int, language string, content string")
    named = {r.qualified_name: (r.kind, r.line_start, r.line_end) for r in extract.scoped_symbols(files).collect()}
    assert named == {"Box": ("class", 3, 11), "Box.items": ("field", 4, 4), "Box.make": ("method", 5, 10), "Box.make.deep": ("function", 7, 7), "open": ("function", 14, 14)}
    bound = {(r.local_name, r.imported_name) for r in extract.bindings(files).collect()}
    assert bound == {("d", "default"), ("b", "a"), ("c", "c"), ("ns", "*")}
    assert {(r.kind, r.name) for r in extract.exports(files).collect()} == {("named", "Box"), ("list", "y"), ("list", "z"), ("commonjs", "helper")}
    assert {r.file_id: (r.status, r.diagnostics) for r in extract.parse_status(files).collect()} == {1: ("parsed_with_errors", "1 blocks not closed"), 2: ("parsed_with_errors", "unexpected } in line 1"), 3: ("skipped", None), 4: ("skipped", None)}


def test_guards_of_built_evidence(spark):
    asks = spark.createDataFrame([(1, "explain", None, 1), (2, "other", None, 1), (3, "explain", "trace", 1), (4, "explain", None, 0), (5, "explain", None, 2)], "question_id int, intent string, unsupported string, targets int")
    targets = spark.createDataFrame([(q, 0, "t") for q in (1, 2, 3)] + [(5, 0, "none"), (5, 1, "u")], "question_id int, target_seq int, target string")
    rows = spark.createDataFrame([("t", 1, "k1", 1.0, "grounded"), ("t", 2, "k1", 0.5, "partial"), ("u", 1, "k2", 0.5, "partial")], "target string, row_seq int, key string, score double, confidence string")
    kept, states = evidence.built(asks, evidence.target_candidates(targets, [("storage", rows), ("query", rows)]), 5, 8)
    assert {r.question_id: (r.answer_state, r.evidence) for r in states.collect()} == {1: ("grounded", 1), 2: ("unsupported", 0), 3: ("unsupported", 0), 4: ("insufficient", 0), 5: ("partial", 1)}
    assert {(r.question_id, r.key, r.source) for r in kept.collect()} == {(1, "k1", "storage"), (5, "k2", "storage")}


def test_ignore_lines_and_bounds_of_a_scan(spark, tmp_path):
    root = tmp_path / "ws"
    names = ["a.ts", "b.ts", "big.ts", "dist/x.ts", "src/dist/y.ts", "src/gen/z.ts", "src/gen/keep.ts", "deep/1/2/3/d.ts", "note.txt", "node_modules/m.ts"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * (500 if name == "big.ts" else 5))
    ignore = ["# made", "", "dist/", "/src/gen/*", "!keep.ts"]
    files, report = workspace.bounded_scan(spark, str(root), ignore, max_depth=3, max_bytes=100)
    assert [r.rel_path for r in files.collect()] == ["a.ts", "b.ts", "src/gen/keep.ts"]
    assert report.first().asDict() == {"visited": 10, "indexed": 3, "ignored": 3, "other": 2, "too_deep": 1, "too_large": 1, "stop_reason": "file_too_large"}
    few, report = workspace.bounded_scan(spark, str(root), max_files=2)
    assert few.count() == 2 and report.first().stop_reason == "file_limit" and report.first().indexed == 2


def test_sessions_are_exported_in_parts(spark):
    rows = [("s", k, "note", f"v{k}") for k in range(25)] + [("t", 0, "token", "x")]
    messages = spark.createDataFrame(rows, "session_id string, seq int, key string, value string")
    out = sessions.exported(messages, [], 10)
    assert {(r.session_id, r.part, len(r.messages)) for r in out.collect()} == {("s", 0, 10), ("s", 1, 10), ("s", 2, 5), ("t", 0, 1)}
    assert sessions.imported(out).where("session_id = 's'").orderBy("seq").select("value").collect() == [(f"v{k}",) for k in range(25)]


def test_scopes_of_python_and_imports_of_go(spark):
    python = "\n".join(["@wrapped", "class A(B):", "    x = 1", "", "    @property", "    def top(self):", "        def inner(): return 1", "        return inner", "    class C:", "        async def go(self): pass", "def _main():", "    pass", ""])
    go = "\n".join(["package p", 'import "one"', "import (", '  "two/x"', '  y "three"', ")", "const s = `", '"four"', '  "five"', "`", 'import z "six"'])
    files = spark.createDataFrame([(1, "python", python), (2, "go", go)], "file_id int, language string, content string")
    named = {r.qualified_name: (r.kind, r.line_start, r.line_end, r.exported) for r in extract.scoped_symbols(files).collect()}
    assert named == {"A": ("class", 2, 10, True), "A.top": ("method", 6, 8, True), "A.top.inner": ("function", 7, 7, True), "A.C": ("class", 9, 10, True), "A.C.go": ("method", 10, 10, True), "_main": ("function", 11, 12, False)}
    assert [r.specifier for r in extract.imports(files).where("file_id = 2").orderBy("line").collect()] == ["one", "two/x", "three", "six"]


def test_tiles_equal_pairs(spark, monkeypatch):
    """Copies, zeros, nulls and other sizes: the tiles give what native expressions give pair by pair, and no pair is a row of the plan."""
    rng = random.Random(5)
    rows = [(k, [float(rng.choice([-2, -1, 0, 1, 3])) for _ in range(3)]) for k in range(120)]
    rows += [(200, None), (201, [1.0]), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [])]
    df = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>").repartition(3)
    asked = df.where("chunk_id % 10 = 0 or chunk_id > 199").withColumnRenamed("chunk_id", "question_id")
    pairs = df.join(asked.withColumnRenamed("vector", "q"), F.col("chunk_id") != F.col("question_id")).select("question_id", "chunk_id", F.round(vector.cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r.question_id, []).append((r.score is None, -(r.score or 0.0), r.chunk_id))
    monkeypatch.setattr(vector, "TILE", 7)
    out = vector.batch_scan(df, asked, 6)
    got = {}
    for r in out.collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.chunk_id))
    assert {q: [c for _, c in sorted(v)] for q, v in got.items()} == {q: [c for *_, c in sorted(v)[:6]] for q, v in want.items()}
    sound = df.where("size(vector) = 3 and chunk_id < 120 and vector != array(0f, 0f, 0f)")
    plan = vector.batch_scan(sound, sound.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "question_id"), 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    near = vector.bucketed_search(sound, sound.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "question_id"), 3, 6, tables=4, planes=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in near


def test_ledgers_and_evidence_are_dealt_by_question(spark, monkeypatch):
    """What a task sorts is bounded: rows go by question to as many tasks as their number asks for."""
    from quillgraph import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    rows = spark.range(2000).selectExpr("id % 40 AS question_id", "concat('p', id % 9) AS path", "1 AS line_start", "2 AS line_end", "'s' AS source", "cast(id % 7 AS double) AS score", "id AS order")
    kept, told = evidence.ledger(rows, "small")
    assert "RepartitionByExpression [question_id" in kept._jdf.queryExecution().optimizedPlan().toString() and kept.rdd.getNumPartitions() == 40
    assert {(r.question_id, r.entries) for r in told.collect()} == {(q, 4) for q in range(40)}
    asks = spark.range(40).selectExpr("id AS question_id", "'explain' AS intent", "cast(null AS string) AS unsupported", "1 AS targets")
    met = evidence.target_candidates(spark.range(40).selectExpr("id AS question_id", "0 AS target_seq", "'hot' AS target"), [("query", spark.range(50).selectExpr("'hot' AS target", "id AS row_seq", "concat('k', id) AS key", "0.5 AS score", "'partial' AS confidence"))])
    made, states = evidence.built(asks, met, 5, 8)
    assert made.rdd.getNumPartitions() == 40
    assert {tuple(r) for r in states.collect()} == {(q, "partial", 40) for q in range(40)}


def test_built_evidence_counts_all_that_there_is(spark):
    """Definitions beyond 30 of a name and rows beyond 40 of a question count; keys that targets share count once a question, as the first of them says."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["built_evidence"](spark, sf)
    assert oracle.spark_rows(out) == oracle.sql_rows(oracle.connection(sf), SQL["built_evidence"]) and out.agg({"evidence": "max"}).first()[0] > 200
    rng = random.Random(7)
    asks = spark.createDataFrame([(q, rng.choice(["explain"] * 5 + ["trace"]), rng.choice([None] * 5 + ["x"]), 1) for q in range(60)], "question_id int, intent string, unsupported string, targets int")
    targets = spark.createDataFrame([(q, k, rng.choice(["t", "u", "v", "w", None])) for q in range(60) for k in range(q % 4)], "question_id int, target_seq int, target string")
    some = lambda n: [(rng.choice("tuvw"), k, rng.choice([None, *(f"k{x}" for x in range(150))]), 1.0, rng.choice(["grounded"] * 40 + ["partial"])) for k in range(n)]
    sources = [(name, spark.createDataFrame(some(n), "target string, row_seq int, key string, score double, confidence string")) for name, n in (("storage", 120), ("query", 60))]
    want = evidence.built(asks, evidence.target_candidates(targets, sources), 1000, 1000)[1]
    got = evidence.judged(asks, targets, sources)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.agg({"evidence": "max"}).first()[0] > 40


def test_built_evidence_makes_no_row_of_a_question_and_a_candidate(spark):
    asks = spark.range(300).selectExpr("id AS question_id", "'explain' AS intent", "cast(null AS string) AS unsupported", "1 AS targets")
    rows = spark.range(700).selectExpr("'hot' AS target", "id AS row_seq", "concat('k', id) AS key", "0.5 AS score", "'grounded' AS confidence")
    out = evidence.judged(asks, spark.range(300).selectExpr("id AS question_id", "0 AS target_seq", "'hot' AS target"), [("query", rows)])
    assert {tuple(r)[1:] for r in out.collect()} == {("grounded", 700)}
    made, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
    assert made and max(made) <= 700
