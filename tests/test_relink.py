"""Relinking by what uses ask: as many rows wait as different questions, and repeated uses all keep their edges."""

from collections import Counter

from quillgraph.operators import link

FILES = "file_id bigint, rel_path string, root_id bigint"
SYMBOLS = "symbol_id bigint, file_id bigint, name string, exported boolean"
IMPORTS = "file_id bigint, specifier string, local_name string, imported_name string, is_reexport boolean, line int"
USES = "use_id bigint, file_id bigint, caller_id bigint, name string, qualified string, line int"


def workspace(spark, times, names):
    files = spark.createDataFrame([(k, f"src/f{k}.ts", 0) for k in range(12)], FILES)
    symbols = spark.createDataFrame([(100 + k, k, names[k % 3], True) for k in range(12)], SYMBOLS)
    imports = spark.createDataFrame([(k, f"./f{(k + 1) % 12}", *(("red", "red"), ("ns", "*"), ("blue", None))[k % 3], k % 5 == 0, k) for k in range(12)], IMPORTS)
    asked = [(k, name, qualified) for k in range(12) for name, qualified in (("red", "red"), ("green", "ns.green"), ("blue", None), ("nothing", ""))]
    # a use_id may come back with another name
    uses = spark.createDataFrame([(f * 10 + i % 2, f, None, n, q, i) for f, n, q in asked for i in range(times)], USES)
    imports, uses = link.with_origins(imports, uses, uses.limit(0))
    return {"files": files, "symbols": symbols, "imports": imports, "uses": uses}


def test_what_waits_does_not_grow_with_repeated_uses(spark):
    one, many = (workspace(spark, times, ("red", "green", "blue")) for times in (1, 40))
    count = lambda t: link.waiting(t["files"], t["imports"], t["uses"]).count()
    assert count(many) == count(one) > 0


def test_relinked_equals_linked_with_repeated_uses(spark):
    now = workspace(spark, 5, ("red", "green", "blue"))
    away, other = "file_id != 4", "file_id != 7"
    named = now["symbols"].selectExpr("symbol_id", "file_id", f"if({other}, name, 'green') as name", "exported")
    before = {"files": now["files"].where(away), "symbols": named.where(away), "imports": now["imports"].where(away).where(other), "uses": now["uses"].where(away)}
    edges = link.linked(*before.values())
    again = link.relinked(edges, before, now, now["files"].where(f"not ({away} and {other})").select("file_id"))
    whole = link.linked(*now.values())
    rows = lambda df: Counter(str(r) for r in df.drop("origin").collect())
    assert rows(again) == rows(whole) and again.count() == 12 + 12 * 4 * 5
