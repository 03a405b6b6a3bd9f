"""Tables that change together, and only where files changed."""

import pytest
from pyspark.sql import functions as F
from quillgraph.sources import versions


def tables(spark, ids, mark):
    files = spark.createDataFrame([(k, f"{mark}{k}") for k in ids], "file_id int, name string")
    facts = spark.createDataFrame([(k, n, f"{mark}") for k in ids for n in range(3)], "file_id int, n int, fact string")
    return {"files": files, "facts": facts}


def rows(spark, root, name, version=None):
    return sorted(map(tuple, versions.read(spark, root, name, version).collect()))


def test_all_tables_change_or_none(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert versions.latest(spark, root) is None
    first = versions.begin(spark, root, tables(spark, range(100), "a"), buckets=16)
    assert versions.latest(spark, root) == first and len(rows(spark, root, "facts")) == 300
    changed = spark.createDataFrame([(3,), (50,), (200,)], "file_id int")
    second = versions.replace(spark, root, tables(spark, [3, 200, 77], "b"), changed)
    want = sorted([(k, f"a{k}") for k in range(100) if k not in (3, 50)] + [(3, "b3"), (200, "b200")])
    assert rows(spark, root, "files") == want and rows(spark, root, "files", first) == sorted((k, f"a{k}") for k in range(100))
    assert {r[0] for r in rows(spark, root, "facts") if r[2] == "b"} == {3, 200} and len(rows(spark, root, "facts")) == 300
    moved = [b for b in second.tables["files"]["folders"] if second.tables["files"]["folders"][b] != first.tables["files"]["folders"].get(b)]
    assert 1 <= len(moved) <= 3
    # the second table fails: readers keep the version before, in both tables
    broken = tables(spark, [3], "c")
    broken["facts"] = broken["facts"].withColumn("fact", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.replace(spark, root, broken, changed.where("file_id = 3"))
    assert versions.latest(spark, root) == second and rows(spark, root, "files") == want
    third = versions.replace(spark, root, tables(spark, [], "d"), changed)
    assert third.number == 3 and {r[0] for r in rows(spark, root, "files")} == set(range(100)) - {3, 50}
    with pytest.raises(versions.Conflict):
        versions._commit(spark, root, third)
    empty = versions.replace(spark, f"file://{tmp_path}/none", tables(spark, [], "e"), None)
    assert empty.number == 1 and rows(spark, f"file://{tmp_path}/none", "files") == []
