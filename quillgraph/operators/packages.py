"""Entries of packages: ``exports`` maps with conditions and patterns, entry fields, and the file that a specifier reaches."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.link import ENDINGS, normalised, package_of

# what runs in tasks travels by value, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Conditions that hold, and entry fields in order.
CONDITIONS = ["import", "require", "node", "types", "default"]
ENTRY_FIELDS = ["types", "module", "main"]
_RESULT = "struct<targets: array<string>, via: string>"


def targets_of(manifest: str | None, inner: str, conditions: list[str]) -> dict:
    """Targets of a path inside a package, best first, and how they were found: exports, blocked, not_exported, entry, path or invalid."""
    try:
        own = json.loads(manifest or "{}")
        if not isinstance(own, dict):
            raise ValueError
    except ValueError:
        return {"targets": [], "via": "invalid"}
    exports = own.get("exports")
    if exports is None:
        if inner:
            return {"targets": [inner], "via": "path"}
        fields = [own[f] for f in ENTRY_FIELDS if isinstance(own.get(f), str)]
        return {"targets": [*fields, "index", "src/index"], "via": "entry"}

    def pick(node: object, star: str) -> list[str] | None:
        """Targets of a tree of conditions in its own order: None where no condition holds, no target where it is blocked."""
        if node is None:
            return []
        if isinstance(node, str):
            return [node.replace("*", star)]
        if isinstance(node, list):  # the first that holds, the others behind it
            found = [p for x in node if (p := pick(x, star)) is not None]
            return [t for p in found for t in p] if found else None
        if isinstance(node, dict):
            for name, below in node.items():
                if name in conditions and (p := pick(below, star)) is not None:
                    return p
        return None

    paths = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    asked, star, found = "./" + inner if inner else ".", "", None
    if asked in paths and "*" not in asked:
        found = asked
    else:
        fits = []
        for k in paths:
            head, mark, tail = k.partition("*")
            if mark and asked.startswith(head) and asked.endswith(tail) and len(asked) > len(head) + len(tail):
                fits.append((len(head), len(k), k, asked[len(head) : len(asked) - len(tail)]))
            elif k.endswith("/") and asked.startswith(k) and len(asked) > len(k):
                fits.append((len(k), len(k), k, ""))
        if fits:
            _, _, found, star = max(fits)
    got = None if found is None else pick(paths[found], star)
    if got is not None and found.endswith("/"):
        got = [t + asked[len(found) :] for t in got]
    if got is None:
        return {"targets": [], "via": "not_exported"}
    return {"targets": got, "via": "exports" if got else "blocked"}


def inside(folder: Column, target: Column) -> Column:
    """The path of a target in its package's folder; null where it leaves it."""
    path = normalised(F.concat_ws("/", folder, target))
    stays = F.when(folder == "", ~path.startswith("..")).otherwise(F.startswith(path, F.concat(folder, F.lit("/"))))
    return F.when(stays & ~target.startswith("/") & ~F.concat(F.lit("/"), target, F.lit("/")).contains("/node_modules/"), path)


def resolve_exports(imports: DataFrame, packages: DataFrame, files: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    """Imports (import_id, specifier) of workspace packages (name, folder, manifest) with via, status, path and target_file_id.

    Each different (package, path inside it) is looked up in the manifest once.  A target must stay inside the package; of the
    targets in order, and of what a path may end with, the first file that is there is taken.  Status: resolved, ambiguous
    (several packages of the name reach files), unsafe, blocked, not_exported, invalid or missing.
    """
    holds = conditions or CONDITIONS
    look = F.udf(lambda manifest, inner: targets_of(manifest, inner, holds), _RESULT)
    name, rest = package_of(F.col("specifier"))
    asked = imports.withColumn("name", name).withColumn("inner", rest).join(packages.select("name").distinct(), "name", "left_semi")
    ways = asked.select("name", "inner").distinct().join(packages, "name").withColumn("r", look("manifest", "inner")).select("name", "inner", "folder", "r.*")
    targets = ways.select("name", "inner", "folder", "via", F.posexplode_outer("targets").alias("order", "target")).withColumn("path", inside(F.col("folder"), F.col("target")))
    probes = targets.where("path is not null").select("name", "inner", "folder", "order", "path", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat("path", e))).alias("ending", "probe"))
    there = probes.join(files.select(F.col("rel_path").alias("probe"), "file_id"), "probe")
    best = there.groupBy("name", "inner", "folder").agg(F.min(F.struct("order", "ending", "probe", "file_id")).alias("b"))
    hits = best.groupBy("name", "inner").agg(F.count_distinct("b.file_id").alias("n"), F.min("b.probe").alias("found"), F.min("b.file_id").alias("target_file_id"))
    told = targets.groupBy("name", "inner").agg(F.max("via").alias("via"), F.max(F.when(F.col("target").isNotNull() & F.col("path").isNull(), 1)).alias("left"), F.max((F.col("via") == "invalid").cast("int")).alias("invalid"))
    status = (
        F.when(F.col("invalid") == 1, "invalid").when(F.col("left") == 1, "unsafe").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "resolved")
        .when(F.col("via").isin("blocked", "not_exported"), F.col("via")).otherwise("missing")
    )
    out = asked.join(told, ["name", "inner"]).join(hits, ["name", "inner"], "left").withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select(*imports.columns, "via", "status", F.when(good, F.col("found")).alias("path"), F.when(good, F.col("target_file_id")).alias("target_file_id"))
