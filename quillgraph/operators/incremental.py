"""What to index again: dirty plans, deltas, invalidation, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import CONFIG_NAMES
from quillgraph.operators.graph import frontier
from quillgraph.operators.joins import suffix_matches

KEY = ["root_id", "rel_path"]


def compare(before: DataFrame, scanned: DataFrame) -> DataFrame:
    """One full outer join of the live files before with the files found now."""
    old = before.where("deleted_at_unix_ms is null").select(*KEY, F.lit(True).alias("was"), F.col("content_hash").alias("old_hash"), F.col("size_bytes").alias("old_size"), F.col("mtime_unix_ms").alias("old_mtime"))
    new = scanned.select(*KEY, F.lit(True).alias("is"), F.col("content_hash").alias("new_hash"), F.col("size_bytes").alias("new_size"), F.col("mtime_unix_ms").alias("new_mtime"))
    return old.join(new, KEY, "full_outer")


def dirty_plan(before: DataFrame, scanned: DataFrame, forced: bool = False, touched: DataFrame | None = None) -> DataFrame:
    """(root_id, rel_path, level): what changed and how much follows from it; unchanged files are left out."""
    both = compare(before, scanned)
    if touched is not None:
        both = both.join(touched.select(*KEY, F.lit(True).alias("touched")).distinct(), KEY, "left")
    else:
        both = both.withColumn("touched", F.lit(None).cast("boolean"))
    config = F.lower("rel_path").rlike(CONFIG_NAMES)
    level = (
        F.when(F.col("is").isNull(), "deleted")
        .when(F.lit(forced), "resolution_scope")
        .when(F.col("was").isNull(), "content_only")
        .when((F.col("old_hash") == F.col("new_hash")) & ~F.coalesce("touched", F.lit(False)), F.lit(None))
        .when(config, "resolution_scope")
        .otherwise("content_only")
    )
    return both.select(*KEY, level.alias("level")).where("level is not null")


def to_hash(before: DataFrame, scanned: DataFrame, forced: bool = False) -> DataFrame:
    """Files whose content must be hashed: new, of other size or time, without a hash, or all if forced."""
    both = compare(before, scanned).where("is")
    changed = F.lit(forced) | F.col("was").isNull() | ~F.col("old_size").eqNullSafe(F.col("new_size")) | ~F.col("old_mtime").eqNullSafe(F.col("new_mtime")) | (F.coalesce("old_hash", F.lit("")) == "")
    return both.where(changed).select(*KEY)


def metadata_dirty(before: DataFrame, scanned: DataFrame) -> DataFrame:
    """(root_id, rel_path, level) without hashing: known files whose size or time differs, that were deleted or have no hash, and files that are gone.

    New files are not among them: they are found by hashing.
    """
    old = before.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("size_bytes").alias("old_size"), F.col("mtime_unix_ms").alias("old_mtime"), F.col("deleted_at_unix_ms").isNotNull().alias("dead"))
    new = scanned.select(*KEY, F.lit(True).alias("is"), F.col("size_bytes").alias("new_size"), F.col("mtime_unix_ms").alias("new_mtime"))
    both = old.join(new, KEY, "left")
    changed = F.col("dead") | (F.coalesce("old_hash", F.lit("")) == "") | ~F.col("old_size").eqNullSafe(F.col("new_size")) | ~F.col("old_mtime").eqNullSafe(F.col("new_mtime"))
    level = F.when(F.col("is") & changed, "content_only").when(F.col("is").isNull() & ~F.col("dead"), "deleted")
    return both.select(*KEY, level.alias("level")).where("level is not null")


def resolution_scope(before: DataFrame, scanned: DataFrame, planned: DataFrame) -> DataFrame:
    """(root_id, rel_path, action) where ``planned`` (with level) changes how names resolve: every other live file is refreshed, or not current if it is not found now."""
    basis = planned.where("level = 'resolution_scope'").agg(F.count("*").alias("__roots"))
    rest = before.where("deleted_at_unix_ms is null").select(*KEY).join(planned.select(*KEY), KEY, "left_anti")
    there = rest.join(scanned.select(*KEY, F.lit(True).alias("is")), KEY, "left")
    # one row of an aggregate
    return there.join(F.broadcast(basis), F.lit(True)).where("__roots > 0").select(*KEY, F.when(F.col("is"), "refresh").otherwise("not_current").alias("action"))


def invalidation(imports: DataFrame, unresolved: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, depth): what depends on changed files, over imports and over specifiers that did not resolve but end like a root's path.

    ``imports`` are file edges, ``unresolved`` has (file_id, specifier); importers by suffix count as one hop.
    """
    paths = files.join(roots.select("file_id").distinct(), "file_id", "left_semi")
    near = suffix_matches(unresolved.select(F.col("file_id").alias("from_id"), "specifier"), paths).select("from_id", F.col("file_id").alias("to_id"))
    guessed = near.select(F.lit("imports").alias("kind"), F.lit("file").alias("from_kind"), "from_id", F.lit("file").alias("to_kind"), "to_id")
    return dependents_of(imports.select(*guessed.columns).unionByName(guessed), roots)


def confirmed_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, structure_changed, api_changed); a new file changed neither."""
    old = before.select("file_id", F.lit(True).alias("was"), F.col("structure_hash").alias("s0"), F.col("public_api_hash").alias("a0"))
    both = after.select("file_id", "structure_hash", "public_api_hash").join(old, "file_id", "left")
    was = F.col("was").isNotNull()
    return both.select("file_id", (was & ~F.col("s0").eqNullSafe(F.col("structure_hash"))).alias("structure_changed"), (was & ~F.col("a0").eqNullSafe(F.col("public_api_hash"))).alias("api_changed"))


def reusable_edges(delta: DataFrame) -> DataFrame:
    return delta.where(~F.col("structure_changed") & ~F.col("api_changed")).select("file_id")


def dependents_of(imports: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(file_id, depth): the transitive importers of the roots (file_id), they themselves at 0; all of them unless hops are bounded."""
    seeds = roots.select(F.lit(0).alias("seed"), F.lit("file").alias("node_kind"), F.col("file_id").alias("node_id"))
    return frontier(imports, seeds, max_hops, "incoming").select(F.col("node_id").alias("file_id"), "depth")


def direct_dependents(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """Importers at one hop, without the roots."""
    ids = roots.select("file_id").distinct()
    near = imports.join(ids, F.col("to_id") == F.col("file_id")).select(F.col("from_id").alias("file_id")).distinct()
    return near.join(ids, "file_id", "left_anti")


def refreshed(files: DataFrame, indexed: DataFrame, run_id: str) -> DataFrame:
    """Files after a run: indexed ones are refreshed, current ones retained, others as they were."""
    marked = files.join(indexed.select("file_id", F.lit(True).alias("__now")).distinct(), "file_id", "left")
    state = F.when(F.col("__now"), "refreshed_current").when(F.col("freshness_state").isin("refreshed_current", "retained_current"), "retained_current").otherwise(F.col("freshness_state"))
    return marked.withColumn("freshness_state", state).withColumn("run_id", F.when(F.col("__now"), run_id)).drop("__now")


def tombstoned(files: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    """Files with those of ``gone`` marked deleted; the rows stay."""
    marked = files.join(gone.select("file_id", F.lit(True).alias("__gone")).distinct(), "file_id", "left")
    out = marked.withColumn("freshness_state", F.when(F.col("__gone"), "deleted").otherwise(F.col("freshness_state")))
    return out.withColumn("deleted_at_unix_ms", F.when(F.col("__gone"), F.coalesce("deleted_at_unix_ms", F.lit(now_ms))).otherwise(F.col("deleted_at_unix_ms"))).drop("__gone")


def invalidated(files: DataFrame, paths: list[str]) -> DataFrame:
    hit = F.col("rel_path").isin(paths) if paths else F.lit(False)
    return files.withColumn("freshness_state", F.when(hit, "not_current").otherwise(F.col("freshness_state")))


def workspace_changes(before: DataFrame, scanned: DataFrame, most: int = 50) -> DataFrame:
    """One row: first_run, fresh or changed, and the first changed or added paths."""
    both = compare(before, scanned)
    differs = F.col("is") & (F.col("was").isNull() | ~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    removed = F.col("was") & F.col("is").isNull()
    counted = both.agg(F.count_if("was").alias("known"), F.count_if(differs).alias("n"), F.count_if(removed).alias("removed"))
    first = both.where(differs).orderBy("rel_path").limit(most).agg(F.array_sort(F.collect_list("rel_path")).alias("paths"))
    status = F.when(F.col("known") == 0, "first_run").when((F.col("n") == 0) & (F.col("removed") == 0), "fresh").otherwise("changed")
    # both sides are one row of an aggregate
    return counted.join(first, F.lit(True)).select(status.alias("status"), "n", "removed", "paths")


def converted_paths(chunks: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Chunks with convertible paths made canonical; canonical and unresolved ones stay as they are."""
    told = classify_paths(chunks, files, root)
    return told.withColumn("file_path", F.when(F.col("status") == "convertible", F.col("canonical")).otherwise(F.col("file_path"))).select(*chunks.columns)


def classify_paths(chunks: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Stored chunk paths: canonical, convertible (absolute below the root, or with ``./``), or unresolved."""
    path = F.regexp_replace(F.when(F.col("file_path").startswith(root.rstrip("/") + "/"), F.expr(f"substring(file_path, {len(root.rstrip('/')) + 2})")).otherwise(F.col("file_path")), r"^\./", "")
    known = files.select(F.col("rel_path").alias("canonical"), F.lit(True).alias("there")).distinct()
    out = chunks.withColumn("canonical", path).join(known, "canonical", "left")
    status = F.when(F.col("there").isNull(), "unresolved").when(F.col("canonical") == F.col("file_path"), "canonical").otherwise("convertible")
    return out.withColumn("status", status).drop("there")
