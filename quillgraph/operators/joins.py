"""Freshness joins, orphans, path relations, interval containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh_embeddings(embeddings: DataFrame, chunks: DataFrame, files: DataFrame, model: str | None = None, dimensions: int | None = None) -> DataFrame:
    """Embeddings whose chunk has their content hash and whose file is not deleted."""
    own = embeddings
    if model is not None:
        own = own.where(F.col("model") == model)
    if dimensions is not None:
        own = own.where(F.col("dimensions") == dimensions)
    live = files.where("deleted_at_unix_ms is null").select("file_id", "rel_path")
    return own.join(chunks.select("chunk_id", "file_id", F.col("content_hash").alias("now")), "chunk_id").where("content_hash = now").drop("now").join(live, "file_id")


def orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def stale(embeddings: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Embeddings to prune, with why: no chunk, another content hash, a deleted file."""
    known = chunks.select("chunk_id", "file_id", F.col("content_hash").alias("now"))
    gone = files.select("file_id", F.col("deleted_at_unix_ms").isNotNull().alias("deleted"))
    joined = embeddings.join(known, "chunk_id", "left").join(gone, "file_id", "left")
    why = F.when(F.col("file_id").isNull(), "no_chunk").when(~F.col("content_hash").eqNullSafe(F.col("now")), "hash").when(F.col("deleted"), "deleted")
    return joined.withColumn("why", why).where("why is not null")


def leaf_roots(roots: DataFrame, path: str = "path") -> DataFrame:
    """Roots that are no parent of another: each root names its parents, which an equi-join removes."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    parents = roots.select(F.explode(above).alias("parent"), F.col(path).alias("child")).where("parent != child").select("parent").distinct()
    return roots.join(parents, F.col(path) == F.col("parent"), "left_anti")


def suffix_matches(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Specifiers with the files whose path, with or without its extension, equals them or ends with ``/`` and them.

    Every file names the suffixes of its path, so a common last segment is no hot key and
    nothing but matches is made.
    """
    clean = F.regexp_replace(F.regexp_replace("specifier", r"^(\./|\.\./|/)+", ""), r"\.(ts|tsx|js|jsx|mjs|py|rs|go)$", "")
    parts = F.split(F.regexp_replace("rel_path", r"\.[a-z]+$", ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    there = files.select("file_id", "rel_path", F.explode(suffixes).alias("wanted"))
    return specifiers.withColumn("wanted", clean).join(there, "wanted").drop("wanted")


def enclosing(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, key: str, cell: int = 64) -> DataFrame:
    """Each point with the smallest span that holds it (null: none), by an equi-join on cells of positions."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)))
    wide = spans.select(by, key, start, end, cells.alias("__cell"))
    met = points.withColumn("__cell", F.floor(F.col(at) / cell)).join(wide, [by, "__cell"], "left")
    inside = (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))
    best = F.min_by(F.when(inside, F.col(key)), F.when(inside, F.struct(F.col(end) - F.col(start), F.col(key))))
    return met.groupBy(*points.columns).agg(best.alias(key))


def labelled_nodes(nodes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node_kind, node_id) rows with a label: path, qualified name (or name, if empty), else ``kind:id``."""
    f = files.select(F.lit("file").alias("node_kind"), F.col("file_id").alias("node_id"), F.col("rel_path").alias("label"))
    named = F.when(F.coalesce("qualified_name", F.lit("")) == "", F.col("name")).otherwise(F.col("qualified_name"))
    s = symbols.select(F.lit("symbol").alias("node_kind"), F.col("symbol_id").alias("node_id"), named.alias("label"))
    out = nodes.join(f.unionByName(s), ["node_kind", "node_id"], "left")
    return out.withColumn("label", F.coalesce("label", F.concat_ws(":", "node_kind", "node_id")))


def first_by(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
