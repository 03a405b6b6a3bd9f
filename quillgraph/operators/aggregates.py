"""Counts, roll-ups, percentiles and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.lookup import is_current


def freshness_counts(files: DataFrame) -> DataFrame:
    """One row: files of each freshness; deleted ones do not count."""
    count = lambda s: F.count_if(F.col("freshness_state") == s).alias(s)
    return files.agg(*map(count, ["refreshed_current", "retained_current", "degraded_partial", "not_current"]))


def count_by_domain(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) for each value of a fixed domain, zero included."""
    spark = rows.sparkSession
    values = spark.createDataFrame([(v,) for v in domain], "value string")
    return values.join(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def buckets(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values; ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def nearest_rank_of(rows: DataFrame, column: str, percents: list[float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles of each group by ranks, not by lists, so a hot group spills instead of filling memory."""
    from pyspark.sql import Window

    order, whole = Window.partitionBy(*by).orderBy(column), Window.partitionBy(*by)
    ranked = rows.where(F.col(column).isNotNull()).select(*by, column, F.row_number().over(order).alias("k"), F.count("*").over(whole).alias("n"))
    at = lambda p: F.round(F.lit(p / 100) * (F.col("n") - 1)) + 1
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("k") == at(p), F.col(column))).alias(f"p{p:g}") for p in percents])


def parity(counts: DataFrame, by: str = "fact") -> DataFrame:
    """100 * (sum of max - sum of |difference|) / sum of max of expected and actual counts; 100 of nothing."""
    top, off = F.sum(F.greatest("expected", "actual")), F.sum(F.abs(F.col("expected") - F.col("actual")))
    return counts.groupBy(by).agg(F.when(top > 0, F.round(100.0 * (top - off) / top, 6)).otherwise(100.0).alias("parity"))


def fingerprint(rows: DataFrame, line: Column, by: list[str]) -> DataFrame:
    """(by, fingerprint, lines): a hash over all lines of each group, whatever their order; repeats count.

    A tree of hashes: equal lines become one leaf with their number, leaves whose hashes
    begin with the same six hexadecimal digits one hash, those with the same three one
    hash, and these the fingerprint.  So no list grows with a group beyond its leaves over
    16 million, and what is equal in two snapshots hashes alike.
    """
    leaf = rows.groupBy(*by, F.sha2(line, 256).alias("h")).agg(F.count("*").alias("n"))
    node = leaf.select(*by, F.substring("h", 1, 6).alias("at"), F.concat_ws(":", "h", "n").alias("part"), "n")
    for digits in (3, 0):
        up = node.groupBy(*by, "at").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("part"))), 256).alias("h"), F.sum("n").alias("n"))
        node = up.select(*by, F.substring("at", 1, digits).alias("at"), F.concat_ws(":", "at", "h").alias("part"), "n")
    root = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("part"))), 256)
    return node.groupBy(*by).agg(root.alias("fingerprint"), F.sum("n").alias("lines"))


def link_report(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: linked and unresolved edges by kind, and links across roots."""
    side = lambda end, name: files.select(F.lit("file").alias(f"{end}_kind"), F.col("file_id").alias(f"{end}_id"), F.col("root_id").alias(name))
    found = edges.join(side("from", "r1"), ["from_kind", "from_id"], "left").join(side("to", "r2"), ["to_kind", "to_id"], "left")
    linked = F.col("resolution") == "resolved"
    count = lambda kind, ok: F.count_if((F.col("kind") == kind) & (linked if ok else ~linked))
    names = [("imports", "imports"), ("calls", "calls"), ("references", "references"), ("re_exports", "re_exports")]
    across = F.count_if(linked & (F.col("from_kind") == "file") & (F.col("r1") != F.col("r2"))).alias("across_roots")
    return found.agg(*[count(k, ok).alias(f"{'linked' if ok else 'unresolved'}_{n}") for k, n in names for ok in (True, False)], across)


def telemetry_summary(rows: DataFrame) -> DataFrame:
    """By kind: runs, sums and averages, 0 of nothing."""
    return rows.groupBy("kind").agg(
        F.count("*").alias("runs"),
        F.sum("k").alias("total_tokens"),
        F.round(F.sum("duration_ms"), 2).alias("total_ms"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 6).alias("avg_ms"),
    )


def strategy_breakdown(rows: DataFrame, kind: str) -> DataFrame:
    """One row: a map of each strategy to how often it ran."""
    counted = rows.where(F.col("kind") == kind).groupBy("strategy").agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("by_strategy"))


def index_freshness(files: DataFrame, state: DataFrame) -> DataFrame:
    """One row: cold without files or state, stale during a run or with old files, partial with degraded ones, else current."""
    counted = files.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("freshness_state") == "not_current").alias("old"),
        F.count_if(F.col("freshness_state") == "degraded_partial").alias("degraded"),
    )
    known = state.agg(F.count("*").alias("states"), F.max("status").alias("status"), F.max("active_run_id").alias("active"))
    # both sides are one row of an aggregate
    return counted.join(known, F.lit(True)).select(
        F.when((F.col("n") == 0) | (F.col("states") == 0), "cold")
        .when(F.col("active").isNotNull() | (F.col("status") != "completed"), "stale")
        .when(F.col("old") > 0, "stale")
        .when(F.col("degraded") > 0, "partial")
        .otherwise("current")
        .alias("freshness")
    )


def current_share(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("n"), F.count_if(is_current(F.col("freshness_state"))).alias("current"))


def weakest(rows: DataFrame, state: str, order: list[str]) -> DataFrame:
    """Of each capability the weakest state over languages, by the order from weak to strong."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return rows.groupBy("capability").agg(F.min_by(state, rank).alias("weakest"))
