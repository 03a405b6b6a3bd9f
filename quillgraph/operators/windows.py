"""Ranking, latest rows, linking of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def latest_value(rows: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """As ``latest``, by a partial aggregate: no sort of a hot group."""
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("__x"))
    return picked.select(*by, *[F.col(f"__x.{c}").alias(c) for c in columns])


def neighbours(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Rows with the keys before and after them."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "sequence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def tail(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The last rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def dedupe_by_score(rows: DataFrame, key: list[str], most: int, score: str = "score", seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """The best row of each key, then the best ``most`` of those, of each group if ``by`` names one; ties by sequence."""
    w = Window.partitionBy(*(by or []), *key).orderBy(F.desc(score), seq)
    best = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    if not by:
        return best.orderBy(F.desc(score), seq).limit(most)
    return cap_each(best, by, [F.desc(score), seq], most)


def cap_each(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows of each group, taken before any later filter."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def stage_history(rows: DataFrame, by: str, order: list[str], stage: str) -> DataFrame:
    """Each stage with the one before it, and whether the step goes to the next stage of the list."""
    return rows.withColumn("previous", F.lag(stage).over(Window.partitionBy(by).orderBy(*order)))


def running(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Running maximum of files, running sums of lines, last stage that is not null."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        by,
        *order,
        F.max("files_changed").over(w).alias("files_changed"),
        F.sum("additions").over(w).alias("additions"),
        F.last("stage", ignorenulls=True).over(w).alias("stage"),
    )
