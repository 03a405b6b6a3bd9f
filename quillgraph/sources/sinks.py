"""Writing fact tables: replace, upsert, cascade delete, as new versions of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replaced(table: DataFrame, facts: DataFrame, by: str = "file_id") -> DataFrame:
    """``table`` with the rows of the keys that ``facts`` has replaced by those facts."""
    return table.join(facts.select(by).distinct(), by, "left_anti").unionByName(facts)


def upserted(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key; of equal ones the new row."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


def cascaded(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the facts of the files of ``gone``; embeddings go with their chunks."""
    out = {name: df.join(gone.select("file_id"), "file_id", "left_anti") for name, df in tables.items() if "file_id" in df.columns}
    if "embeddings" in tables and "chunks" in out:
        out["embeddings"] = tables["embeddings"].join(out["chunks"].select("chunk_id"), "chunk_id", "left_semi")
    return tables | out


def write_bucketed(df: DataFrame, path: str, by: str = "bucket") -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
