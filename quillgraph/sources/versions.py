"""Several tables that change together: a file's facts are replaced in all of them or in none.

Rows are dealt into buckets by a hash of their file.  A version is a manifest that names, for each table and bucket,
the folder that holds it; a change writes new folders for the buckets of changed files only and then puts its
manifest in place by one rename.  Readers take the latest manifest, so they see all of a change or nothing of it, and a
job that fails half-way leaves the version before.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class Version(NamedTuple):
    """``tables``: by name the schema and, by bucket, the folder."""

    number: int
    buckets: int
    tables: dict


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def latest(spark: SparkSession, root: str) -> Version | None:
    """The version that readers see; None where there is none yet."""
    fs, at = _files(spark, f"{root}/manifests")
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return None
    told = spark.read.text(f"{root}/manifests/{max(numbers):012d}.json", wholetext=True).first()[0]
    return Version(**json.loads(told))


def _commit(spark: SparkSession, root: str, version: Version) -> None:
    fs, final = _files(spark, f"{root}/manifests/{version.number:012d}.json")
    _, temporary = _files(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(version._asdict()).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        raise Conflict(f"version {version.number} is there already")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, folder: str, key: str, buckets: int) -> list[int]:
    """Writes rows by bucket, and tells the buckets that have any."""
    seen = Observation()
    dealt = rows.withColumn("__bucket", bucket_of(F.col(key), buckets)).repartition("__bucket").observe(seen, F.collect_set("__bucket").alias("b"), F.count("*").alias("n"))
    dealt.write.partitionBy("__bucket").parquet(folder)
    return sorted(seen.get["b"])


def read(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame:
    """A table as of a version, the latest if none is given."""
    version = version or latest(spark, root)
    own = version.tables[name]
    folders = sorted(set(own["folders"].values()))
    return spark.read.schema(own["schema"]).parquet(*folders) if folders else spark.createDataFrame([], own["schema"])


def begin(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str = "file_id", buckets: int = BUCKETS) -> Version:
    """The first version of the tables, each of which has the key."""
    return replace(spark, root, tables, None, key, buckets)


def replace(spark: SparkSession, root: str, tables: dict[str, DataFrame], changed: DataFrame | None, key: str = "file_id", buckets: int = BUCKETS) -> Version:
    """The version in which the rows of changed files (key) are those of ``tables``, in every table; without ``changed`` all rows are.

    Files that are changed and have no row in ``tables`` are gone.  Only buckets that hold changed files are rewritten.
    """
    before = latest(spark, root)
    number, made = (before.number + 1 if before else 1), {}
    buckets = before.buckets if before else buckets
    touched = None
    if before and changed is not None:
        changed = changed.select(key).distinct()
        # at most ``buckets`` numbers
        touched = [r["b"] for r in changed.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]
    for name, rows in tables.items():
        folder = f"{root}/{name}/{number:012d}-{uuid.uuid4().hex}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        folders = {}
        if touched is not None:
            folders = {b: f for b, f in before.tables[name]["folders"].items() if int(b) not in touched}
            old = [f for b, f in before.tables[name]["folders"].items() if int(b) in touched]
            rows = rows.join(changed, key, "left_semi").select(*rows.columns)
            if old:
                rows = spark.read.schema(schema).parquet(*old).join(changed, key, "left_anti").select(*rows.columns).unionByName(rows)
        for b in _written(rows, folder, key, buckets):
            folders[str(b)] = f"{folder}/__bucket={b}"
        made[name] = {"schema": schema, "folders": folders}
    out = Version(number, buckets, made)
    _commit(spark, root, out)
    return out
