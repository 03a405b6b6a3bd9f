"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import unicodedata
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: operators hold whole texts, so few rows bound their memory.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where a local session has none (tests), a folder of this machine is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/quillgraph"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, what: str, told: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates over its rows that the same job takes."""
    seen = Observation()
    out = stored(df.observe(seen, *[v.alias(k) for k, v in told.items()]), what)
    return out, seen.get


def counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """``stored``, and how many rows that are."""
    out, told = observed(df, what, {"n": F.count(F.lit(1))})
    return out, told["n"]


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """``df``, which has about ``rows`` rows, in tasks of about ``each`` rows: small steps of a loop write few files."""
    return df.coalesce(max(1, -(-rows // each)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, and keep Arrow batches small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph_pkg.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(to))
    sc._quillgraph_shipped = True


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; what a task's buffers held goes back to the system at its end, as workers outlive tasks."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # where the C library has it
            trim(0)

    return task


def relieved(spark: SparkSession) -> None:
    """Give back what the driver still holds of earlier jobs: plans, broadcasts and results that nothing refers to, and freed buffers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # where the C library has it
        trim(0)
    spark.sparkContext._jvm.java.lang.System.gc()


class Kept(dict):
    """Remembers what ``make`` gives for short keys: the latest ``most``, and those before them until the next clearance."""

    def __init__(self, make, most: int, longest: int = 100):
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def latin(member) -> str:
    """The characters below U+0250 for which ``member`` holds, as ranges of a regular expression's class."""
    ranges: list[list[int]] = []
    for c in (c for c in range(0x250) if member(chr(c))):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


#: Letters and numbers below U+0250, where all Unicode versions since 5 agree.
LETTERS = latin(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = latin(lambda c: unicodedata.category(c)[0] == "N")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, remainder: int, col: str = "doc_id") -> Column:
    return (id_crc(col) % modulus) == remainder


def text_of(col: str = "text") -> Column:
    """Null text counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def drawn_by(key: Column, seed: int, stratum: Column, share: dict) -> Column:
    """Whether a row is in a sample of a share of each stratum: the hash of its key decides, so that files and reruns do not matter."""
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.lit(0.0)
    for k, v in share.items():
        limit = F.when(stratum == k, min(1.0, v)).otherwise(limit)
    return place < limit


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of about ``per_class`` documents of each label 0 and 1, stored, and how many labels there are of each.

    Labels are sampled before the join, so what is sent to the executors is at most
    about ``2 * per_class`` ids and labels, and the texts are not shuffled.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and __key is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = known.where(drawn_by(F.col("__key"), seed, F.col("label"), {k: per_class / v for k, v in sizes.items()}))
    rows = docs.select(F.col(key).alias("__id"), text_of(text).alias("text"))
    return stored(rows.join(F.broadcast(drawn), F.col("__id") == F.col("__key")).select("text", "label"), "sample"), sizes
