"""Cutting lineage in iterative jobs, and folders for tables that outlive a query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder (a folder of this machine only in a local session without one), set for checkpoints too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file://{tempfile.gettempdir()}/checkpoints/quillgraph"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


@contextmanager
def set_for(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    """Settings of the session that hold for what is run inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def place(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written to a new folder in the shared one and read from there: smaller than a checkpoint, and columns are read apart."""
    path = place(df.sparkSession, what)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(spark: SparkSession, owners: int) -> bool:
    """Whether there are enough owners of rows to deal all of a shuffle's tasks evenly by owner alone."""
    return owners >= 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a task's input, about, below which a small input is dealt anew.
TASK_BYTES = 64 << 20


def spread(df: DataFrame, least: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt over all cores where its files are so small (below ``least`` a core) that few tasks would read them; larger inputs stay as they are, unshuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if known < cores * least else df


#: Rows of a task, about, where a window or a count sorts all that it gets.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by columns into tasks of about TASK_ROWS rows, so that what a task sorts does not grow with the table."""
    most = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(most, *by)
