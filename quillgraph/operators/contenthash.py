"""Content hashes (BLAKE3) of files of any size: large ones in pieces that any executor hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import blake3
from quillgraph.storage import spread

cloudpickle.register_pickle_by_value(blake3)

#: Bytes of a piece: a power of two of chunks, so that a piece is a whole subtree.
PIECE = 1 << 20
#: Bytes of texts that are hashed together: a call's fixed cost is spread over many, and its arrays stay in the cache.
TOGETHER = 1 << 20


def blake3_hashes(files: DataFrame, key: str = "file_id", content: str = "content", piece: int = PIECE) -> DataFrame:
    """(key, size_bytes, hash) of each row: lower-case hexadecimal BLAKE3 of its content, text as UTF-8.

    Contents of at most ``piece`` bytes are hashed whole.  Larger ones are cut into pieces, each a subtree of the hash; their
    chaining values (32 bytes a piece) meet by file and are merged.  Null content has a null hash; repeated keys keep a row each.
    """
    data = F.col(content).cast("binary")
    rows = files.select(F.col(key), data.alias("data"), F.octet_length(data).cast("long").alias("size_bytes"))
    kind = rows.schema[key].dataType.simpleString()
    together_bytes = TOGETHER
    small = F.col("data").isNull() | (F.col("size_bytes") <= piece)

    def grouped(data: list[bytes | None]) -> Iterator[list[int]]:
        group, held = [], 0
        for k, x in enumerate(data):
            if x is not None:
                group.append(k)
                held += max(len(x), blake3.CHUNK)
                if held >= together_bytes:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            found = [None] * len(data)
            for group in grouped(data):
                for k, x in zip(group, blake3.digests([data[k] for k in group]), strict=True):
                    found[k] = x.hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string())], names=[key, "size_bytes", "hash"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, numbers = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            found = [None] * len(data)
            for group in grouped(data):
                for k, x in zip(group, blake3.pieces([data[k] for k in group], [numbers[k] * (piece // blake3.CHUNK) for k in group]), strict=True):
                    found[k] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(found, pa.binary())], names=["row", key, "size_bytes", "at", "value"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blake3.of_pieces([p["value"] for p in x]).hex() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=[key, "size_bytes", "hash"])

    one = spread(rows.where(small)).mapInArrow(whole, f"{key} {kind}, size_bytes long, hash string")
    large = rows.where(~small).withColumn("row", F.monotonically_increasing_id())
    cut = large.withColumn("at", F.explode(F.expr(f"sequence(0, cast((size_bytes - 1) div {piece} as int))")))
    cut = cut.select("row", key, "size_bytes", "at", F.expr(f"substring(data, at * {piece} + 1, {piece})").alias("part"))
    # dealt anew: the pieces of one file go to all cores
    hashed = cut.repartition("row", "at").mapInArrow(parts, f"row long, {key} {kind}, size_bytes long, at int, value binary")
    met = hashed.groupBy("row").agg(F.first(key).alias(key), F.first("size_bytes").alias("size_bytes"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("values"))
    return one.unionByName(met.select(key, "size_bytes", "values").mapInArrow(together, f"{key} {kind}, size_bytes long, hash string"))
