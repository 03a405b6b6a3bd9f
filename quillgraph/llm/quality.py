"""Quality: compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on blocks of labelled good and bad text.  A
text is cut into blocks, each is compressed with either dictionary, and the
difference of the compressed sizes over their sum says which kind it is made of.
A logistic curve fitted on other labelled documents turns that into a score.

Defined results: null and empty texts have no difference and get the score of the
features 0; rows of null label teach nothing; with one class, or none, every score is
the share of that class (0.5 without rows); texts of any length are compressed whole;
equal sizes are no difference; repeated rows each get a row, and repeated blocks train
once; an empty table gives no row; other columns pass through unless named score or gain,
which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.calibrate import fit_logistic, logistic
from quillgraph.llm.common import labelled_sample, lean

#: Labelled documents of each class for the dictionaries, and as many for the curve, about.
PER_CLASS = 3000
#: Characters of a block, and blocks of each class that train a dictionary at most.
BLOCK = 2000
BLOCKS = 3000
DICT_BYTES = 64 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


def compressors(model: Model) -> tuple:
    pair = []
    for data in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return tuple(pair)


def features(pair: tuple, text: str) -> tuple[float, float, float]:
    """Mean and least difference of the compressed sizes over their sum, by block, and how far the text compresses."""
    good, bad = pair
    g = b = n = 0
    least = 1.0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK].encode()
        x, y = len(good(block)), len(bad(block))
        g, b, n = g + x, b + y, n + len(block)
        if at == 0 or len(block) >= BLOCK // 2:
            least = min(least, (y - x) / (x + y))
    return ((b - g) / (b + g), least, min((g + b) / (2 * n), 1.0)) if n else (0.0, 0.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, seed: int = 13, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from about ``2 * per_class`` documents of each label 0 and 1, half for the dictionaries and half for the curve."""
    sample, sizes = labelled_sample(docs, labels, label, 2 * per_class, seed, key, text)
    if len(sizes) < 2:
        y = np.array([*sizes.keys()], float)
        return Model(b"", b"", np.r_[fit_logistic(np.zeros((len(y), 1)), y)[0], 0.0, 0.0, 0.0])
    sample = sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    count = F.ceil(F.length("text") / BLOCK).cast("int")
    blocks = sample.where("half = 0 and text != ''").select(
        "label", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col("text"), k * BLOCK + 1, F.lit(BLOCK)))).alias("block")
    )
    taken = []
    for k in (1, 0):
        own = blocks.where(F.col("label") == k).dropDuplicates(["block"])
        taken.append([r["block"] for r in own.select("block").orderBy(F.xxhash64("block")).limit(BLOCKS).collect()])
    model = Model(train(apart(taken[0], taken[1])), train(apart(taken[1], taken[0])), np.zeros(4))
    if not (model.good and model.bad):
        y = sizes[1] / (sizes[0] + sizes[1])
        model.weights[0] = np.log(y / (1 - y))
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        for batch in batches:
            x = [features(pair, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array([v[k] for v in x], pa.float64()) for k in range(3)]], names=["label", "a", "b", "c"])

    seen = sample.where("half = 1").select("text", "label").mapInArrow(lean(measure), "label int, a double, b double, c double").toPandas()
    y = seen["label"].to_numpy(float)
    model.weights = fit_logistic(shaped(seen[["a", "b", "c"]].to_numpy(float)), y)
    drawn, real = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5), sizes[1] / sizes[0]
    model.weights[0] += np.log(real / drawn)
    return model


def shaped(x: np.ndarray) -> np.ndarray:
    """The features in units that one ridge penalty suits."""
    return x * np.array([20.0, 20.0, 4.0])


def apart(own: list[str], other: list[str]) -> list[bytes]:
    """Blocks without the lines that the other kind has too: those tell nothing."""
    theirs = {line for block in other for line in block.split("\n")}
    kept = ("\n".join(line for line in block.split("\n") if line not in theirs) for block in own)
    return [block.encode() for block in kept if block]


def train(blocks: list[bytes]) -> bytes:
    """A dictionary, or the blocks themselves as raw content where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICT_BYTES]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and gain (the difference of compressed sizes over their sum)."""
    new = ["score", "gain"]
    kept = [c for c in docs.columns if c.lower() not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__scored"))
    schema = T.StructType([*rows.drop("__scored").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = compressors(m) if m.good and m.bad else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = np.array([features(pair, t or "") if pair else (0.0,) * 3 for t in batch.column(batch.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(logistic(m.weights, shaped(x))), pa.array(x[:, 0])],
                    names=[*batch.schema.names[:-1], *new],
                )

    return rows.mapInArrow(lean(run), schema)
