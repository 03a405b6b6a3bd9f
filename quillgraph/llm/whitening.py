"""Embedding whitening on exact sums: digit-slice products in double-precision BLAS.

Entries become whole numbers x = floor(scale * c).  The fit list holds each distinct vector
of a length once: n vectors with sums S.  Centred numbers y = n * x - S are whole, so
their products sum to n**3 times the covariance without any rounding.  A task splits y
into limbs of ``LIMB`` bits; a product of two slices of ``ROWS`` rows stays below 2**53, so a
float64 matrix product of them is exact; slices are recombined as big integers.  Tasks
hand over digits of 30 bits, which Spark adds up as longs whatever the number of tasks,
and the driver gets dims * (dims + 1) / 2 sums, which it rounds once and decomposes.

Defined results: a vector that is null or holds a null or non-finite entry is dropped;
so is one without entries; vectors of different lengths are whitened apart, each length
by its own fit list; equal vectors count once in the fit and each get their rows;
repeated or null ids keep rows of their own; a component along which nothing varies
(eigenvalue 0 to double precision) has null ``whitened``, 0 ``explained`` and does not
count in ``identity_error``; vectors of fewer entries than components give as many rows as
they have entries; of equal eigenvalues any orthonormal pair of directions is taken, the
same for all rows; numbers beyond a long end at its ends; an empty table gives no row;
columns other than these two do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import lean, stored

#: Bits of a limb, and rows of a product: 2 * LIMB + log2(ROWS) is at most 53.
LIMB, ROWS = 20, 4096
#: Bits of the digits that tasks hand over.
DIGIT = 30


class Model(NamedTuple):
    """Of one length of vectors: fit size, sums, components (dims, k), their eigenvalues and shares of the variance, and whether each varies."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    varies: np.ndarray


def whole(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * c) of each entry; null for vectors that are dropped."""
    c = F.col(vector)
    sound = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(sound, F.transform(c, lambda v: F.floor(v.cast("double") * scale)))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of vectors of a batch, in pieces of at most ``ROWS`` rows."""
    lists = batch.column(column)
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(ends)
    for dims in np.unique(size):
        rows = np.flatnonzero(size == dims)
        for k in range(0, len(rows), ROWS):
            at = rows[k : k + ROWS]
            yield at, flat[ends[at][:, None] + np.arange(dims)].astype(np.int64)


def sized_for(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` as longs where results up to ``most`` times its greatest entry fit them, as Python's numbers otherwise."""
    return x if most * max(int(x.max(initial=0)), -int(x.min(initial=0))) < 2**62 else x.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: longs where they hold them, Python's otherwise."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Slices of ``LIMB`` bits, lowest first, as doubles; the last one bears the sign."""
    out = []
    while True:
        if max(int(y.max(initial=0)), -int(y.min(initial=0))) < 1 << LIMB:
            out.append(y.astype(np.float64))
            return out
        rest = y >> LIMB
        out.append((y - (rest << LIMB)).astype(np.float64))
        y = rest


def gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y as big integers, by exact products of slices of at most ``ROWS`` rows."""
    parts = limbs(y)
    out = np.zeros((y.shape[1],) * 2, object)
    for p, a in enumerate(parts):
        for q in range(p, len(parts)):
            product = (a.T @ parts[q]).astype(np.int64).astype(object) << LIMB * (p + q)
            out += product if p == q else product + product.T
    return out


def digits(value: int) -> list[int]:
    """Signed digits of ``DIGIT`` bits, lowest first."""
    sign, value, out = (1 if value >= 0 else -1), abs(value), []
    while value:
        out.append(sign * (value & (1 << DIGIT) - 1))
        value >>= DIGIT
    return out


def totals(vectors: DataFrame, add) -> dict[int, dict[int, int]]:
    """Sums over all rows of (x): by length, of the numbers that ``add`` gives for matrices of that length, each under its place.

    The driver receives one row for each length, place and digit, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch, 0):
                got = add(x)
                held[x.shape[1]] = held[x.shape[1]] + got if x.shape[1] in held else got
        for dims, sums in held.items():
            rows = [(dims, at, k, d) for at, v in enumerate(sums) for k, d in enumerate(digits(int(v)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4, names=["dims", "at", "k", "d"])

    parts = vectors.select("x").mapInArrow(lean(run), "dims long, at long, k long, d long")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dims", "at", "k").agg(F.sum("d").alias("d")).collect():
        own = out.setdefault(r["dims"], {})
        own[r["at"]] = own.get(r["at"], 0) + (r["d"] << DIGIT * r["k"])
    return out


def covariance(n: int, dims: int, upper: dict[int, int]) -> np.ndarray:
    """Sums of products of n * x - S, upper triangle by rows, as the covariance: one rounding an entry."""
    out = np.zeros((dims, dims))
    for at, (i, j) in enumerate(zip(*np.triu_indices(dims), strict=True)):
        out[i, j] = out[j, i] = upper.get(at, 0) / n**3
    return out


def fit(vectors: DataFrame, k: int = 4) -> dict[int, Model]:
    """By length of vectors, the model of the fit list (distinct x, stored): its ``k`` first components."""
    counts = totals(vectors, lambda x: np.array([len(x), *sized_for(x, len(x)).sum(axis=0)], object))
    known = {dims: (own[0], [own.get(i + 1, 0) for i in range(dims)]) for dims, own in counts.items()}

    def products(x: np.ndarray) -> np.ndarray:
        n, sums = known[x.shape[1]]
        return gram(centred(x, n, sums))[np.triu_indices(x.shape[1])]

    told = totals(vectors, products)
    out = {}
    for dims, (n, sums) in known.items():
        v = covariance(n, dims, told.get(dims, {}))
        values, directions = np.linalg.eigh(v)
        values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
        trace = float(np.trace(v))
        varies = values > dims * np.finfo(float).eps * trace
        out[dims] = Model(n, sums, directions, values, np.where(varies, values / (trace or 1.0), 0.0), varies)
    return out


def project(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(id, dims, n, deviation, whitened): of rows (id, x), the coordinates along the components; deviation is exact up to 38 digits, null beyond."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1):
                m = models[x.shape[1]]
                y = centred(x, m.n, m.sums)
                squares = (sized_for(y, y.shape[1] * int(np.abs(y).max(initial=1))) ** 2).sum(axis=1)
                scale = np.where(m.varies, np.sqrt(np.where(m.varies, m.values, 1.0)) * m.n, 1.0)
                w = (y.astype(np.float64) @ m.components) / scale
                flat = pa.array(w.ravel(), pa.float64(), mask=np.broadcast_to(~m.varies, w.shape).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array(np.full(len(at), x.shape[1]), pa.int32()),
                        pa.array(np.full(len(at), m.n), pa.int64()),
                        pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), flat),
                    ],
                    names=["id", "dims", "n", "deviation", "whitened"],
                )

    return rows.select("id", "x").mapInArrow(lean(run), f"id {kind}, dims int, n long, deviation decimal(38,0), whitened array<double>")


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By length, the largest entry of the covariance of the fit list's whitened coordinates minus the identity."""
    most = max((len(m.values) for m in models.values()), default=0)
    if not most:
        return {}
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    named = project(vectors.select(F.lit(0).alias("id"), "x"), models).select("dims", *[F.get("whitened", F.lit(i)).alias(f"w{i}") for i in range(most)])
    out = {}
    for r in named.groupBy("dims").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect():
        varies = models[r["dims"]].varies
        out[r["dims"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(varies) and varies[i] and varies[j]), default=0.0)
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component up to ``k``."""
    own = rows.select(F.col(key).alias("id"), whole(vector, scale).alias("x")).where("x is not null")
    # copies are one row a task before the shuffle
    vectors = stored(own.select("x").distinct(), "vectors")
    models = fit(vectors, k)
    errors = identity_errors(vectors, models)
    told = F.lit(None).cast("struct<explained:array<double>,error:double>")
    # one entry for each length of vectors
    for dims, m in models.items():
        told = F.when(F.col("dims") == dims, F.struct(F.array(*[F.lit(float(e)) for e in m.explained]).alias("explained"), F.lit(errors[dims]).alias("error"))).otherwise(told)
    placed = project(own, models).withColumn("m", told).select("*", F.posexplode("whitened").alias("at", "w"))
    return placed.select(
        F.col("id").alias(key),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("w").alias("whitened"),
        F.get("m.explained", F.col("at")).alias("explained"),
        F.col("m.error").alias("identity_error"),
    )
