"""Vector arithmetic with higher-order functions, in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different or no length, or of zero norm."""
    norms = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def seeded_vector(text: Column, dimensions: int) -> Column:
    """A deterministic unit vector of a text: a 32-bit rolling hash of its characters seeds a linear congruence; null counts as empty."""

    @F.pandas_udf("array<double>")
    def made(column: pd.Series) -> pd.Series:
        size = column.str.len().to_numpy(np.int64)
        letters = np.frombuffer("".join(column).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        ends = np.cumsum(size)
        # the hash is a polynomial in 31 modulo 2**32
        powers = np.cumprod(np.append(np.uint32(1), np.full(int(size.max(initial=0)), 31, np.uint32)), dtype=np.uint32)
        sums = np.append(np.uint32(0), np.cumsum(letters * powers[np.repeat(ends, size) - 1 - np.arange(len(letters))], dtype=np.uint32))
        state = (sums[ends] - sums[ends - size]).astype(np.uint64)
        out, total = np.empty((len(size), dimensions)), np.zeros(len(size))
        for k in range(dimensions):
            state = (state * np.uint64(1664525) + np.uint64(1013904223)) & np.uint64(0xFFFFFFFF)
            out[:, k] = state / (2.0**32 - 1) * 2 - 1
            total += out[:, k] * out[:, k]
        length = np.sqrt(total)
        return pd.Series((out / np.where(length > 0, length, 1.0)[:, None]).tolist())

    return made(F.coalesce(text, F.lit("")))
