"""Media columns: WAV samples, short-time Fourier transforms, peak-pair fingerprints.

``store_payload`` turns bytes into a column of WAV files (8-bit mono samples,
written by the ``wave`` module); ``read_media`` reads such a column back, restores
the payload and computes fingerprints: the strongest bins of four bands of each
frame that stand above their neighbours in time, each paired with the next peaks,
stored as two arrays (frame of the anchor, pair code).

Defined results: null text counts as empty; an empty payload is padded to 64 zero
bytes, so every row has media; a frame of silence has no peaks, so its arrays are
empty; of equally strong bins of a band the lower one is its peak, and of equal
neighbours in time the earlier one; texts of any length are read whole, frames in blocks;
equal payloads, so repeated rows too, give equal media and arrays; an empty table gives
no row; other columns pass through unless they have the name of a result, which replaces
them.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import lean

PAD = 64
RATE = 8000
FRAME = 256
HOP = 128
#: Bins [from, to) of the four bands in which peaks are sought.
BANDS = ((2, 16), (16, 40), (40, 76), (76, 128))
#: Pairs of a peak with so many later ones, at most so many frames later.
FAN = 3
REACH = 32
#: Frames that are transformed at a time, so that memory does not grow with a text.
BLOCK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``PAD``."""
    return data + b"\0" * (PAD - len(data) % PAD if len(data) % PAD or not data else 0)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by frame and then by band."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(FRAME + (n - 1) * HOP - len(x), np.float32)])
    tops, bins = np.empty((n, len(BANDS)), np.float32), np.empty((n, len(BANDS)), np.int32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + BLOCK] * _WINDOW, axis=1))
        for b, (lo, hi) in enumerate(BANDS):
            band = power[:, lo:hi]
            best = band.argmax(axis=1)
            bins[at : at + BLOCK, b] = best + lo
            tops[at : at + BLOCK, b] = band[np.arange(len(best)), best]
    edge = np.full((1, len(BANDS)), -1, np.float32)
    before, after = np.concatenate([edge, tops[:-1]]), np.concatenate([tops[1:], edge])
    t, b = np.nonzero((tops > before) & (tops >= after) & (tops > 1e-3))
    return t.astype(np.int32), bins[t, b]


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame of the anchor, code of the pair) for each peak with its next ``FAN`` peaks in reach."""
    t, f = peaks(samples)
    times, codes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for step in range(1, min(FAN, len(t) - 1) + 1):
        gap = t[step:] - t[:-step]
        ok = gap <= REACH
        times.append(t[:-step][ok])
        codes.append((f[:-step][ok] << 14) | (f[step:][ok] << 7) | gap[ok])
    when, code = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(when, kind="stable")
    return when[order], code[order].astype(np.int32)


def store_payload(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes`` and a WAV column (columns of these names are replaced)."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), media.lower(), "n_bytes")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).cast("binary").alias(media))
    schema = T.StructType([*rows.drop(media).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.num_columns - 1).to_pylist()
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(pad(d)) for d in data], pa.binary())],
                names=[*batch.schema.names[:-1], "n_bytes", media],
            )

    return rows.mapInArrow(lean(run), schema)


FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("fp_time", T.ArrayType(T.IntegerType())),
        T.StructField("fp_code", T.ArrayType(T.IntegerType())),
    ]
)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without the media column, with what its stored bytes give; a null media has null features."""
    kept = [c for c in df.columns if c.lower() not in (media.lower(), *FEATURES.names)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], media)
    schema = T.StructType([*rows.drop(media).schema.fields, *FEATURES.fields])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        payload = from_wav(data)
        when, code = fingerprints(payload)
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-PAD:]),
            len(data),
            hashlib.sha256(data).hexdigest(),
            when,
            code,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                got = [one(d) for d in batch.column(batch.num_columns - 1).to_pylist()]
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=[*batch.schema.names[:-1], *FEATURES.names])

    return rows.mapInArrow(lean(run), schema)
