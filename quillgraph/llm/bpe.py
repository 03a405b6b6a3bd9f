"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list.

``encode`` turns a text column into packed token ids (little-endian unsigned 32-bit),
``decode`` turns packed ids back into text by concatenating vocabulary strings.

A text is cut by the vocabulary's pattern and each pre-token merged: the pair of least
rank (leftmost first) is popped, entries whose symbols have changed since are skipped,
and a merge links the symbol out and pushes its new neighbours.  A worker remembers
about ``KEPT`` pre-tokens.

Defined results: null text counts as empty and gives no ids; the strings of added tokens
become those tokens, as in the library; decoding drops ids outside the vocabulary and
replaces broken UTF-8; null ids decode to null; repeated rows each get a row; texts of any
length are encoded whole; of equal ranks the leftmost pair merges first; an empty table
gives no row; other columns pass through unless they have the result's name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import LETTERS, NUMBERS, Kept

#: Pre-tokens that a worker remembers between two clearances (about 60 MB).
KEPT = 400_000
#: The pattern of byte-level vocabularies (fixed value of the format), spelt out for characters below U+0250.
PATTERN = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Texts with other characters, or four that Python takes for white space and the library does not, are cut by the library.
OTHER = re.compile("[^\x00-\x1b\x20-\u024f]").search


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        bytes_of = {c: b for b, c in symbols.items()}
        self.path = path
        self.symbol = [vocab[symbols[b]] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.ranks = {a << 32 | b: rank << 32 for rank, (a, b, _) in enumerate(self.rules)}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        words = {i: bytes(bytes_of[c] for c in w) for w, i in vocab.items()} | {i: w.encode() for w, i in added.items()}
        self.words = pa.array([words.get(i, b"") for i in range(max(words) + 1)], pa.binary())
        self.pieces = Kept(lambda piece: array("I", self.merge(piece.encode())).tobytes(), KEPT)
        self._library = None

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        own = [self.symbol[b] for b in data]
        n, ranks, rules = len(own), self.ranks, self.rules
        # an entry is a merge's rank and the place of its left symbol
        heap = [hit | i for i in range(n - 1) if (hit := ranks.get(own[i] << 32 | own[i + 1])) is not None]
        if not heap:
            return own
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            a, b, new = rules[entry >> 32]
            j = after[i]
            if own[i] != a or j >= n or own[j] != b:
                continue  # a stale entry: one of its symbols was merged away
            own[i], own[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (hit := ranks.get(new << 32 | own[k])) is not None:
                    heappush(heap, hit | i)
            h = before[i]
            if h >= 0 and (hit := ranks.get(own[h] << 32 | new)) is not None:
                heappush(heap, hit | h)
        return [x for x in own if x >= 0]

    def pre_tokens(self, text: str) -> list[str]:
        if not OTHER(text):
            return PATTERN.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        out = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += map(self.pieces.__getitem__, self.pre_tokens(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(self.words.take(pa.array(ids[ids < len(self.words)])).to_pylist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary for each worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with packed ids instead of the text; ``path`` is the vocabulary's file on every worker."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = pa.array([bpe.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], packed], names=[*batch.schema.names[:-1], ids])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its packed ids; all else passes through."""
    kept = [c for c in df.columns if c.lower() != text.lower()]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    at_ids = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path).words
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = batch.column(at_ids).to_pylist()
                flat = np.frombuffer(b"".join(p or b"" for p in packed), "<u4")
                known = flat < len(words)
                ends = np.concatenate([[0], np.cumsum(known)])[np.cumsum([0, *[len(p or b"") // 4 for p in packed]])]
                # the strings that were taken lie one after another: their buffer is the text
                taken = words.take(pa.array(flat[known]))
                if len(taken):
                    starts, data = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1], taken.buffers()[2].to_pybytes()
                else:
                    starts, data = np.zeros(1, np.int32), b""
                places = starts[ends]
                texts = [None if p is None else data[places[k] : places[k + 1]].decode("utf-8", "replace") for k, p in enumerate(packed)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, schema)
