"""Packing: bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document is cut into full
windows and a rest; the rest goes to the open window that it fills best; when none has
room, the fullest is topped up with the head of the rest and emitted.  What stays open
at the end of a partition is merged over all partitions: the open pieces are laid end to
end and cut at window borders, and the last, partly filled stretch is cut into powers of
two, which need no padding.

Defined results: null text counts as empty; an empty document is its end token alone;
null and repeated ids are kept as they are, each row is a document of its own; ties
between equally full windows go to the older; an empty table gives no piece; documents of
any length are packed whole; other columns do not take part.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import lean, stored

WINDOW = 2048
#: Open windows of a partition.
OPEN = 16
#: Words that a worker remembers between two clearances (about 40 MB).
KEPT = 200_000
#: Sequence numbers of merged leftovers start here; below are partition << 32 | count.
MERGED = 1 << 61


#: The pre-token pattern of lower-casing vocabularies with word ends.  Fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of the characters below U+0250, none of which is composed of others, in the pattern's terms.
SPACE, LETTER, NUMBER, MARK = range(4)
KINDS = np.full(0x250, MARK, np.int8)
for _c in range(0x250):
    KINDS[_c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(_c))[0], SPACE if chr(_c).isspace() else MARK)
#: Other characters, and four that Python takes for white space and the library does not.
OTHER = re.compile("[^\x00-\x1b\x20-\u024f]").search
#: Characters that are cut at a time.
STEP = 1_000_000


def cut_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pre-token, and each stretch of white space, of lower-cased UTF-8 begins, and which are white space."""
    kind = KINDS[np.where(data < 0x80, data, ord("a"))]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        kind[wide] = kind[wide + 1] = KINDS[(data[wide].astype(np.int32) & 0x1F) << 6 | data[wide + 1] & 0x3F]
    first = np.ones(len(data), bool)
    # runs of one kind stay together, but every number is one of its own
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    first[wide + 1] = False
    # an apostrophe alone takes one or two letters with it
    lone = np.flatnonzero(first & (data == ord("'")))
    lone = lone[(lone + 1 < len(data))]
    lone = lone[first[lone + 1] & (kind[lone + 1] == LETTER)]
    after = np.append(data, np.uint8(0)).astype(np.int32)
    x, y = after[lone + 1], after[lone + 2]
    one = np.isin(x, [ord(c) for c in "stmd"])
    two = ~one & np.isin(x << 8 | y, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
    taken = np.r_[lone[one], lone[two]]
    first[taken + 1] = False
    ends = np.r_[lone[one] + 2, lone[two] + 3]
    first[ends[ends < len(data)]] = True
    at = np.flatnonzero(first)
    return at, kind[at] == SPACE


class Worded:
    """A library tokenizer that is asked once for each word.

    Where a vocabulary drops white space, lower-cases and cuts by ``PATTERN``, a text of
    Latin letters is the ids of its lower-cased pre-tokens one after another: texts are
    cut together, and ids looked up once for each different word.  Texts with other
    characters, and other vocabularies, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.worded = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and cut.get("pattern") == {"Regex": PATTERN} and cut.get("invert") is True
        self.marks = [x["content"] for x in spec["added_tokens"]]
        if self.worded:
            # the same vocabulary for words that are lowered and cut already, one a line
            lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            steps = {"type": "Sequence", "pretokenizers": [lines, spec["pre_tokenizer"]["pretokenizers"][1]]}
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": steps}))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ask the library for words that were not asked for yet."""
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            told = self.bare.encode("\n".join(some), add_special_tokens=False)
            ids, place = np.array(told.ids, "<u4"), np.array(told.word_ids)
            ends = np.searchsorted(place, np.arange(len(some)), "right")
            packed, last = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.words[word] = packed[4 * last : 4 * end]
                last = end

    def lookup(self, words: list[str]) -> list[bytes]:
        """Packed ids of different words; the latest ``KEPT`` are remembered, and those before until the next clearance."""
        if len(self.words) >= KEPT:
            self.older, self.words = self.words, {}
        known, older, new = self.words, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        return [known[w] for w in words]

    def latin(self, low: list[str]) -> list[bytes]:
        """Packed ids of lower-cased texts of Latin letters."""
        data = np.frombuffer("\n".join([*low, ""]).encode(), np.uint8)
        at, blank = cut_points(data)
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).filter(pa.array(~blank)).dictionary_encode()
        ids = self.lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = pieces.indices.to_numpy()
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin, many = np.cumsum(size) - size, size[code]
        upto = np.cumsum(many)
        total = int(upto[-1]) if len(upto) else 0
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[code] - upto + many, many) + np.arange(total)]
        ends = np.cumsum([len(t.encode()) + 1 for t in low])
        words = np.searchsorted(at[~blank], ends)
        cuts = [0, *np.concatenate([[0], upto])[words].tolist()]
        packed = flat.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        low = [t.lower() for t in texts] if self.worded else []
        odd = {k for k, t in enumerate(texts) if not self.worded or OTHER(low[k]) or any(m in t for m in self.marks)}
        out: list[bytes] = [b""] * len(texts)
        for some, how in ((sorted(odd), lambda own: self.whole([texts[k] for k in own])), ([k for k in range(len(texts)) if k not in odd], lambda own: self.latin([low[k] for k in own]))):
            at = 0
            while at < len(some):
                size, stop = 0, at
                while stop < len(some) and (stop == at or size + len(texts[some[stop]]) <= STEP):
                    size, stop = size + len(texts[some[stop]]), stop + 1
                for k, packed in zip(some[at:stop], how(some[at:stop]), strict=True):
                    out[k] = packed
                at = stop
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Worded:
    """One tokenizer for each worker process."""
    return Worded(path)


def token_batches(path: str, end_id: int | None, ids: str = "ids") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches whose last column is text into batches with packed ids instead."""
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            packed = [p + end for p in tokenizer.encode(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], ids])
        tokenizer.older.clear()

    return run


def tokenize(docs: DataFrame, path: str, end_id: int | None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with packed ids (little-endian unsigned 32-bit), ended by ``end_id``, instead of the text."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField(ids, T.BinaryType())])
    return rows.mapInArrow(lean(token_batches(path, end_id, ids)), schema)


class Windows:
    """The open windows of a partition, by free tokens and age; a window is a list of (document, start, packed ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.age = size, most, 0
        self.open: list[tuple[int, int, list]] = []

    def place(self, doc: object, start: int, packed: bytes) -> Iterator[list]:
        """Place a piece of at most ``size`` ids; yields windows that became full."""
        while packed:
            n = len(packed) // 4
            at = bisect_left(self.open, (n,))
            if at < len(self.open):
                free, age, held = self.open.pop(at)
                take = n
            elif len(self.open) < self.most:
                self.age += 1
                free, age, held = self.size, self.age, []
                take = min(n, free)
            else:
                free, age, held = self.open.pop(0)
                take = free
            held.append((doc, start, packed[: 4 * take]))
            start, packed = start + take, packed[4 * take :]
            if take == free:
                yield held
            else:
                insort(self.open, (free - take, age, held))


def pack_partitions(rows: DataFrame, window: int = WINDOW, most: int = OPEN, before: Callable = iter, keep_ids: bool = True) -> DataFrame:
    """Pieces (key, start, length, doc_tokens, sequence_id, offset, ids_crc32, open, part, ids) of each partition; ``open`` marks what was left.

    ``rows`` has a key and packed ids, or what ``before`` turns into these in the same
    task.  Unless ids are to be kept, only open pieces have them.
    """
    long, kind = T.LongType(), rows.schema[0]
    schema = T.StructType([kind, *[T.StructField(c, long) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32")], T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, part, count = Windows(window, most), TaskContext.get().partitionId(), 0
        out: list[tuple] = []
        key_type = None

        def emit(held: list, is_open: bool) -> None:
            nonlocal count
            offset = 0
            for (doc, tokens), start, packed in held:
                out.append((doc, start, len(packed) // 4, tokens, part << 32 | count, offset, crc32(packed), is_open, part, packed if keep_ids or is_open else None))
                offset += len(packed) // 4
            count += 1

        def flush() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 6, pa.bool_(), pa.int32(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=schema.names)
            out.clear()
            return made

        for batch in before(batches):
            key_type = batch.schema.field(0).type
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = packed.as_py()
                tokens = len(packed) // 4
                whole = tokens // window * window
                for start in range(0, whole, window):
                    emit([((doc, tokens), start, packed[4 * start : 4 * (start + window)])], False)
                for held in windows.place((doc, tokens), whole, packed[4 * whole :]):
                    emit(held, False)
                if len(out) >= 1000:
                    yield flush()
        for _, _, held in windows.open:
            emit(held, True)
        if out:
            yield flush()

    return rows.mapInArrow(lean(run), schema)


def merge_leftovers(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Open pieces, laid end to end over all partitions, cut at window borders and at last into powers of two; ``ids`` is cut with them."""
    spark = pieces.sparkSession
    # one sum a partition: as many small rows as the job has partitions
    sums = pieces.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for r in sums:
        bases.append((r["part"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    full, rest = total // window * window, total % window
    cuts = np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]).tolist()
    borders = F.array(*[F.lit(full + c).cast("long") for c in [0, *cuts]])
    # window number of a place, and where a window begins
    number = lambda x: F.when(x < full, F.floor(x / window)).otherwise(F.lit(full // window - 1) + F.size(F.filter(borders, lambda b: b <= x)))
    begin = lambda k: F.when(k < full // window, k * window).otherwise(F.try_element_at(borders, (k - full // window + 1).cast("int")))

    order = _window(("part",), ("sequence_id", "offset"))
    laid = pieces.join(base, "part").withColumn("g", F.col("base") + F.sum("length").over(order) - F.col("length"))
    laid = laid.withColumn("w", F.explode(F.sequence(number(F.col("g")), number(F.col("g") + F.col("length") - 1))))
    low = F.greatest(F.col("g"), begin(F.col("w")))
    high = F.least(F.col("g") + F.col("length"), F.coalesce(begin(F.col("w") + 1), F.lit(total)))
    cut = laid.withColumn("low", low).withColumn("high", high)
    values = {
        "start": F.col("start") + F.col("low") - F.col("g"),
        "length": F.col("high") - F.col("low"),
        "sequence_id": F.lit(MERGED) + F.col("w"),
        "offset": F.col("low") - begin(F.col("w")),
        "open": F.lit(False),
        "ids": F.expr("substring(ids, cast(4 * (low - g) + 1 as int), cast(4 * (high - low) as int))"),
    }
    values["ids_crc32"] = F.crc32(values["ids"])
    return cut.select(*[(values[c].alias(c) if c in values else F.col(f"`{c}`")) for c in pieces.columns])


def _window(by: tuple, order: tuple):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pack(docs: DataFrame, key: str = "doc_id", ids: str = "ids", window: int = WINDOW, most: int = OPEN, keep_ids: bool = True) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, packed ids) of all documents."""
    rows = docs.select(key, F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return merged(pack_partitions(rows, window, most, keep_ids=keep_ids), key, window, keep_ids)


def pack_texts(docs: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = OPEN, keep_ids: bool = True) -> DataFrame:
    """``pack`` of what ``tokenize`` gives, in one Python worker a task: ids do not travel between the two."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return merged(pack_partitions(rows, window, most, token_batches(path, end_id), keep_ids), key, window, keep_ids)


def merged(local: DataFrame, key: str, window: int, keep_ids: bool) -> DataFrame:
    """The pieces of all partitions with what was left open merged."""
    held = stored(local, "packed")
    whole = held.where("not open").unionByName(merge_leftovers(held.where("open"), window))
    return whole.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
