"""BPE and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillgraph.llm import bpe, packing, queries
from quillgraph.llm.common import LETTERS, NUMBERS, Kept

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = list("aAbZ'sStdlLmvreE01  \n\t.,!<|>-_éÉßİĲǅøØñ") + ["<|endoftext|>", "<|startoftext|>", "中", "́", "ẞ", "Σ", "K", "\x1c", "\xa0", "\x85", "''s", "🙂"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)


@pytest.fixture(scope="module")
def byte_pair(tokenizer_path):
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word_pair(tokenizer_path):
    path = tokenizer_path("word_bpe_49k.json")
    return packing.Worded(path), tokenizers.Tokenizer.from_file(path)


def library_ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=500, deadline=None)
@given(text=TEXTS | st.text(max_size=40))
def test_bpe_equals_library(byte_pair, text):
    own, library = byte_pair
    packed = own.encode(text)
    assert packed == library_ids(library, text)
    assert own.decode(packed) == library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS | st.text(max_size=40))
def test_words_equal_library(word_pair, text):
    own, library = word_pair
    assert own.encode([text]) == [library_ids(library, text)]


def test_every_latin_character(byte_pair, word_pair):
    for c in map(chr, range(0x300)):
        text = f"a{c}{c}1 {c}b\n{c} {c.upper()}x"
        assert byte_pair[0].encode(text) == library_ids(byte_pair[1], text), hex(ord(c))
        assert word_pair[0].encode([text]) == [library_ids(word_pair[1], text)], hex(ord(c))
    assert "\\u0061-\\u007a" in LETTERS and "\\u0030-\\u0039" in NUMBERS


def test_any_ids_decode(byte_pair):
    own, library = byte_pair
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([10**6, 64], "<u4").tobytes()) == library.decode([64])


def test_long_words_and_memo(byte_pair):
    own, library = byte_pair
    text = "ab" * 5000 + " " + "x" * 3000
    assert own.encode(text) == library_ids(library, text)
    kept = Kept(lambda k: k.upper().encode(), 3)
    for k in "abcdabcefa":
        assert kept[k] == k.upper().encode()
    assert len(kept) <= 3


def test_bpe_odd_rows(spark, tokenizer_path):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(1, None, "x"), (2, "", "x"), (None, "hi there", "x"), (3, "hi there", "x"), (3, "hi there", "x"), (4, "long word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Ids string")
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(out) == 6 and all(r.text == ({1: "", 2: "", 4: "long word " * 30_000}.get(r.doc_id, "hi there")) for r in out)
    assert bpe.encode(df.limit(0), path).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id int, ids binary")
    assert bpe.decode(null, path).first().text is None


def test_bpe_query(spark, sf, byte_pair):
    out = {r.doc_id: r for r in queries.op6_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        import hashlib

        packed, r = library_ids(byte_pair[1], d.text or ""), out[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def check_pieces(pieces, ids, window):
    """Every id once, sequences gapless and full but for powers of two."""
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert by.keys() == ids.keys()
    for k, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("window,most,parts", [(16, 3, 4), (8, 1, 1), (32, 16, 5)])
def test_packing_keeps_every_id(spark, window, most, parts):
    rng = random.Random(window)
    ids = {k: [rng.randrange(50_000) for _ in range(rng.choice([1, 2, 3, 5, 7, 15, 16, 17, 40, 100]))] for k in range(150)}
    rows = [(k, bytearray(np.array(v, "<u4").tobytes())) for k, v in ids.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, ids binary").repartition(parts, "doc_id")
    for keep in (False, True):
        out = packing.pack(df, window=window, most=most, keep_ids=keep)
        check_pieces(out.collect(), ids, window)
    for r in out.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]


def test_windows_place_best_fit():
    w = packing.Windows(10, 2)
    put = lambda n: [[(d, s, len(p) // 4) for d, s, p in held] for held in w.place("d", 0, b"\0" * 4 * n)]
    assert put(6) == [] and put(7) == []
    assert put(3) == [[("d", 0, 7), ("d", 0, 3)]]  # the window with three free, not the one with four
    assert put(8) == []
    assert put(5) == [[("d", 0, 8), ("d", 0, 2)]]  # none fits: the fullest is topped up, the rest goes on


def test_packing_odd_rows(spark, tokenizer_path):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "x", 7), (3, "same", 7), (3, "same", 7), (4, "word " * 40_000, 7)], "doc_id bigint, text string, Start int")
    out = packing.pack(packing.tokenize(df, path, 1), keep_ids=False).collect()
    assert sum(p.length for p in out) == 1 + 1 + 2 + 2 + 2 + 40_001
    assert packing.pack(packing.tokenize(df.limit(0), path, 1)).count() == 0


def test_packing_query(spark, sf, word_pair):
    docs = {r.doc_id: library_ids(word_pair[1], r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {k: [*np.frombuffer(v, "<u4").tolist(), 1] for k, v in docs.items()}
    check_pieces(queries.op8_packing(spark, sf).collect(), ids, 2048)


def test_ids_column_is_packed(spark, tokenizer_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    out = packing.tokenize(df, tokenizer_path("word_bpe_49k.json"), None).select(F.octet_length("ids").alias("n")).first()
    assert out.n == 8
