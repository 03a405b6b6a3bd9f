"""Media columns, URL filters and archives."""

import base64
import gzip
import hashlib
import io
import random
import wave
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import media, queries, urlfilter, warc


def test_media_round_trip(spark):
    long = "é" * 70_000
    rows = [(1, "hello", 1), (1, "hello", 1), (2, None, 2), (3, "", 3), (4, long, 4), (None, "x" * 64, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Media_Bytes int")
    stored = media.store_payload(df)
    held = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    assert media.from_wav(held[(4, 140_000)])[:140_000] == long.encode()
    out = media.read_media(stored).collect()
    assert len(out) == 6 and sorted(r.payload_bytes for r in out) == [64, 64, 64, 64, 64, 140_032]
    for r in out:
        text = {1: "hello", 4: long, None: "x" * 64}.get(r.doc_id, "") or ""
        payload = media.pad(text.encode())
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(held[(r.doc_id, r.n_bytes)])
        assert len(r.fp_time) == len(r.fp_code) and list(r.fp_time) == sorted(r.fp_time)
    silent = next(r for r in out if r.doc_id == 3)
    assert media.read_media(stored.limit(0)).count() == 0 and silent is not None
    nothing = spark.createDataFrame([(1, None)], "doc_id int, media binary")
    assert media.read_media(nothing).first().payload_bytes is None


def test_fingerprints_pair_peaks(spark):
    tone = (128 + 100 * np.sin(np.arange(8000) * 2 * np.pi * 0.11) * (np.arange(8000) // 500 % 2)).astype(np.uint8).tobytes()
    t, f = media.peaks(tone)
    when, code = media.fingerprints(tone)
    assert len(t) and len(when)
    peaks = set(zip(t.tolist(), f.tolist(), strict=True))
    for w, c in zip(when.tolist(), code.tolist(), strict=True):
        assert (w, c >> 14) in peaks and (w + (c & 127), c >> 7 & 127) in peaks
    shifted = media.peaks(b"\x80" * media.HOP * 10 + tone)
    assert set(zip((shifted[0] - 10).tolist(), shifted[1].tolist(), strict=True)) & peaks


def brute_pairs(payload):
    """Peaks and pairs by definition: a transform as sums of sines, every frame, band and pair by hand."""
    frames = 1 + max(0, -(-(len(payload) - 256) // 128))
    x = np.zeros(256 + (frames - 1) * 128)
    x[: len(payload)] = np.frombuffer(payload, np.uint8) - 128.0
    k, n = np.arange(129)[:, None], np.arange(256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 255)
    basis = np.exp(-2j * np.pi * k * n / 256) * window
    power = [np.abs(basis @ x[128 * f : 128 * f + 256]) for f in range(frames)]
    top = [[max((power[f][b], -b) for b in range(lo, hi)) for lo, hi in media.BANDS] for f in range(frames)]
    peaks = []
    for f in range(frames):
        for b in range(4):
            before = top[f - 1][b][0] if f else -1
            after = top[f + 1][b][0] if f + 1 < frames else -1
            if top[f][b][0] > before and top[f][b][0] >= after and top[f][b][0] > 1e-3:
                peaks.append((f, -top[f][b][1]))
    pairs = [(i, step) for step in range(1, 4) for i in range(len(peaks) - step) if peaks[i + step][0] - peaks[i][0] <= 32]
    return [(peaks[i][0], peaks[i][1] << 14 | peaks[i + s][1] << 7 | (peaks[i + s][0] - peaks[i][0])) for i, s in sorted(pairs, key=lambda p: (peaks[p[0]][0], p[1], p[0]))]


def test_media_query(spark, sf):
    out = queries.op3_media(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {r.doc_id: r for r in out.collect()}
    assert len(told) == docs.count()
    for r in docs.collect():
        data = (r.text or "").encode()
        payload, held = data + b"\0" * (-len(data) % 64 or 64 * (not data)), io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        x = told[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(held.getvalue()), hashlib.sha256(held.getvalue()).hexdigest())
        if len(payload) < 1500:
            assert list(zip(x.fp_time, x.fp_code, strict=True)) == brute_pairs(payload)
    same = out.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("feature", "media_sha256").alias("n"))
    assert same.where("n != 1").count() == 0


def urls():
    return [
        ("http://a.example.org/es/1?x=/de/", "example.org/es/", "block"), ("https://EXAMPLE.org/en/17", "example.org/en/1", "block"), ("https://example.org/en/2", "org/", "allow"),
        ("http://x.com/de/#/fr/", "com/de/", "block"), ("http://com/fr/a", "com/fr/", "allow"), ("http://x.net/de/", None, "allow"), ("http://notexample.org/es/", "org/", "allow"),
        ("http://x.org", None, "allow"), ("nothing here", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://", None, "allow"), ("http://x.com?/de/", None, "allow"), ("ftp://x.com/DE/", None, "allow"),
        ("http:///de/", None, "allow"), ("https://?com/de/", None, "allow"), ("http://" + "a." * 3000 + "org/" + "y" * 5000, "org/", "allow"),
    ]


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, action string")
    df = spark.createDataFrame([(i, u, "old", 1) for i, (u, *_) in enumerate(urls())] * 2, "page_id int, url string, Rule string, won int")
    out = urlfilter.judge_urls(df, rules)
    assert out.columns == ["page_id", "url", "won", "host", "path", "rule", "verdict"] and out.count() == 2 * len(urls())
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(urls())}
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def test_url_plain_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(urls())], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(urls())}


def test_url_equal_lengths(spark):
    rules = spark.createDataFrame([("org", "/ab", "allow"), ("org", "/ab", "block")], "host string, path string, action string")
    df = spark.createDataFrame([(1, "http://org/abc")], "page_id int, url string")
    assert urlfilter.judge_urls(df, rules).first().verdict == "block"


def test_url_query(spark, sf):
    con = oracle.connection(sf)
    assert oracle.spark_rows(queries.op5_url_filter(spark, sf)) == oracle.sql_rows(con, queries.oracle_sql()["op5_url_filter"])
    plan = queries.op5_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nWARC/1.1", "same", 0), (3, None, "same", 0), (9, "u", None, 0), (2, "u", "", 0), (7, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", 0), (None, "u", "same", 0), (4, "u", "é" * 50_000, 0), (4, "u", "é" * 50_000, 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, row int").repartition(3)
    planned = warc.plan_records(df)
    path = str(tmp_path / "warc")
    warc.write_archives(planned, path)
    read = warc.read_archives(spark, path)
    assert read.where("error is not null").count() == 0 and read.count() == len(rows)
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.payload_bytes, r.payload_digest, r.refers) for r in read.select(warc.page_of("record_id").alias("page_id"), "record_type", "payload_bytes", "payload_digest", warc.page_of("refers_to").alias("refers")).collect())
    same, none, long = b"same", b"", ("é" * 50_000).encode()
    tricky = rows[4][2].encode()
    want = [
        (-1, "revisit", 4, b32(same), 3), (2, "response", 0, b32(none), None), (3, "response", 4, b32(same), None), (4, "response", len(long), b32(long), None), (4, "revisit", len(long), b32(long), 4),
        (5, "revisit", 4, b32(same), 3), (7, "response", len(tricky), b32(tricky), None), (9, "revisit", 0, b32(none), 2),
    ]
    assert got == sorted(want)
    bodies = {warc_id: bytes(b) for warc_id, b in read.where("record_type = 'response'").select("record_id", "payload").collect()}
    assert bodies["<urn:page:7>"] == tricky


def test_warc_small_payloads_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string")
    assert {r.record_type for r in warc.plan_records(df, min_bytes=3).collect()} == {"response"}
    warc.write_archives(warc.plan_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_revisits_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    df = spark.createDataFrame([(i, "u", "ab") for i in range(20)], "page_id bigint, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.plan_records(df).where("record_type = 'revisit'").collect()} == {(i, 0) for i in range(1, 20)}


def record(k, body):
    head = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = head + body
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{b32(body)}\r\nWARC-Block-Digest: sha1:{b32(block)}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    whole = [record(k, b"body %d " % k * 50) for k in range(6)]
    pack = (lambda b: gzip.compress(b, mtime=0)) if zipped else (lambda b: b)
    good = [pack(r) for r in whole]
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 0xFF
    cut = good[4][: len(good[4]) * 2 // 3]
    data = good[0] + b"garbage between" + good[1] + bytes(broken) + good[3] + cut + good[5]
    found = list(warc.salvage(data))
    assert [r["fields"]["warc-record-id"] for *_, r in found if r] == [f"<urn:page:{k}>" for k in (0, 1, 3, 5)]
    gaps = [(a, n) for a, n, e, r in found if r is None]
    starts = [0, len(good[0]) + 15, len(good[0]) + 15 + len(good[1]) + len(broken)]
    assert gaps[0] == (len(good[0]), 15) and gaps[1] == (starts[1] + len(good[1]), len(broken)) and gaps[2][1] == len(cut)
    assert sum(n for _, n, *_ in found) == len(data)


@pytest.mark.parametrize("front", ["magic", "garbage"])
def test_salvage_whatever_the_file_begins_with(front):
    """A broken first member, and plain records and members after one another."""
    whole = [record(k, b"body %d " % k * 50) for k in range(6)]
    zipped = [gzip.compress(r, mtime=0) for r in whole]
    first = b"XX" + zipped[0][2:] if front == "magic" else b"garbage"
    for data, n in ((first + b"".join(zipped[1:]), len(first)), (first + whole[1] + zipped[2] + whole[3] + zipped[4] + zipped[5], len(first))):
        found = list(warc.salvage(data))
        assert [r["fields"]["warc-record-id"] for *_, r in found if r] == [f"<urn:page:{k}>" for k in range(1, 6)]
        assert [(a, n) for a, n, _, r in found if r is None] == [(0, n)]
    broken = bytearray(whole[3])
    broken[-20] ^= 0xFF
    for data in (zipped[1] + b"garbage" + whole[2] + bytes(broken) + zipped[4] + whole[5], whole[1] + bytes(broken) + zipped[2] + zipped[3][:60] + whole[4] + zipped[5]):
        found = list(warc.salvage(data))
        kept = [r["fields"]["warc-record-id"] for *_, r in found if r]
        assert kept == [f"<urn:page:{k}>" for k in ((1, 2, 4, 5))] and sum(n for _, n, *_ in found) == len(data)


def other_record(head, body, *lines):
    block = head + b"\r\n\r\n" + body if head else body
    fields = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:x>", *lines, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    http, chunked = b"HTTP/1.1 200 OK", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked"
    body, parts = b"hello world", b"6\r\nhello \r\n5;x=1\r\nworld\r\n0\r\n\r\n"
    digest = lambda x: b"WARC-Payload-Digest: " + x.encode()
    sha256 = hashlib.sha256(body)
    sound = [
        (http, body), (http, body, digest("sha1:" + b32(body))), (http, body, digest("sha1:" + hashlib.sha1(body).hexdigest())), (http, body, digest("sha256:" + sha256.hexdigest())),
        (http, body, digest("SHA-256:" + base64.b32encode(sha256.digest()).decode())), (http, body, digest("blake3:00")), (http + b"\r\nContent-Length: 11", body),
        (http + b"\r\nContent-Length: 99", body, b"WARC-Truncated: length"), (chunked, parts), (chunked, parts, digest("sha1:" + b32(body))), (chunked, parts, digest("sha1:" + b32(parts))), (b"", body, b"Content-Type: text/dns"),
    ]
    for args in sound:
        got = warc.parse_record(other_record(*args), 0)
        assert not isinstance(got, str), (args, got)
        assert (got[0]["payload"], got[0]["length"]) == (body, len(body))
    for args in ((http, body, digest("sha1:" + b32(b"x"))), (http, body, digest("sha256:" + "0" * 64)), (http + b"\r\nContent-Length: 12", body), (chunked, parts, digest("sha1:" + b32(b"x")))):
        assert isinstance(warc.parse_record(other_record(*args), 0), str), args


def names(found):
    return [r["fields"]["warc-record-id"][10:-1] for *_, r in found if r]


def test_several_records_in_a_member():
    whole = [record(k, b"body %d " % k * 50) for k in range(8)]
    two, six = gzip.compress(whole[0] + whole[1], mtime=0), gzip.compress(b"".join(whole[2:]), mtime=0)
    found = list(warc.salvage(two + six))
    assert names(found) == [str(k) for k in range(8)] and not any(e for _, _, e, _ in found)
    assert [(a, n) for a, n, *_ in found] == [(0, len(two)), (0, 0), (len(two), len(six)), *[(len(two), 0)] * 5]
    broken = bytearray(whole[3])
    broken[-20] ^= 0xFF
    found = list(warc.salvage(gzip.compress(whole[2] + bytes(broken) + b"noise" + whole[4], mtime=0) + whole[5]))
    assert names(found) == ["2", "4", "5"]
    (gap,) = [(n, e) for _, n, e, r in found if r is None]
    assert gap == (0, f"block digest differs, at {len(whole[2])} to {len(whole[2]) + len(broken) + 5} of the member")
    # a stream that breaks off, or breaks, gives what it held before
    rng = random.Random(2)
    whole = [record(k, rng.randbytes(3000)) for k in range(6)]
    stream = gzip.compress(b"".join(whole), mtime=0)
    found = list(warc.salvage(stream[: len(stream) // 2] + record(9, b"later")))
    assert names(list(warc.salvage(stream[: len(stream) // 2])))[:2] == ["0", "1"]
    assert names(found)[:2] == ["0", "1"] and names(found)[-1] == "9" and sum(n for _, n, *_ in found) == len(stream) // 2 + len(record(9, b"later"))
    hole = bytearray(stream)
    hole[len(stream) // 2 : len(stream) // 2 + 400] = bytes(400)
    found = list(warc.salvage(bytes(hole) + gzip.compress(record(9, b"later"), mtime=0)))
    assert {"0", "1", "9"} <= set(names(found)) and sum(n for _, n, *_ in found) == len(stream) + len(gzip.compress(record(9, b"later"), mtime=0))


def test_older_versions_and_records_inside_a_damaged_one():
    old = record(1, b"x" * 50).replace(b"WARC/1.1", b"WARC/0.18")
    assert names(list(warc.salvage(old + gzip.compress(old)))) == ["1", "1"]
    inner = record(7, b"inner")
    outer = bytearray(record(2, b"a" * 99 + inner + b"b" * 99))
    outer[-20] ^= 0xFF
    found = list(warc.salvage(bytes(outer) + record(3, b"after")))
    assert names(found) == ["7", "3"] and [r["in_gap"] for *_, r in found if r] == [True, False]
    assert [r["in_gap"] for *_, r in warc.salvage(gzip.compress(bytes(outer) + record(3, b"after"))) if r] == [True, False]


def test_archives_of_no_page_and_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, gaps int, path string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "none"))
    assert queries.read_back(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([(1, None, None, 5, "p"), (2, None, "x", 5, "p")], pages.schema)
    warc.write_archives(warc.plan_records(rows), str(tmp_path / "some"))
    assert {(r.page_id, r.payload_bytes, r.gaps) for r in queries.read_back(spark, str(tmp_path / "some")).collect()} == {(1, 0, 0), (2, 1, 0)}


def test_salvage_never_fails_on_noise():
    rng = random.Random(3)
    base = record(1, b"x" * 100) + gzip.compress(record(2, b"y")) + record(3, b"")
    for _ in range(300):
        data = bytearray(base)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            data[at : at + rng.randrange(3)] = rng.randbytes(rng.randrange(3))
        found = list(warc.salvage(bytes(data)))
        assert sum(n for _, n, *_ in found) == len(data)
    assert list(warc.salvage(b"")) == []


def test_warc_query(spark, sf):
    out = queries.op10_warc(spark, sf)
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    want = {(k, len(b), b32(b), "response" if first[b] == k else "revisit", None if first[b] == k else first[b], 0) for k, b in pages.items()}
    assert {tuple(r) for r in out.collect()} == want


def test_damaged_archives_tell_their_gaps(spark, tmp_path):
    """A flipped first byte, a hole and a cut end: what is whole is read, and each row tells how many gaps there are."""
    whole = [record(k, b"page %d " % k * 40) for k in range(9)]
    zipped = [gzip.compress(r, mtime=0) for r in whole]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(b"\x00" + b"".join(zipped[:3])[1:])
    (tmp_path / "deep" / "b.warc").write_bytes(whole[3] + whole[4][:-30] + zipped[5] + whole[6])
    (tmp_path / "c.warc").write_bytes(whole[7] + whole[8][:100])
    out = queries.read_back(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.payload_bytes) for r in out} == {(k, 280) for k in (1, 2, 3, 5, 6, 7)} and {r.gaps for r in out} == {3}
    logged = warc.read_archives(spark, str(tmp_path)).where("error is not null").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.offset, r.length) for r in logged) == [("a.warc.gz", 0, len(zipped[0])), ("b.warc", len(whole[3]), len(whole[4]) - 30), ("c.warc", len(whole[7]), 100)]


def test_noise_spares_whole_records():
    """Bytes put between records and members never cost a whole one."""
    rng = random.Random(9)
    for _ in range(100):
        data, want = b"", []
        for k in range(6):
            data += bytes(rng.choice(b"WARC/1.\r\n\x1f\x8b\x08xyz") for _ in range(rng.choice([0, 0, 3, 40])))
            r = record(k, rng.randbytes(rng.randrange(60)))
            data += gzip.compress(r, mtime=0) if rng.random() < 0.5 else r
            want.append(f"<urn:page:{k}>")
        found = list(warc.salvage(data))
        assert [r["fields"]["warc-record-id"] for *_, r in found if r] == want and sum(n for _, n, *_ in found) == len(data)


def test_warc_large_payloads_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_PAYLOAD", 100)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    df = spark.createDataFrame([(i, "u", f"{i}" * (10 if i % 3 else 300)) for i in range(30)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(df), str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"))
    assert read.where("error is null").count() == 30
    by = read.groupBy("path").agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("b")).collect()
    assert max(r.b for r in by if "/large/" in r.path) <= 1000 and sum(r.n for r in by if "/large/" in r.path) == 10
