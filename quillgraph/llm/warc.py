"""WARC archives: write records through Spark's text sink, read them with a salvage reader.

``plan_records`` finds for each payload its response (the smallest id) and marks
the others as revisits; ``write_archives`` writes one WARC 1.1 record per row;
``read_archives`` reads archives back, and, where a record fails its checks,
searches for the next version line or gzip member, whichever is nearer, whose record
holds, logging the bytes between as a quarantined gap.  Only lengths and digests that a
record carries are checked, digests in the algorithms of ``ALGORITHMS``.

Archives may be plain, gzip files of one member a record, of several records a member, or
one stream for all, or a mix; versions of the format from 0.17 on are read.  Inside a
member's content the reader searches as it does in a file: records around a damaged one
are kept, also those that a cut member held, and of a damaged one those before the last that
could be unpacked; where only a checksum tells of the damage, those of several whose block
digest holds, marked ``in_gap``.  A record ends
with two line ends, which are the sink's separator, so the sink writes exact records.

Where a record is damaged but tells its length, a record that is found within that
length may be part of its payload (an archive in an archive): it is returned, marked
``in_gap``.

Defined results: null payload counts as empty; a null id is larger than any other;
of rows with the same id and payload one is the response; a null url has no target
line; control characters of a url are percent-encoded; an empty table writes no
record and reads back as no row; other columns are not stored, whatever their names;
payloads of any length are stored whole.  The payload of a chunked
response is its content without the chunks; a response that is not of HTTP is all payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import counted, stored

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive file at most, and bytes of a payload among so many; larger ones have archives of their own.
RECORDS_PER_FILE, SMALL_PAYLOAD = 4096, 64 << 10
#: Bytes of an archive of larger payloads, about, unless one record has more.
ARCHIVE_BYTES = 256 << 20
#: Digests that occur again: so many rows (64 bytes each) may be sent to every executor.
BROADCAST_DIGESTS = 200_000
_LARGEST = (1 << 63) - 1


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from four groups of five bytes."""
    digest = F.sha1(data)
    groups = [
        F.translate(
            F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for k in range(4)
    ]
    return F.concat(*groups)


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, files: bool = False) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) a row; payloads under ``min_bytes`` are all responses.

    Rows are told apart by their place, which only holds for rows read from files; others
    (``files`` false) are written to the shared folder first.
    """
    if not files:
        pages = stored(pages.select(key, url, payload), "pages")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body.cast("binary")).alias("payload_digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = F.struct(F.coalesce("page_id", F.lit(_LARGEST)).alias("k"), F.col("row").alias("r"))
    marks = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", "row", order.alias("o"))
    grouped = marks.groupBy("payload_digest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
    # stored, so that a join of very many of them deals both sides anew and can split a hot digest
    first, n = counted(grouped.select("payload_digest", "first"), "digests")
    later = (F.col("row") != F.col("first.r")) & (F.col("payload_bytes") >= min_bytes)
    to = F.when(F.col("first.k") < _LARGEST, F.col("first.k"))
    if n <= BROADCAST_DIGESTS:
        told = rows.join(F.broadcast(first), "payload_digest", "left").withColumn("seen", later).withColumn("refers_to", F.when(later, to))
    else:
        # payloads move once, by row, and never by digest
        again = marks.join(first, "payload_digest").where(F.col("row") != F.col("first.r")).select("row", to.alias("refers_to"), F.lit(True).alias("seen"))
        told = rows.join(again, "row", "left")
    kind = F.when(F.col("seen"), F.lit("revisit")).otherwise(F.lit("response"))
    return told.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def record_text(date: str = "2000-01-01T00:00:00Z") -> Column:
    """The record of a planned row, without the two line ends that follow it."""
    revisit = F.col("record_type") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    target = F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A")
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit("\r\n")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("refers_to"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("\r\nWARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned rows as archives below ``path``: small payloads by number, larger ones by bytes."""
    large = F.col("payload_bytes") > SMALL_PAYLOAD
    seen = Observation()
    rows = records.observe(seen, F.max(F.when(large, F.col("payload_bytes"))).alias("most"))
    _write(rows.where(~large), f"{path}/small", RECORDS_PER_FILE)
    if most := seen.get["most"]:
        _write(records.where(large), f"{path}/large", max(1, ARCHIVE_BYTES // most))


def _write(records: DataFrame, path: str, most: int) -> None:
    records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


#: Digests that are checked.
ALGORITHMS = {"md5", "sha1", "sha256", "sha384", "sha512"}
_CHUNK = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n")
_LINE = re.compile(rb"WARC/\d\.\d{1,2}\r\n")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n")
_MEMBER = b"\x1f\x8b\x08"


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def fits(told: str, data: bytes) -> bool:
    """Whether ``data`` has the digest ``told``, in base32, hex or base64; true of an algorithm that is not known."""
    name, _, value = told.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if name not in ALGORITHMS:
        return True
    own = hashlib.new(name, data).digest()
    plain = [x.decode().rstrip("=") for x in (base64.b64encode(own), base64.urlsafe_b64encode(own))]
    return value.lower() == own.hex() or value.upper() == base64.b32encode(own).decode().rstrip("=") or value in plain


def unchunked(body: bytes) -> bytes | None:
    """The content of a chunked body; None if it is not one."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        at = m.end() + int(m[1], 16)
        if at == m.end():
            return b"".join(out)
        if body[at : at + 2] != b"\r\n":
            return None
        out.append(body[m.end() : at])
        at += 2
    return None


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at ``at`` and where the next begins, or why it does not hold."""
    if not _LINE.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "header does not end"
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if stop > len(data):
        return "record is cut off"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no record end"
    block = data[start:stop]
    told = fields.get("warc-block-digest")
    if told and not fits(told, block):
        return "block digest differs"
    kind = fields.get("warc-type", "")
    head, gap, body = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n")[1:] if re.fullmatch(rb"(?i)content-length:\s*\d+", x)), None) if gap else None
    if kind == "response":
        if not block.startswith(b"HTTP/"):
            head, body, length = b"", block, None
        chunked = any(re.fullmatch(rb"(?i)transfer-encoding:.*\bchunked\s*", x) for x in head.split(b"\r\n")[1:])
        if length is not None and length != len(body) and not chunked and "warc-truncated" not in fields:
            return "payload length differs"
        plain = unchunked(body) if chunked else None
        # writers differ in whether the digest of a chunked body is of its content
        bodies = [body] if plain is None else [plain, body]
        same = [x for x in bodies if fits(fields.get("warc-payload-digest", ""), x)]
        if not same:
            return "payload digest differs"
        fields["warc-payload-digest"] = f"sha1:{_b32(same[0])}"
        body, length = bodies[0], len(bodies[0])
    return {"fields": fields, "kind": kind, "payload": body, "length": length}, stop + 4


def unzip(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where it ends (0: it does not), and why not; what came before a fault is kept."""
    whole, z, out = memoryview(data), zlib.decompressobj(31), []
    while at < len(data):
        held = z.copy() if step > 1 else None
        try:
            out.append(z.decompress(whole[at : at + step]))
        except zlib.error as e:
            if held is None:
                return b"".join(out), 0, f"bad member: {e}"[:80]
            z, step = held, max(1, step // 256)  # again, in smaller steps, up to the fault
            continue
        at = min(at + step, len(data))
        if z.eof:
            return b"".join(out), at - len(z.unused_data), ""
    return b"".join(out), 0, "member is cut off"


def claimed(data: bytes, at: int) -> int:
    """Where the damaged record at ``at`` says that it ends; ``at`` where it does not say."""
    end = data.find(b"\r\n\r\n", at)
    if not _LINE.match(data, at) or end < 0:
        return at
    told = _LENGTH.search(data, at, end + 2)
    return end + 4 + int(told[1]) if told else at


def walk(data: bytes) -> Iterator[tuple]:
    """(offset, length, error, record) of a plain stretch of records: what a member holds."""
    at, bad, why, outer = 0, -1, "", 0
    while at < len(data):
        got = parse_record(data, at)
        if isinstance(got, str):
            if bad < 0:
                bad, why = at, got
            outer = max(outer, claimed(data, at))
            m = _LINE.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad >= 0:
            yield bad, at - bad, why, None
            bad = -1
        yield at, got[1] - at, None, got[0] | {"in_gap": at < outer}
        at = got[1]
    if bad >= 0:
        yield bad, len(data) - bad, why, None


def salvage(data: bytes) -> Iterator[tuple]:
    """(offset, length, error, record) for each record that holds and each gap that does not.

    Offsets and lengths are of the file.  Of a member with several records the first has its length and
    the others none; a gap inside a member, which has no length either, tells its place there.
    """
    at, bad, why, outer = 0, -1, "", 0
    n = len(data)
    member = line = -1  # the next of each kind, found once
    while at < n:
        found: list[tuple] = []
        end, error = 0, ""
        if data[at : at + 3] == _MEMBER:
            plain, end, error = unzip(data, at)
            inside = list(walk(plain))
            found = [x for x in inside if x[3] is not None or end]
            if not end and error.startswith("bad member"):
                # damage shows after it was done, and a checksum does not tell where: then block digests must
                kept = [x for x in found if "warc-block-digest" in x[3]["fields"]] if len(found) > 1 else []
                found = [(*x[:3], x[3] | {"in_gap": True}) for x in kept] if "check" in error else found[:-1]
            if end and not any(x[3] for x in found):
                end, error, found = 0, next((x[2] for x in inside), "empty member"), []
        else:
            got = parse_record(data, at)
            if isinstance(got, str):
                error = got
                outer = max(outer, claimed(data, at))
            else:
                found, end = [(0, 0, None, got[0] | {"in_gap": at < outer})], got[1]
        if not end:
            # what a broken member held before its fault
            yield from ((at, 0, None, x[3]) for x in found)
            if bad < 0:
                bad, why = at, error
            if member <= at:
                member = x if (x := data.find(_MEMBER, at + 1)) >= 0 else n
            if line <= at:
                line = m.start() if (m := _LINE.search(data, at + 1)) else n
            at = min(member, line)
            continue
        if bad >= 0:
            yield bad, at - bad, why, None
            bad = -1
        length = end - at
        for place, size, wrong, rec in found:
            own = length if rec is not None else 0
            yield at, own, None if rec else f"{wrong}, at {place} to {place + size} of the member", rec
            length -= own
        at = end
    if bad >= 0:
        yield bad, n - bad, why, None


RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("in_gap", T.BooleanType()),
    ]
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``error`` not null) of the archives below ``path``; one archive is in memory at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=RECORDS.names)

        for batch in batches:
            for k in range(batch.num_rows):
                name, rows, size = batch.column(0)[k].as_py(), [], 0
                for offset, length, error, rec in salvage(batch.column(1)[k].as_py()):
                    if rec is None:
                        rows.append((name, offset, length, error, *[None] * 8))
                    else:
                        f = rec["fields"]
                        body = rec["payload"] if payloads and rec["kind"] != "revisit" else None
                        rows.append((name, offset, length, None, rec["kind"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), rec["length"], body, rec["in_gap"]))
                        size += len(body or b"")
                    if len(rows) >= 2000 or size > 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(run, RECORDS)


def page_of(col: str) -> Column:
    """The page id of a record name; null for the name of a null id."""
    return F.regexp_extract(col, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
