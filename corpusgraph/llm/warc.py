"""WARC archives: writing pages as records, and reading them back from their segments.

Writing: of pages with equal payloads one is stored, the others revisit it. A stored page is an
HTTP response with chunked transfer framing; a block longer than a segment is cut into a first
record and continuation records. Each record is a gzip member of its own. Spark's text writer
lays the members into files (see `members`), so archives go through the same committed output
and the same file systems as any table.

Reading: archives are parsed record by record; continuation records are grouped by the id of the
record they continue, ordered by segment number, checked against the total length, joined, and
freed of their framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import Workspace, join_small

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
#: A record is compressed as one gzip member of less than this many bytes of content.
MEMBER_BYTES = 1 << 24
#: Fixed value: how zlib starts a member that has no name or time.
MEMBER_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03"
#: Parsed records that go on together.
BATCH_BYTES = 4 << 20


def to_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. Extensions and trailers are skipped."""
    out, at, view = [], 0, memoryview(body)
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(view[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, by its transfer framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    return from_chunks(body) if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked", head, re.IGNORECASE) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", str(v))
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + b"\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def members(raw: bytes) -> bytes:
    """A record as one gzip member, without the last byte, which the writer's line end supplies.

    A member ends with its length in four little-endian bytes. Below 16 MiB the last of them is
    zero, and a zero is what the text writer puts after each row. The file is then exactly the
    members one after the other.
    """
    if len(raw) >= MEMBER_BYTES:
        raise ValueError("a segment is too long for one member")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(raw) + squeeze.flush()
    assert out[-1] == 0 and out.startswith(MEMBER_HEAD)
    return out[:-1]


def page_records(record_id: str, page: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, revisit: bool, segment: int, chunk: int) -> Iterator[bytes]:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest), ("X-Page-ID", page), ("X-Payload-Length", len(payload))]
    if revisit:
        yield record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT), ("X-Refers-To-Page-ID", refers)], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + to_chunks(payload, chunk)
    cuts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(cuts) == 1:
        yield record([("WARC-Type", "response"), *fields], block)
        return
    yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], cuts[0])
    for k, cut in enumerate(cuts[1:], 2):
        own = uuid.uuid5(uuid.UUID(record_id), str(k))
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(cuts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", k), *last], cut)


def equal_payloads(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, response): the payloads of least_bytes or more that several pages have, and the largest page id."""
    return pages.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.max("page_id").alias("response")).where("k > 1 and response is not null").select("digest", "response")


def write_archives(pages: DataFrame, path: str, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10) -> None:
    """Writes a record per page under path; see read_archives for what a page's record holds.

    Only digests and ids are shuffled to find equal payloads; the pages themselves are written
    by the tasks that read them.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = work.save(equal_payloads(own, least_bytes), "equal")
    told = join_small(own, same, "digest", "left", same.count())
    revisit = F.col("response").isNotNull() & (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    told = told.select("page_id", "url", "payload", "digest", "response", revisit.alias("revisit"))
    run_id = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page, url, payload, sha1, response, again in zip(*(batch.column(k) for k in range(6)), strict=True):
                n += 1
                name = str(uuid.uuid5(run_id, f"{task}-{n}"))
                for raw in page_records(name, page.as_py(), url.as_py(), payload.as_py(), sha1.as_py(), response.as_py(), again.as_py(), segment_bytes, chunk_bytes):
                    out.append(members(raw))
                    held += len(out[-1])
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    # the cast takes the bytes as they are; the writer copies them and ends each row with a zero
    told.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def inflate(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other; a file that isn't gzip comes as it is."""
    view = memoryview(content)
    while len(view):
        if bytes(view[:2]) != b"\x1f\x8b":
            if bytes(view).strip(b"\x00"):
                yield bytes(view)
            return
        d = zlib.decompressobj(31)
        out = d.decompress(view)
        yield out + d.flush()
        view = view[len(view) - len(d.unused_data) :] if d.unused_data else view[:0]


def member_rows(spark: SparkSession, path: str) -> DataFrame:
    """(content): the members of the archives of `write_archives`, one a row, whatever the files' size.

    Every member starts with the same ten bytes, which Spark's text reader takes for the line
    separator: so a file is split between tasks at member bounds and never held as a whole. Should
    compressed data hold these bytes by chance (once in 2 ** 80 places), the cut shows, as the part
    before it isn't a whole member.
    """
    return spark.read.option("lineSep", MEMBER_HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "part-*.txt").text(path).select(F.col("value").cast("binary").alias("content")).where(F.octet_length("content") > 0)


def inflate_member(tail: bytes) -> bytes:
    """The content of a member of which the head is left out."""
    d = zlib.decompressobj(31)
    out = d.decompress(MEMBER_HEAD + tail)
    if not d.eof or d.unused_data.strip(b"\x00"):
        raise ValueError("no whole member between two heads")
    return out


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased header fields, block) of each record of a stretch of an archive."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record where one should start")
        fields = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
        n = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + n]
        at = end + 4 + n


PARSED = "origin string, segment int, total long, kind string, page_id long, refers_to long, digest string, n long, good boolean, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, good boolean"


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None


def _declared(fields: dict[str, str]) -> str | None:
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _payload(block: bytes, declared: str | None) -> tuple[str | None, int | None, bool]:
    """(digest, length, whether it agrees with the declared digest) of a block's payload."""
    try:
        payload = http_payload(block)
    except ValueError:
        return declared, None, False
    sha1 = hashlib.sha1(payload).hexdigest()
    return sha1, len(payload), declared in (None, sha1)


def parse_record(fields: dict[str, str], block: bytes) -> dict | None:
    kind, own = fields.get("warc-type"), fields.get("warc-record-id")
    row = dict.fromkeys(("origin", "segment", "total", "kind", "page_id", "refers_to", "digest", "n", "good", "block"))
    segment = _number(fields, "warc-segment-number")
    if kind == "continuation":
        return row | {"origin": fields.get("warc-segment-origin-id"), "segment": segment, "total": _number(fields, "warc-segment-total-length"), "block": block}
    if kind not in ("response", "revisit"):
        return None
    row |= {"origin": own, "kind": kind, "page_id": _number(fields, "x-page-id"), "refers_to": _number(fields, "x-refers-to-page-id"), "digest": _declared(fields)}
    if kind == "revisit":
        return row | {"n": _number(fields, "x-payload-length"), "good": True}
    if segment is not None:
        return row | {"segment": segment, "block": block}
    digest, n, good = _payload(block, row["digest"])
    return row | {"digest": digest, "n": n, "good": good}


def read_archives(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and good of each page record.

    A whole record is decoded where it is parsed, so only its figures go on; segments travel with
    their bytes to the record they continue. A group is one record, so its size is that of a
    page. good is false, and the length null, if segments are missing or double, their lengths
    don't add up to the total, the framing is broken, or the digest differs.

    Archives of `write_archives` are read member by member. With whole_files, any archives are, plain
    or of gzip members of any form, each file in one piece, so a file has to fit in a task.
    """

    def rows_of(raws: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        kinds = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("good", pa.bool_()), ("block", pa.binary())]
        schema, out, held = pa.schema(kinds), [], 0
        for raw in raws:
            for fields, block in records(raw):
                if (row := parse_record(fields, block)) is not None:
                    out.append(row)
                    held += 200 + len(row["block"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (x.as_buffer() for batch in batches for x in batch.column(0))
        yield from rows_of(raw for x in contents for raw in (inflate(x.to_pybytes()) if whole_files else [inflate_member(x.to_pybytes())]))

    source = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content") if whole_files else member_rows(spark, path)
    parsed = source.mapInArrow(parse, PARSED)
    part = F.when(F.col("segment").isNotNull(), F.struct("segment", "block"))
    whole = parsed.groupBy("origin").agg(*[F.max(c).alias(c) for c in ("kind", "page_id", "refers_to", "digest", "n", "total", "good")], F.array_sort(F.collect_list(part)).alias("parts")).where("kind is not null")
    numbers = F.transform("parts", lambda p: p.segment)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p.block))
    complete = (numbers == F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))) & (length == F.col("total"))
    blocks = F.when(F.size("parts") > 0, F.transform("parts", lambda p: p.block))
    whole = whole.select("page_id", "n", "digest", "kind", "refers_to", "good", blocks.alias("blocks"), F.coalesce(complete, F.lit(False)).alias("complete"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "n", "digest", "kind", "refers_to", "good"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        result = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            rows = batch.select(names).to_pylist()
            for row, parts, whole_one in zip(rows, batch.column(6), batch.column(7), strict=True):
                if parts.is_valid:
                    # the parts are joined once, from views of the batch
                    raw = b"".join(memoryview(p.as_buffer()) for p in parts.values) if whole_one.as_py() else None
                    row["digest"], row["n"], row["good"] = _payload(raw, row["digest"]) if raw is not None else (row["digest"], None, False)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=result)

    return whole.mapInArrow(decode, RESULT)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Writes archives of the pages into the shared folder and returns read_archives of them.

    Of records with equal payloads of least_bytes or more, that of the largest page id is the
    response and the others revisit it; rows that repeat with that id are all responses. Shorter
    payloads, null and empty ones among them, are all responses. A page without an id revisits a
    page with one, and never is what others refer to. An empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "warc")
    write_archives(pages, f"{work.path}/archives", work, id_col, url_col, html_col, **options)
    return read_archives(pages.sparkSession, f"{work.path}/archives")
