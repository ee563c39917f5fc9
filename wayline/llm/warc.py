"""Legacy archives to WARC.

``arc_bytes`` writes an ARC file, version 1 or 2; ``parse_arc`` reads one: the
version block names the fields of the header lines, and each record's declared
length says where it ends. ``convert`` turns a record into its WARC 1.1
equivalent: an identifier (a name-based UUID, so conversions repeat exactly),
the capture time in ISO form, a type and SHA-1 digests in base32.

Records with equal payloads: that of the largest page id is the response, the
others become revisits of it, without payload but with its HTTP header. Which
payloads repeat is found as in ``exact_dedup``: only pages that a Bloom filter
can't clear shuffle. Archives are text files whose separator is the end of a
WARC record, so Spark's own writer commits them, to any store; bytes pass
unchanged. ``read`` parses such files by their declared lengths. An archive
holds at most RECORDS_PER_FILE records, and fewer where the longest page could
make that many exceed ARCHIVE_BYTES; files of 2 GB or more can't be read back.

``read_arc`` reads stored ARC files, plain or compressed record by record, and
``convert_archives`` writes them as WARC: dates come from their header lines.

Edge cases: a null payload is empty. A null address is ``about:blank``; white
space and control characters in addresses are percent-encoded. Null ids count
as smallest and come back null. Rows that repeat the largest id of a group are
responses each. A payload may hold anything, header lines and separators too.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import attach, fresh_path, materialize
from .exact_dedup import filter_bits, maybe_repeated, repeated_cells

RECORDS_PER_FILE = 4000
ARCHIVE_BYTES = 1 << 29
BATCH_BYTES = 4 << 20
# The field lines of the two versions of the ARC format; fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def address(url: str | None) -> str:
    if not url:
        return "about:blank"
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def http_response(payload: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), len(payload)) + payload


def arc_bytes(name: str, version: int, records: Iterable[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (address, 14-digit time, media type, document) records."""
    about = f"{version} 0 wayline\n{ARC_FIELDS[version]}\n\n".encode()

    def line(url: str, ip: str, when: str, kind: str, data: bytes, at: int) -> bytes:
        more = "" if version == 1 else f" 200 {hashlib.md5(data).hexdigest()} - {at} {name}"
        return f"{url} {ip} {when} {kind}{more} {len(data)}\n".encode()

    parts = [line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", about, 0) + about]
    at = len(parts[0])
    for url, when, kind, data in records:
        parts.append(line(url, "127.0.0.1", when, kind, data, at) + data + b"\n")
        at += len(parts[-1])
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: the fields that its version block names, and ``document``."""
    fields: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        words = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(words[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at {at} is cut short")
        at = end + 1 + length
        if words[0].startswith("filedesc://"):
            version, fields = int(body.split(b" ", 1)[0]), body.split(b"\n")[1].decode().split(" ")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(words) != len(fields):
            raise ValueError(f"{len(words)} fields where the version block names {len(fields)}")
        yield dict(zip(fields, words, strict=True)) | {"document": body}


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def iso_time(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a response; documents without a header are all payload."""
    if block.startswith(b"HTTP/"):
        at = block.find(_END)
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def page_key(page_id: int | None) -> str:
    return f"page:{page_id}"


def capture_key(arc: dict) -> str:
    """What names a record that no page id does: address, time and content."""
    return f"capture:{arc['URL']} {arc['Archive-date']} {hashlib.sha1(arc['document']).hexdigest()}"


def convert(arc: dict, page_id: int | None, response_of: int | None, key: str | None = None) -> bytes:
    """The WARC record, without the two empty lines that end it. ``response_of``: the page whose response it revisits; ``key`` names the record instead of its page id."""
    header, payload = payload_of(arc["document"])
    revisit = response_of is not None
    block = header if revisit else arc["document"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response' if header else 'resource'}",
        f"WARC-Record-ID: {record_id(key or page_key(page_id))}",
        f"WARC-Date: {iso_time(arc['Archive-date'])}",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(page_key(response_of))}", f"Refers-To-Page: {response_of}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head += [f"Content-Type: {'application/http; msgtype=response' if header else arc['Content-type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        end = data.index(_END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + len(_END)


def _archive(version_of, when: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = list(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload").to_pylist(), batch.column("response_of").to_pylist(), strict=True))
            at = 0
            while at < len(rows):
                end, held = at, 0
                while end < len(rows) and (end == at or held + len(rows[end][2]) <= BATCH_BYTES):
                    held += len(rows[end][2])
                    end += 1
                legacy = arc_bytes(f"part-{part:05d}-{nth:05d}.arc", version_of(nth), [(address(u), when, "text/html", http_response(p)) for _, u, p, _ in rows[at:end]])
                made = [convert(arc, row[0], row[3]) for arc, row in zip(parse_arc(legacy), rows[at:end], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])
                at, nth = end, nth + 1

    return run


def alternate(nth: int) -> int:
    """Archives of both versions, by turns."""
    return 1 + nth % 2


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, dict]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_buffer().to_pybytes()
            if data.startswith(b"\x1f\x8b"):
                data = gzip.decompress(data)
            for nth, arc in enumerate(parse_arc(data)):
                yield path, nth, arc


def _in_batches(rows: Iterator[tuple], size_of, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES, so that a large archive's are not held at once."""
    held, out = 0, []
    for row in rows:
        out.append(row)
        held += size_of(row)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
            held, out = 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _arc_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "nth": pa.int64(), "url": pa.string(), "ip": pa.string(), "date": pa.string(), "content_type": pa.string(), "document": pa.binary(), "payload_digest": pa.string(), "record_id": pa.string()}
    rows = ((path, nth, a["URL"], a["IP-address"], iso_time(a["Archive-date"]), a["Content-type"], a["document"], base32_sha1(payload_of(a["document"])[1]), record_id(capture_key(a))) for path, nth, a in _stored(batches))
    return _in_batches(rows, lambda r: len(r[6]), kinds)


def _arc_files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of stored ARC files, of either version: path, nth (place in the file), url, ip, date (ISO), content_type, document, payload_digest (base32 SHA-1), record_id.

    A file is a task; a malformed one is an error that says where. No files, no rows."""
    return _arc_files(spark, path).mapInArrow(_arc_rows, "path string, nth bigint, url string, ip string, date string, content_type string, document binary, payload_digest string, record_id string")


def _arc_to_warc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((convert(a, None, None, capture_key(a)),) for _, _, a in _stored(batches))
    return _in_batches(rows, lambda r: len(r[0]), {"record": pa.binary()})


def convert_archives(spark: SparkSession, source: str, target: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a WARC record of every record of the ARC files under ``source``, equal ones too, to archives that ``read`` reads."""
    records = _arc_files(spark, source).mapInArrow(_arc_to_warc, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", records_per_file).text(target)


def records_per_file(largest: int) -> int:
    """As many records as fit an archive if all were as large."""
    return max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES // max(largest, 1)))


def write(pages: DataFrame, path: str, when: str = "20080430204825") -> None:
    """Writes a WARC record of each page (page_id, url, html) to the archives under ``path``."""
    ship(pages.sparkSession)
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    # a record's length at most: headers, an address whose characters may all be encoded, and the payload
    size = F.octet_length(payload) + 6 * F.coalesce(F.octet_length(pages["url"].cast("string")), F.lit(0)) + 2048
    rows = materialize(pages.select(pages["page_id"].cast("long").alias("page_id"), F.sha1(payload).alias("digest"), size.cast("long").alias("size")).withColumn("h", F.xxhash64("digest")), "warc-digests")
    largest = rows.agg(F.max("size").alias("m")).first()["m"] or 0
    n, bits = filter_bits(rows)
    filled = repeated_cells(rows, bits)
    some = maybe_repeated(rows, filled, bits).where("maybe")
    groups = materialize(some.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-groups")
    whole = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha1(payload).alias("digest"))
    tested = maybe_repeated(whole.withColumn("h", F.xxhash64("digest")), filled, bits)
    alone = tested.where("not maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("response_of"))
    met = attach(tested.where("maybe").select("page_id", "url", "payload", "digest"), groups, "digest", "n", n, "page_id")
    revisits = met.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("response_of"))
    records = alone.unionByName(revisits).mapInArrow(_archive(alternate, when), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", records_per_file(largest)).text(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for headers, block in parse_warc(content.as_buffer().to_pybytes()):
                header, payload = payload_of(block)
                kind, size = headers["warc-type"], len(payload)
                told = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "revisit":
                    size = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", header)[1])
                elif base32_sha1(payload) != told:
                    raise ValueError(f"{headers['warc-record-id']}: the payload's digest is not {told}")
                page, first = headers.get("page-id"), headers.get("refers-to-page")
                out.append((int(page) if page else None, headers.get("warc-target-uri"), headers["warc-date"], size, told, kind, int(first) if first else None))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, payload_bytes, payload_digest, record_type, refers_to of every record in the archives."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, "page_id bigint, url string, date string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
