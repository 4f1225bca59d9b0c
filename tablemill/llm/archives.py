"""Web archives: ARC files of versions 1 and 2, converted to WARC.

Pages are packed into ARC archives, archives are parsed by their version's URL-record fields
and declared lengths, and each record becomes a WARC record: an identifier made from its
place, the ISO form of its 14-digit date, a type, and SHA-1 digests of block and payload.
An archive is the unit of work: a row on its way to a file, and a file on its way back. Its
size is bounded when it is written, and a record larger than the bound has one to itself.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.llm.common import release
from tablemill.session import work_path

ARCHIVE_BYTES = 8 << 20
CAPTURED = "20000101000000"

# The URL-record fields of the two ARC versions, in the order of the header line.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ),
}
RECORDS = "archive string, at long, page_id long, payload_bytes long, payload_digest string"
DECIDED = "array<struct<at:long,record_type:string,refers_to:long,refers_uri:string>>"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _field(value: bytes | None) -> str:
    """A header-line field: no white space or control characters, never empty."""
    text = (value or b"").decode("utf-8", "replace")
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in text) or "-"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    """The stored HTTP response of a page."""
    lines = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if page_id is not None:
        lines.append(b"X-Page-Id: %d" % page_id)
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload


def arc_header(version: int, name: str) -> bytes:
    """The version block that opens an ARC file."""
    body = b"%d %d example\n%s\n" % (version, 0, " ".join(ARC_FIELDS[version]).encode())
    fields = [f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: bytes | None, block: bytes, name: str, offset: int, captured: str = CAPTURED) -> bytes:
    fields = [_field(url), "0.0.0.0", captured, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return b"\n" + " ".join([*fields, str(len(block))]).encode() + b"\n" + block


def unpacked(content: bytes) -> bytes:
    """The content of a file: each gzip member in turn, or as it is if it isn't gzip."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += [member.decompress(content), member.flush()]
        content = member.unused_data
    return b"".join(out)


def read_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an ARC file, its version block left out.

    The version block names the fields; each record's last field declares its length, so what
    a block holds is never looked at to find the next one.
    """
    names: Sequence[str] = ()
    at = 0
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"an ARC record at {at} has no header line")
        values = content[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        try:
            size = int(values[-1])
        except ValueError:
            raise ValueError(f"an ARC record at {at} declares no length") from None
        block = content[end + 1 : end + 1 + size]
        if size < 0 or len(block) < size:
            raise ValueError(f"an ARC record at {at} declares {size} bytes; {len(block)} are there")
        if values[0].startswith("filedesc://"):
            version = int(block.split(b" ", 1)[0])
            names = block.split(b"\n")[1].decode().split(" ") if block.count(b"\n") > 1 else ARC_FIELDS[version]
        else:
            if not names:
                names = ARC_FIELDS[2 if len(values) >= len(ARC_FIELDS[2]) else 1]
            # Old writers left spaces in URLs: surplus parts belong to the first field.
            surplus = max(0, len(values) - len(names))
            values = [" ".join(values[: surplus + 1]), *values[surplus + 1 :]]
            yield at, dict(zip(names, values, strict=False)), block
        at = end + 1 + size


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its blank line, headers by lower-case name, payload) of a stored response."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return b"", {}, block
    head = block[: end + 4]
    lines = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return head, {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, v in lines}, block[end + 4 :]


def record_uri(archive: str, at: int) -> str:
    """Identifier of the record at a place: the same each time it is made."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def iso_date(captured: str) -> str:
    """ISO form of an ARC date; missing digits count as the start of the period."""
    digits = (captured + CAPTURED[len(captured) :])[:14] if captured.isdigit() else CAPTURED
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def _warc(headers: Sequence[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def warc_record(
    archive: str, at: int, fields: dict[str, str], block: bytes, record_type: str, refers_uri: str | None, refers_to: int | None
) -> bytes:
    """The WARC record of one ARC record; a revisit keeps the HTTP head and drops the payload."""
    head, _, payload = http_parts(block)
    kept = block if record_type == "response" else head
    headers = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", record_uri(archive, at)),
        ("WARC-Date", iso_date(fields.get("Archive-date", ""))),
        ("WARC-Target-URI", fields.get("URL", "-")),
        ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")),
        ("WARC-Block-Digest", f"sha1:{digest(kept)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response" if head else fields.get("Content-type", "-")),
    ]
    if record_type == "revisit":
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", refers_uri or "-"))
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    return _warc(headers, kept)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths."""
    at = 0
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = (x.split(":", 1) for x in content[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        headers = {k.strip().lower(): v.strip() for k, v in lines}
        size = int(headers["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the WARC record at {at} declares {size} bytes; {len(block)} are there")
        yield headers, block
        at = end + 4 + size


def _one_file_each(archives: DataFrame, path: str) -> str:
    """Write each row's ``content`` as a gzip file of its own: bytes go out as they are."""
    rows = archives.select(F.col("content").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1).alias("archive")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(name, "content")


def write_arc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    versions: Sequence[int] = (1, 2),
) -> str:
    """Write pages as gzipped ARC archives under ``path``; versions take turns within a task.

    A payload is the HTML in UTF-8 (NULL: empty). A NULL URL is written as ``-``, a NULL id
    as no id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts, size = 0, [], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])

        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):
                block = http_response(page.as_py(), html.as_py() or b"")
                if parts and size + len(block) > archive_bytes:
                    yield whole()
                    made, parts, size = made + 1, [], 0
                version, name = versions[made % len(versions)], f"archive-{made}"
                if not parts:
                    parts.append(arc_header(version, name))
                    size = len(parts[0])
                parts.append(arc_record(version, url.as_py(), block, name, size))
                size += len(parts[-1])
        if parts:
            yield whole()

    rows = pages.select(
        F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("binary"), F.col(f"`{html_col}`").cast("binary")
    )
    return _one_file_each(rows.mapInArrow(run, "content binary"), path)


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "at", "page_id", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for archive, content in zip(*batch.columns, strict=True):
            rows = []
            for at, _, block in read_arc(unpacked(content.as_py())):
                _, headers, payload = http_parts(block)
                page = headers.get("x-page-id")
                rows.append((archive.as_py(), at, None if page is None else int(page), len(payload), digest(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content, decided in zip(*batch.columns, strict=True):
            name = archive.as_py()
            info = _warc(
                [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uri(name, 0)), ("WARC-Date", iso_date(CAPTURED)), ("Content-Type", "application/warc-fields")],
                f"converted-from: {name}\r\n".encode(),
            )
            how = {d["at"]: d for d in decided.as_py()}
            parts = [info]
            for at, fields, block in read_arc(unpacked(content.as_py())):
                d = how[at]
                parts.append(warc_record(name, at, fields, block, d["record_type"], d["refers_uri"], d["refers_to"]))
            # The writer ends a row with a line feed: the last of the record's two line ends.
            whole = b"".join(parts)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["content"])


def _uri_frame(records: DataFrame) -> DataFrame:
    """Adds ``uri``, the identifier of the record at (archive, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = [record_uri(a.as_py(), o.as_py()) for a, o in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uris, pa.string())], [*batch.schema.names, "uri"])

    return records.mapInArrow(run, records._jdf.schema().toDDL() + ", uri string")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> str:
    """Convert the ARC archives under ``arc_path`` to gzipped WARC archives, one for one.

    Of records with equal payloads the one with the smallest page id (then the first by archive
    and place; records without an id last) is the response; others become revisits that refer
    to it. Payloads are compared by digest and length, and empty ones count like any other.
    """
    archives = _files(spark, arc_path)
    found_path = work_path(spark, "arc-records")
    archives.mapInArrow(_arc_records, RECORDS).write.parquet(found_path)
    found = spark.read.schema(RECORDS).parquet(found_path)
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "archive", "at")).alias("first")
    firsts_path = work_path(spark, "arc-firsts")
    heads = found.groupBy("payload_digest", "payload_bytes").agg(first)
    heads = heads.select(F.col("first.archive").alias("archive"), F.col("first.at").alias("at"), F.col("first.page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    _uri_frame(heads).write.parquet(firsts_path)
    heads = spark.read.parquet(firsts_path).withColumnsRenamed({"archive": "first_archive", "at": "first_at"})
    known = found.join(heads, ["payload_digest", "payload_bytes"])
    is_first = (F.col("archive") == F.col("first_archive")) & (F.col("at") == F.col("first_at"))
    decided = F.struct(
        "at",
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("refers_to")).alias("refers_to"),
        F.when(~is_first, F.col("uri")).alias("refers_uri"),
    )
    per_archive = known.groupBy("archive").agg(F.collect_list(decided).alias("decided"))
    decided_path = work_path(spark, "arc-decided")
    per_archive.write.parquet(decided_path)
    per_archive = spark.read.schema(f"archive string, decided {DECIDED}").parquet(decided_path)
    release(spark)
    joined = archives.join(per_archive, "archive").select("archive", "content", "decided")
    return _one_file_each(joined.mapInArrow(_converted, "content binary"), warc_path)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in read_warc(unpacked(content.as_py())):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                _, http, payload = http_parts(block)
                declared = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != declared:
                    raise ValueError(f"{headers['warc-record-id']}: the payload isn't the one that was written")
                page, to = http.get("x-page-id"), headers.get("x-refers-to-page-id")
                size = len(payload) if kind == "response" else int(http["content-length"])
                rows.append((None if page is None else int(page), size, declared, kind, None if to is None else int(to)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records under ``path``.

    The size of a revisit is that of its stored HTTP head; a response's payload is checked
    against its digest.
    """
    rows = _files(spark, path).select("content")
    return rows.mapInArrow(_warc_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per row of ``pages``.

    Rows of one id are records of their own: with equal payloads one is the response. A NULL id
    stays NULL, and such a record is the response only of payloads that no page with an id has.
    NULL HTML is an empty payload. An empty table gives an empty one. Extra columns are ignored.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, work_path(spark, "arc"), id_col, url_col, html_col, archive_bytes)
    return warc_records(spark, convert_arc(spark, arc, work_path(spark, "warc")))
