"""WARC archives in which equal payloads are stored once, and reading them back.

Only headers (page, url, digest, size) are shuffled by payload digest to find the original of
each group: the record of the smallest page_id. The others become revisit records that
refer to it and carry no payload. Each record is a gzip member of its own, so it can be read
at its offset alone; ``archive_index`` lists (payload_digest, file, offset, length). Spark's
text sink writes the members into files of bounded size, and the committer discards what
lost executors have half written. Reading streams each file record by record, trusts
Content-Length only, and joins revisits to the responses they refer to.

A gzip member ends with the high byte of its size, zero for records under 16 MB; larger ones
are followed by an empty member, which ends with zero too. That byte is the sink's line
separator, so files hold nothing but members. They are gzip files whatever the sink calls them.

Payloads are equal when their SHA-256 is. Those under ``LEAST_REVISIT`` bytes are always
stored. A null html is an empty payload; a null url leaves its header out; line breaks in
a url are percent-encoded. Rows that repeat a page_id with equal html are records of the
same identifier and all response (or all revisit); the smallest url of the original's rows is
the one revisits name. A null page_id is never the smallest; a group of such rows alone is all
response. Rows of one page_id (or none) and html that fill an archive are dealt to several. An
empty table gives no archives and no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from latelane.llm.common import map_rows, written
from latelane.sources.scratch import scratch_path

LEAST_REVISIT = 100
ARCHIVE_BYTES = 24 << 20  # bytes of records per archive file, before compression
HEAD_BYTES = 600  # about what a record's headers take
BLOCK = 1 << 20
LEVEL = 6

# Fixed values of the WARC 1.1 and HTTP formats.
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = (
    "record_id string, page_id bigint, url string, record_type string, refers_to_record string, "
    "payload_bytes bigint, payload_digest string"
)
INDEX = (
    "record_id string, page_id bigint, record_type string, payload_digest string, file string, "
    "offset bigint, length bigint"
)


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and a key for equal rows."""
    html = F.coalesce("html", F.lit(""))
    return (
        pages.select("page_id", "url", html.alias("html"))
        .withColumn("payload_bytes", F.octet_length("html").cast("bigint"))
        .withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
        .withColumn(
            "row_key", F.concat_ws(":", F.col("page_id").cast("string"), F.col("payload_digest"))
        )
    )


def resolved(headers: DataFrame) -> DataFrame:
    """Per row_key the page and url that its records revisit, null for responses, and the
    bytes that all rows of the key take."""
    of_digest = headers.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = written(of_digest.agg(F.min(known).alias("first")), "first_records")
    size = F.sum(F.col("payload_bytes") + HEAD_BYTES).alias("row_bytes")
    rows = written(headers.groupBy("row_key", "page_id", "payload_digest").agg(size), "record_keys")
    other = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return rows.join(firsts, "payload_digest", "left").select(
        "row_key",
        "row_bytes",
        F.when(other, F.col("first.page_id")).alias("original"),
        F.when(other, F.col("first.url")).alias("original_url"),
    )


def record_urn(page_id: Column, digest: Column) -> Column:
    """A name-based identifier: the same page and payload always get the same."""
    h = F.md5(F.concat_ws(":", F.lit("page"), page_id.cast("string"), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(rows: DataFrame) -> Column:
    """The text of a row's record up to its closing empty lines."""
    revisit = F.col("original").isNotNull()
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "html"))

    def address(url: str) -> Column:
        return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")

    def header(name: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_urn(F.col("page_id"), F.col("payload_digest"))),
        header("WARC-Date", date),
        header("WARC-Target-URI", address("url")),
        header("X-Page-ID", F.col("page_id")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, header("WARC-Profile", REVISIT_PROFILE)),
        header("WARC-Refers-To", F.when(revisit, record_urn(F.col("original"), F.col("payload_digest")))),
        header("WARC-Refers-To-Target-URI", F.when(revisit, address("original_url"))),
        header("WARC-Refers-To-Date", F.when(revisit, date)),  # all records are written at once
        header("Content-Type", "application/http;msgtype=response"),
        header("Content-Length", F.octet_length(block)),
    )  # concat_ws leaves out the headers that are null
    return F.concat(lines, F.lit(END), block)


def member(record: bytes) -> bytes:
    """``record`` as a gzip member, with an empty one behind it if it does not end with zero."""
    packed = gzip.compress(record, LEVEL, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", LEVEL, mtime=0)


def _packed(rows: DataFrame) -> DataFrame:
    """The members of ``rows``' records less their last byte, the sink's separator."""

    def make():
        return lambda record: [(member(record + END.encode())[:-1],)]

    found = map_rows(
        rows.select(records(rows).cast("binary").alias("record")), "member binary", make, size=lambda r: len(r[0])
    )
    return found.select(F.col("member").cast("string").alias("value"))  # the same bytes


def write_archives(pages: DataFrame, path: str) -> str:
    """Write a record per row of ``pages`` (page_id, url, html) under the folder ``path``."""
    rows = with_digest(pages)
    keys = written(resolved(written(rows.drop("html"), "page_headers")), "resolved")
    heavy = F.col("row_bytes") >= ARCHIVE_BYTES

    def files(of: Column) -> int:
        return -(-(keys.where(of).agg(F.sum("row_bytes")).first()[0] or 0) // ARCHIVE_BYTES)

    # The payloads move once, to files of about equal size.
    light, many = rows, files(heavy)
    if many:
        light = rows.join(keys.where(heavy).select("row_key"), "row_key", "left_anti")
    out = light.repartition(max(1, files(~heavy)), "row_key").join(keys.where(~heavy), "row_key")
    if many:
        # Rows that would fill an archive by their key alone are dealt in turn.
        out = out.unionByName(rows.join(keys.where(heavy), "row_key").repartition(many))
    _packed(out).write.option("lineSep", "\0").text(path)
    return path


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """The header fields of the record that begins here, none at the end."""
    fields: dict[str, str] = {}
    if line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one must begin: {line[:40]!r}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
    return fields


def parse_records(stream: io.BufferedIOBase, payload: bool = False) -> Iterator[tuple]:
    """RECORD rows of one archive, and the payload as text if asked for."""
    while fields := _fields(stream):
        left = int(fields["content-length"])
        while left:
            line = stream.readline(left)
            left -= len(line)
            if line == b"\r\n":
                break
        digest, size, parts = hashlib.sha256(), left, []
        while left:
            part = stream.read(min(left, BLOCK))
            if not part:
                raise ValueError("the archive ends within a record")
            digest.update(part)
            left -= len(part)
            if payload:
                parts.append(part)
        if stream.read(4) != END.encode():
            raise ValueError("a record does not end where its length says")
        page = fields.get("x-page-id")
        row = (
            fields["warc-record-id"],
            int(page) if page is not None else None,
            fields.get("warc-target-uri"),
            fields["warc-type"],
            fields.get("warc-refers-to"),
            size,
            digest.hexdigest(),
        )
        yield (*row, b"".join(parts).decode()) if payload else row


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """RECORD rows (and ``html``) of all archives under ``path``, as they are stored."""

    def make():
        def each(content):
            with gzip.open(io.BytesIO(content)) as stream:
                yield from parse_records(stream, payload)

        return each

    files = spark.read.format("binaryFile").load(path)
    schema = RECORD + ", html string" * payload
    return map_rows(
        files.select("content"), schema, make, size=lambda r: len(r[7]) if payload else 0
    )


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member of an archive, empty ones left out."""
    start = 0
    while start < len(content):
        unpack, at, step, parts = zlib.decompressobj(31), start, 1 << 12, []
        while not unpack.eof:
            if at >= len(content):
                raise ValueError("the archive ends within a member")
            parts.append(unpack.decompress(content[at : at + step]))
            at += step
            step = min(2 * step, BLOCK)
        end = min(at, len(content)) - len(unpack.unused_data)
        if record := b"".join(parts):
            yield start, end - start, record
        start = end


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX rows of all archives under ``path``: where each record's member lies.

    payload_digest is that of the full payload, also of a revisit.
    """

    def make():
        def each(file, content):
            for offset, length, record in members(content):
                fields = _fields(io.BytesIO(record))
                page = fields.get("x-page-id")
                yield (
                    fields["warc-record-id"],
                    int(page) if page is not None else None,
                    fields["warc-type"],
                    fields["warc-payload-digest"].removeprefix("sha256:"),
                    file,
                    offset,
                    length,
                )

        return each

    files = spark.read.format("binaryFile").load(path)
    return map_rows(files.select("path", "content"), INDEX, make)


def full_records(stored: DataFrame) -> DataFrame:
    """``stored`` records with the size and digest of the full payload: those of the
    response that a revisit refers to."""
    stored = written(stored, "stored_records")
    targets = stored.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"))
    originals = written(
        targets.agg(
            F.min("page_id").alias("refers_to"),
            F.first("payload_bytes").alias("full_bytes"),
            F.first("payload_digest").alias("full_digest"),
        ),
        "responses",
    )
    revisit = F.col("record_type") == "revisit"
    return stored.join(originals, "refers_to_record", "left").select(
        "page_id",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what they hold."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch_path(spark, "archives"))
    return full_records(read_archives(spark, path))
