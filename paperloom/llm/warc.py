"""Content-addressed WARC archive.

store_records() keeps two tables: `payloads`, every distinct payload once under its SHA-256, and `records`, the exact
header bytes of every record with that digest. read_archive() joins them and gives back each record, header and payload,
after checking length and digest; a payload that does not match stops the job. write_archive() stores pages: of pages with
equal payloads the one with the least id is a response and the others are revisits of it. record_bytes() is a record as
it stands in a WARC file, parsed() takes such bytes apart again, write_warc() and read_warc() are the files themselves.

All but read_warc() is DataFrame functions. Finding the least id pre-aggregates on the map side; the joins on the digest are plain
equi-joins whose hot digests AQE may split. read_warc() takes each file, plain or gzipped, as the whole input of one task.

Defined cases: a null payload counts as empty; payloads below `least_bytes` are always responses; repeated ids with
equal payloads give as many records, of which those with the least id are responses; a repeated id with another payload is a
record of its own; a null url is written as an empty target, line breaks in one are left out, and it may be of any length; given headers
are kept byte for byte; a payload may hold what looks like a record; an empty table gives an empty archive; rows without
an id are left out; other input columns, whatever their names, are ignored; a file that ends inside a record stops the job.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import scratch_path, with_ids

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
EMPTY_DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight groups of five hexadecimal digits, four letters each."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        group = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)
        ]
    return F.concat(*letters)


def _headers() -> Column:
    """Header block of a record, up to and with the empty line."""
    uid = lambda n: F.concat(F.lit("<urn:uuid:"), F.format_string("%08x-0000-4000-8000-%012x", F.shiftrightunsigned(n, 48).cast("int"), n.bitwiseAND(F.lit((1 << 48) - 1))), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), uid(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(EMPTY_DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uid(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def _rows(pages: DataFrame, id_column: str, payload_column: str, url_column: str) -> DataFrame:
    url = F.col(url_column).cast("string") if url_column in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = with_ids(pages, id_column).select(F.col(id_column).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.unhex(F.sha2("payload", 256))})


def _store_payloads(rows: DataFrame, path: str, *more: Column) -> None:
    held = [F.first("payload_bytes").alias("payload_bytes"), F.first("payload").alias("payload")]
    rows.groupBy("sha256").agg(*more, *held).write.parquet(f"{path}/payloads")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url") -> None:
    rows = _rows(pages, id_column, payload_column, url_column)
    _store_payloads(rows, path, F.min("page_id").alias("head"))
    heads = pages.sparkSession.read.schema("sha256 binary, head long").parquet(f"{path}/payloads")
    ids = rows.select("page_id", "url", "payload_bytes", "sha256", sha1_base32(F.col("payload")).alias("payload_digest"))
    revisit = (F.col("page_id") != F.col("head")) & (F.col("payload_bytes") >= least_bytes)
    records = ids.join(heads, "sha256").withColumns(
        {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("head"))}
    )
    records.select("page_id", "sha256", "payload_bytes", _headers().cast("binary").alias("header")).write.parquet(f"{path}/records")


def store_records(records: DataFrame, path: str, keys: tuple[str, ...] = ("file", "place")) -> None:
    """Store records (keys, header, payload), such as those of read_warc(), with their headers as they are."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = records.select(*keys, F.col("header").cast("binary").alias("header"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.unhex(F.sha2("payload", 256))})
    _store_payloads(rows, path)
    rows.select(*keys, "sha256", "payload_bytes", "header").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str, keys: str = "page_id long") -> DataFrame:
    """keys, header, payload of every record, the payload checked against the digest and the length it was stored under."""
    payloads = spark.read.schema("sha256 binary, payload_bytes long, payload binary").parquet(f"{path}/payloads")
    records = spark.read.schema(f"{keys}, sha256 binary, payload_bytes long, header binary").parquet(f"{path}/records")
    whole = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    sound = payloads.select(
        "sha256", F.col("payload_bytes").alias("stored_bytes"),
        F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"),
    )
    same = F.when(F.col("payload_bytes") == F.col("stored_bytes"), F.col("payload"))
    same = same.otherwise(F.raise_error(F.lit("a record's length does not match its payload")))
    return records.join(sound, "sha256").select(*[k.split()[0] for k in keys.split(", ")], "header", same.alias("payload"))


def record_bytes() -> Column:
    """A record as it stands in a WARC file; a revisit has no block."""
    block = F.when(F.col("header").cast("string").contains("WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), block, F.lit((CRLF + CRLF).encode()))


def parsed(record: Column) -> tuple[Column, Column]:
    """(header as text, block) of a record's bytes: the header ends at the first empty line, its Content-Length cuts the block."""
    header = F.concat(F.substring_index(record.cast("string"), CRLF + CRLF, 1), F.lit(CRLF + CRLF))
    length = F.regexp_extract(header, r"(?i)\r\nContent-Length: *(\d+)\r\n", 1).cast("int")
    block = F.substring(record, F.octet_length(header) + 1, length)
    end = F.octet_length(header) + length + 4 == F.octet_length(record)
    return header, F.when(end, block).otherwise(F.raise_error(F.lit("a record's block does not have the length that its header says")))


def describe(records: DataFrame) -> DataFrame:
    """What the bytes of read_archive()'s records of pages say, a response's block checked against its header's digest.

    A revisit has its payload's length and digest in its header; they are checked against the payload it refers to.
    """
    header, block = parsed(F.col("record"))
    rows = records.select("page_id", "payload", record_bytes().alias("record"))
    rows = rows.select("page_id", header.alias("header"), block.alias("block"), "payload")
    field = lambda pattern: F.regexp_extract("header", pattern, 1)
    high, low = (F.regexp_extract("header", r"WARC-Refers-To: <urn:uuid:([0-9a-f]{8})-0000-4000-8000-([0-9a-f]{12})>", k) for k in (1, 2))
    refers = F.when(high != "", F.conv(F.concat(F.substring(high, 5, 4), low), 16, -10).cast("long"))
    said = rows.select(
        "page_id", field(r"WARC-Type: (\w+)\r\n").alias("record_type"), refers.alias("refers_to"), field(r"WARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n").alias("said"),
        field(r"X-Payload-Length: (\d+)\r\n").cast("long").alias("length"),
        F.when(F.col("header").contains("WARC-Type: revisit\r\n"), F.col("payload")).otherwise(F.col("block")).alias("payload"),
    )
    said = said.withColumn("digest", sha1_base32(F.col("payload")))
    true = (F.col("said") == F.col("digest")) & (F.col("length") == F.octet_length("payload"))
    digest = F.when(true, F.col("said")).otherwise(F.raise_error(F.lit("a record's header does not match its payload")))
    return said.select("page_id", F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


# --- files ---


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records of read_archive() as WARC files, one for each partition: the text writer puts the bytes out as they are
    and ends each with two line breaks, as the format wants. With compression="gzip" a file is one gzip member."""
    block = F.when(F.col("header").cast("string").contains("WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat("header", block).cast("string")
    records.select(whole.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def records_of(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(place, header with its empty line, block) of each record of a WARC file; gzip members may follow one another."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    place = 0
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        header = [line]
        while header[-1] not in (b"\r\n", b"\n"):
            header.append(source.readline())
            if not header[-1]:
                raise ValueError("the file ends inside a record's header")
        whole = b"".join(header)
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", whole)
        if not length:
            raise ValueError("a record's header has no Content-Length")
        block = source.read(int(length[1]))
        if len(block) < int(length[1]):
            raise ValueError("the file ends inside a record's block")
        yield place, whole, block
        place += 1


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held, size = [], 0
            for record in records_of(data.as_py()):
                held.append((name, *record))
                size += len(record[2])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["file", "place", "header", "payload"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["file", "place", "header", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, header, payload) of every record of the WARC files under a path, headers as they stand there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read_files, "file string, place long, header binary, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to an archive in the shared folder and described from its records' bytes."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return describe(read_archive(pages.sparkSession, path))
