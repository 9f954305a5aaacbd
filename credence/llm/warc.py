"""WARC archives with revisit resolution.

Writing: headers (row, digest, length) are shuffled by payload digest, the record
with the largest page id of each digest stays a response, the others become revisit
records that name it. Records are built with fresh headers in the JVM and written
by Spark's text writer, whose committed files survive lost tasks: a record ends in
two line ends, the second of which is the writer's line separator.

Reading: archives are read as binary files, records are parsed by their content
length, payloads are checked against their digests, and revisit records are joined
with the original responses by digest.

Defined cases: a null html is an empty payload; payloads under ``least`` bytes are
always responses; of repeated rows one is the response and the others revisit it; a
null url leaves its header out; a null page id comes back as null and counts as the
smallest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import materialise, row_of, shared_dir, stable

#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Bytes of records that an archive should hold, before compression, and records at most.
ARCHIVE_BYTES, PER_FILE = 64_000_000, 20_000
#: Bytes that a reader inflates at once.
_PART = 1 << 20
_EOL = "\r\n"
#: Fixed value: the profile of revisit records that have the same payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        row_of(pages).alias("row"), F.col("page_id"), F.col("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
    )


def _record_id(page, row):
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), row.cast("string")))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def revisits(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows that revisit another: row, refers_to (page id), refers_row. Only headers are shuffled.

    The group of a digest is counted before the shuffle; in the join behind it, adaptive
    execution splits the partition of a digest that many rows share.
    """
    long = headers.filter(F.col("payload_bytes") >= least).select("row", "page_id", "digest", "payload_bytes")
    last = long.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "row")).alias("o"), F.count("*").alias("n"))
    many = last.filter(F.col("n") > 1).select("digest", "payload_bytes", F.col("o.page_id").alias("refers_to"), F.col("o.row").alias("refers_row"))
    return long.join(many, ["digest", "payload_bytes"]).filter(F.col("row") != F.col("refers_row")).select("row", "refers_to", "refers_row")


def records(pages: DataFrame, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One ``value`` per page: its whole WARC record but for the last line end."""
    headers = with_headers(pages)
    all_rows = headers.join(revisits(headers, least), "row", "left")
    again = F.col("refers_row").isNotNull()
    eol = F.lit(_EOL)

    def line(name: str, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, eol)
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), eol, eol)
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _record_id(F.col("page_id"), F.col("row")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(uri, F.lit("")), F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.lit(PROFILE), again),
        line("WARC-Refers-To", F.coalesce(F.concat(F.lit("<urn:uuid:"), _record_id(F.col("refers_to"), F.col("refers_row")), F.lit(">")), F.lit("")), again),
        line("Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("page_id").isNotNull()),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        eol,
    )
    return all_rows.select(F.concat(head, block, eol).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write deduplicated archives under ``path`` (gzip), of about ``ARCHIVE_BYTES`` each."""
    pages = stable(pages)
    n, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    per_file = max(1, min(PER_FILE, ARCHIVE_BYTES * n // (size + 600 * n))) if n else PER_FILE
    records(pages, least).write.option("lineSep", _EOL).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive in parts of bounded size, plain or of any number of gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PART] for i in range(0, len(data), _PART))
        return
    while data:
        member = zlib.decompressobj(31)
        part = member.decompress(data, _PART)
        while part or member.unconsumed_tail:
            yield part
            part = member.decompress(member.unconsumed_tail, _PART)
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, plain or gzip; one record is held at a time."""
    parts, held, at = inflated(data), bytearray(), 0

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held:
            return
        if end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        version, *lines = held[:end].decode().split(_EOL)
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        while len(held) < stop + 4 and more():
            pass
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record doesn't end at byte {at + stop}")
        yield head, bytes(held[start:stop])
        del held[: stop + 4]
        at += stop + 4


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record below ``path``: record_id, page_id, url, type, digest, refers, payload_bytes (null for revisits), payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "page_id", "url", "type", "digest", "refers", "payload_bytes"] + ["payload"] * with_payload
        made = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for head, block in parse(bytes(data)):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                    page = head.get("page-id")
                    row = (head["warc-record-id"], None if page is None else int(page), head.get("warc-target-uri"), head["warc-type"], digest, head.get("warc-refers-to"), None if payload is None else len(payload))
                    rows.append((*row, payload) if with_payload else row)
                    size += len(payload or b"") * with_payload
                    if size > 16 * _PART or len(rows) >= 10_000:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    schema = "record_id string, page_id long, url string, type string, digest string, refers string, payload_bytes long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def resolve(found: DataFrame) -> DataFrame:
    """Join revisit records to their original responses by payload digest: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    originals = found.filter("type = 'response'").select("digest", F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"))
    again = found.filter("type = 'revisit'").drop("payload_bytes").join(originals, ["digest", "refers"])
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"]
    first = found.filter("type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.select(*columns).unionByName(again.withColumnRenamed("original_bytes", "payload_bytes").select(*columns))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write deduplicated archives to the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/credence/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return resolve(materialise(read_records(spark, path), "warc-records"))
