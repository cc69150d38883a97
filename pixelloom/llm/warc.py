"""WARC archives with revisit resolution.

Writing: payload digests are compared without the payloads. Headers (page id,
digest, length) are shuffled by digest, the record with the largest page id of
each group becomes the response, and the others revisit it; then every page is
joined with its decision by page id, so a hot digest never gathers payloads.
Records go out through Spark's text writer, which commits files whole or not at
all and reaches every file system that Spark does: each row is a record up to
its last line end, and the line separator is CRLF. Archives are gzip files.

Reading: a file is inflated and cut by Content-Length. Revisit records hold no
payload; ``resolve`` shuffles headers by payload digest again and joins each
revisit to the response that its digest names.

Defined results: a null payload is empty. Payloads under ``least`` bytes are
always responses. A page id that occurs twice with the winning payload is
written as a response both times. Records without a page id rank below all
others; where no record of a group has one, all are responses. URLs are
percent-encoded where they could break a header; a null URL has no header. Very
long payloads are written whole, one to a file. Further columns are ignored,
whatever their names. An empty table gives archives without records.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes up to which so many records go to one archive file: none but a single
#: record has more than 128 MiB of payloads, so readers hold a bounded part.
SIZES = ((1 << 16, 2048), (1 << 20, 128), (1 << 24, 8), (1 << 62, 1))


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row for each page: what a record's header needs, and the payload itself."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
        payload.alias("payload"),
    )


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url) of the records that revisit another."""
    keys = records.where(F.col("payload_bytes") >= least).select("page_id", "url", "payload_digest", "payload_bytes").where("page_id is not null")
    # equal payloads have equal digest and length
    group = ["payload_digest", "payload_bytes"]
    first = keys.groupBy(*group).agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = shared.cut(first, "originals")  # both sides of the join then have exchanges, which Spark may split
    return keys.join(first, group).where("page_id <> first.page_id").select("page_id", "payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(records: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every record, deduplicated, under fresh headers; large records in files of their own."""
    largest, low = records.agg(F.max("payload_bytes")).first()[0] or 0, -1
    for k, (high, most) in enumerate(SIZES):
        if low < largest:
            part = records.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))  # equal payloads are of one size
            _write(part, revisits(part, least), f"{path}/size-{k}", most, date)
        low = high


def _write(records: DataFrame, again_: DataFrame, path: str, most: int, date: str) -> None:
    decided = records.alias("r").join(
        again_.alias("v"),
        (F.col("r.page_id") == F.col("v.page_id")) & (F.col("r.payload_digest") == F.col("v.payload_digest")),
        "left",
    )
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("r.page_id"), F.col("r.payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("r.payload_digest"))),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("refers_to"), F.col("r.payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("X-Page-ID", F.col("r.page_id")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )
    decided.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        at = end + 4 + int(fields["Content-Length"])
        yield fields, data[end + 4 : at]
        at += 4


READ = "page_id long, url string, record_id string, record_type string, payload_digest string, refers_id string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``. Digests of responses are
    computed from what was read and must be those of the headers."""
    from hashlib import sha1

    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                rows = []
                for h, block in parse(gzip.decompress(raw) if bytes(raw[:2]) == b"\x1f\x8b" else raw.to_pybytes()):
                    digest, kind, page = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], h.get("X-Page-ID")
                    if kind == "response" and sha1(block).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
                    rows.append((None if page is None else int(page), h.get("WARC-Target-URI"), h["WARC-Record-ID"], kind, digest, h.get("WARC-Refers-To"), len(block) if kind == "response" else None, block if payloads and kind == "response" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the revisits' payload_bytes filled in and refers_to, the
    page_id of the response that each revisit's digest and record id name."""
    own = records.drop("payload")
    originals = own.where("record_type = 'response'").select("payload_digest", F.col("record_id").alias("refers_id"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("original_bytes"))
    # repeated rows of one response are one original; only those that are asked for are kept
    asked = own.where("record_type = 'revisit'").select("payload_digest", "refers_id").distinct()
    originals = shared.cut(originals.join(asked, ["payload_digest", "refers_id"], "left_semi").distinct(), "resolved")
    joined = own.join(originals, ["payload_digest", "refers_id"], "left")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"))


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(headers(pages), path := shared.fresh_path(spark, "warc"))
    records = shared.cut(read_archives(spark, path, payloads=False), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM w
"""
