"""A content-addressed web archive.

Payload bytes are stored once, in a table of blobs named by their SHA-256. The exact header
bytes of every record are stored apart, in a table of headers. A record is its header and,
for a response, the blob it names; original records come back through a join of the two.

Of the records whose payloads are equal, that with the smallest id is the response; the others
are revisits that refer to it. Payloads shorter than ``least`` bytes are all responses.
A blob is verified when it is read: its bytes must have the digest they are stored under.

Copies are grouped by a pre-aggregated first value, so a payload moves at most once from each
task, whatever the size of its group. Headers are joined with stored tables of one row per
digest, which adaptive execution splits for a frequent digest. Null payloads are empty ones;
null addresses give an empty target. Ids name records and should be unique; records with a
null id are always responses.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.session import settle, shared_folder

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    blobs: str
    headers: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits give four base-32 digits."""
    digest = F.sha1(payload)
    out = []
    for k in range(0, 40, 5):
        part = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1))
                for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _header(kind: str) -> Column:
    """Header of a record, ending in an empty line."""
    common = [
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"),
                         "\n", "%0A"), F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha1"), F.lit("\r\n")]
    if kind == "revisit":
        common += [F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:record:"),
                   F.col("refers_to"), F.lit(">\r\nX-Payload-Length: "), F.col("bytes"),
                   F.lit("\r\nContent-Length: 0\r\n\r\n")]
    else:
        common += [F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
                   F.col("bytes"), F.lit("\r\n\r\n")]
    return F.concat(*[c.cast("string") for c in common])


def write(pages: DataFrame, archive: Archive, least: int = 0, id: str = "page_id",
          url: str = "url", payload: str = "html") -> None:
    """Write a record for every row: each distinct payload to the blobs, each header to the
    headers. ``payload`` is a string (stored as UTF-8) or binary."""
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option(
        "compression", "zstd").parquet(archive.blobs)
    digests = settle(rows.select("id", "url", "digest", F.length("payload").cast("long")
                                 .alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")),
                     "digests")
    first = settle(digests.groupBy("digest").agg(F.min("id").alias("response")), "responses")
    named = digests.join(first, "digest").withColumn("refers_to", F.when(
        (F.col("bytes") >= least) & (F.col("id") != F.col("response")), F.col("response")))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    named.select(
        "id", kind.alias("kind"), F.when(F.col("refers_to").isNull(), F.col("digest"))
        .alias("blob"), F.when(F.col("refers_to").isNull(), _header("response")).otherwise(
            _header("revisit")).cast("binary").alias("header")).write.parquet(archive.headers)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, record: the bytes of every original record, header, block and end, from the join
    of headers and blobs. A blob whose bytes do not have its digest is an error."""
    blobs = spark.read.parquet(archive.blobs)
    checked = blobs.where(F.expr(
        "CASE WHEN sha2(payload, 256) = digest THEN true ELSE "
        "raise_error(concat('damaged blob ', digest)) END")).withColumnRenamed("digest", "blob")
    headers = spark.read.parquet(archive.headers)
    end = F.lit(b"\r\n\r\n")
    full = headers.where("kind = 'response'").join(checked, "blob").select(
        "id", F.concat("header", "payload", end).alias("record"))
    return full.union(headers.where("kind = 'revisit'").select(
        "id", F.concat("header", end).alias("record")))


def parsed(record: bytes) -> dict:
    """Fields of one record: type, target, digest, refers_to, payload length, checked against
    its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"malformed record {head[:80]!r}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return {"type": "revisit", "digest": digest, "bytes": int(fields["X-Payload-Length"]),
                "refers_to": fields["WARC-Refers-To"][len("<urn:record:"):-1]}
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"payload without its digest in {head[:80]!r}")
    return {"type": "response", "digest": digest, "bytes": len(block), "refers_to": None}


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the reconstructed
    records say; lengths and digests of responses are those of their bytes."""
    found = records(spark, archive)
    kind = dict(found.dtypes)["id"]

    def make():
        def compute(batch: pa.RecordBatch) -> tuple:
            r = [parsed(x) for x in batch.column("record").to_pylist()]
            return tuple([x[k] for x in r] for k in ("bytes", "digest", "type", "refers_to"))

        return compute

    return computed(found.withColumnRenamed("id", "page_id"), ["page_id"], "payload_bytes bigint, "
                    "payload_digest string, record_type string, refers_to string", make).withColumn(
        "refers_to", F.col("refers_to").cast(kind))


def archived(pages: DataFrame, least: int = 0, id: str = "page_id", url: str = "url",
             payload: str = "html") -> DataFrame:
    """Write all pages to a new archive below the shared folder, and read it back."""
    spark = pages.sparkSession
    root = shared_folder(spark, "archive")
    archive = Archive(f"{root}/blobs", f"{root}/headers")
    write(pages, archive, least, id, url, payload)
    return read(spark, archive)
