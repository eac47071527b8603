"""Content-addressed WARC archive: payloads once by digest, exact headers by record.

Every page becomes a record. Its payload is stored once under its SHA-256, which is verified
against length and SHA-1 when written and computed anew when read; its header block is kept
as it is, byte by byte, in a table of its own. Reading joins the two and gives back
the original records, revisits with the payload they share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import map_batches, table, written
from baitwatch.plans.session import work_folder

#: Shorter payloads are stored and written as responses even where they repeat.
MIN_REVISIT_BYTES = 0
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, target_uri string, record binary"
)
#: Bytes of payload after which the records put together so far are handed on.
RECORD_BYTES = 4_000_000
_NAMESPACE = uuid.UUID(int=0)


class Archive(NamedTuple):
    headers: str
    payloads: str


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def header_block(page_id, url, sha1: bytes, length: int, first) -> bytes:
    """The header block of a record; ``first`` is the page a revisit refers to, else null.

    Line breaks in an address would end a header line, so they are percent-encoded.
    """
    address = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(sha1).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}",
        ]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: text/html; charset=utf-8",
              f"Content-Length: {length if first is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Writes headers and payloads below the shared folder and returns the two places.

    Of equal payloads the record with the smallest id is the response. Which one that is
    follows from digests alone, so a payload only moves if it is stored. A null payload is
    empty, and a record without an id is always a response.
    """
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload").cast("long"),
    })
    facts = written(rows.select("page_id", "url", "digest", "bytes",
                                F.unhex(F.sha1("payload")).alias("sha1")), "records")
    groups = facts.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.min("bytes").alias("low"), F.max("bytes").alias("high"),
        F.min("sha1").alias("sha1_low"), F.max("sha1").alias("sha1_high"))
    sound = (F.col("low") == F.col("high")) & (F.col("sha1_low") == F.col("sha1_high"))
    groups = groups.select("first", F.when(sound, F.col("digest")).otherwise(
        F.raise_error(F.lit("two payloads with one SHA-256"))).alias("digest"))
    groups = written(groups, "digests")

    spark = pages.sparkSession
    # A null id gets the lowest number, so that the join and what follows share one exchange.
    def key_of(column: str):
        return F.coalesce(column, F.lit(-(1 << 63)))

    stored = groups.select(key_of("first").alias("key"), "digest")
    store = rows.select(key_of("page_id").alias("key"), "digest", "payload").join(
        stored, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])

    def pack(batch: pa.RecordBatch):
        yield {"digest": batch.column(0),
               "packed": [zlib.compress(p, 1) for p in batch.column(1).to_pylist()]}

    payloads = work_folder(spark, "payloads")
    map_batches(store, ["digest", "payload"], pack, "digest binary, packed binary").write.parquet(
        payloads)

    repeats = (F.col("page_id") != F.col("first")) & (F.col("bytes") >= min_revisit_bytes)
    typed = facts.join(groups, "digest").withColumn("first", F.when(repeats, F.col("first")))

    def head(batch: pa.RecordBatch):
        digests, *columns = batch.columns
        yield {"digest": digests,
               "header": [header_block(*row) for row in zip(*(c.to_pylist() for c in columns))]}

    headers = work_folder(spark, "headers")
    typed = typed.select("digest", "page_id", "url", "sha1", "bytes", "first")
    map_batches(typed, typed.columns, head, "digest binary, header binary").write.parquet(headers)
    return Archive(headers, payloads)


def read_archive(spark: SparkSession, archive: Archive, with_record: bool = True) -> DataFrame:
    """The original records with what their headers say; fails on a payload that has changed.

    ``record`` holds header block and payload, of a revisit too; without ``with_record`` it
    is null.
    """
    headers = spark.read.schema("digest binary, header binary").parquet(archive.headers)
    payloads = spark.read.schema("digest binary, packed binary").parquet(archive.payloads)
    joined = headers.join(payloads, "digest").select("digest", "header", "packed")

    names = [f.split()[0] for f in READ.split(", ")]

    def unpack(batch: pa.RecordBatch):
        found: dict[str, list] = {name: [] for name in names}
        size, last, payload, sha1 = 0, None, b"", ""
        for row in range(batch.num_rows):
            digest, block, packed = (c[row].as_py() for c in batch.columns)
            if digest != last:
                # Rows come in order of the digest, so a payload is checked once a batch.
                last, payload = digest, zlib.decompress(packed)
                sha1 = base32_sha1(payload)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"a payload of {len(payload)} bytes has changed")
            header = parse_header(block)
            if header["WARC-Payload-Digest"] != f"sha1:{sha1}":
                raise ValueError(f"payload of {header['WARC-Record-ID']} has changed")
            page, first = header.get("X-Page"), header.get("X-Refers-To-Page")
            values = (page and int(page), len(payload), sha1, header["WARC-Type"],
                      first and int(first), header["WARC-Target-URI"],
                      block + payload if with_record else None)
            for name, value in zip(names, values):
                found[name].append(value)
            size += len(payload)
            if size >= RECORD_BYTES:
                yield found
                found, size = {name: [] for name in names}, 0
        yield found

    return map_batches(joined, joined.columns, unpack, READ)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(spark, write_archive(table(spark, sf_dir, "pages")))
    return records.drop("target_uri", "record")


#: SHA-1 in base32: five hex digits are four digits of base 32.
_BASE32 = "".join(
    f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n{i} >> {shift}) & 31)::INTEGER, 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)[4:]
ORACLE_SQL = f"""
WITH payload AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
         min(page_id) OVER (PARTITION BY body) AS first
  FROM payload),
parts AS (
  SELECT *, {", ".join(f"('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT AS n{i}" for i in range(8))}
  FROM digests)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts
"""
