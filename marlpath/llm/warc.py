"""A content-addressed WARC archive: payloads stored once by SHA-256, exact record headers beside them, records rebuilt by joins.

The archive is two Parquet tables in one folder: ``payloads`` (payload_digest, payload) and ``heads`` (head, http),
where head is a record's WARC header block and http its HTTP header block, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:marlpath:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def one_line(text: Column) -> Column:
    """Header values can't hold line ends: these are percent-encoded, and a null is a single dash."""
    return F.replace(F.replace(F.coalesce(text, F.lit("-")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, least: int = 100, captured: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row of ``pages`` (page_id, url, html) into the archive at ``path``.

    The payload is the html in UTF-8, empty for null. Of the records with equal payloads of at least ``least`` bytes
    that of the smallest page_id is the response and the others revisit it; smaller payloads are all responses, but
    stored once too. Repeated rows give repeated records: with one page_id they are all responses, or all revisits.
    A null page_id comes after all others; if there is no other it is the response. Page ids are whole numbers.
    Digests and the header of each record are made in one pass; only digests and ids meet to find the first of each
    payload, and each payload is shuffled once, to be stored.
    """
    digest = F.lower(F.hex("payload_digest"))  # as bytes on the way
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    hashed = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("payload_digest"))
    sized = hashed.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("n"))
    first = sized.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    store = hashed.join(first, "payload_digest").where(F.col("page_id").eqNullSafe(F.col("first_id"))).select(digest.alias("payload_digest"), "payload")
    repeated = sized.groupBy("page_id", "payload_digest").count().where("count > 1").limit(1).count()
    (store.dropDuplicates(["payload_digest"]) if repeated else store).write.option("compression", "zstd").parquet(f"{path}/payloads")

    joined = sized.join(first, "payload_digest")
    revisits = (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(captured)),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisits, F.concat(line("WARC-Refers-To", record_id(F.col("first_id"))), line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisits, 0).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"),
    )
    joined.select(head.alias("head"), http.alias("http")).write.option("compression", "zstd").parquet(f"{path}/heads")


def header(head: Column, name: str) -> Column:
    """The value of a header line; null where there is none."""
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, payload_digest, refers_to, payload_bytes, record (all its bytes) and payload.

    Records are rebuilt by joining heads and payloads on the digest that a head names. page_id, type and reference come
    from the record's header lines; payload_bytes and payload_digest from the rebuilt bytes: a response's from behind its
    header blocks, a revisit's from the payload that it shares. A digest or a Content-Length that doesn't hold raises.
    A payload joins all its records; with very many copies that join's one key is split by adaptive skew handling.
    """
    stored = spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads").select(F.unhex("payload_digest").alias("key"), "payload")
    heads = spark.read.schema("head string, http string").parquet(f"{path}/heads")
    named = heads.select("head", "http", F.unhex(F.regexp_extract(header(F.col("head"), "WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1)).alias("key"))
    full = named.join(stored, "key").withColumn("named", F.lower(F.hex("key"))).drop("key")
    response = header(F.col("head"), "WARC-Type") == "response"
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("head").cast("binary"), F.col("http").cast("binary"), body, F.lit(b"\r\n\r\n"))
    made = full.withColumn("record", record).withColumn("blocks", F.octet_length("head") + F.octet_length("http"))
    inside = F.octet_length("record") - F.col("blocks") - 4
    made = made.withColumn("payload", F.when(response, F.substring(F.col("record"), F.col("blocks") + 1, inside)).otherwise(F.col("payload")))
    fits = (F.sha2("payload", 256) == F.col("named")) & (header(F.col("head"), "Content-Length").try_cast("long") == F.octet_length("http") + inside)
    return made.select(
        F.regexp_extract(header(F.col("head"), "WARC-Record-ID"), r"page:(-?\d+)", 1).try_cast("long").alias("page_id"),
        header(F.col("head"), "WARC-Type").alias("record_type"),
        F.when(fits, F.col("named")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "named"))).alias("payload_digest"),
        F.regexp_extract(header(F.col("head"), "WARC-Refers-To"), r"page:(-?\d+)", 1).try_cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "record",
        "payload",
    )


def export_files(records: DataFrame, path: str, records_a_file: int = 5000, compression: str = "none") -> None:
    """The records of read_archive as .warc text files: the blank lines that end a record are the writer's line ends."""
    text = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "utf-8")
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_a_file).option(
        "compression", compression
    ).text(path)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(head, block) of every record of uncompressed .warc files, parted by their Content-Length; a file is one task's, so files are kept small."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, heads, found = content.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    size = next(int(x.split(b":")[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    heads.append(data[at:end].decode())
                    found.append(data[end : end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(found, pa.binary())], ["head", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "head string, block binary")
