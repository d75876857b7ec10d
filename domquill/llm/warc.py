"""Content-addressed WARC archive: payloads once by digest, record headers apart, joined to read."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, new_table_path, one_step, utf8

END = "\r\n"
#: The date that records carry unless one is given: an archive is the same whenever it is written.
WRITTEN = "2024-01-01T00:00:00Z"


def _base32_sha1(hexes: pa.Array) -> pa.Array:
    return pa.array([base64.b32encode(bytes.fromhex(h.as_py())).decode() for h in hexes], pa.string())


def write_archive(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", written: str = WRITTEN) -> str:
    """Archive ``pages`` under ``path`` (a new table in the shared folder by default) and return it.

    ``{path}/payloads``: (sha256, payload), each payload once. ``{path}/headers``: (record_id,
    sha256, response, header), the exact header block of every record, and whether it is a response.
    Of the records with one payload that with the largest key is the response, the others are
    revisits that refer to it; several rows with the same key and payload share one record id, and
    all of them are responses if it is the largest. Rows with a null key come after all others. A
    null html is an empty payload, a null url an empty one; line ends in a url become blanks.
    Payloads may be of any length; an empty table makes an empty archive; other columns are left out.

    Only digests are shuffled to find the response; payload bytes move once, those of response
    rows, and are checked against their digest on the way into the store.
    """
    spark = pages.sparkSession
    path = path or new_table_path(spark, "warc")
    body = utf8(pages[html])
    heads = pages.select(pages[key].cast("long").alias("record_id"), F.coalesce(pages[url], F.lit("")).alias("url"), F.sha2(body, 256).alias("sha256"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), _base32_sha1(b.column(3)), b.column(4)], ["record_id", "url", "sha256", "sha1", "size"])

    heads = in_arrow(heads, digests, "record_id long, url string, sha256 string, sha1 string, size long", 4096)
    # Both digests and the size: payloads that differ would have to collide in all three.
    first = heads.groupBy("sha256", "sha1", "size").agg(F.max("record_id").alias("response_id"))
    both = heads.join(first, ["sha256", "sha1", "size"])
    is_response = F.col("record_id").eqNullSafe(F.col("response_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(written)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        F.when(~is_response, F.concat(line("WARC-Refers-To", urn(F.col("response_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(is_response, F.col("size")).otherwise(F.lit(0)).cast("string")),
        F.lit(END),
    )
    with one_step(spark):
        both.select("record_id", "sha256", is_response.alias("response"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    # Joined by record, not by digest: copies of one payload are spread, and each partition then
    # has all rows of a record, so rows that repeat go without another shuffle.
    number = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    keep = spark.read.parquet(f"{path}/headers").where("response").select(number(F.col("record_id")).alias("id"), F.col("sha256").alias("digest")).distinct()
    store = pages.select(number(pages[key]).alias("id"), F.sha2(body, 256).alias("digest"), body.alias("payload")).join(keep, ["id", "digest"])
    store = store.dropDuplicates(["id", "digest"]).select(F.col("digest").alias("sha256"), "payload")
    with one_step(spark):
        store.write.parquet(f"{path}/payloads")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload): the stored bytes, each checked against its digest as it is read."""
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("a stored payload doesn't have its digest: "), F.col("sha256")))
    return stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, sha256, header, fields): every record's header block, and its named fields."""
    stored = spark.read.parquet(f"{path}/headers")
    lines = F.filter(F.split(F.decode("header", "UTF-8"), END), lambda x: x.contains(": "))
    return stored.drop("response").withColumn("fields", F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ": ", 1)), F.substr(x, F.position(F.lit(": "), x) + 2)))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record, header, payload, fields): the original records, byte by byte. A response's block is
    its payload, a revisit's is empty; ``payload`` is the full one of either, by join on the digest."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    block = F.when(F.col("fields")["warc-type"] == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_id", F.concat("header", block, F.lit((END + END).encode())).alias("record"), "header", "payload", "fields")


def record_summary(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page, from its records as they are put together again.

    Sizes and digests are those of the bytes read back; a record whose length or digest isn't what
    its header says raises. Payloads move once, to their records; a payload that very many records
    have is one row that adaptive execution hands to each part of them. Of a page that was archived
    twice there are two records; an empty archive has none.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), _base32_sha1(b.column(2)), *b.columns[3:]], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "told"])

    field = lambda name: F.col("fields")[name]
    records = read_records(spark, path)
    whole = F.octet_length("record") - F.octet_length("header") - 4 == field("content-length").cast("long")
    refers = F.try_to_number(F.regexp_extract(F.coalesce(field("warc-refers-to"), F.lit("")), r"<urn:page:(-?\d+)>", 1), F.lit("S9999999999999999999")).cast("long")
    read = records.select(
        F.when(whole, F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("a record isn't as long as its header says: "), F.col("record_id").cast("string"))).cast("long")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("sha1"),
        field("warc-type").alias("record_type"),
        refers.alias("refers_to"),
        field("warc-payload-digest").alias("told"),
    )
    out = in_arrow(read, digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, told string", 4096)
    checked = F.when(F.col("told") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a header's digest isn't its payload's: "), F.col("told"))).cast("string"))
    return out.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
