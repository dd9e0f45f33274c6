"""Content-addressed WARC archive: payloads once, record headers apart, records by joins.

An archive is a folder of two tables. `payloads` holds every distinct payload once under its
SHA-256; `headers` holds the exact header block of every record with the digest of its
payload. Reading recomputes the digests from the stored bytes and puts records together by
joins on them. Only ids and digests are shuffled for finding repeats; they are stored before they
are joined, so that adaptive execution can split a digest which a third of all pages share. A
payload is shuffled once, by digest and page, so that such a payload moves no more than others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.rows import column, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NO_ID = 2**63 - 1
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Hexadecimal SHA-1 as base32: five hexadecimal digits are four characters."""

    def characters(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[
                F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * n).bitwiseAND(31) + 1, F.lit(1))
                for n in range(4)
            ]
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), characters), "")


def _header(record_type: Column, page: Column, url: Column, digest: Column, size: Column,
            refers_to: Column, run: str, date: str) -> Column:
    """The header block of a record, with the empty line that ends it."""

    def record_id(number: Column) -> Column:
        return F.concat(F.lit(f"<urn:{run}:"), number.cast("string"), F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    revisit = record_type == "revisit"
    # A line break in an address would end its field: control characters are percent-encoded.
    address = url
    for code in [*range(32), 127]:
        address = F.replace(address, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        field("WARC-Type", record_type),
        field("WARC-Record-ID", record_id(page)),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.when(url.rlike(r"[\x00-\x1F\x7F]"), address).otherwise(url)),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("X-Payload-Length", size.cast("string")),
        field("WARC-Refers-To", F.when(revisit, record_id(refers_to))),
        field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit(END),
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "2026-01-01T00:00:00Z",
) -> None:
    """Write one record per row of `pages` below `folder`.

    The payload is the UTF-8 of the text; null is an empty payload. Of records with equal
    payloads of at least `least_bytes`, those with the smallest id are responses and the
    others revisit them; smaller payloads are all responses. Rows without an id come last,
    and where only such rows share a payload, they are responses. Rows that repeat the
    smallest id of their payload are responses too, and share the stored payload. An empty
    table gives an empty archive.
    """
    body = F.coalesce(column(payload), F.lit("")).cast("binary")
    rows = pages.select(
        column(key).cast("long").alias("page"),
        column(url).cast("string").alias("url"),
        body.alias("payload"),
    ).withColumn("place", F.coalesce("page", F.lit(NO_ID)))
    named = rows.withColumn("digest", F.sha2("payload", 256))
    # Digests are taken once and stored. What is known of a digest is stored as well: joins of
    # two plain exchanges can be split where a third of all pages have the same payload.
    seen = stored(
        named.select(
            "page", "place", "url", "digest",
            F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"),
        ),
        "archive-digests",
    )
    first = seen.groupBy("digest").agg(F.min("place").alias("first_place"))
    first = stored(first.withColumnRenamed("digest", "first_digest"), "archive-firsts")
    same = F.col("digest") == F.col("first_digest")

    small = F.col("size") < least_bytes
    response = small | (F.col("place") == F.col("first_place"))
    record_type = F.when(response, "response").otherwise("revisit")
    refers_to = F.when(~response, F.col("first_place"))
    run = uuid.uuid5(uuid.NAMESPACE_URL, folder).hex
    headers = seen.join(first, same).select(
        "page",
        "digest",
        record_type.alias("record_type"),
        _header(record_type, F.col("page"), F.col("url"), base32_of_hex(F.col("sha1")),
                F.col("size"), refers_to, run, date).alias("header"),
    )
    headers.write.parquet(f"{folder}/headers")
    once = (
        named.join(first, same & (F.col("place") == F.col("first_place")))
        .dropDuplicates(["digest", "place"])
        .select("digest", "payload")
    )
    once.write.parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """`(digest, payload, size, sha1, verified)`, all computed from the stored bytes."""
    return spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("size"),
        base32_of_hex(F.sha1("payload")).alias("sha1"),
        (F.sha2("payload", 256) == F.col("digest")).alias("verified"),
    )


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    schema = "page long, digest string, record_type string, header string"
    return spark.read.schema(schema).parquet(f"{folder}/headers")


def _named(field: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{field}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: `(page, record)`, whole as they stand in a WARC file.

    Responses get their payload by a join on the digest; revisits have none.
    """
    headers = read_headers(spark, folder)
    payloads = read_payloads(spark, folder).select(F.col("digest").alias("_digest"), "payload")
    wanted = F.when(F.col("record_type") == "response", F.col("digest"))
    whole = F.concat(
        F.col("header").cast("binary"),
        F.coalesce("payload", F.lit(b"")),
        F.lit(f"{END}{END}".encode()),
    )
    return headers.withColumn("_wanted", wanted).join(
        payloads, F.col("_wanted") == F.col("_digest"), "left"
    ).select("page", whole.alias("record"))


def read_archive(spark: SparkSession, folder: str, key: str = "page_id") -> DataFrame:
    """One row per record, from its header and its verified payload.

    A record whose stored payload is missing, or does not have the digest and length that its
    header names, fails the job.
    """
    checked = read_payloads(spark, folder).select(
        F.col("digest").alias("_digest"), "size", "sha1", "verified"
    )
    joined = read_headers(spark, folder).join(checked, F.col("digest") == F.col("_digest"), "left")
    sound = F.coalesce(
        F.col("verified")
        & (F.concat(F.lit("sha1:"), F.col("sha1")) == _named("WARC-Payload-Digest"))
        & (F.col("size") == _named("X-Payload-Length").cast("long")),
        F.lit(False),
    )
    digest = F.when(sound, F.substring(_named("WARC-Payload-Digest"), 6, 32)).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    )
    number = F.regexp_extract(_named("WARC-Refers-To"), r":(-?\d+)>$", 1)
    own = F.regexp_extract(_named("WARC-Record-ID"), r":(-?\d+)>$", 1)
    return joined.select(
        F.when(own != "", own.cast("long")).alias(key),
        F.col("size").alias("payload_bytes"),
        digest.alias("payload_digest"),
        _named("WARC-Type").alias("record_type"),
        F.when(number != "", number.cast("long")).alias("refers_to"),
    )
