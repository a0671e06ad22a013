"""Content-addressed web archive.

``write_archive`` keeps two tables in a folder: ``payloads`` holds each distinct payload
once under its SHA-256, ``headers`` holds the exact header block of every record, its url as
given, and that digest. ``read_archive`` joins them to the original record bytes.

A record is the header block, an empty line, the payload and two line ends, as in
WARC/1.1. Of records with equal payloads of at least ``least`` bytes the one with the
largest id is the response and the others are revisits of it.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.groups import match
from tidemark.llm.columns import HEAVY_SHARE, join_groups, saved
from tidemark.session import save_stage

END = "\r\n"
LEAST_HEAVY = 100  # records of one payload that a task always takes together
# Fixed values of WARC/1.1.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTML = "text/html; charset=UTF-8"


def _line(name: str, value: Column) -> Column:
    """One header line; NULL leaves it out. Line ends in a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def records(
    pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", captured: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Header rows and payload rows of the pages.

    A NULL payload is empty and a NULL url has no header line. Rows equal in id and
    payload are revisits of each other's response: exactly one of them is the response.
    ``captured`` is the time of every record (``2024-05-01T00:00:00Z``), by default now. Line
    ends of a url are percent-encoded in the header; ``url`` keeps it as it is.
    """
    if captured is None:
        captured = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"),
                   "length": F.octet_length("payload")})
    order = F.struct(F.col("id").isNotNull(), F.col("id"))
    payloads = rows.groupBy("sha256").agg(F.max_by("payload", order).alias("payload"))
    facts, total = saved(
        rows.select("id", "url", "sha256", "sha1", "length")
        .withColumn("tag", F.monotonically_increasing_id())
    )
    ranked = F.struct(F.col("id").isNotNull().alias("known"), "id", "tag")
    firsts = facts.where(F.col("length") >= least).groupBy("sha256").agg(
        F.max(ranked).alias("top"), F.count(F.lit(1)).alias("copies")
    )
    # A payload of one record needs no partner.
    firsts = save_stage(firsts.where(F.col("copies") > 1))
    told = join_groups(facts, firsts, ["sha256"], "copies", total, "left")
    revisit = F.col("top").isNotNull() & (F.col("top.tag") != F.col("tag"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Date", F.lit(captured)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("top.id")))),
        _line("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _line("Content-Type", F.lit(HTML)),
        _line("Content-Length", F.col("length").cast("string")),
        F.lit(END),
    )
    headers = told.select(F.col("id").alias("record_id"), head.alias("header"), "url", "sha256")
    return headers, payloads


def write_archive(pages: DataFrame, folder: str, **options) -> None:
    headers, payloads = records(pages, **options)
    payloads.write.mode("overwrite").parquet(f"{folder}/payloads")
    headers.write.mode("overwrite").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as written: ``record_id, url, header, payload, record``.

    The digest is recomputed on each stored payload, and a damaged payload fails the
    read. The records of one payload are dealt over many tasks, each with its copy of it.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))
    checked = stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(damaged.cast("binary")))
    joined = _with_payload(spark.read.parquet(f"{folder}/headers"), checked)
    record = F.concat(
        F.encode("header", "UTF-8"), F.col("payload"), F.encode(F.lit(END * 2), "UTF-8")
    )
    return joined.select("record_id", "url", "header", "payload", record.alias("record"))


def _with_payload(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Join by digest, where no task meets more than a share of the records of a digest.

    Digests above 1/HEAVY_SHARE of all records number fewer than that, so their table is
    small enough to broadcast. Any part of such a digest has the payload.
    """
    limit = max(headers.count() // HEAVY_SHARE, LEAST_HEAVY)
    counts = headers.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    parts = F.ceil(F.col("copies") / limit).cast("int").alias("parts")
    heavy = F.broadcast(save_stage(counts.where(F.col("copies") > limit).select("sha256", parts)))
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
    dealt = match(headers, heavy, ["sha256"], "left").withColumn("part", F.coalesce(part, F.lit(0)))
    copied = match(payloads, heavy, ["sha256"], "left").withColumn("part", F.explode(all_parts))
    return match(dealt.drop("parts"), copied.drop("parts"), ["sha256", "part"], "inner")


def header_value(header: Column, name: str) -> Column:
    """The value of a header line, NULL if there is none."""
    found = F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.contains(f"{END}{name}: "), found)


def describe(archive: DataFrame) -> DataFrame:
    """What the records say, with length and digest taken from the payload read back."""
    number = lambda name: F.regexp_extract(header_value(F.col("header"), name), r"page:(-?\d+)", 1)
    read = lambda name: F.when(number(name) != "", number(name).cast("long"))
    return archive.select(
        read("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_value(F.col("header"), "WARC-Type").alias("record_type"),
        read("WARC-Refers-To").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM r
"""
