from __future__ import annotations

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import clashing
from tidemark.llm import warc

PAGES = "page_id long, url string, html string"
BIG, OTHER = "é" * 600, "x" * 1000
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/\r\nEvil: 1", BIG), (3, None, BIG), (4, "http://c/", None),
    (5, "http://c/", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", OTHER), (8, "u", OTHER),
    (None, None, "y" * 2000), (9, "u", "\r\n\r\nWARC-Type: lie\r\n"), (10, "u", "z" * 3_000_000),
]


def archive(spark, tmp_path, rows=ROWS):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(clashing(spark.createDataFrame(rows, PAGES), "sha256", "payload", "id"), folder)
    return folder


def test_records_come_back(spark, tmp_path):
    folder = archive(spark, tmp_path)
    out = warc.describe(warc.read_archive(spark, folder)).collect()
    assert len(out) == len(ROWS)
    assert spark.read.parquet(f"{folder}/payloads").count() == 7
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out)
    want = []
    for i, (page, _, html) in enumerate(ROWS):
        data = (html or "").encode()
        same = [(p or 0, -j) for j, (p, _, h) in enumerate(ROWS) if (h or "") == (html or "")]
        top = max(same)
        revisit = len(data) >= 1000 and (page or 0) != top[0]
        want.append([page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                     top[0] if revisit else 0])
    # Of the repeated row 8 one is the response, the other revisits it.
    want[[w[0] for w in want].index(8)][3:] = ["revisit", 8]
    assert got == sorted(map(tuple, want))


def test_records_are_exact(spark, tmp_path):
    out = {r.record_id: r for r in warc.read_archive(spark, archive(spark, tmp_path)).collect()}
    record = bytes(out[2].record)
    head, rest = record.split(b"\r\n\r\n", 1)
    assert rest == BIG.encode() + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")
    assert b"WARC-Target-URI: http://b/%0D%0AEvil: 1" in head and b"\r\nEvil" not in head
    assert f"Content-Length: {len(BIG.encode())}".encode() in head


def test_headers_are_complete(spark, tmp_path):
    """The mandatory fields of WARC/1.1, and a url that comes back as given."""
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write_archive(pages, folder, captured="2024-05-01T00:00:00Z")
    out = warc.read_archive(spark, folder).collect()
    assert sorted((r.record_id or 0, r.url or "") for r in out) == sorted((p or 0, u or "") for p, u, _ in ROWS)
    for r in out:
        first, *lines = r.header.removesuffix("\r\n\r\n").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        assert first == "WARC/1.1" and len(fields) == len(lines)
        assert fields["WARC-Date"] == "2024-05-01T00:00:00Z" and fields["Content-Type"].startswith("text/html")
        assert {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= fields.keys()
        revisit = fields["WARC-Type"] == "revisit"
        assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == revisit
    plain, _ = warc.records(pages)
    assert plain.where(F.col("header").rlike(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n")).count() == len(ROWS)


def test_records_of_one_payload_are_dealt(spark, tmp_path, monkeypatch):
    """A third of the records share a payload, some are equal in every column."""
    rows = [(i // 2, "u", "h" * 1500) for i in range(300)] + [(1000 + i, "u", f"{i} " * 400) for i in range(600)]
    monkeypatch.setattr(warc, "LEAST_HEAVY", 10)
    folder = archive(spark, tmp_path, rows)
    seen = {}
    joined = warc._with_payload

    def dealt(headers, payloads):
        seen["plan"] = joined(headers, payloads)
        return seen["plan"]

    monkeypatch.setattr(warc, "_with_payload", dealt)
    out = warc.describe(warc.read_archive(spark, folder)).collect()
    assert len(out) == 900 and sum(r.record_type == "response" for r in out) == 601
    assert {r.refers_to for r in out} == {None, 149}
    parts = seen["plan"].groupBy("sha256", "part").count().groupBy("sha256").count()
    assert parts.agg(F.max("count")).first()[0] == 30
    assert spark.read.parquet(f"{folder}/payloads").count() == 601


def test_damage_is_noticed(spark, tmp_path):
    folder = archive(spark, tmp_path)
    stored = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    stored.write.parquet(f"{folder}-damaged/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-damaged/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{folder}-damaged").collect()


def test_empty_table(spark, tmp_path):
    assert warc.read_archive(spark, archive(spark, tmp_path, [])).count() == 0
