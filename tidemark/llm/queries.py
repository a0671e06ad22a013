"""The operators applied to their tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    html_text,
    mixing,
    near_dedup,
    prefix_trie,
    quality,
    secrets,
    substring_dedup,
    token_alignment,
    url_filters,
    warc,
)
from tidemark.session import stage_folder

RULES = (
    url_filters.Rule("allow", "org"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_report(table(spark, sf, "documents").select("doc_id", "text"))


def bpe_report(docs: DataFrame) -> DataFrame:
    """Ids and decoded bytes of each document as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, bytes_col="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf, "documents"))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


def op5_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A page is named after a document, the number in its path; its label is the outcome."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1)
    named = pages.withColumn("doc_id", F.when(number != "", number.cast("long")))
    labels = table(spark, sf, "labels").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    outcomes = named.join(labels, "doc_id").select("url", "bad")
    return url_filters.judge_urls(pages, outcomes, RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{stage_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.describe(warc.read_archive(spark, folder))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passage_report(table(spark, sf, "documents").select("doc_id", "text"))


def passage_report(docs: DataFrame) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op10_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_report(table(spark, sf, "documents").select("doc_id", "text"))


def secret_report(docs: DataFrame) -> DataFrame:
    found = secrets.scan_secrets(docs)
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    tools = token_alignment.Tokenizers(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.alignment_report(table(spark, sf, "documents"), tools)


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.overlap_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_secret_scans": op10_secret_scans,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_url_filters": url_filters.oracle(RULES),
    "op7_warc": warc.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
