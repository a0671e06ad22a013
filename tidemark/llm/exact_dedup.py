"""Exact duplicates by a hash count and a Bloom filter, in DataFrame functions only.

The first pass is an exact count of 64-bit hashes, not a Bloom filter: every different hash
shuffles, so it needs no memory bound and distinct hashes do not share slots; partial
aggregation sends one row per hash and task, so a hot text
costs nothing. Hashes counted twice or more set bits in a blocked Bloom filter of at
most ``MAX_BLOCKS`` blocks of 4 KB, which is broadcast.

The second pass probes the filter. Rows it rules out pass straight through. Only
possibly repeated rows shuffle, and they are decided by SHA-256. A filter too small
for its hashes lets more rows through to the shuffle, never fewer, so results do not
depend on its size.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import (
    ascii_lower, free_name, join_groups, own_names, saved, text_of, without,
)
from tidemark.session import save_stage

MAX_BLOCKS = 16_384  # 64 MB: the bound of what is broadcast
BLOCK_BITS = 32_768  # fixed by Spark's bitmap functions
BITS_PER_HASH = 12
PROBES = 3


@dataclass(frozen=True)
class Bloom:
    table: DataFrame  # block, bits; at most MAX_BLOCKS rows of 4 KB
    blocks: int


def normal_text(name: str) -> Column:
    return ascii_lower(text_of(name))


def repeat_filter(hashes: DataFrame, name: str, max_blocks: int = MAX_BLOCKS) -> Bloom:
    """Filter of the values that occur more than once."""
    repeated = (
        hashes.groupBy(name).agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1).select(name)
    )
    return bloom_filter(repeated, name, max_blocks)


def bloom_filter(values: DataFrame, name: str, max_blocks: int = MAX_BLOCKS) -> Bloom:
    """Blocked Bloom filter of a column of values."""
    table, n = saved(values)
    blocks = min(max_blocks, n * BITS_PER_HASH // BLOCK_BITS + 1)
    bits = table.select(
        _block(F.col(name), blocks).alias("block"), F.explode(_probes(F.col(name))).alias("bit")
    )
    return Bloom(save_stage(bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))), blocks)


def probe(df: DataFrame, value: Column, bloom: Bloom, flag: str) -> DataFrame:
    """Adds ``flag``: false only where the value is certainly not in the filter."""
    table = F.broadcast(bloom.table.withColumnsRenamed({"block": "__block", "bits": "__bits"}))
    hits = [_bit(F.col("__bits"), p) for p in _probe_list(value)]
    all_set = functools.reduce(lambda a, b: a & b, hits)
    found = df.join(table, _block(value, bloom.blocks) == F.col("__block"), "left")
    return found.withColumn(flag, F.coalesce(all_set, F.lit(False))).drop("__block", "__bits")


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(17)), F.lit(blocks)).cast("int")


def _probe_list(value: Column) -> list[Column]:
    mixed = F.xxhash64(value, F.lit(71))
    return [
        F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(BLOCK_BITS - 1).cast("int")
        for i in range(PROBES)
    ]


def _probes(value: Column) -> Column:
    return F.array(*_probe_list(value))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3) + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), position.bitwiseAND(7)) == 1


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """One row per document: id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. The
    row with the largest id stays; a NULL id counts as smallest, and of rows equal in
    id and text exactly one stays. Other columns are not returned. An empty table
    gives an empty result.
    """
    digest = F.sha2(normal_text(text_col), 256)
    rows, total = saved(
        docs.select(F.col(id_col).alias("__id"), digest.alias("text_sha256"))
        .withColumns({"__hash": F.xxhash64("text_sha256"), "__tag": F.monotonically_increasing_id()})
    )
    bloom = repeat_filter(rows.select("__hash"), "__hash", max_blocks)
    probed = probe(rows, F.col("__hash"), bloom, "__maybe")
    order = F.struct(F.col("__id").isNotNull().alias("known"), "__id", "__tag")
    once = probed.where(~F.col("__maybe")).select(
        "__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    maybe = probed.where("__maybe")
    groups = save_stage(
        maybe.groupBy("text_sha256").agg(
            F.max(order).alias("__top"), F.count(F.lit(1)).alias("group_size")
        )
    )
    joined = join_groups(
        maybe.select("__id", "__tag", "text_sha256"), groups, ["text_sha256"], "group_size", total
    )
    more = joined.select(
        "__id", F.col("__top.__id").alias("keep_id"), "group_size",
        (F.col("__tag") == F.col("__top.__tag")).alias("kept"), "text_sha256",
    )
    return once.unionByName(more).withColumnRenamed("__id", id_col)


@own_names
def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """The documents that :func:`mark_copies` keeps, with all their columns.

    Rows that certainly have no copy never move. The rest is aggregated by digest and
    only the keeper of each task travels, so a hot group is combined before the
    shuffle.
    """
    key, flag, packed = (free_name(docs, n) for n in ("__hash", "__maybe", "__row"))
    text = normal_text(text_col)
    bloom = repeat_filter(docs.select(F.xxhash64(F.sha2(text, 256)).alias(key)), key, max_blocks)
    keyed = docs.withColumn(key, F.xxhash64(F.sha2(text, 256)))
    probed = probe(keyed, F.col(key), bloom, flag)
    once = probed.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    best = (
        probed.where(flag).groupBy(F.sha2(text, 256).alias(key))
        .agg(F.max_by(whole, order).alias(packed)).select(f"{packed}.*")
    )
    return once.unionByName(best)


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    kept = without(docs, ["keep_id", "group_size", "kept", "text_sha256"])
    return mark_copies(kept).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
