"""Prefix trie of rebuilt conversations, with a count-min screen of prefix digests.

Every prefix has a 128-bit digest: two exclusive-or sums of the hashes of its numbered turns.
A count-min sketch of all digests is built in the tasks and merged block by block; its size is
bounded. An estimate of one proves that a prefix belongs to a single conversation, and so do
all longer ones: such tails are emitted where they are. Only prefixes that may be shared
shuffle, as rows of numbers, and are grouped exactly. A sketch too small for its digests lets
more rows through to the shuffle, never fewer, so results do not depend on its size.

The exact part needs no walk over the trie. The smallest member of a node *owns* it, and a
conversation owns its prefixes from some depth on, because a smallest member stays smallest
further down. With that depth known for each conversation, all figures of a node are sums over
its members:

- children: members that own their next prefix,
- leaves: members that own their last prefix, if nobody goes on from there,
- saved tokens: the words of each member's prefixes from here down that it does not own.

Conversations of more than ``spark.tidemark.hotGroupRows`` turns are numbered in parts over
several tasks; joins keep the rows of a heavy key where they are.

Defined results: NULL role or text counts as empty. Rows without a conversation id belong to
no conversation. Turns are ordered by number (NULL first), equal numbers by role, the first 64
letters of the text, and digest; repeated rows are turns of their own. An empty table has no
nodes. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.groups import attach, hot_groups, match, ordered_parts, running_before
from tidemark.llm.columns import join_groups, saved, text_of, word_count
from tidemark.llm.text_words import mix
from tidemark.session import save_stage

MOST_HEAD = 3  # turns taken over from the bundle's first conversation
BLOCK = 1 << 16  # cells of a sketch that travel together
KEY = ["depth", "p1", "p2"]
ORDER = ["turn", "role", "start", "y1", "y2"]
HEADS = [f"head{n}" for n in range(1, MOST_HEAD + 1)]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    bundle: int = 20  # conversations that share the turns of the first of them
    max_cells: int = 1 << 26  # bound of the sketch: one byte a cell in a task, one bit broadcast
    cells_each: int = 6  # cells per prefix below that bound
    id_chunk: int = 4096  # ids written as one piece of text


def _lanes(place: Column, y1: Column, y2: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, y1, y2), F.xxhash64(F.lit(1), y2, y1, place)


def _turns(conversations: DataFrame, rule: Trie) -> DataFrame:
    role, text = text_of("role"), text_of("text")
    base = F.col("conv_id") - F.col("conv_id") % rule.bundle
    return conversations.where(F.col("conv_id").isNotNull()).select(
        base.alias("base"), "conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("start"),
        F.xxhash64(role, text).alias("y1"), F.xxhash64(F.lit(1), role, text).alias("y2"),
        word_count(text).alias("words"),
    )


def _head(n: int) -> Column:
    """The ``n``-th turn of a bundle's first conversation, as an aggregate."""
    own = (F.col("conv_id") == F.col("base")) & (F.col("place") == n)
    return F.max(F.when(own, F.struct("y1", "y2", "words")))


def _first_of(n: int) -> Column:
    return F.get(F.col("heads"), n - 1)


def _head_nodes() -> Column:
    """The root and the prefixes of the turns taken over, as rows of the trie."""
    zero = F.lit(0).cast("long")
    rows, p1, p2, before = [], zero, zero, zero
    rows.append(F.struct(zero.alias("depth"), p1.alias("p1"), p2.alias("p2"), zero.alias("up1"),
                         zero.alias("up2"), zero.alias("words"), zero.alias("before")))
    for n in range(1, MOST_HEAD + 1):
        turn = _first_of(n)
        l1, l2 = _lanes(F.lit(n).cast("long"), turn["y1"], turn["y2"])
        n1, n2 = p1.bitwiseXOR(l1), p2.bitwiseXOR(l2)
        rows.append(F.when(turn.isNotNull(), F.struct(
            F.lit(n).cast("long").alias("depth"), n1.alias("p1"), n2.alias("p2"), p1.alias("up1"),
            p2.alias("up2"), turn["words"].alias("words"), before.alias("before"))))
        p1, p2, before = n1, n2, before + turn["words"]
    return F.array_compact(F.array(*rows))


def _carried() -> tuple[Column, Column, Column]:
    """Digest sums and words of the turns taken over."""
    p1 = p2 = words = F.lit(0).cast("long")
    for n in range(1, MOST_HEAD + 1):
        turn = _first_of(n)
        l1, l2 = _lanes(F.lit(n).cast("long"), turn["y1"], turn["y2"])
        p1 = F.when(turn.isNull(), p1).otherwise(p1.bitwiseXOR(l1))
        p2 = F.when(turn.isNull(), p2).otherwise(p2.bitwiseXOR(l2))
        words = words + F.coalesce(turn["words"], F.lit(0).cast("long"))
    return p1, p2, words


def _own_turns(df: DataFrame) -> DataFrame:
    """Adds each turn's rebuilt place and what it adds to the running sums (0 if replaced)."""
    wanted = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")
    df = df.withColumn("h", wanted).withColumn(
        "heads", F.slice(F.array_compact(F.array(*HEADS)), F.lit(1), F.col("h"))
    ).drop(*HEADS)
    df = df.withColumn("own", F.col("place") > F.col("h")).withColumn(
        "depth", F.col("place") - F.col("h") + F.size("heads")
    ).withColumn("len", F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    l1, l2 = _lanes(F.col("depth"), F.col("y1"), F.col("y2"))
    zero = F.lit(0).cast("long")
    return df.withColumns({
        "l1": F.when(F.col("own"), l1).otherwise(zero),
        "l2": F.when(F.col("own"), l2).otherwise(zero),
        "w": F.when(F.col("own"), F.col("words")).otherwise(zero),
    })


def _numbered(turns: DataFrame) -> DataFrame:
    """Bundles that fit a task: all by windows, one shuffle."""
    bundle = Window.partitionBy("base")
    whole = Window.partitionBy("base", "conv_id")
    ordered = whole.orderBy(*ORDER)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = turns.withColumn("place", F.row_number().over(ordered).cast("long"))
    df = df.withColumn("n", F.count(F.lit(1)).over(whole))
    df = df.withColumns({h: _head(i + 1).over(bundle) for i, h in enumerate(HEADS)})
    return _own_turns(df).withColumns({
        "s1": F.bit_xor("l1").over(so_far), "s2": F.bit_xor("l2").over(so_far),
        "sw": F.sum("w").over(so_far),
    })


def _numbered_hot(turns: DataFrame) -> DataFrame:
    """Bundles with too many turns for a task: range-partitioned, each part solved by itself."""
    key = ["conv_id"]
    parts = ordered_parts(turns, key, ORDER)
    inside = Window.partitionBy("__part", "conv_id").orderBy(*ORDER, "__tie")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = running_before(parts, key, F.count(F.lit(1)), "earlier", F.sum)
    df = attach(parts, before, [*key, "__part"]).withColumn(
        "place", F.row_number().over(inside) + F.coalesce("earlier", F.lit(0))
    ).drop("earlier")
    df = save_stage(attach(df, turns.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key))
    heads = df.where(F.col("place") <= MOST_HEAD).groupBy("base").agg(
        *[_head(i + 1).alias(h) for i, h in enumerate(HEADS)])
    df = save_stage(_own_turns(attach(df, heads, ["base"])))
    for name, lane, total in (("s1", "l1", F.bit_xor), ("s2", "l2", F.bit_xor), ("sw", "w", F.sum)):
        earlier = running_before(df, key, total(lane), "earlier", total)
        here = F.coalesce("earlier", F.lit(0).cast("long"))
        inner = total(lane).over(so_far)
        joined = attach(df, earlier, [*key, "__part"]).withColumn("inner", inner)
        both = F.col("inner") + here if name == "sw" else F.col("inner").bitwiseXOR(here)
        df = joined.withColumn(name, both).drop("inner", "earlier")
    return df.drop("__part", "__tie")


def rebuilt_turns(conversations: DataFrame, rule: Trie = Trie()) -> DataFrame:
    """One row per conversation and depth, the root included: digests and running words.

    ``up1, up2`` is the digest of the prefix one turn shorter, ``before`` the words before
    the last turn, ``len`` the depth of the whole conversation.
    """
    turns = _turns(conversations, rule)
    hot = hot_groups(turns, ["base"])
    if hot is None:
        df = _numbered(turns)
    else:
        cold = _numbered(match(turns, hot, ["base"], "left_anti"))
        df = cold.unionByName(_numbered_hot(save_stage(match(turns, hot, ["base"], "left_semi"))))
    c1, c2, words = _carried()
    p1, p2 = F.col("s1").bitwiseXOR(c1), F.col("s2").bitwiseXOR(c2)
    own = F.struct(
        "depth", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("l1")).alias("up1"),
        p2.bitwiseXOR(F.col("l2")).alias("up2"), "words", (F.col("sw") - F.col("w") + words).alias("before"),
    )
    none = F.slice(F.array(own), 1, 0)
    rows = F.concat(
        F.when(F.col("place") == 1, _head_nodes()).otherwise(none),
        F.when(F.col("own"), F.array(own)).otherwise(none),
    )
    return df.select("conv_id", "len", F.inline(rows))


@dataclass(frozen=True)
class Screen:
    """Cells of a count-min sketch that two prefixes or more have met, one bit each."""

    bits: np.ndarray
    cells: int
    rows: int

    def shared(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Whether the estimate is above one."""
        above = np.ones(len(p1), bool)
        for places in _cells(p1, p2, self.cells, self.rows):
            above &= (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
        return above


def _cells(p1: np.ndarray, p2: np.ndarray, cells: int, rows: int) -> Iterator[np.ndarray]:
    """The cell of each digest in every row of the sketch."""
    width = cells // rows
    a, b = p1.view(np.uint64), p2.view(np.uint64)
    for r in range(rows):
        yield (mix(a + np.uint64(r) * (b | np.uint64(1))) % np.uint64(width)).astype(np.int64) + r * width


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], cells: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a task, counts above two cut to two, in blocks that are not empty."""
    counts = np.zeros(cells, np.uint8)
    for batch in batches:
        for places in _cells(_numbers(batch, "p1"), _numbers(batch, "p2"), cells, rows):
            met, times = np.unique(places, return_counts=True)
            counts[met] = np.minimum(counts[met] + np.minimum(times, 2), 2)
    for block in range(0, cells, BLOCK):
        part = counts[block:block + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block // BLOCK], pa.int32()),
                                              "counts": pa.array([part.tobytes()], pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches added block by block; the rows come sorted by block."""
    block, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int32()),
            "bits": pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary()),
        })

    for batch in batches:
        for row_block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            part = np.frombuffer(counts.as_buffer(), np.uint8)
            if row_block != block:
                if block is not None:
                    yield out()
                block, total = row_block, part.copy()
            else:
                total = np.minimum(total + part, 2)
    if block is not None:
        yield out()


def sketch(prefixes: DataFrame, n: int, rule: Trie = Trie()) -> Screen:
    """Count-min sketch of ``n`` digests ``p1, p2``, merged to one bit per cell."""
    cells = min(rule.max_cells, -(-max(n * rule.cells_each, 1) // BLOCK) * BLOCK)
    rows = int(np.clip(round(0.69 * cells / max(n, 1)), 1, 4))
    cells -= cells % rows
    counted = prefixes.select("p1", "p2").mapInArrow(
        lambda batches: _counted(batches, cells, rows), "block int, counts binary")
    blocks = counted.repartition("block").sortWithinPartitions("block")
    bits = np.zeros(-(-cells // 8), np.uint8)
    for row in blocks.mapInArrow(_merged, "block int, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        begin = row["block"] * BLOCK // 8
        bits[begin:begin + len(part)] = part
    return Screen(bits, cells, rows)


def _screened(rows: DataFrame, screen: Screen) -> DataFrame:
    """Adds ``kind``: 0 may be shared, 1 the first prefix of a tail, 2 a longer one."""
    held = rows.sparkSession.sparkContext.broadcast(screen)
    schema = StructType([*rows.schema.fields, StructField("kind", IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = _numbers(batch, "depth")
            self_shared = held.value.shared(_numbers(batch, "p1"), _numbers(batch, "p2")) | (depth == 0)
            up_shared = held.value.shared(_numbers(batch, "up1"), _numbers(batch, "up2")) | (depth <= 1)
            kind = np.where(up_shared, np.where(self_shared, 0, 1), 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.int32())],
                                             names=[*batch.schema.names, "kind"])

    return rows.mapInArrow(judge, schema)


def _ends(rows: DataFrame, rule: Trie) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in a node, in order.

    Ids are joined to pieces first; the pieces of a node are hashed one after another.
    """
    pieces = rows.where(F.col("depth") == F.col("len")).groupBy(
        *KEY, F.floor(F.col("conv_id") / rule.id_chunk).alias("piece")
    ).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends", pa.string())])
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if key != node:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if node is not None:
            last = [*node, running.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, schema)], schema=schema)

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return ordered.select(*KEY, "ids").mapInArrow(digest, "depth long, p1 long, p2 long, ends string")


def prefix_trie(conversations: DataFrame, rule: Trie = Trie()) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    rows, _ = saved(rebuilt_turns(conversations, rule))
    prefixes = rows.where(F.col("depth") > 0)
    screen = sketch(prefixes, prefixes.count(), rule)
    close, n_close = saved(_screened(rows, screen).where(F.col("kind") < 2))
    maybe = close.where(F.col("kind") == 0)
    own_end = F.col("depth") == F.col("len")

    # Exact groups of the prefixes that may be shared: size, owner, does anybody go on.
    groups = save_stage(maybe.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("size"), F.min("conv_id").alias("owner"),
        F.max(~own_end).alias("goes_on"),
    ))
    members = join_groups(maybe, groups, KEY, "size", n_close)
    tops = close.where(F.col("kind") == 1).select(
        "*", F.lit(1).cast("long").alias("size"), F.col("conv_id").alias("owner"), (~own_end).alias("goes_on"))
    known = save_stage(members.select(*tops.columns).unionByName(tops))

    # Per conversation: where ownership begins and who owns the node above.
    owned = F.col("owner") == F.col("conv_id")
    after = F.col("before") + F.col("words")
    ended = F.max(F.when(own_end, F.col("goes_on")))
    convs = save_stage(known.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(owned, F.col("depth"))), F.max("len") + 1).alias("from"),
        F.max_by("owner", F.when(~owned, F.col("depth"))).alias("above"),
        F.coalesce(F.min(F.when(owned, F.col("before"))), F.max(after)).alias("foreign"),
        (F.coalesce(F.min(F.when(owned, F.col("depth"))), F.max("len") + 1) <= F.max("len")).alias("owns"),
        F.coalesce(ended, F.lit(False)).alias("continued"),
        F.count(F.lit(1)).alias("rows"),
    ))
    full = save_stage(join_groups(known, convs, ["conv_id"], "rows", n_close))

    parent = F.when(F.col("from") < F.col("depth"), F.col("conv_id")).otherwise(F.col("above"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    next_owned = (F.col("from") <= F.col("depth") + 1) & (F.col("len") > F.col("depth"))
    leaf = F.col("owns") & ~F.col("continued")
    shared = full.where(F.col("kind") == 0).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(owned, parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(next_owned).alias("n_children"),
        F.count_if(leaf).alias("n_leaves"),
        F.sum(F.greatest(F.col("foreign") - F.col("before"), zero)).alias("saved_tokens"),
    )
    nodes = shared.join(_ends(maybe, rule), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )

    def tail(part: DataFrame, above: Column) -> DataFrame:
        return part.select(
            "conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"),
            F.when(own_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(own_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA))
            .alias("ends_sha256"),
        )

    longer = _screened(rows, screen).where(F.col("kind") == 2)
    return nodes.unionByName(tail(full.where(F.col("kind") == 1), parent)).unionByName(
        tail(longer, F.col("conv_id")))


ORACLE = r"""
WITH ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, (list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), heads AS (SELECT conv_id, base, xor(crc, 4294967295) % 4 AS h FROM ids),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, place, role, text
  FROM heads h JOIN turns t ON t.conv_id = h.base AND place <= h
  UNION ALL
  SELECT h.conv_id, 1, place, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND place > h
), prefixes AS (
  SELECT conv_id, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY part, place) AS p
  FROM rebuilt
  UNION ALL SELECT conv_id, [] FROM ids
), members AS (SELECT conv_id, p, len(p) AS depth, max(len(p)) OVER (PARTITION BY conv_id) AS n FROM prefixes),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n) AS ends,
         CASE WHEN depth > 0 THEN len(regexp_extract_all(p[-1].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM members GROUP BY p, depth
), sized AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.p[:n.depth] = n.p) AS n_children
  FROM nodes n
), below AS (
  SELECT u.p, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM sized u JOIN sized v ON v.depth >= u.depth AND v.p[:u.depth] = u.p GROUP BY u.p
)
SELECT s.conv_id, s.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, s.n_convs,
       s.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(s.ends, '')) AS ends_sha256
FROM sized s JOIN below USING (p) LEFT JOIN nodes up ON up.depth = s.depth - 1 AND up.p = s.p[:s.depth - 1]
"""
