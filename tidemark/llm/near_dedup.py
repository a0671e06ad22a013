"""Near duplicates by DartMinHash signatures and banding, verified exactly.

Darts fall on the plane of weight and rank of every shingle, the same in all documents:
hashes decide how many fall in each cell of a fixed dyadic grid, where, and for which of
``coordinates``. A document holds the darts below its shingles' weights. For each
coordinate it keeps the one of lowest rank; two documents keep the same one with the
probability of their weighted Jaccard similarity. Only ranks up to about
(k ln k + 2k)/weight have to be looked at, so a signature costs the shingles plus
k ln k darts, whatever the weights.

Documents of equal words are one node. Nodes that agree on a band share a bucket. Each is
first compared with the likeliest of its buckets' hubs, stars instead of all pairs, and
the links join nodes into classes. What is left are strays: nodes that share a bucket
with other classes. They are compared with all of those, in small buckets as listed
pairs, in large ones block by block inside tasks that return links only. Every
comparison is the exact similarity of the shingle sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.groups import match
from tidemark.llm.columns import join_groups, own_names, saved, text_of
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import bloom_filter, probe
from tidemark.llm.text_words import U, Words, mix, slices, words_of
from tidemark.session import save_stage


@dataclass(frozen=True)
class NearDedup:
    """At similarity 0.8 a pair misses all bands with a probability of 3e-6."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    counts: bool = False  # weight a shingle by its count instead of 1
    tries: int = 4  # hubs a node is compared with before the exact remainder
    few: int = 2000  # comparisons in a bucket that are listed as pairs
    stray_block: int = 500
    member_block: int = 250

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


LOWEST = -12  # the first rank cell is [0, 2^LOWEST)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1)."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53


@functools.cache
def _poisson(mean: float) -> np.ndarray:
    terms = [math.exp(-mean)]
    for i in range(1, 20):
        terms.append(terms[-1] * mean / i)
    return np.cumsum(terms)


def _throw(items: np.ndarray, weights: np.ndarray, level: int, cell: int) -> tuple[np.ndarray, ...]:
    """Darts of one rank level and one weight cell: item index, dart, rank.

    Rank levels are [0, 2^LOWEST), then [2^l, 2^(l+1)); weight cells are [0, 1), then
    [2^c, 2^(c+1)). A cell of area above 1 is cut into parts of area 1 along the rank.
    """
    low, high = (0.0, 2.0**LOWEST) if level < LOWEST else (2.0**level, 2.0 ** (level + 1))
    left, right = (0.0, 1.0) if cell < 0 else (2.0**cell, 2.0 ** (cell + 1))
    area = (high - low) * (right - left)
    parts = max(int(area), 1)
    key = mix(items + U((level + 64) * 1_000_003 + (cell + 1) * 7919))
    index = np.arange(len(items))
    part = np.zeros(len(items), np.int64)
    if parts > 1:
        index, part = np.repeat(index, parts), np.tile(np.arange(parts), len(items))
        key = mix(key[index] + part.astype(U) * U(0xD6E8FEB86659FD93))
    number = np.searchsorted(_poisson(area / parts), _unit(key), "right")
    some = np.flatnonzero(number)
    number = number[some]
    at = np.repeat(some, number)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(key[at] + (turn.astype(U) + U(1)) * U(0xA0761D6478BD642F))
    step = (high - low) / parts
    rank = low + (part[at] + _unit(mix(dart + U(1)))) * step
    weight = left + _unit(mix(dart + U(2))) * (right - left)
    inside = weight < weights[index[at]]
    return index[at][inside], dart[inside], rank[inside]


def dart_signatures(
    items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, coordinates: int
) -> np.ndarray:
    """An n x coordinates table of 64-bit values; rows of owners without items are 0.

    ``items`` are hashes, each once per owner.
    """
    total = np.bincount(owner, weights, n)
    need = coordinates * math.log(coordinates) + 2 * coordinates
    top = np.full(n, LOWEST - 2, np.int64)
    full = total > 0
    top[full] = np.ceil(np.log2(need / total[full])).astype(np.int64) - 1  # last rank level
    top[full] = np.maximum(top[full], LOWEST - 1)
    best = np.full(n * coordinates, np.iinfo(np.uint64).max, U)
    empty = U(np.iinfo(np.uint64).max)
    cells = range(-1, max(int(math.ceil(math.log2(max(weights.max(initial=1), 1)))), 0))
    level, wanted = LOWEST - 1, full.copy()
    while wanted.any():
        use = np.flatnonzero(wanted[owner])
        for cell in cells:
            chosen = use if cell < 0 else use[weights[use] > 2.0**cell]
            index, dart, rank = _throw(items[chosen], weights[chosen], level, cell)
            place = owner[chosen][index] * coordinates + ((dart >> U(33)) % U(coordinates)).astype(np.int64)
            # Rank first, as its float bits; the dart's own bits make the value unique.
            value = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart & U(0xFFFFFFFF))
            np.minimum.at(best, place, value)
        level += 1
        lacking = (best.reshape(n, coordinates) == empty).any(axis=1)
        wanted = full & ((level <= top) | lacking)
    table = best.reshape(n, coordinates)
    table[~full] = 0
    return mix(table)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their texts; a shorter text is one shingle, an empty one has none."""
    count = np.diff(words.first)
    hashes, start = words.grams(size)
    owner = np.searchsorted(words.first, start, "right") - 1
    extra_hash, extra_owner = [], []
    for i in np.flatnonzero((count > 0) & (count < size)):
        total = U(1)
        for h in words.hashes[words.first[i]:words.first[i + 1]]:
            total = mix(np.array([h]) + mix(np.array([total])))[0]
        extra_hash.append(total)
        extra_owner.append(i)
    return (np.concatenate([hashes, np.array(extra_hash, U)]),
            np.concatenate([owner, np.array(extra_owner, np.int64)]))


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle once per text, with its count."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


SIGNED = [
    T.StructField("node", T.StringType(), False),  # digest of the words
    T.StructField("bands", T.ArrayType(T.LongType(), False), False),
    T.StructField("sketch", T.ArrayType(T.LongType(), False), False),  # a bit per coordinate
]


def _digests(texts: pa.Array) -> list[str]:
    joined = (b" ".join(t.as_py().encode().split()) for t in texts)
    return [hashlib.blake2b(x, digest_size=16).hexdigest() for x in joined]


def sign(docs: DataFrame, text_col: str, options: NearDedup) -> DataFrame:
    """Node, band values and sketch of every row, in place of its text."""
    rows = docs.withColumn(text_col, text_of(text_col))
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*[rows.schema[c] for c in kept], *SIGNED])
    k, bands = options.coordinates, options.bands
    salts = mix(np.arange(1, options.rows + 1).astype(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts, n = batch.column(text_col), len(batch)
                items, owner, count = _distinct(*shingles(words_of(texts), options.shingle))
                weights = count.astype(np.float64) if options.counts else np.ones(len(items))
                table = dart_signatures(items, weights, owner, n, k)
                parts = (table.reshape(n, bands, options.rows) * salts).sum(axis=2, dtype=U)
                values = mix(parts + np.arange(bands).astype(U) * U(0x2545F4914F6CDD1D)).view(np.int64)
                has = np.bincount(owner, minlength=n) > 0
                bits = np.zeros((n, -(-k // 64) * 64), np.uint8)
                bits[:, :k] = (table & U(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                ends = np.concatenate([[0], np.cumsum(has)]) * bands
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[has].ravel())),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1) * sketch.shape[1], pa.int32()), pa.array(sketch.ravel())
                    ),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(kept).columns, pa.array(_digests(texts)), *lists],
                    names=[*kept, "node", "bands", "sketch"],
                )

    return rows.mapInArrow(run, schema)


def _similar(pairs: DataFrame, options: NearDedup) -> DataFrame:
    """Pairs ``a, b`` whose texts ``__ta, __tb`` reach the similarity exactly."""
    share = options.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "__ta", "__tb")):
            sides = []
            for name in ("__ta", "__tb"):
                items, owner, count = _distinct(*shingles(words_of(batch.column(name)), options.shingle))
                cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
                sides.append((items, count, cuts))
            keep = np.zeros(len(batch), bool)
            (x, nx, cx), (y, ny, cy) = sides
            for i in range(len(batch)):
                a, b = slice(cx[i], cx[i + 1]), slice(cy[i], cy[i + 1])
                _, p, q = np.intersect1d(x[a], y[b], assume_unique=True, return_indices=True)
                if options.counts:
                    both = int(np.minimum(nx[a][p], ny[b][q]).sum())
                    union = int(nx[a].sum() + ny[b].sum()) - both
                else:
                    both, union = len(p), cx[i + 1] - cx[i] + cy[i + 1] - cy[i] - len(p)
                keep[i] = union > 0 and both >= share * union - 1e-9
            chosen = batch.select(["a", "b"]).filter(pa.array(keep))
            yield chosen

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b")])
    return pairs.select("a", "b", "__ta", "__tb").mapInArrow(run, schema)


def texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Saved table of the texts of the nodes wanted, one row each.

    ``texts`` has a row per document. A Bloom filter rules out the others where they are,
    and copies of a node are combined before the shuffle.
    """
    nodes = wanted.select(F.xxhash64("node").alias("h")).distinct()
    near = probe(texts, F.xxhash64("node"), bloom_filter(nodes, "h"), "__may").where("__may")
    return save_stage(near.groupBy("node").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, held: DataFrame, options: NearDedup) -> DataFrame:
    """Links among the node pairs ``a, b``; ``held`` has the texts of their nodes."""
    first = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("__tb")), "b")
    both = first.join(held.select(F.col("node").alias("a"), F.col("text").alias("__ta")), "a")
    return _similar(both, options)


def _most_differ(options: NearDedup) -> int:
    """Bits in which two sketches of the similarity sought may differ.

    Coordinates agree with probability s, their bits with (1+s)/2; at six deviations a
    pair of similarity s is lost once in a billion.
    """
    p, k = (1 + options.similarity) / 2, options.coordinates
    return int(k * (1 - p) + 6 * math.sqrt(k * p * (1 - p))) + 1


def _differ(x: Column, y: Column, options: NearDedup) -> Column:
    """Number of coordinates whose bits differ."""
    return functools.reduce(
        lambda s, t: s + t,
        [F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(-(-options.coordinates // 64))],
    )


def _stars(members: DataFrame, sketches: DataFrame, options: NearDedup) -> DataFrame:
    """The ``tries`` likeliest of each node's hubs, one pair a row."""
    pairs = members.where(F.col("node") != F.col("hub")).select("node", "hub").distinct()
    uses = save_stage(
        match(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("uses")),
              sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("other")), ["hub"], "inner")
    )
    total = uses.agg(F.sum("uses")).first()[0] or 0
    told = join_groups(pairs, uses, ["hub"], "uses", total)
    rated = match(told, sketches, ["node"], "inner").withColumn(
        "differ", _differ(F.col("sketch"), F.col("other"), options)
    ).where(F.col("differ") <= _most_differ(options))
    # A node has one hub per band at most.
    best = rated.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("differ", "hub"))).alias("hubs"))
    best = best.select("node", F.explode(F.slice("hubs", 1, options.tries)).alias("h"))
    return save_stage(best.select(F.col("node").alias("a"), F.col("h.hub").alias("b")))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """``bucket, node, root, size, apart, strays`` of the buckets with several classes.

    ``apart`` marks the strays, the nodes outside the bucket's largest class.
    """
    rooted = save_stage(
        match(members.select("bucket", "node", "size"), roots.select("node", "root"), ["node"], "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = save_stage(
        counts.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"),
            F.max(F.struct("n", "root")).alias("largest"),
        ).where(F.col("classes") > 1)
        .select("bucket", "size", F.col("largest.root").alias("main"),
                (F.col("size") - F.col("largest.n")).alias("strays"))
    )
    if mixed.isEmpty():
        return None
    inside = join_groups(rooted.drop("size"), mixed, ["bucket"], "size", rooted.count())
    return save_stage(inside.withColumn("apart", F.col("root") != F.col("main")).drop("main"))


def _few(inside: DataFrame, sketches: DataFrame, options: NearDedup) -> DataFrame:
    """Pairs of different classes in buckets of few comparisons, each at its first bucket."""
    told = save_stage(match(inside, sketches, ["node"], "inner").select(
        "bucket", "node", "root", "apart", "sketch", "bands"
    ))
    other = told.select("bucket", *[F.col(c).alias(f"{c}2") for c in told.columns[1:]])
    first = F.array_min(F.array_intersect("bands", "bands2"))
    pairs = told.where("apart").join(other, "bucket").where(
        (F.col("root") != F.col("root2")) & (~F.col("apart2") | (F.col("node") < F.col("node2")))
        & (_differ(F.col("sketch"), F.col("sketch2"), options) <= _most_differ(options))
    )
    chosen = pairs.withColumn("first", first == F.col("bucket")).where("first")
    return chosen.select(F.col("node").alias("a"), F.col("node2").alias("b"))


def _crowded(inside: DataFrame, texts: DataFrame, options: NearDedup) -> DataFrame:
    """Links of strays in large buckets: strays against members, block by block.

    A block of strays meets a block of members in one task, which returns a link for
    each stray and class it belongs to; compared pairs are not rows.
    """
    strays, rows = options.stray_block, options.member_block
    stray_blocks, member_blocks = F.ceil(F.col("strays") / strays), F.ceil(F.col("size") / rows)
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    queries = inside.where("apart").select(
        "bucket", block(stray_blocks).alias("x"), upto(member_blocks).alias("y"), F.lit(True).alias("query"),
        "node", "root",
    )
    corpus = inside.select(
        "bucket", upto(stray_blocks).alias("x"), block(member_blocks).alias("y"), F.lit(False).alias("query"),
        "node", "root",
    )
    both = queries.unionByName(corpus).join(texts, "node")
    dealt = both.withColumn("cell", F.xxhash64("bucket", "x", "y"))
    partitions = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "cell").sortWithinPartitions("cell").select(
        "cell", "query", "node", "root", "text"
    )
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                links = _block_links(pa.Table.from_batches(held).combine_chunks(), options)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in links], pa.string()) for i in range(2)], names=["a", "b"]
                )

        for batch in batches:
            keys = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start and keys[start] != cell:
                    yield from finish()
                    cell, held = keys[start], []
                held.append(batch.slice(start, end - start))
        yield from finish()

    return dealt.mapInArrow(run, schema)


def _block_links(rows: pa.Table, options: NearDedup) -> list[tuple[str, str]]:
    """One link for each query and class that has a similar member in this block."""
    rows = rows.to_batches()[0]
    query = np.array(rows.column("query").to_pylist(), bool)
    nodes, roots = rows.column("node").to_pylist(), rows.column("root").to_pylist()
    items, owner, count = _distinct(*shingles(words_of(rows.column("text")), options.shingle))
    weight = count if options.counts else np.ones(len(items), np.int64)
    n = len(nodes)
    size = np.bincount(owner, weight, n)
    cuts = np.searchsorted(owner, np.arange(n + 1))
    member = np.flatnonzero(~query[owner])
    order = member[np.argsort(items[member], kind="stable")]
    hashes, owners, weights = items[order], owner[order], weight[order]
    links = []
    for i in np.flatnonzero(query):
        mine = slice(cuts[i], cuts[i + 1])
        low, high = (np.searchsorted(hashes, items[mine], side) for side in ("left", "right"))
        times = high - low
        at = np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)
        shared = np.minimum(weights[at], np.repeat(weight[mine], times))
        both = np.bincount(owners[at], shared, n)
        similar = both >= options.similarity * (size[i] + size - both) - 1e-9
        found = {roots[j]: j for j in np.flatnonzero(similar & (both > 0))}
        links += [(nodes[i], nodes[j]) for root, j in found.items() if root != roots[i]]
    return links


def _residual(
    members: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, options: NearDedup
) -> DataFrame | None:
    """Links between nodes that share a bucket but are in different classes so far."""
    inside = _apart(members, roots)
    if inside is None:
        return None
    work = F.col("strays") * F.col("size")
    pairs = save_stage(_few(inside.where(work <= options.few), nodes, options))
    crowded = inside.where(work > options.few)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).unionByName(crowded.select("node"))
    held = texts_of(wanted, texts)
    return save_stage(verified(pairs, held, options).unionByName(_crowded(crowded, held, options)))


def near_classes(
    docs: DataFrame, options: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``class_id`` (smallest id of its class), ``class_size``, ``kept``.

    NULL counts as empty; texts without a word are one class, texts of fewer words than a
    shingle are alike only if equal. Repeated rows are in one class, of which exactly one
    row is kept: the one with the smallest id, a NULL id counting as largest.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    signed = save_stage(sign(rows.withColumn("__tag", F.monotonically_increasing_id()), "text", options))
    nodes, n_nodes = saved(signed.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    ))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    # A different hub in each bucket: the node that a hash of the bucket puts first.
    hubs = save_stage(
        buckets.groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node")).alias("first"),
            F.count(F.lit(1)).alias("size"),
        ).where(F.col("size") > 1).select("bucket", F.col("first.node").alias("hub"), "size")
    )
    members = save_stage(join_groups(buckets, hubs, ["bucket"], "size", n_nodes * options.bands))
    sketches = nodes.select("node", "sketch")
    stars = _stars(members, sketches, options)
    texts = with_node(docs.select(F.col(text_col).alias("text")))
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node")))
    links = save_stage(verified(stars, texts_of(ends, texts), options))
    roots = components(links)
    rest = _residual(members, roots, nodes.select("node", "sketch", "bands"), texts, options)
    if rest is not None and not rest.isEmpty():
        roots = components(links.unionByName(rest))
    root = match(nodes.select("node", "copies"), roots, ["node"], "left").select(
        "node", "copies", F.coalesce("root", "node").alias("root")
    )
    root = save_stage(root)
    total = signed.count()
    rooted = save_stage(join_groups(
        signed.select("__id", "__tag", "node"), root, ["node"], "copies", total
    ).drop("node", "copies"))
    order = F.struct(F.col("__id").isNull().alias("unknown"), "__id", "__tag")
    classes = save_stage(rooted.groupBy("root").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")
    ))
    return join_groups(rooted, classes, ["root"], "class_size", total).select(
        F.col("__id").alias(id_col), F.col("first.__id").alias("class_id"), "class_size",
        (F.col("__tag") == F.col("first.__tag")).alias("kept"),
    )


def with_node(docs: DataFrame) -> DataFrame:
    """The rows with the digest of their words, as in the signatures."""
    rows = docs.withColumn("text", text_of("text"))
    schema = T.StructType([*rows.schema.fields, SIGNED[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_digests(batch.column("text")))],
                names=[*batch.schema.names, "node"],
            )

    return rows.mapInArrow(run, schema)


@own_names
def drop_near(
    docs: DataFrame, options: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents kept, one per class, with all their columns.

    Dropped ids go into a Bloom filter; rows it rules out stay where they are, only the
    others are checked by a join. Of rows that share an id, none is dropped unless all
    are; rows with a NULL id stay.
    """
    judged = near_classes(docs, options, id_col, text_col)
    dropped = save_stage(
        judged.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("any"))
        .where(~F.col("any")).select(F.col(id_col).alias("__gone"))
    )
    bloom = bloom_filter(dropped.select(F.xxhash64("__gone").alias("h")), "h")
    probed = probe(docs, F.xxhash64(F.col(id_col)), bloom, "__may")
    stay = probed.where(~F.col("__may")).drop("__may")
    unsure = probed.where("__may").drop("__may")
    return stay.unionByName(unsure.join(dropped, F.col(id_col) == F.col("__gone"), "left_anti"))
