"""Connected components of an edge table, by contraction and alternating stars.

Tasks join the nodes of ``CHUNK`` edges at a time, in memory. A graph of more edges takes
rounds: each is a few shuffles over a saved edge table, and only nodes that are roots of
different chunks go on to the next; nothing is collected. A node with very many neighbours
contributes one partial minimum per task, and the join that brings the minimum back splits
such a key (``join_groups``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.groups import attach
from tidemark.llm.columns import join_groups, saved
from tidemark.session import save_stage

CHUNK = 10_000  # edges that are joined in memory; two digests each


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is linked to by the edges ``x, y``."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _contract(edges: DataFrame, n: int, chunk: int) -> DataFrame:
    """``a, b``: the nodes of every chunk of the ``n`` edges, each with its root there.

    Roots have rows of their own. Up to ``chunk`` edges are one chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for at in range(0, len(whole), chunk):
                batch = whole.slice(at, chunk)
                if rows + len(batch) > chunk:
                    yield finish(held)
                    held, rows = [], 0
                held.append(batch)
                rows += len(batch)
        if held:
            yield finish(held)

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b"))
        nodes = pc.unique(pa.concat_arrays([a, b]))
        nodes = nodes.take(pc.sort_indices(nodes))
        x, y = (pc.index_in(ends, nodes).to_numpy() for ends in (a, b))
        return pa.RecordBatch.from_arrays(
            [nodes, nodes.take(pa.array(_roots(x, y, len(nodes))))], names=["a", "b"]
        )

    return edges.select("a", "b").coalesce(max(-(-n // chunk), 1)).mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the smallest one, or to the node itself."""
    # ``edges`` point from larger (a) to smaller (b).
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = save_stage(
        pairs.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree"))
        .withColumn("least", F.least("a", "least"))
    )
    total = least.agg(F.sum("degree")).first()[0] or 0
    told = join_groups(pairs, least, ["a"], "degree", total)
    out = told.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node.

    ``links`` has columns ``a`` and ``b`` in any order. The number of rounds grows with the
    logarithm of the nodes; they end when the roots still to be joined fit one chunk.
    """
    edges, n = saved(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct()
    )
    rounds = []
    while n > chunk:
        # A small star: a node has a root per chunk at most, and all of them are linked.
        told = save_stage(_contract(edges, n, chunk).groupBy("a").agg(
            F.min("b").alias("least"), F.collect_set("b").alias("roots")
        ))
        rounds.append(told.select(F.col("a").alias("node"), "least"))
        apart = save_stage(
            told.select(F.explode("roots").alias("a"), F.col("least").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        edges, n = saved(_large_star(apart))
    roots = save_stage(_contract(edges, n, chunk).toDF("node", "root"))
    for told in reversed(rounds):
        above = roots.withColumnRenamed("node", "least")
        roots = save_stage(
            attach(told, above, ["least"]).select("node", F.coalesce("root", "least").alias("root"))
        )
    return roots
