"""Connected components of a large graph by union-find in tasks and star contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import stored

#: Links joined by one union-find at a time (bounds a task's memory).
FOREST_LINKS = 2_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its own root; a root is the smallest node of its group."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _forests(links: DataFrame) -> DataFrame:
    """Links of each task replaced by (node, root) of the task's own groups."""

    def run(batches):
        u, v, held = [], [], 0

        def flush():
            a, b = union_find(np.concatenate(u), np.concatenate(v))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= FOREST_LINKS:
                yield flush()
                u, v, held = [], [], 0
        if held:
            yield flush()

    return links.mapInArrow(run, "u long, v long")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (long columns u, v); component is the smallest node.

    Every round: a task's links become stars (union-find); then each node
    passes its larger neighbours to its smallest one (large star) and its
    smaller neighbours likewise (small star). Each round is a written table;
    rounds end when the stars no longer change. Nothing is gathered on the driver
    but a count and a checksum, and no table of links is broadcast.
    """
    stars = stored(_forests(links.where("u <> v").select("u", "v")), "links")
    mark = _mark(stars)
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(
            both.where("v > u").join(stored(least, "least").hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        moved = large.join(small.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(small.select("u", F.col("m").alias("v")).union(moved).distinct(), "stars")
        new = _mark(stars)
        if new == mark:
            break
        mark = new
    tops = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
