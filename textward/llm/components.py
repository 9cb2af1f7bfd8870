"""Connected components over an edge table, by alternating large-star and small-star steps.

Each round ends with a contraction inside every task, which needs no shuffle: edges that a task holds become stars around
the smallest vertex that they reach. Once the edges left are few enough for one task, it settles them at once. The rest is joins and aggregates with partial sums; each round is written to the shared
folder, which cuts the lineage. Hot vertices are keys of plain sort-merge joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import drop, save


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' vertices but the smallest of each component, and that smallest one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(u, v) edges that connect the same vertices: those of a task become stars, about ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                u, v = joined()
                held, n = [(u, v)], len(u)
                if 2 * n > most:  # mostly edges of a forest: they go on as they are
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, n = [], 0
        if held:
            u, v = joined()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _settled(e: DataFrame) -> DataFrame:
    """(v, root) from edges that one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            v, root = stars(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            top = np.unique(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, top])), pa.array(np.concatenate([root, top]))], ["v", "root"])

    return e.select("u", "v").coalesce(1).mapInArrow(run, "v long, root long")


def components(edges: DataFrame, few: int = 1 << 20) -> DataFrame:
    """(a, b) pairs of longs -> (v, root): the smallest vertex that each vertex reaches; vertices without edges are absent.

    ``few`` edges, 16 bytes each, are settled by one task.
    """
    spark = edges.sparkSession
    e = contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")).distinct()
    e, path = save(contracted(e))
    state = lambda: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state()
    while seen[0] > few:
        # large star: of all neighbours, each vertex hangs its larger ones below its smallest
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, path_large = save(large)
        # small star: each vertex hangs its smaller neighbours, and itself, below the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        tops = small.select("u", F.col("m").alias("v"))
        many = small.where("n > 1").select(F.col("u").alias("k"), "m")
        rest = large.join(many, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = save(contracted(tops.union(rest).distinct()))
        drop(spark, path, path_large)
        e, path = new, new_path
        before, seen = seen, state()
        if seen == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root")).union(e.select("v", F.col("v").alias("root")).distinct())
    settled, _ = save(_settled(e))
    drop(spark, path)
    return settled


def spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, smallest id reached) for both sides of a block's links: they connect what the block connects."""
    a, b = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(a):
        return []
    hit = hit[np.ix_(a, b)]
    la, lb = left[a], right[b]
    most = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(lb, np.where(hit, la[:, None], most).min(axis=0))
        new_a = np.minimum(la, np.where(hit, new_b[None, :], most).min(axis=1))
        if np.array_equal(new_a, la) and np.array_equal(new_b, lb):
            return [(left[a], la), (right[b], lb)]
        la, lb = new_a, new_b
