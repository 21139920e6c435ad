"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, join_hot


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b of one task."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v): root is the smallest node that it reaches.

    Each round every node points at its smallest neighbour, pointers are doubled twice, and the links are rewritten
    between the nodes that they point at. Linked nodes shrink by a constant factor at least, chains by a power of
    their length; the driver learns only how many links are left. A node that many others point at is dealt over several tasks.
    """
    links = scratch.save(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("root", F.col("node"))
    labels = scratch.save(labels)
    nodes = labels.count()
    while n := links.count():
        both = links.union(links.select("v", "u"))
        to = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        for _ in range(2):
            up = to.select(F.col("u").alias("p"), F.col("p").alias("q"))
            to = scratch.save(join_hot(to, up, "p", F.col("u"), n, "left").select("u", F.coalesce("q", "p").alias("p")))
        labels = scratch.save(
            join_hot(labels, to.withColumnRenamed("u", "root"), "root", F.col("node"), nodes, "left").select("node", F.coalesce("p", "root").alias("root"))
        )
        ends = join_hot(links, to.withColumnRenamed("p", "x"), "u", F.col("v"), n)
        ends = join_hot(ends, to.select(F.col("u").alias("v"), F.col("p").alias("y")), "v", F.col("u"), n)
        links = scratch.save(
            ends.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        )
    return labels


def as_batches(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))
