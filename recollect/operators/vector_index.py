"""An inverted-file index of vectors: every row filed under its nearest of some centroids, queries looking into a few lists.

Centroids are fitted by k-means on a bounded sample; every row is filed. The index is a written table in order of lists. A
search sends each query to the lists of its ``probes`` nearest centroids, where it meets their vectors exactly. Lists are cut
into blocks by their size, so that one list with a third of all rows is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.vector import _NEAR, _matrix, best_of_unit, k_best
from recollect.sources.scratch import written

#: Rows of the sample for each centroid; rounds of k-means; most centroids, which bounds the sample and what tasks are sent.
SAMPLE_EACH, ROUNDS, MOST_LISTS = 64, 12, 4_096
#: Vectors of a list, and queries to it, in one group.
LIST_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 11
SEED = 42


@dataclass(frozen=True)
class Index:
    """``rows``: id, embedding, list, of all vectors that are there; ``centroids``: one row a list, of length one."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: DataFrame


def _directions(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of directions by spherical k-means, begun with rows far from each other in turn."""
    x, rng = _directions(sample), np.random.default_rng(SEED)
    chosen = [int(rng.integers(len(x)))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(lists, len(x)):
        far = np.maximum(1 - best, 0)
        if far.sum() <= 1e-12:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        some = np.bincount(nearest, minlength=len(centres)) > 0
        centres[some] = _directions(sums[some])
    return centres


def _lists_of(rows: DataFrame, id_col: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, embedding, lists): the nearest centroids of each row, best first; rows of another length have none."""
    dims = centroids.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            rows = batch.filter(fits)
            if not rows.num_rows:
                continue
            order = np.argsort(-(_directions(_matrix(rows.column(1), dims)) @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], [id_col, "embedding", "lists"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select(F.col(id_col).cast("long").alias(id_col), "embedding").mapInArrow(each, f"{id_col} long, embedding {kind}, lists array<int>")


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """Index all rows of ``vectors`` (id, embedding) that have the length of most; by default with the root of their number of lists.

    The sample is the SAMPLE_EACH rows a list whose ids have the smallest hashes, so it is spread over all ids and the same each time.
    """
    held = vectors.filter("embedding IS NOT NULL")
    length = held.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims, n = (length[0].d, length[0].n) if length else (1, 0)
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    sample = held.filter(F.size("embedding") == dims).orderBy(F.xxhash64("id"), "id").select("embedding").limit(SAMPLE_EACH * lists).toArrow()
    x = _matrix(sample.column("embedding"), dims) if n else np.zeros((1, dims))
    centroids = fitted(x, lists)
    rows = _lists_of(held, "id", centroids, 1).select("id", "embedding", F.col("lists")[0].alias("list"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.repartitionByRange("list", "row").sortWithinPartitions("list"), "inverted")
    return Index(rows, centroids, rows.groupBy("list").agg(F.count("*").alias("n")))


def search(index: Index, queries: DataFrame, k: int, probes: int, floor: float = S.VECTOR_FLOOR, metric: str = "cosine") -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of the vectors in the ``probes`` lists nearest to each query (query_id, embedding)."""
    asked = _lists_of(queries, "query_id", index.centroids, probes).select("query_id", "embedding", F.explode("lists").alias("list"), F.monotonically_increasing_id().alias("row"))
    asked = written(asked, "probes")
    askers = asked.groupBy("list").agg(F.count("*").alias("m"))
    cuts = index.sizes.join(askers, "list").select("list", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("down"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("across"))
    cuts = F.broadcast(cuts)  # a row a list, MOST_LISTS at most
    own = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = asked.join(cuts, "list").select("query_id", "embedding", "list", own("across").alias("i"), every("down").alias("j"))
    b = index.rows.join(cuts, "list").select("id", "embedding", "list", every("across").alias("i"), own("down").alias("j"))
    keys = ["list", "i", "j"]
    unit = lambda x, y: best_of_unit(x, y, k, metric, floor)
    return k_best(a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(unit, _NEAR), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query_id, id) that were found."""
    return exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
