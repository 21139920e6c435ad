"""Whitening of embeddings by their covariance, with multiplicity as a weight.

Equal vectors are one row with a count before anything is fitted, so a vector that fills a third of the table is centred,
multiplied and whitened once. A fit weight stands for it: one (each distinct vector counts once) or its count. The
covariance comes from weighted GEMMs of centred rows, one a task, whose sums are added up row of the matrix by row; the
driver holds matrices of dims x dims, whatever the table's size. Each distinct vector is whitened once and joined back to the
rows that have it.

Sums of vectors are whole numbers and exact; a row is centred as (n x - S) / n, where only the division rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch, join_spread
from recollect.llm.vectors import common_length, in_whole_numbers, is_whole

COMPONENTS = 4
#: Variance, as a share of the largest eigenvalue, under which a direction counts as flat.
FLAT = 1e-12
#: Rows multiplied at once.
_ROWS = 8_192
#: Partial rows of the matrix are first added up in this many groups.
_FAN = 64
_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, wide_deviation decimal(38,0), n_rows long"


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(x as rows, weights, batch) of columns x and w, in blocks of bounded size."""
    for i in range(0, batch.num_rows, _ROWS):
        part = batch.slice(i, _ROWS)
        x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
        yield x, part.column("w").to_numpy(zero_copy_only=False).astype(np.int64), part


def _totals(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The total weight, and the weighted sum of each dimension, as exact whole numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            for x, w, _ in _blocks(batch, dims):
                n += int(w.sum())
                narrow = int(w.max(initial=0)) * int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
                part = w @ x if narrow else w.astype(object) @ x.astype(object)
                sums = [s + int(p) for s, p in zip(sums, part, strict=True)]
        kinds = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([Decimal(n), *map(Decimal, sums)], kinds)], ["i", "s"])

    found = distinct.select("x", "w").mapInArrow(each, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    by = {r.i: int(r.s) for r in found}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(dims)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once where n x fits 62 bits."""
    most = int(np.abs(x).max(initial=0))
    if sums.dtype != object and n * most + int(np.abs(sums).max(initial=0)) < 1 << 62:
        return (n * x - sums) / n
    return np.array((n * x.astype(object) - sums) / n, float)


def _covariance(distinct: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    whole = _as_array(sums)

    def gemm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = np.zeros((dims, dims))
        for batch in batches:
            for x, w, _ in _blocks(batch, dims):
                d = centred(x, n, whole)
                v += (d * w[:, None]).T @ d
        group = (TaskContext.get().partitionId() if TaskContext.get() else 0) % _FAN
        if v.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, group, np.int32)), pa.array(list(v))], ["i", "g", "row"])

    def added(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        return pa.table({"i": table.column("i").slice(0, 1), "g": table.column("g").slice(0, 1), "row": pa.array([rows.sum(0)])})

    kinds = "i int, g int, row array<double>"
    parts = distinct.select("x", "w").mapInArrow(gemm, kinds).groupBy("i", "g").applyInArrow(added, kinds)
    v = np.zeros((dims, dims))
    for r in parts.withColumn("g", F.lit(0)).groupBy("i").applyInArrow(added, kinds).collect():  # dims rows
        v[r.i] = r.row
    return (v + v.T) / (2 * n)


def _as_array(sums: list[int]) -> np.ndarray:
    return np.array(sums, np.int64 if max(map(abs, sums), default=0) < 1 << 62 else object)


def _whitened(distinct: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """x, n_rows, deviation, wide_deviation and w (the weight), y: the centred vector on each of the axes."""
    dims, whole = len(sums), _as_array(sums)
    square = sum(s * s for s in sums)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _, part in _blocks(batch, dims):
                y = centred(x, n, whole) @ axes
                xx, xs = _inner(x, x), _inner(x, np.broadcast_to(whole, x.shape))
                exact = [n * n * a - 2 * n * b + square for a, b in zip(xx, xs, strict=True)]
                narrow = [e if e < 1 << 63 else None for e in exact]
                wide = [Decimal(e) if e < 10**38 else None for e in exact]
                columns = [pa.array(narrow, pa.int64()), pa.array(wide, pa.decimal128(38, 0)), pa.array(list(y), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("n_rows"), part.column("w"), *columns], ["x", "n_rows", "w", "deviation", "wide_deviation", "y"])

    return distinct.select("x", "n_rows", "w").mapInArrow(each, "x array<long>, n_rows long, w long, deviation long, wide_deviation decimal(38,0), y array<double>")


def _inner(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Exact inner products of rows."""
    if b.dtype != object and int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 62:
        return (a * b).sum(1).tolist()
    return [int(x) for x in (a.astype(object) * b).sum(1)]


def _identity_error(whitened: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest entry of the covariance of y minus the identity, over the axes with variance; sums come out as one row each."""
    if not used or not n:
        return None
    y = [F.col("y")[k] for k in used]
    mean = whitened.agg(*[(F.sum(c * F.col("w")) / n).alias(f"m{i}") for i, c in enumerate(y)]).first()
    pairs = [(i, j) for i in range(len(y)) for j in range(i, len(y))]
    cov = whitened.agg(*[(F.sum((y[i] - mean[i]) * (y[j] - mean[j]) * F.col("w")) / n).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(cov[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """One row for each row of ``vectors`` and component: id, component, n, deviation, whitened, explained, identity_error, wide_deviation, n_rows.

    A vector is taken as x = floor(256 * entry). Rows whose vector is null or has null or non-finite entries are dropped, and so
    are those of another length than the most common one, which have no place in one covariance. ``weights``: what a distinct
    x vector counts in the fit, ``one`` or its ``count`` of rows; ``n`` is the total weight. Components are unit eigenvectors of the
    covariance by falling eigenvalue. A flat direction (FLAT, or a single vector) has null ``whitened``; ``explained`` is null where nothing
    varies. ``deviation`` is n x - S squared and added up, null beyond 64 bits; ``wide_deviation`` has it as a decimal up to 38 digits. Null
    and repeated ids keep their rows. ``n_rows`` is how many rows share the x vector. An empty table gives no rows; other
    columns don't matter.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be one or count")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dims = common_length(named.filter(is_whole("v")), "v")
    if not dims:
        return spark.createDataFrame([], f"{id_col} long, {_RESULT}")
    rows = in_whole_numbers(named, "v", dims).select("id", "x")
    distinct = scratch.save(rows.groupBy("x").agg(F.count("*").alias("n_rows")).withColumn("w", F.lit(1).cast("long") if weights == "one" else F.col("n_rows")))
    n, sums = _totals(distinct, dims)
    v = _covariance(distinct, dims, n, sums)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    values, axes, trace = values[order], axes[:, order], float(np.trace(v))
    used = [k for k, e in enumerate(values) if e > FLAT * max(values[0], 0.0)]
    scale = np.array([1 / np.sqrt(e) if k in used else 0.0 for k, e in enumerate(values)])
    whitened = scratch.save(_whitened(distinct, n, sums, axes * scale))
    error = _identity_error(whitened, n, used)
    key = [F.xxhash64("x").alias("h")]
    left = rows.select("id", "x", *key)
    right = whitened.select("x", *key, "n_rows", "deviation", "wide_deviation", "y")
    both = join_spread(left, right, ["h", "x"], ["n_rows", "deviation", "wide_deviation", "y"], F.col("n_rows"), rows.count(), F.xxhash64("id"))
    share = {k + 1: float(e) / trace for k, e in enumerate(values)} if trace > 0 else {}
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), (F.col("y")[k] if k in used else F.lit(None).cast("double")).alias("whitened"), F.lit(share.get(k + 1)).cast("double").alias("explained")) for k in range(len(values))]))
    return both.select(F.col("id").alias(id_col), each.alias("c"), F.lit(n).cast("long").alias("n"), "deviation", "wide_deviation", "n_rows").select(
        id_col, "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), "wide_deviation", "n_rows"
    )
