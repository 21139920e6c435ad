"""Vectors as whole numbers: what of a table of embeddings can be counted exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One in this many of a component's unit.
SCALE = 256


def largest(dims: int) -> int:
    """The size up to which components are taken, so that the inner product of two vectors fits 62 bits."""
    return int((2.0**62 / max(1, dims)) ** 0.5)


def is_whole(vector: str | Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    size = lambda c: F.abs(c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (size(c) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite), F.lit(False))


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have, the larger of two as common; 0 for an empty table. One row comes to the driver."""
    lengths = vectors.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def in_whole_numbers(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """``vectors`` whose vector is whole and ``dims`` long, with x: floor(256 * component), component as double.

    Components whose x would be larger than ``largest(dims)`` either way count as that: an embedding has none, and inner products
    stay exact.
    """
    most = float(largest(dims))
    x = F.transform(vector_col, lambda c: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(most)), F.lit(-most))).cast("long"))
    return vectors.filter(is_whole(vector_col) & (F.size(vector_col) == dims)).withColumn("x", x)
