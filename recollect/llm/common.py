"""Shared helpers: scratch tables in the cluster's shared folder, and joins that survive a hot key."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with fewer rows than this is never treated as hot.
HEAVY_ROWS = 1_000
#: A hot key holds at least one row in this many, so there are at most this many hot keys.
HEAVY_SHARE = 1_000


#: Whether Spark deletes the shuffle files of a query when it ends. Those of a table that is written once are of no more use.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one only in local mode, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables that cut lineage: written once to the shared folder, then read back.

    A lost executor costs a re-read of these files, never a recomputation of what made them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._made}"
        self._made += 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete saved tables that nothing will read again."""
        for df in saved:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete all of these tables; whatever still reads them must have been written or shown before."""
        self._delete(self.base)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What empties the spellings and the like that operators keep on a worker from task to task.
kept_on_worker: list[Callable[[], object]] = []


def free_worker() -> None:
    """Give back what earlier tasks of any operator have left in this worker, before work that needs the memory."""
    for empty in kept_on_worker:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can do it
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def cleared() -> Iterator[None]:
    """Scratch tables that operators make within are deleted at the end; write what is made of them before it."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.clear()


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, or with marks after it a name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_spread(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    weight: Column,
    total: int,
    spread: Column,
) -> DataFrame:
    """Left join of many rows to one row a key, when one key may hold a third of all rows.

    ``weight`` is how many left rows a right row stands for and ``total`` the number of left rows. Keys with at
    least ``max(HEAVY_ROWS, total / HEAVY_SHARE)`` rows are hot; there can't be more than HEAVY_SHARE of them. Of these only the
    keys are broadcast, with a number of salts, one for each so many rows; values of any size are shuffled. A hot key's left
    rows are dealt over its salts by ``spread``, and its right row is there once a salt, so no task sees a key above that size.
    """
    heavy_from = max(HEAVY_ROWS, total // HEAVY_SHARE)
    salts = F.ceil(weight / heavy_from).cast("int")
    hot = right.filter(weight >= heavy_from).select(*keys, salts.alias("__salts"))
    some = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), list(keys), "left").withColumn("__s", F.pmod(F.xxhash64(spread), some).cast("int")).drop("__salts")
    there = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.explode(F.sequence(F.lit(0), F.when(weight >= heavy_from, salts).otherwise(1) - 1)).alias("__k"), *values)
    on = [F.col("__s") == F.col("__k")] + [dealt[k] == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return dealt.join(there, on, "left").select(*left.columns, *values)


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: Column, total: int, how: str = "inner") -> DataFrame:
    """Join of many rows to one row a key as in ``join_spread``, where how many left rows a key has is yet to be counted.

    ``right`` has the key and columns that ``left`` doesn't. With fewer than HEAVY_ROWS left rows no key can be hot.
    """
    if total < HEAVY_ROWS:
        return left.join(right, key, how)
    heavy_from = max(HEAVY_ROWS, total // HEAVY_SHARE)
    counts = left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= heavy_from)
    hot = F.broadcast(counts.select(key, F.ceil(F.col("__n") / heavy_from).cast("int").alias("__salts")))  # HEAVY_SHARE keys at most
    some = F.coalesce("__salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__s", F.pmod(F.xxhash64(spread), some).cast("int")).drop("__salts")
    there = right.join(hot, key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), some - 1))).drop("__salts")
    return dealt.join(there, [key, "__s"], how).drop("__s")
