"""Scans, filters and projections over memory records. The clock is an argument everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def unexpired(now: str = S.NOW) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > at(now))


def not_superseded() -> Column:
    return F.col("superseded_by").isNull() | (F.col("superseded_by") == 0)


def valid_at(when: Column) -> Column:
    """valid_from <= when < valid_to, open ends allowed."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))


def live(items: DataFrame, now: str = S.NOW) -> DataFrame:
    return items.filter((F.col("status") == "active") & unexpired(now) & not_superseded())


def facets(items: DataFrame, **equal: str) -> DataFrame:
    """Equality filters on any columns; they reach the scan."""
    for name, value in equal.items():
        items = items.filter(F.col(name) == value)
    return items


def recent(items: DataFrame, limit: int = 20, status: str = "active", now: str = S.NOW, **equal: str) -> DataFrame:
    found = facets(items, status=status, **equal)
    if status == "active":
        found = found.filter(unexpired(now))
    return found.orderBy(F.desc("updated_at"), "id").limit(limit)


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a table of ids; ids without a record drop out."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def masked(items: DataFrame, visible: tuple[str, ...] = ("low", "untrusted"), limit: int = 200) -> DataFrame:
    """What a caller of low trust may see: rows of the visible levels, with clipped bodies and no structured columns."""
    body = F.when(F.char_length("body") > limit, F.concat(F.substring("body", 1, limit), F.lit("..."))).otherwise(F.col("body"))
    return items.filter(F.col("trust_level").isin(*visible)).withColumn("body", body).withColumn("applies_to_json", F.lit(""))


def allowed(items: DataFrame, projects: DataFrame) -> DataFrame:
    return items.join(projects.select("project_id").distinct(), "project_id", "left_semi")


def touching(items: DataFrame, part: str) -> DataFrame:
    """Records that apply to a file whose name holds ``part``, whatever its case."""
    return items.filter(F.lower("applies_to_json").contains(part.lower()))


def compact(items: DataFrame, limit: int = 600) -> DataFrame:
    return items.select("id", "title", F.concat(F.lit("memory://"), "id").alias("uri"), F.substring("body", 1, limit).alias("text"), "project_id", "kind")


def fold_usage(items: DataFrame, usage: DataFrame) -> DataFrame:
    """Access counters with the events since folded in."""
    seen = usage.groupBy("memory_id").agg(F.count("*").alias("__n"), F.max("ts").alias("__last"))
    out = items.join(seen, items["id"] == seen["memory_id"], "left")
    return out.select(
        "id", (F.col("access_count") + F.coalesce("__n", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "__last").alias("last_accessed")
    )
