"""Chains of pointers followed to their ends, by pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.sources.scratch import written


def current(records: DataFrame, id_col: str = "id", next_col: str = "superseded_by") -> DataFrame:
    """(id, current_id, depth, cyclic): the record at the end of each record's chain, and how many steps away it is.

    ``records`` has each id once and points at the next record, or nowhere (null, 0, itself). A chain ends at a record that
    points nowhere or at one that isn't there. Each round every record that isn't at an end yet points at what its target points
    at, so a chain of n records takes log n rounds. What is still on its way after as many rounds as the number of records asks
    for is in a cycle or leads into one: it has no current record, null depth, and ``cyclic`` is true.
    """
    raw = records.select(F.col(id_col).alias("id"), F.col(next_col).alias("to")).filter("id IS NOT NULL")
    there = raw.select(F.col("id").alias("to"))
    has = raw.filter("to IS NOT NULL AND to <> 0 AND to <> id").join(there, "to", "left_semi").select("id", "to")
    start = written(raw.select("id").join(has, "id", "left"), "chains")
    ended = start.filter("to IS NULL").select("id", F.col("id").alias("current_id"), F.lit(0).cast("long").alias("depth"))
    moving = start.filter("to IS NOT NULL").withColumn("depth", F.lit(1).cast("long"))
    done, rounds = [ended], math.ceil(math.log2(max(2, start.count()))) + 1
    for _ in range(rounds):
        # what a record points at has either come to an end or moves on itself; as many records may point at one, that side is the unique one
        at_end = done[0]
        for more in done[1:]:
            at_end = at_end.unionByName(more)
        reach = at_end.select(F.col("id").alias("to"), F.col("current_id").alias("on"), F.col("depth").alias("far"), F.lit(True).alias("end")).unionByName(
            moving.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("depth").alias("far"), F.lit(False).alias("end"))
        )
        step = written(moving.join(reach, "to").select("id", F.col("on").alias("to"), (F.col("depth") + F.col("far")).alias("depth"), "end"), "jump")
        done.append(step.filter("end").select("id", F.col("to").alias("current_id"), "depth"))
        moving = step.filter("NOT end").select("id", "to", "depth")
        if moving.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lost = moving.select("id", F.lit(None).cast(raw.schema["id"].dataType).alias("current_id"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    return out.withColumn("cyclic", F.lit(False)).unionByName(lost)
