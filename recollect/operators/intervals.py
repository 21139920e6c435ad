"""Intervals against points by a dyadic cover: both sides meet by equality, open ends included.

The days of a domain of 2**LEVELS are cut into aligned spans of 1, 2, 4, ... days. An interval is filed under the fewest spans
that cover its days, at most two a level; a point lies in one span a level. Point and interval share exactly one span if
the interval has the point's day, and none otherwise; the exact ends, within a day, are compared on what meets.

Records that are always valid all lie under the one widest span. Spans with many intervals are therefore salted: their
intervals are dealt over several keys, and points look at each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.sources.scratch import written

#: Days of the domain as a power of two, and its first day: some 1969 to 2148.
LEVELS, FIRST = 16, "1969-01-01"
#: A span with more intervals than this is salted, one salt for each so many; it must also hold a thousandth of all.
HEAVY = 10_000
_SHARE = 1_000


def _day(moment: Column) -> Column:
    """Days from the domain's first one; what lies outside the domain counts as its first or last day."""
    days = F.datediff(F.to_date(moment), F.lit(FIRST).cast("date"))
    return F.when(moment.isNotNull(), F.greatest(F.lit(0), F.least(days, F.lit((1 << LEVELS) - 1)))).cast("int")


def spans(start: Column, stop: Column) -> Column:
    """The spans (array of longs) whose days are those of [start, stop); null ends are open. An empty interval has none."""
    lo = F.coalesce(_day(start), F.lit(0))
    hi = F.coalesce(_day(stop), F.lit((1 << LEVELS) - 1)) + 1  # the day on which it ends may be in it
    none = F.array().cast("array<bigint>")

    def level(acc: Column, k: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        left, right = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
        key = lambda place: F.array(k.cast("long") * (1 << (LEVELS + 1)) + place)
        out = F.concat(acc["out"], F.when(left, key(lo)).otherwise(none), F.when(right & (lo + left.cast("int") < hi), key(hi - 1)).otherwise(none))
        return F.struct(F.shiftright(lo + left.cast("int"), 1).alias("lo"), F.shiftright(hi - right.cast("int"), 1).alias("hi"), out.alias("out"))

    begin = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), none.alias("out"))
    cover = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, level, lambda acc: acc["out"])
    return F.when(start.isNotNull() & stop.isNotNull() & (start >= stop), none).otherwise(cover)


def spans_at(moment: Column) -> Column:
    """The spans that hold a moment, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: k.cast("long") * (1 << (LEVELS + 1)) + F.call_function("shiftright", _day(moment), k))


def holding(intervals: DataFrame, points: DataFrame, start: str, stop: str, moment: str, heavy: int = HEAVY) -> DataFrame:
    """Every row of ``points`` beside every row of ``intervals`` with start <= moment < stop; null ends are open.

    The columns of both sides must have different names. A point without a moment meets nothing.
    """
    filed = written(intervals.withColumn("__row", F.monotonically_increasing_id()).withColumn("__span", F.explode(spans(F.col(start), F.col(stop)))), "spans")
    sizes = filed.groupBy("__span").agg(F.count("*").alias("__n"))
    least = max(heavy, filed.count() // _SHARE)
    hot = F.broadcast(sizes.filter(F.col("__n") > least).select("__span", F.ceil(F.col("__n") / least).cast("int").alias("__salts")))  # under _SHARE rows
    salted = filed.join(hot, "__span", "left").withColumn("__salt", F.pmod(F.xxhash64("__row"), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts", "__row")
    asked = points.filter(F.col(moment).isNotNull()).withColumn("__span", F.explode(spans_at(F.col(moment))))
    asked = asked.join(hot, "__span", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    both = asked.join(salted, ["__span", "__salt"])
    held = (F.col(start).isNull() | (F.col(start) <= F.col(moment))) & (F.col(stop).isNull() | (F.col(stop) > F.col(moment)))
    return both.filter(held).select(*points.columns, *intervals.columns)
