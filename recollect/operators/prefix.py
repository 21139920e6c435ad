"""Running sums, counts and maxima of ordered groups, and ranks within them, with no group in one task.

Rows are dealt by ranges of (group, order), so a range has the end of one group, some whole groups, and the beginning of
another. Within ranges a window runs over (group, range). What a range needs from those before it is one summary of the one
group that goes on into it, so the table of these is no longer than there are ranges, however many groups there are: it is
broadcast and added on. A group of a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.scratch import written

PART = "__part"


def ranged(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` written by ranges of group and order, with the number of the range."""
    dealt = rows.repartitionByRange(*by, *order)
    return written(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def running(
    rows: DataFrame,
    by: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """``rows`` with a column for each name: the sum, or the largest value, of its group's rows up to each row.

    Not ``inclusive``, up to the row before. ``totals`` are sums of the whole group. ``order`` must tell the rows of a group
    apart, or ties fall as they come. Null groups are a group; nulls count nothing; a sum of nothing is null, as is a maximum. Maxima
    may be of structs.
    """
    sums, maxima, totals = sums or {}, maxima or {}, totals or {}
    values = {f"__run_v{i}": c for i, c in enumerate([*sums.values(), *maxima.values(), *totals.values()])}
    names = list(zip(values, [*sums, *maxima, *totals], [F.sum] * len(sums) + [F.max] * len(maxima) + [F.sum] * len(totals), strict=True))
    last = len(sums) + len(maxima)  # from here on totals
    held = ranged(rows.withColumns(values), by, order)

    pieces = held.groupBy(*by, PART).agg(*[f(v).alias(v) for v, _, f in names])
    group, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *[F.col(c).alias(f"__run_g{i}") for i, c in enumerate(by)], F.col(PART).alias("__run_p"), F.count("*").over(group).alias("__run_n"),
        *[f(v).over(earlier if i < last else group).alias(f"__run_b{i}") for i, (v, _, f) in enumerate(names)],
    )
    pieces = F.broadcast(pieces.filter("__run_n > 1"))  # a range shares at most two of its groups with others

    w = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = Window.partitionBy(*by, PART)
    inner = held.select(*rows.columns, PART, *[f(v).over(w if i < last else whole).alias(f"__run_w{i}") for i, (v, _, f) in enumerate(names)])
    same = F.col(PART) == F.col("__run_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__run_g{i}"))
    both = inner.join(pieces, same, "left")

    def put(i: int, f) -> Column:
        mine, before = F.col(f"__run_w{i}"), F.col(f"__run_b{i}")
        if i >= last:
            return F.coalesce(before, mine)
        if f is F.max:
            return F.greatest(mine, before)
        return F.coalesce(mine + before, mine, before)

    return both.select(*rows.columns, *[put(i, f).alias(name) for i, (_, name, f) in enumerate(names)])


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group: for each name the exact percentile, interpolated at share * (n - 1); null where a group has no value.

    Equal values are counted first. A running count then tells which ranks each value holds, and only the two values about
    each rank asked for go on, so no task sees a group.
    """
    counted = rows.groupBy(*by, value).agg(F.count(value).alias("__n"))
    ranks = running(counted.filter(F.col(value).isNotNull()), by, [F.asc(value)], sums={"__upto": F.col("__n")}, totals={"__all": F.col("__n")})
    picked, out = [], []
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(share) * (F.col("__all") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank)
            picked.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"__{side}{i}"))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (F.lit(share) * (F.col("__all") - 1) - F.floor(F.lit(share) * (F.col("__all") - 1)))).alias(name))
    found = ranks.groupBy(*by).agg(F.max("__all").alias("__all"), *picked)
    groups = counted.groupBy(*by).agg(F.sum("__n").alias("__have"))
    named = found.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__all", *[f"__{s}{i}" for i in range(len(shares)) for s in ("lo", "hi")])
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return groups.join(named, same, "left").select(*by, *out)
