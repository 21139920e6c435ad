import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import intervals, lifecycle, prefix


def rows_of(n, seed=1):
    """A third of all rows in one group."""
    rng = random.Random(seed)
    return [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{rng.randint(0, 40)}", rng.randint(0, 200), i, rng.choice([None, 1, 2, 5, -3])) for i in range(n)]


def grouped(rows):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    return by


def test_running_sums_and_maxima_over_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the eight ranges apart
    try:
        rows = rows_of(3_000)
        df = spark.createDataFrame(rows, "g string, at int, id int, v int").repartition(5)
        order = [F.asc("at"), F.asc("id")]
        for inclusive in (True, False):
            got = {r.id: r for r in prefix.running(df, ["g"], order, sums={"s": F.col("v"), "n": F.lit(1)}, maxima={"m": F.struct("v", "id")}, totals={"all": F.col("v")}, inclusive=inclusive).collect()}
            assert len(got) == len(rows)
            for group in grouped(rows).values():
                for k, (_, _, i, _) in enumerate(group):
                    past = group[: k + inclusive]
                    values = [v for *_, v in past if v is not None]
                    assert (got[i].s, got[i].n) == (sum(values) if values else None, len(past) or None)
                    best = max(((v is not None, v or 0, j) for _, _, j, v in past), default=None)
                    assert (got[i].m and (got[i].m.v, got[i].m.id)) == (best and ((best[1] if best[0] else None), best[2]))
                    assert got[i].all == sum(v for *_, v in group if v is not None)
        share = [r["count"] for r in prefix.ranged(df, ["g"], order).groupBy(prefix.PART).count().collect()]
        assert len(share) == 8 and max(share) < 1.5 * len(rows) / 8  # no task holds the group
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert prefix.running(df.limit(0), ["g"], order, sums={"s": F.col("v")}).count() == 0


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", rng.choice([1.5, 2.0, rng.random() * 9])) for i in range(2_000)] + [("none", None), ("one", 4.0), (None, 1.0), (None, None), (None, 3.0)]
    got = {r.g: r for r in prefix.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in (("low", 0), ("p50", 50), ("p95", 95), ("top", 100)):
            assert got[g][name] is None if not values else abs(got[g][name] - np.percentile(values, p)) < 1e-12


def test_feedback_folds_of_a_hot_record(spark):
    rng = random.Random(5)
    events = [(7 if i % 3 == 0 else i % 11, i // 5, i, rng.uniform(-3, 2)) for i in range(900)]
    got = {r.memory_id: r.utility for r in lifecycle.feedback_fold(spark.createDataFrame(events, "memory_id int, ts int, event_id int, reward double").repartition(4)).collect()}
    want = defaultdict(lambda: 1.0)
    for m, _, _, reward in sorted(events, key=lambda e: (e[1], e[2])):
        want[m] = max(0.1, want[m] + 0.2 * max(-1.0, min(1.0, reward)))
    assert set(got) == set(want) and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_intervals_meet_points(spark, monkeypatch):
    rng = random.Random(7)
    base = datetime(2023, 1, 1)
    when = lambda: base + timedelta(hours=rng.randint(0, 9_000))
    rows = []
    for i in range(400):
        a, b = (None if rng.random() < 0.2 else when()), (None if rng.random() < 0.4 else when())
        rows.append((i, a, b))
    rows += [(i, None, None) for i in range(400, 600)]  # a third is always valid
    rows += [(600, datetime(1950, 1, 1), datetime(1955, 1, 1)), (601, datetime(2300, 1, 1), None), (602, base, base), (603, datetime(1950, 1, 1), None)]
    points = [(k, when()) for k in range(60)] + [(100, datetime(1940, 1, 1)), (101, datetime(1952, 1, 1)), (102, datetime(2400, 1, 1)), (103, None), (104, base), (104, base)]
    df, at = spark.createDataFrame(rows, "id int, a timestamp, b timestamp"), spark.createDataFrame(points, "k int, t timestamp")
    want = Counter((k, i) for k, t in points if t for i, a, b in rows if (a is None or a <= t) and (b is None or b > t))
    for heavy in (10_000, 20):  # with salts, and without
        assert Counter(map(tuple, intervals.holding(df, at, "a", "b", "t", heavy).select("k", "id").collect())) == want
    sizes = df.select(F.size(intervals.spans(F.col("a"), F.col("b"))).alias("n")).collect()
    assert max(r.n for r in sizes) <= 2 * intervals.LEVELS
    assert intervals.holding(df.limit(0), at, "a", "b", "t").count() == 0
