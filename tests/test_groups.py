import re
from itertools import groupby

from recollect.plans import lifecycles, scans
from recollect.sources.tables import memory_items

SF = "/root/testdata/sf0.001"


def test_candidate_sources_gather_no_group(spark):
    got = lifecycles.j17_candidate_sources(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # a group's ids never meet in one row
    rows = [r for r in memory_items(spark, SF).collect() if r.status == "candidate"]
    least = {}
    for r in rows:
        key = (r.project_id, r.kind)
        least[key] = min(r.id, least.get(key, r.id))
    assert rows and sorted(map(tuple, got.collect())) == sorted((least[r.project_id, r.kind], r.id, r.title) for r in rows)


def test_timeline_holds_no_project_in_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the eight ranges apart
    try:
        got = scans.n1_timeline(spark, SF)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(project_id#\d+L?, updated_at", plan)
        rows = sorted((r.project_id, r.updated_at, r.id) for r in memory_items(spark, SF).collect())
        want = []
        for _, group in groupby(rows, lambda r: r[0]):
            ids = [r[2] for r in group]
            want += [(x, k + 1, [-1, *ids][k], [*ids, -1][k + 1], len(ids)) for k, x in enumerate(ids)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
