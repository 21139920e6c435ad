from pyspark.sql import functions as F

from recollect.operators import imports, lifecycle, search


def test_operators_are_words_of_their_own(spark):
    texts = ["find ingested_asof:2024-01-01 my profile:x rows", "asof:2023-01-01", "file:a file:b c path:", "xasof:1 y\tsession:s1\nz", "", None]
    got = imports.parsed_queries(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    told = [(r.asof, r.since, r.ingested_asof, r.session, r.file, r.path, r.terms) for r in got]
    assert told == [
        (None, None, "2024-01-01", None, None, None, "find my profile:x rows"), ("2023-01-01", None, None, None, None, None, ""),
        (None, None, None, None, "a", None, "c path:"), (None, None, None, "s1", None, None, "xasof:1 y z"), (None,) * 6 + ("",), (None,) * 6 + ("",),
    ]


def test_filters_come_before_ranks_and_lanes(spark):
    """The only record that the filter lets pass is the worst of three hundred matches; of another query it has some terms only."""
    rows = [(i, "apple apple pear") for i in range(300)] + [(300, "apple pear " + "plum " * 50), (301, "apple")]
    docs = spark.createDataFrame(rows, "id long, body string")
    queries = spark.createDataFrame([(1, ["apple", "pear"]), (2, ["apple", "plum", "pear"])], "query_id long, terms array<string>")
    only = lambda rows: rows.filter("(query_id = 1 AND id = 300) OR (query_id = 2 AND id = 301)")
    got = search.matches(docs, queries, passing=only).collect()
    assert sorted((r.query_id, r.id, r.hits, r.lane) for r in got) == [(1, 300, 2, "all"), (2, 301, 1, "any")]


def items(spark, groups):
    rows = [(i, f"p{g}", None if g == 0 else "d", "k", "active", None) for g, ids in enumerate(groups) for i in ids]
    return spark.createDataFrame(rows, "id long, project_id string, domain string, kind string, status string, superseded_by long")


def test_groups_of_other_records_are_new(spark):
    a, b = [1, 10, 13, 15, 16, 30], [1, 11, 12, 14, 17, 30]  # as many, with the same ends, sum and sum of squares
    new = lambda x, y: [(r.project_id, r.n, r.first_id) for r in lifecycle.new_groups(items(spark, x), items(spark, y)).collect()]
    assert new([a], [b]) == [("p0", 6, 1)]
    assert new([a], [a]) == []
    assert new([[], a], [a]) == []  # the same records under another project
    assert new([a], [[*a, 31]]) == [("p0", 6, 1)] and new([[*a, 31]], [a]) == [("p0", 7, 1)]
    assert new([[1, 2]], []) == []  # too few


def test_imports_are_idempotent(spark):
    s = spark.createDataFrame([("c1",), ("c2",), ("c2",)], "id string")
    p = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "y", "k"), (3, "y", "k"), (4, "z", "")], "id long, content string, sync_id string")
    fresh, new = imports.imported(s, p, s.filter("id = 'c1'"))
    assert [r.id for r in fresh.collect()] == ["c2"]
    rows = new.collect()
    assert sorted(r.id for r in rows) == [1, 2, 4] and new.columns == p.columns
    again = imports.imported(s, p, s, new)
    assert again[0].isEmpty() and again[1].isEmpty()


def test_migrated_rows_without_details_stay(spark):
    old, new = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2, None, None), (3, "s", 4)], "id int, summary string, revision int")
    got = lifecycle.migrated(old, new, {"summary": "none", "revision": 0})
    assert sorted(map(tuple, got.select("id", "summary", "revision").collect())) == [(1, "none", 0), (2, "none", 0), (3, "s", 4)]
    assert got.filter(F.col("revision").isNull()).isEmpty()
