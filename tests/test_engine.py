import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recollect import plans
from recollect.functions import text as X
from recollect.operators import graph, lifecycle, packing, search, similarity, vector

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["search_topk", "v7_hybrid_search", "p4_n5_greedy_pack", "c2_similar_titles", "e11_apply_changes", "w16_feedback_fold", "z_session_windows", "a1_grouped_counts", "f2_as_of_join", "j5_p3_comentions"]


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert len(plans.queries()) > 130


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def flat(x):
    if isinstance(x, float):
        return f"{x:.5f}"
    return str(x)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(plans.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    rows = sorted(tuple(map(flat, r)) for r in want.fetchall())
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(map(flat, r)) for r in got.select(*cols).collect()) == rows


def test_redaction(spark):
    secret = "ghp_" + "a" * 36
    assert one(spark, X.redact(F.lit(f"use {secret} now"))) == "use [SECRET] now"
    assert one(spark, X.redact(F.lit(f"use {secret}[SECRET] now"))) == "use [SECRET] now"
    assert one(spark, X.redact(F.lit("password: " + "x" * 32))) == "[SECRET]"
    assert one(spark, X.strip_private(F.lit("a <PRIVATE>x\ny</private> b"))) == "a [REDACTED] b"


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("src/a.py", "src/a.py", 120), ("x/src/a.py", "src/a.py", 100), ("p/a.py", "q/a.py", 75), ("src", "src/a.py", 70), ("s/a.py", "s/b.py", 22), ("", "a", 0), ("lib/x/a.py", "lib/b.py", 62)],
)
def test_path_scores(spark, a, b, score):
    assert one(spark, X.path_score(F.lit(a), F.lit(b))) == score


def test_query_terms(spark):
    assert one(spark, X.query_terms(F.lit("The quick, (quick) fox is at"))) == ["quick", "fox"]
    assert one(spark, X.query_terms(F.lit("is at the"))) == ["is", "at", "the"]
    assert set(one(spark, X.fallback_terms(F.lit("queries boxes cats")))) == {"queries", "query", "boxes", "box", "cats", "cat"}


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vector.cosine(v(1, 0), v(0, 0))) == 0.0
    assert one(spark, vector.cosine(v(1, 0), v(1, 0, 0))) == 0.0
    assert round(one(spark, vector.cosine(v(1, 1), v(2, 2))), 9) == 1.0


def test_pagerank_sums_to_one_and_spreads(spark):
    nodes = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.1), (1, 3, 0.1), (2, 9, 1.0)], "query_id long, id long, s double")
    edges = graph.adjacency(spark.createDataFrame([(1, 2, "caused"), (1, 2, "resolves"), (7, 7, "caused")], "from_id long, to_id long, relation string"), nodes)
    got = {(r.query_id, r.id): r.ppr for r in graph.personalized_pagerank(nodes, edges, F.col("s")).collect()}
    assert abs(sum(v for (q, _), v in got.items() if q == 1) - 1) < 1e-9 and abs(got[2, 9] - 1) < 1e-9
    assert got[1, 1] > got[1, 3]


def test_greedy_budget(spark):
    rows = [(1, 1, 10, 200), (1, 2, 11, 150), (1, 3, 12, 300), (1, 4, 13, 20)]
    df = spark.createDataFrame(rows, "request_id long, place int, id long, tokens int")
    got = {r.id: (r.used, r.verdict) for r in packing.greedy(df, 400).collect()}
    assert got == {10: (200, "included"), 11: (150, "included"), 12: (0, "excluded"), 13: (20, "included")}
    assert {r.verdict for r in packing.greedy(df.filter("id = 12"), 250).collect()} == {"truncated"}


def test_feedback_floor(spark):
    e = spark.createDataFrame([(7, 1, 1, -1.0), (7, 2, 2, -1.0), (7, 3, 3, -1.0), (7, 4, 4, -1.0), (7, 5, 5, -1.0), (7, 6, 6, -5.0), (7, 7, 7, 1.0)], "memory_id long, event_id long, ts long, reward double")
    assert abs(lifecycle.feedback_fold(e).first().utility - 0.3) < 1e-9


def test_fallback_only_where_nothing_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "id long, body string")
    queries = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["beta", "gamma"])], "query_id long, terms array<string>")
    out = search.matches(docs, queries).collect()
    assert {(r.query_id, r.id, r.lane) for r in out} == {(1, 1, "all"), (2, 1, "any"), (2, 2, "any")}


def test_names(spark):
    names = spark.createDataFrame([("harbor",), ("Harbor",), ("harbors-x",), ("harber",), ("go",), ("golang",)], "name string")
    got = {(r.name, r.other): (r.match, r.distance) for r in similarity.similar_names(names).collect()}
    assert got["harbor", "Harbor"] == ("case", 0) and got["harbor", "harbors-x"] == ("substring", 0)
    assert got["harbor", "harber"] == ("levenshtein", 1) and ("go", "harbor") not in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id long, body string")
    queries = spark.createDataFrame([], "query_id long, terms array<string>")
    assert search.matches(docs, queries).count() == 0
    assert vector.nearest(spark.createDataFrame([], "id long, embedding array<float>"), spark.createDataFrame([], "query_id long, embedding array<float>"), 3).count() == 0
