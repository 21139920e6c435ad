import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import vector, vector_index
from recollect.plans import searches

SF = "/root/testdata/sf0.001"


def table(spark, rows, name="id"):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{name} long, embedding array<float>")


def brute(vectors, queries, k, metric="cosine", floor=0.12):
    out = set()
    for q, a in queries:
        scored = []
        for i, b in vectors:
            if a is None or b is None or len(a) != len(b):
                continue
            x, y = np.float32(a).astype(float), np.float32(b).astype(float)
            whole = np.sqrt(x @ x) * np.sqrt(y @ y)
            s = (x @ y / whole if whole else 0.0) if metric == "cosine" else -np.sqrt(((x - y) ** 2).sum())
            if metric != "cosine" or s >= floor:
                scored.append((-round(s, 6) + 0.0, i))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_blocks_of_queries_meet_blocks_of_vectors(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).round(1).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[4][1]) for i in range(150)] + [(2_000, [1.0, 2.0]), (2_001, [2.0, 1.0]), (2_002, None), (2_003, [0.0] * 6)]
    queries = [(i, v) for i, v in rows if i % 20 == 0 or i >= 2_000]
    for block in (4_096, 7):
        monkeypatch.setattr(vector, "QUERY_BLOCK", block)
        monkeypatch.setattr(vector, "LEAST_BLOCK", 16 * block)
        got = vector.nearest(table(spark, rows), table(spark, queries, "query_id"), 8, metric=metric)
        assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == brute(rows, queries, 8, metric)
    assert vector.nearest(table(spark, rows).limit(0), table(spark, queries, "query_id"), 3).isEmpty()
    assert vector.nearest(table(spark, rows), table(spark, queries, "query_id").limit(0), 3).isEmpty()


def test_index_finds_most_neighbours_in_few_lists(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_BLOCK", 64)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.25, 16)).tolist()) for i in range(3_000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1_000)] + [(20_000, None), (20_001, [1.0])]  # a quarter in one list
    v, q = table(spark, rows), table(spark, [r for r in rows if r[0] % 20 == 0 and r[0] < 10_000], "query_id")
    exact, index = vector.nearest(v, q, 10), vector_index.build(v, 40)
    assert index.rows.count() == 4_000  # every row of their length is filed
    assert vector_index.recall(vector_index.search(index, q, 10, probes=4), exact) > 0.95
    every = vector_index.search(index, q, 10, probes=len(index.centroids))
    key = lambda df: {tuple(r) for r in df.select("query_id", "id", "similarity", "rank").collect()}
    assert key(every) == key(exact)  # all lists are the exact way
    assert vector_index.search(vector_index.build(v.limit(0)), q, 3, 1).isEmpty()


def test_recall_of_the_query(spark):
    exact = vector.nearest(searches._vectors(spark, SF), searches._vector_queries(spark, SF), 10)
    assert vector_index.recall(searches.v3_index_search(spark, SF).select("query_id", "id"), exact) > 0.9
    ids = searches.v3_index_search(spark, SF).filter(F.col("id") == F.col("query_id"))
    assert ids.count() == searches._vector_queries(spark, SF).count()
