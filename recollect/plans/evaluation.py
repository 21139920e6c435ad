"""Retrieval quality: hits, recall, reciprocal rank, gain, and gates. A benchmark item's documents are those of its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import evaluate as B
from recollect.operators import graph as G
from recollect.operators import packing as P
from recollect.operators import search as O
from recollect.operators import vector as V
from recollect.plans.base import query
from recollect.plans.packs import _NEEDS, _SQL, _USED, _placed, _rows
from recollect.plans.searches import _FIELDS, _FUSE, _PARTS, _STOP, _VEC, _lexical, _scored, _vector_queries, _vectors
from recollect.sources.scratch import written
from recollect.sources.tables import memory_items, relations, sql, table

_REL = "SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, split_part(benchmark.text, '.', 1))"
_HITS = "SELECT query_id, r.rank, r.id FROM (SELECT * FROM ranked WHERE rank <= 10) r JOIN relevant USING (query_id, id)"
_PER = """SELECT q.query_id, min(rank) AS first, count(h.rank) FILTER (rank <= 5) AS found5, coalesce(sum(1 / log2(1 + rank)) FILTER (rank <= 5), 0) AS dcg, any_value(n) AS n
    FROM (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1) q LEFT JOIN hits h USING (query_id) GROUP BY 1"""
_EVAL = _PARTS | {"relevant": _REL, "hits": _HITS, "per": _PER}


def _relevant(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("lead"))
    return B.containing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), b)


def _cases(spark, d):
    best = O.top(_scored(spark, d), 10).select("query_id", "id", "rank")
    return B.per_query(best, _relevant(spark, d), 5)


@query(sql("""SELECT query_id, coalesce(CAST(first AS INTEGER), 0) AS first_rank, found5 AS found, n AS relevant, round(coalesce(1.0 / first, 0), 6) AS rr,
    round(dcg / (SELECT sum(1 / log2(1 + k)) FROM range(1, 6) t(k) WHERE k <= n), 6) AS ndcg FROM per""", "items", "outcomes", **_EVAL))  # fmt: skip
def b1_b3_per_query(spark, d):
    return _cases(spark, d)


@query(sql("""SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
    round(avg(round(coalesce(1.0 / first, 0), 6)), 6) AS mrr FROM per""", "items", "outcomes", **_EVAL))  # fmt: skip
def b2_summary(spark, d):
    return B.summary(_cases(spark, d)).select("queries", "recall_1", "recall_3", "recall_5", "mrr")


@query(sql("""SELECT query_id % 4 AS category, count(*) AS queries, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3 FROM per GROUP BY 1""", "items", "outcomes", **_EVAL))
def b5_by_category(spark, d):
    rows = _cases(spark, d).withColumn("category", F.col("query_id") % 4)
    return B.summary(rows, "category").select("category", "queries", "recall_3")


@query(sql("""SELECT gate, value, value >= floor AS passed FROM (SELECT 'recall_3' AS gate, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS value, 0.8 AS floor FROM per
    UNION ALL SELECT 'mrr', round(avg(round(coalesce(1.0 / first, 0), 6)), 6), 0.7 FROM per)""", "items", "outcomes", **_EVAL))  # fmt: skip
def b9_gates(spark, d):
    return B.gates(B.summary(_cases(spark, d)), {"recall_3": 0.8, "mrr": 0.7})


@query(sql("""SELECT query_id, CAST(row_number() OVER (ORDER BY severity DESC, query_id) AS INTEGER) AS place, severity FROM
    (SELECT query_id, round((n - found5) / n::DOUBLE + CASE WHEN first IS NULL THEN 1 ELSE (first - 1) / 10.0 END, 6) AS severity FROM per) WHERE severity > 0 QUALIFY place <= 20""", "items", "outcomes", **_EVAL))  # fmt: skip
def l4_worst_cases(spark, d):
    return B.worst(_cases(spark, d), 20)


@query(sql("""SELECT guard, round(hits / (5.0 * (SELECT count(DISTINCT query_id) FROM found)), 6) AS share FROM (SELECT
      count(*) FILTER (expires_at <= TIMESTAMP '2024-01-31 00:00:00') AS stale, count(*) FILTER (status = 'archived' OR coalesce(superseded_by, 0) <> 0) AS superseded, count(*) FILTER (project_id <> own) AS wrong_project FROM found)
    UNPIVOT (hits FOR guard IN (stale, superseded, wrong_project))""", "items", **{**_VEC, "found": """SELECT n.query_id, i.status, i.superseded_by, i.expires_at, i.project_id, o.project_id AS own
      FROM (SELECT * FROM near WHERE rank <= 5) n JOIN items i ON i.id = n.id JOIN items o ON o.id = n.query_id"""}))  # fmt: skip
def b6_guards(spark, d):
    """What share of the five places of each vector query goes to records that are stale, superseded or of another project."""
    near = V.nearest(_vectors(spark, d), _vector_queries(spark, d), 5).select("query_id", "id", "rank")
    i = memory_items(spark, d).select("id", "project_id", "status", "superseded_by", "expires_at")
    own = i.select(F.col("id").alias("query_id"), F.col("project_id").alias("project"))
    return B.guards(near.join(i, "id").join(own, "query_id"), 5)


@query(sql("""SELECT 'abstention' AS score, count(*) AS cases, round(coalesce(avg(CASE WHEN best >= 0.9 THEN 0.0 ELSE 1.0 END), 1), 6) AS value FROM
      (SELECT b.item_id, max(score) AS best FROM benchmark b LEFT JOIN ranked ON query_id = item_id WHERE item_id NOT IN (SELECT query_id FROM relevant) GROUP BY 1)
    UNION ALL SELECT 'required', count(*), round(sum(least(found5, n))::DOUBLE / sum(n), 6) FROM per""", "items", "outcomes", **_EVAL))  # fmt: skip
def b7_scores(spark, d):
    """Queries without a relevant document whose best result is rightly weak, and hits among those required of the others."""
    scored, relevant = _scored(spark, d), _relevant(spark, d)
    best = written(O.top(scored, 10), "best")
    none = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(relevant.select("query_id").distinct(), "query_id", "left_anti")
    return B.abstention(none, best, 0.9).unionByName(B.required(B.per_query(best.select("query_id", "id", "rank"), relevant, 5)))


@query(sql("""SELECT 'file' AS score, count(*) AS cases, round(sum(least(h, least(n, 3)))::DOUBLE / sum(least(n, 3)), 6) AS value FROM (SELECT e.path, count(DISTINCT e.id) AS n, count(DISTINCT f.id) AS h FROM own e LEFT JOIN best f ON f.path = e.path AND f.id = e.id GROUP BY 1)
    UNION ALL SELECT 'graph', count(*), round(sum(least(h, least(n, 2)))::DOUBLE / sum(least(n, 2)), 6) FROM (SELECT e.id, count(DISTINCT e.other) AS n, count(DISTINCT f.other) AS h FROM edges e LEFT JOIN near f ON f.id = e.id AND f.other = e.other GROUP BY 1)""",
    "items", "relations", own="SELECT DISTINCT json_extract_string(applies_to_json, '$.files[0]') AS path, id FROM items WHERE kind IN ('decision', 'bugfix')",
    best="SELECT path, id FROM (SELECT json_extract_string(applies_to_json, '$.files[0]') AS path, id, row_number() OVER (PARTITION BY json_extract_string(applies_to_json, '$.files[0]') ORDER BY updated_at DESC, id) AS k FROM items) WHERE k <= 10",
    edges="SELECT DISTINCT from_id AS id, to_id AS other FROM relations WHERE relation = 'supersedes' AND from_id <> to_id AND to_id IN (SELECT id FROM items)",
    near="""SELECT id, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS k FROM (SELECT DISTINCT from_id AS id, to_id AS other FROM relations WHERE from_id <> to_id AND to_id IN (SELECT id FROM items)
      UNION SELECT to_id, from_id FROM relations WHERE from_id <> to_id AND from_id IN (SELECT id FROM items))) WHERE k <= 5"""))  # fmt: skip
def b7_file_and_graph(spark, d):
    """How much of what a file's history and a record's neighbourhood should show is among the ten and five that they show."""
    i = memory_items(spark, d).select("id", "kind", "updated_at", F.get_json_object("applies_to_json", "$.files[0]").alias("case"))
    shown = O.top(i, 10, F.desc("updated_at"), F.asc("id"), by="case")
    files = B.neighbours_found(shown, i.filter(F.col("kind").isin("decision", "bugfix")).select("case", "id").distinct(), 3)
    r = relations(spark, d)
    near = G.related(r, memory_items(spark, d)).select(F.col("id").alias("case"), F.col("other").alias("id")).distinct()
    wanted = r.filter("relation = 'supersedes' AND from_id <> to_id").select(F.col("from_id").alias("case"), F.col("to_id").alias("id")).distinct().join(memory_items(spark, d).select("id"), "id", "left_semi").select("case", "id")
    graph = B.neighbours_found(O.top(near, 5, F.asc("id"), by="case"), wanted, 2)
    return files.withColumn("score", F.lit("file")).unionByName(graph.withColumn("score", F.lit("graph")))


@query(sql("SELECT 'pack' AS score, count(*) AS cases, round(avg(CASE WHEN used <= 400 THEN 1.0 ELSE 0 END), 6) AS value FROM (SELECT request_id, sum(used) AS used FROM walk WHERE place > 0 GROUP BY 1)",
    *_NEEDS, **_SQL, walk=_USED))
def b7_pack_budget(spark, d):
    """The share of packs that keep to their budget."""
    packs = P.greedy(_placed(_rows(spark, d)), 400).select(F.col("request_id").alias("pack"), F.col("used").alias("tokens"))
    return B.within_budget(packs, 400)


_Q = rf"list_distinct(list_filter({_FIELDS}, x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP})))"


@query(sql("""SELECT count(*) AS cases, round(avg(best), 6) AS average_overlap, round(max(best), 6) AS most_overlap, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) AS weak_distractors,
    round(avg(CASE WHEN best >= 0.7 THEN 1.0 ELSE 0 END), 6) AS high_overlap FROM audit""", "items", relevant=_REL,
    audit=f"""SELECT query_id, count(*) AS n, max(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t)))::DOUBLE END) AS best FROM
      (SELECT r.query_id, {_Q.replace('@', 'b.text')} AS q, {_Q.replace('@', 'i.title')} AS t FROM relevant r JOIN benchmark b ON b.item_id = r.query_id JOIN items i ON i.id = r.id) GROUP BY 1"""))  # fmt: skip
def b8_fixture_audit(spark, d):
    """How far queries give their answers away: the overlap of their terms with the titles of what they should find."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.plain_terms("text").alias("q"))
    titles = memory_items(spark, d).select("id", X.plain_terms("title").alias("t"))
    return B.audit(_relevant(spark, d).join(asked, "query_id").join(titles, "id"))


_MODES = {k: v for k, v in _EVAL.items() if k not in ("hits", "per")} | {k: v for k, v in _FUSE.items() if k not in _PARTS} | {
    "lanes3": "SELECT 'lexical' AS mode, query_id, id, rank FROM ranked WHERE rank <= 5 UNION ALL SELECT 'vector', query_id, id, rank FROM vnear WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, rank FROM best WHERE rank <= 5"
}


@query(sql("""SELECT mode, count(*) AS queries, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM
    (SELECT m.mode, q.query_id, min(l.rank) AS first FROM (SELECT DISTINCT query_id FROM relevant) q CROSS JOIN (SELECT unnest(['lexical', 'vector', 'hybrid']) AS mode) m
      LEFT JOIN (SELECT l.* FROM lanes3 l JOIN relevant USING (query_id, id)) l ON l.query_id = q.query_id AND l.mode = m.mode GROUP BY 1, 2) GROUP BY 1""", "items", "outcomes", **_MODES))  # fmt: skip
def b10_mode_sweep(spark, d):
    """Every way of retrieval on the same queries."""
    relevant = _relevant(spark, d)
    asked = table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "embedding")
    lexical, near = written(_lexical(spark, d), "lexical"), written(V.nearest(_vectors(spark, d), asked, 20), "near")  # hybrid search begins with these
    modes = {"lexical": lexical.filter("rank <= 5"), "vector": near.filter("rank <= 5"), "hybrid": V.fuse(lexical, near.select("query_id", "id", "rank"), memory_items(spark, d), 5)}
    return B.sweep({k: v.select("query_id", "id", "rank") for k, v in modes.items()}, relevant)


@query(sql("SELECT count(*) AS queries, round(avg(coalesce(h, 0) / 3.0), 6) AS precision_3 FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS h FROM hits WHERE rank <= 3 GROUP BY 1) ON query_id = item_id", "items", "outcomes", **_EVAL))
def b11_precision(spark, d):
    best = O.top(_scored(spark, d), 3).select("query_id", "id", "rank")
    return B.precision(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), best, _relevant(spark, d), 3)
