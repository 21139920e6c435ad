"""Likeness, conflicts and names."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.operators import evaluate as E
from recollect.operators import search as O
from recollect.operators import similarity as C
from recollect.plans.base import query
from recollect.plans.searches import _FIELDS, _PARTS, _scored
from recollect.sources.tables import memory_items, relations, sessions, sql, table

_STOP = ", ".join(f"'{w}'" for w in S.TITLE_STOPWORDS)
_WORDS = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[ \-_/():,]+'), x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP}))))"
_TERMS = rf"list_distinct(list_filter({_FIELDS}, x -> octet_length(encode(x)) >= 2))"
_CLASSES = f"SELECT project_id, kind, words, min(id) AS id, count(*) AS n FROM (SELECT project_id, kind, id, {_WORDS} AS words FROM @) WHERE len(words) > 0 GROUP BY ALL"
_PAIRS = """SELECT a.project_id, a.kind, a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::DOUBLE AS overlap
    FROM classes a JOIN classes b ON a.project_id = b.project_id AND a.kind = b.kind AND a.id < b.id"""


@query(sql(f"SELECT id, array_to_string({_WORDS}, ' ') AS words FROM items", "items"))
def c1_significant_words(spark, d):
    return memory_items(spark, d).select("id", F.array_join(F.array_sort(F.array_distinct(X.significant_words("title"))), " ").alias("words"))


@query(sql("SELECT project_id, kind, a, b, round(overlap, 6) AS overlap FROM pairs WHERE overlap > 0.6", "items", classes=_CLASSES.replace("@", "items"), pairs=_PAIRS))
def c2_similar_titles(spark, d):
    """Pairs between classes of equal words; who is in a class, j19_title_links says."""
    return C.similar_titles(memory_items(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query(sql(f"""SELECT w.id, c.id AS class_id, CAST(c.n - 1 + coalesce(m.met, 0) AS BIGINT) AS links FROM (SELECT project_id, kind, id, {_WORDS} AS words FROM items) w JOIN classes c USING (project_id, kind, words)
    LEFT JOIN (SELECT p.id, sum(n) AS met FROM (SELECT a AS id, b AS o FROM pairs WHERE overlap > 0.6 UNION ALL SELECT b, a FROM pairs WHERE overlap > 0.6) p JOIN classes ON classes.id = o GROUP BY 1) m ON m.id = c.id""",
    "items", classes=_CLASSES.replace("@", "items"), pairs=_PAIRS))
def j19_title_links(spark, d):
    return C.title_links(memory_items(spark, d))


_CHOSEN = "SELECT * FROM items WHERE status = 'active' AND kind IN ('decision', 'pattern', 'config')"
_BY_TITLE = f"""SELECT id, rival, round(overlap, 6) AS overlap FROM (SELECT a.id, b.id AS rival, len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::DOUBLE AS overlap
    FROM (SELECT project_id, kind, id, {_WORDS} AS words FROM chosen) a JOIN (SELECT project_id, kind, id, {_WORDS} AS words FROM chosen) b ON a.project_id = b.project_id AND a.kind = b.kind AND a.id <> b.id AND len(a.words) > 0 AND len(b.words) > 0)
    WHERE overlap > 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(overlap, 6) DESC, rival) = 1"""
_ACTION = "CASE WHEN overlap IS NULL THEN 'add' WHEN overlap >= 1.0 THEN 'suppress' WHEN overlap >= 0.85 THEN 'merge' WHEN overlap >= 0.7 THEN 'invalidate' ELSE 'relate' END"


@query(sql("SELECT * FROM by_title", "items", chosen=_CHOSEN, by_title=_BY_TITLE))
def c3_title_conflicts(spark, d):
    """The strongest rival of each record by its title, records of equal words included."""
    return C.conflicts(memory_items(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query(sql(f"SELECT id, coalesce(rival, -1) AS rival, {_ACTION} AS action, CASE WHEN {_ACTION} IN ('merge', 'suppress') THEN 'archived' ELSE status END AS status FROM chosen LEFT JOIN by_title USING (id)", "items", chosen=_CHOSEN, by_title=_BY_TITLE))
def c4_resolutions(spark, d):
    """What becomes of each record that may conflict: added, suppressed as a copy, merged, its rival invalidated, or related."""
    i = memory_items(spark, d).filter((F.col("status") == "active") & F.col("kind").isin(S.CONFLICT_KINDS)).select("id", "status")
    rows = i.join(C.conflicts(memory_items(spark, d)), "id", "left").withColumn("action", C.resolution(F.round("overlap", 6)))
    return rows.select("id", F.coalesce("rival", F.lit(-1)).alias("rival"), "action", F.when(F.col("action").isin("merge", "suppress"), "archived").otherwise(F.col("status")).alias("status"))


_BY_BODY = rf"""SELECT id, rival, overlap FROM (SELECT a.id, b.id AS rival, round(coalesce(c / (sqrt(len(b.t)) * sqrt(c + (len(a.t) - c) * power(1 + ln(2), 2))), 0), 6) AS overlap FROM
      (SELECT project_id, kind, id, t FROM fresh) a JOIN (SELECT * FROM fresh WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY updated_at DESC, id) <= 50) b
      ON a.project_id = b.project_id AND a.kind = b.kind AND a.id <> b.id, LATERAL (SELECT len(list_intersect(a.t, b.t))::DOUBLE AS c))
    WHERE overlap > 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, rival) = 1"""
_FRESH = rf"SELECT *, {_TERMS.replace('@', 'title || chr(32) || body')} AS t FROM items WHERE kind IN ('decision', 'pattern', 'config')"


@query(sql("""SELECT id, CASE WHEN b THEN br ELSE tr END AS rival, CASE WHEN b THEN 'body_similar' ELSE 'title_overlap' END AS type, CASE WHEN b THEN bo ELSE t END AS overlap FROM
    (SELECT *, coalesce((t IS NULL OR (t < 0.85 AND bo > t + 0.1)) AND bo IS NOT NULL, false) AS b FROM (SELECT id, rival AS tr, overlap AS t FROM by_title) FULL JOIN (SELECT id, rival AS br, overlap AS bo FROM by_body) USING (id))""",
    "items", chosen=_CHOSEN, by_title=_BY_TITLE, fresh=_FRESH, by_body=_BY_BODY))
def c3_conflicts(spark, d):
    """Each record as if it were about to be saved: its conflict by title or, if that says more, by body."""
    i = memory_items(spark, d)
    return C.best_conflict(C.conflicts(i).withColumn("overlap", F.round("overlap", 6)), C.body_conflicts(i, i))


@query(sql("SELECT id AS from_id, rival AS to_id, 'contradicts' AS relation FROM by_title EXCEPT SELECT from_id, to_id, relation FROM relations", "items", "relations", chosen=_CHOSEN, by_title=_BY_TITLE))
def c5_contradictions(spark, d):
    return C.contradictions(C.conflicts(memory_items(spark, d)), relations(spark, d))


_NAMES = """SELECT DISTINCT name FROM (SELECT source AS name FROM documents UNION SELECT upper(source) FROM documents UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer
    UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT p_name FROM part) WHERE name IS NOT NULL"""


def _names(spark, d):
    t = lambda name, *cols: [table(spark, d, name).select(F.expr(c).alias("name")) for c in cols]
    parts = t("documents", "source", "upper(source)") + t("nation", "n_name") + t("region", "r_name") + t("customer", "c_mktsegment") + t("part", "p_brand", "p_type", "p_name")
    return functools.reduce(lambda a, b: a.union(b), parts).filter("name IS NOT NULL").distinct()


@query(f"""WITH names AS (SELECT name, lower(trim(name)) AS low FROM ({_NAMES}))
    SELECT name, other, match, CAST(CASE WHEN match = 'levenshtein' THEN levenshtein(low, olow) ELSE 0 END AS INTEGER) AS distance FROM
    (SELECT a.name, b.name AS other, a.low, b.low AS olow, CASE WHEN a.low = b.low THEN 'case' WHEN length(a.low) >= 3 AND (contains(b.low, a.low) OR contains(a.low, b.low)) THEN 'substring'
       WHEN levenshtein(a.low, b.low) <= least(3, greatest(length(a.low) // 2, 1)) THEN 'levenshtein' END AS match FROM names a JOIN names b ON a.name <> b.name) WHERE match IS NOT NULL""")  # fmt: skip
def c6_c7_similar_names(spark, d):
    """The distinct names of projects, places, segments and wares."""
    return C.similar_names(_names(spark, d))


@query()
def j20_project_groups(spark, d):
    return C.project_groups(_names(spark, d))


@query(sql("""SELECT id, regexp_replace(regexp_replace(lower(trim(replace(title, ' ', '--'), ' ')), '-{2,}', '-', 'g'), '_{2,}', '_', 'g') AS name FROM items""", "items"))
def c8_normal_names(spark, d):
    return memory_items(spark, d).select("id", X.normal_name(F.replace("title", F.lit(" "), F.lit("--"))).alias("name"))


@query(sql("""SELECT id, coalesce(new, project_id) AS project_id FROM items LEFT JOIN (SELECT DISTINCT project AS old, 'merged-' || (CAST(substr(project, 4) AS INTEGER) % 3) AS new FROM sessions WHERE CAST(substr(project, 4) AS INTEGER) % 2 = 0) ON old = project_id""", "items", "sessions"))
def c9_rename_projects(spark, d):
    n = F.substring("project", 4, 9).cast("int")
    names = sessions(spark, d).filter(n % 2 == 0).select(F.col("project").alias("project_id"), F.concat(F.lit("merged-"), n % 3).alias("new")).distinct()
    return memory_items(spark, d).join(names, "project_id", "left").select("id", F.coalesce("new", "project_id").alias("project_id"))


_JUDGED = r"""SELECT r.query_id AS item_id, r.id AS doc_id, r.rank, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\p{L}\p{N}]+'), x -> x <> '')) AS w, i.body AS text
    FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN items i ON i.id = r.id WHERE rank <= 10"""


def _retrieved(spark, d):
    best = O.top(_scored(spark, d), 10).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))
    b = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.tokens("text")).alias("w"))
    return best.join(b, "item_id").join(memory_items(spark, d).select(F.col("id").alias("doc_id"), F.col("body").alias("text")), "doc_id")


@query(sql("SELECT item_id, doc_id, round(len(list_filter(w, t -> contains(lower(text), t))) / len(w)::DOUBLE, 6) AS share FROM judged", "items", "outcomes", **_PARTS, judged=_JUDGED))
def c10_containment(spark, d):
    """How much of an expected answer each body contains that a search for it retrieves."""
    return _retrieved(spark, d).select("item_id", "doc_id", F.round(C.containment(F.col("w"), F.col("text")), 6).alias("share"))


@query(sql(r"""SELECT item_id, max(round(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v)))::DOUBLE, 6)) AS best FROM
    (SELECT item_id, w, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), x -> x <> '')) AS v FROM judged) GROUP BY 1""", "items", "outcomes", **_PARTS, judged=_JUDGED))  # fmt: skip
def c11_overlap_judge(spark, d):
    rows = _retrieved(spark, d).withColumn("v", F.array_distinct(X.tokens("text")))
    return rows.groupBy("item_id").agg(F.max(F.round(X.jaccard(F.col("w"), F.col("v")), 6)).alias("best"))


@query(sql(r"""SELECT item_id, doc_id, round(len(list_filter(w, t -> contains(lower(text), t))) / len(w)::DOUBLE, 6) AS judged FROM judged""", "items", "outcomes", **_PARTS, judged=_JUDGED))
def u2_judge(spark, d):
    """The containment judge again, as a Python function given from outside."""

    def judge(query: str, retrieved: str, expected: list[str]) -> float:
        low = retrieved.lower()
        return round(sum(t in low for t in expected) / len(expected), 6) if len(expected) else 0.0

    rows = _retrieved(spark, d).withColumn("query", F.col("item_id").cast("string"))
    return E.judged(rows, judge, "query", "text", "w").select("item_id", "doc_id", "judged")
