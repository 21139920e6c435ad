"""Joins over relations and entities, lineage and Personalized PageRank."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import graph as G
from recollect.operators import search as O
from recollect.operators.chains import current
from recollect.operators.intervals import holding
from recollect.plans.base import query
from recollect.plans.scans import n1_timeline
from recollect.plans.searches import _PARTS, _scored
from recollect.sources.scratch import written
from recollect.sources.tables import entity_links, memory_items, outcomes, prompts, relations, sessions, sql, table

_BOTH = "SELECT from_id AS id, to_id AS other, relation FROM relations WHERE from_id <> to_id UNION ALL SELECT to_id, from_id, relation FROM relations WHERE from_id <> to_id"
_W = S.lookup_sql("relation", S.RELATION_WEIGHT, 0.012)


@query(sql("""SELECT name, id, CAST(rank AS INTEGER) AS rank FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, id) AS rank FROM links JOIN items ON obs_id = id) WHERE rank <= 10""", "links"))
def j3_entity_context(spark, d):
    return G.context(entity_links(spark, d), memory_items(spark, d), 10)


@query(sql("SELECT id, other, relation FROM both_ways WHERE other IN (SELECT id FROM items)", "items", "relations", both_ways=_BOTH))
def j4_related(spark, d):
    return G.related(relations(spark, d), memory_items(spark, d))


@query(sql("""SELECT id, CAST(round(least(n * 0.01, 0.16), 6) AS DOUBLE) AS weight FROM (SELECT a.obs_id AS id, count(DISTINCT b.obs_id) AS n FROM links a JOIN links b ON a.name = b.name AND a.obs_id <> b.obs_id
    JOIN items m ON m.id = b.obs_id AND m.status = 'active' GROUP BY 1)""", "links"))  # fmt: skip
def j5_p3_comentions(spark, d):
    return G.comentions(entity_links(spark, d), memory_items(spark, d)).select("id", F.round("weight", 6).alias("weight"))


@query(sql("""SELECT project_id, domain, lower(trim(body)) AS body, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs, min(id) AS first_id FROM items GROUP BY 1, 2, 3 HAVING count(*) > 1""", "items"))
def j6_duplicate_pairs(spark, d):
    """How many pairs of equal records there are, counted and not built."""
    i = memory_items(spark, d).groupBy("project_id", "domain", F.lower(F.trim("body")).alias("body")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return i.filter("n > 1").select("project_id", "domain", "body", "n", F.expr("n * (n - 1) div 2").alias("pairs"), "first_id")


@query(sql("""SELECT id, first_id, n FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM items WINDOW w AS (PARTITION BY project_id, domain, lower(trim(body)))) WHERE n > 1""", "items"))
def j6_duplicate_members(spark, d):
    """Who belongs to which class of equal records: classes meet their members on a digest, and only the smaller side is one of classes."""
    i = memory_items(spark, d).select("id", "project_id", "domain", F.sha2(F.lower(F.trim("body")), 256).alias("digest"))
    classes = i.groupBy("project_id", "domain", "digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    named = classes.select(F.col("project_id").alias("p"), F.col("domain").alias("m"), F.col("digest").alias("g"), "first_id", "n")
    same = F.col("project_id").eqNullSafe(F.col("p")) & F.col("domain").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("g"))
    return i.join(named, same).select("id", "first_id", "n")


@query(sql("SELECT event_id, memory_id FROM outcomes WHERE memory_id * 11 NOT IN (SELECT id FROM items)", "items", "outcomes"))
def j8_orphans(spark, d):
    o = outcomes(spark, d).select("event_id", "memory_id", (F.col("memory_id") * 11).alias("id"))
    return o.join(memory_items(spark, d).select("id"), "id", "left_anti").select("event_id", "memory_id")


@query(sql("SELECT id, project FROM prompts WHERE project IN (SELECT project FROM sessions WHERE ended_at IS NULL) OR project = ''", "prompts", "sessions"))
def j9_enrolled(spark, d):
    p = prompts(spark, d).select("id", "project")
    open_ = sessions(spark, d).filter("ended_at IS NULL").select("project").distinct()
    return p.join(open_, "project", "left_semi").unionByName(p.filter("project = ''")).select("id", "project")


@query(sql("SELECT id, project FROM prompts WHERE project NOT IN (SELECT project FROM sessions WHERE ended_at IS NULL)", "prompts", "sessions"))
def j10_not_enrolled(spark, d):
    open_ = sessions(spark, d).filter("ended_at IS NULL").select("project").distinct()
    return prompts(spark, d).select("id", "project").join(open_, "project", "left_anti").select("id", "project")


@query(sql("SELECT id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM prompts p WHERE p.session_id = s.id AND p.id % 1000 > 2)", "prompts", "sessions"))
def j11_not_journalled(spark, d):
    p = prompts(spark, d).filter("id % 1000 > 2").select(F.col("session_id").alias("id"))
    return sessions(spark, d).select("id").join(p, "id", "left_anti")


@query(sql("""SELECT DISTINCT r.to_id AS id FROM relations r WHERE r.from_id IN (SELECT e.from_id FROM relations e JOIN items i ON i.id = e.to_id OR i.id = e.from_id WHERE lower(i.title) LIKE '%the%')""", "items", "relations"))
def j13_topic_lineage(spark, d):
    """Targets of relations whose source touches a record with the topic in its title: the OR becomes two joins."""
    hit = memory_items(spark, d).filter(F.lower("title").contains("the")).select("id")
    r = relations(spark, d)
    a = r.join(hit.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id")
    b = r.join(hit.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id")
    return r.join(a.union(b).distinct(), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


@query(sql("""SELECT name, count(*) AS n, min(i.id) AS first_id FROM links JOIN items i ON obs_id = id WHERE valid_from <= TIMESTAMP '2023-10-01 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2023-10-01 00:00:00') GROUP BY 1""", "links"))
def j14_temporal_state(spark, d):
    from recollect.operators.scans import at, valid_at

    then = memory_items(spark, d).filter(valid_at(at("2023-10-01 00:00:00"))).select("id")
    return entity_links(spark, d).join(then, F.col("obs_id") == F.col("id")).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_MONTHS = "SELECT DISTINCT date_trunc('month', updated_at)::TIMESTAMP AS moment FROM items"


@query(sql("""SELECT CAST(moment AS VARCHAR) AS moment, name, count(*) AS n, min(i.id) AS first_id FROM months JOIN items i ON (valid_from IS NULL OR valid_from <= moment) AND (valid_to IS NULL OR valid_to > moment)
    AND ingested_at <= moment JOIN links ON obs_id = i.id GROUP BY 1, 2""", "links", months=_MONTHS))  # fmt: skip
def j14_states_by_month(spark, d):
    """For each month's beginning what was known of each name: records that were valid and had been taken in by then."""
    i = memory_items(spark, d)
    months = i.select(F.date_trunc("month", "updated_at").alias("moment")).distinct()
    then = holding(i.select("id", "valid_from", "valid_to", "ingested_at"), months, "valid_from", "valid_to", "moment").filter("ingested_at <= moment")
    rows = then.select("moment", "id").join(entity_links(spark, d), F.col("obs_id") == F.col("id"))
    return rows.groupBy(F.col("moment").cast("string").alias("moment"), "name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(sql("SELECT DISTINCT from_id AS id, to_id AS by FROM relations JOIN items ON id = to_id WHERE relation = 'supersedes' AND status = 'active' AND from_id <> to_id", "items", "relations"))
def j15_successors(spark, d):
    return G.successors(relations(spark, d), memory_items(spark, d))


@query(sql("SELECT a.id, a.superseded_by AS by, b.title AS by_title FROM items a JOIN items b ON b.id = a.superseded_by AND b.status = 'active'", "items"))
def j16_replaced_by(spark, d):
    return G.replaced_by(memory_items(spark, d))


@query(sql("""SELECT id, last_value(id) OVER w AS current_id, count(*) OVER w - row_number() OVER (PARTITION BY project_id ORDER BY updated_at, id) AS depth, false AS cyclic FROM items
    WINDOW w AS (PARTITION BY project_id ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "items"))  # fmt: skip
def j15_current_records(spark, d):
    """Every record replaced by the next one of its project: the last of each project is the current one of all before it."""
    return current(n1_timeline(spark, d).select("id", F.when(F.col("next") >= 0, F.col("next")).alias("superseded_by")))


@query(sql("""SELECT i.id, coalesce(n.superseded_by, n.id, i.id) AS current_id, CASE WHEN n.superseded_by IS NOT NULL THEN 2 WHEN n.id IS NOT NULL THEN 1 ELSE 0 END AS depth FROM
    (SELECT id, superseded_by FROM items) i LEFT JOIN (SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM items c WHERE c.id = a.superseded_by) THEN a.superseded_by END AS superseded_by FROM items a) n ON n.id = i.superseded_by""", "items"))  # fmt: skip
def j16_current_of_superseded(spark, d):
    """The record that stands for each one now, however often it was superseded."""
    return current(memory_items(spark, d)).select("id", F.coalesce("current_id", F.lit(-1)).alias("current_id"), "depth")


@query(sql(f"""SELECT id, round(greatest(-0.06, least(sum(w) + count(*) * 0.008, 0.14)), 6) AS weight, count(*) AS degree FROM (SELECT from_id AS id, {_W} AS w FROM relations UNION ALL SELECT to_id, {_W} FROM relations) GROUP BY 1""", "relations"))
def a12_relation_weight(spark, d):
    return G.relation_weight(relations(spark, d)).select("id", F.round("weight", 6).alias("weight"), "degree")


@query(sql("""SELECT root, id, min(hop) AS hop FROM walk GROUP BY 1, 2""", "items", "relations", both_ways=_BOTH, start="SELECT item_id AS root FROM benchmark JOIN items ON id = item_id",
    walk="SELECT root, root AS id, 0 AS hop FROM start UNION SELECT root, other, hop + 1 FROM walk JOIN both_ways USING (id) WHERE hop < 3"))
def v14_lineage(spark, d):
    """Three hops from the records of the benchmark's ids."""
    start = memory_items(spark, d).select("id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    return G.lineage(relations(spark, d), start, 3)


def _ppr_sql(steps: int) -> dict[str, str]:
    parts = {
        "nodes": "SELECT query_id, id, score, CASE WHEN rank <= 3 THEN 1.0 WHEN rank <= 8 THEN 0.5 ELSE 0.1 END AS seed FROM ranked WHERE rank <= 40",
        "edges": f"""SELECT a.query_id, b.id AS src, b.other AS dst, sum({_W.replace("CASE relation", "CASE b.relation")}) AS w FROM both_ways b JOIN nodes a ON a.id = b.id JOIN nodes c ON c.id = b.other AND c.query_id = a.query_id GROUP BY ALL""",
        "base": "SELECT n.query_id, n.id, seed / sum(seed) OVER (PARTITION BY n.query_id) AS p, count(*) OVER (PARTITION BY n.query_id) AS n, o.outw FROM nodes n LEFT JOIN (SELECT query_id, src, sum(w) AS outw FROM edges GROUP BY ALL) o ON o.query_id = n.query_id AND o.src = n.id",
        "s0": "SELECT query_id, id, p AS s FROM base",
    }
    for k in range(steps):
        parts[f"s{k + 1}"] = f"""SELECT b.query_id, b.id, 0.85 * (coalesce(g.got, 0) + coalesce(l.loose, 0) / b.n) + 0.15 * b.p AS s FROM base b
            LEFT JOIN (SELECT e.query_id, e.dst AS id, sum(s * w / outw) AS got FROM s{k} JOIN base USING (query_id, id) JOIN edges e ON e.query_id = s{k}.query_id AND e.src = s{k}.id GROUP BY ALL) g ON g.query_id = b.query_id AND g.id = b.id
            LEFT JOIN (SELECT query_id, sum(s) AS loose FROM s{k} JOIN base USING (query_id, id) WHERE outw IS NULL GROUP BY 1) l ON l.query_id = b.query_id"""
    return parts


def _pagerank(spark, d):
    best = written(O.top(_scored(spark, d), 40).select("query_id", "id", "score", "rank"))
    edges = G.adjacency(relations(spark, d), best)
    seed = F.when(F.col("rank") <= 3, 1.0).when(F.col("rank") <= 8, 0.5).otherwise(0.1)
    return best, G.personalized_pagerank(best, edges, seed)


@query(sql("SELECT query_id, id, round(s, 6) AS ppr FROM s5", "items", "outcomes", "relations", **_PARTS, both_ways=_BOTH, **_ppr_sql(5)))
def v11_v13_pagerank(spark, d):
    """Five steps over the forty best of each query, all queries in one plan."""
    return _pagerank(spark, d)[1].select("query_id", "id", F.round("ppr", 6).alias("ppr"))


@query(sql("""SELECT query_id, id, round(0.85 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END + 0.15 * s / max(s) OVER w, 5) AS blended
    FROM s5 JOIN nodes USING (query_id, id) WINDOW w AS (PARTITION BY query_id)""", "items", "outcomes", "relations", **_PARTS, both_ways=_BOTH, **_ppr_sql(5)))  # fmt: skip
def v15_blend(spark, d):
    best, ppr = _pagerank(spark, d)
    return G.blend(best.join(ppr, ["query_id", "id"])).select("query_id", "id", F.round("blended", 5).alias("blended"))
