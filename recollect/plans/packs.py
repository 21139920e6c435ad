"""Context packs. Requests are the conversations of the table: each asks for its project, session and language."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.operators import graph as G
from recollect.operators import packing as P
from recollect.plans.base import query
from recollect.sources.scratch import written
from recollect.sources.tables import entity_links, memory_items, relations, sql, table

_LIVE = "SELECT * FROM items WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00')"
_W = S.lookup_sql("relation", S.RELATION_WEIGHT, 0.012)
_AGE = "date_diff('second', {}, TIMESTAMP '2024-01-31 00:00:00') / 86400.0"
#: The parts of a candidate's score as SQL, under the names that P.score gives them.
_COMPONENTS = {
    "project_relevance": "CASE WHEN project_id = project THEN 0.26 WHEN scope = 'global' THEN 0.14 ELSE -0.10 END",
    "session_relevance": "CASE WHEN session_id = session THEN 0.36 ELSE 0 END",
    "domain_relevance": "CASE WHEN domain = domain_wanted THEN 0.16 WHEN domain <> '' THEN -0.06 ELSE 0 END",
    "kind_priority": S.lookup_sql("kind", S.PACK_KIND, 0.05),
    "classification_weight": f"CASE WHEN session_id = session AND classification = 'observational' THEN 0 ELSE {S.lookup_sql('classification', S.PACK_CLASS, 0.0)} END",
    "utility_weight_part": "greatest(-0.06, least(utility_weight * 0.04, 0.16))",
    "structural_weight": "greatest(0.0, least(coalesce(entity_weight, 0), 0.16))",
    "relation_weight_part": "greatest(-0.06, least(coalesce(relation_weight, 0), 0.14))",
    "temporal_overlap_boost": "CASE WHEN moment IS NULL OR (valid_from IS NULL AND valid_to IS NULL) THEN 0 WHEN valid_from <= moment AND (valid_to IS NULL OR valid_to > moment) THEN 0.07 ELSE -0.03 END",
    "usage_weight": f"greatest(-0.04, least(ln(1 + access_count) * 0.015 + CASE WHEN {_AGE.format('last_accessed')} <= 14 THEN 0.03 WHEN {_AGE.format('last_accessed')} > 120 THEN -0.01 ELSE 0 END, 0.10))",
    "recency_boost": f"CASE WHEN {_AGE.format('updated_at')} <= 7 THEN 0.08 WHEN {_AGE.format('updated_at')} <= 30 THEN 0.05 WHEN {_AGE.format('updated_at')} <= 90 THEN 0.02 ELSE 0 END",
    "stale_penalty": f"CASE WHEN {_AGE.format('updated_at')} > 365 THEN -0.08 WHEN {_AGE.format('updated_at')} > 180 THEN -0.04 ELSE 0 END",
    "expiry_penalty": "CASE WHEN expires_at <= TIMESTAMP '2024-01-31 00:00:00' THEN -0.40 ELSE 0 END",
    "superseded_penalty": "CASE WHEN status IN ('superseded', 'archived') THEN -0.30 WHEN coalesce(superseded_by, 0) <> 0 THEN -0.24 ELSE 0 END",
    "low_trust_penalty": "CASE WHEN trust_level = 'untrusted' THEN -0.05 ELSE 0 END",
}
_JOINED = "cands c JOIN items i ON i.id = c.id JOIN requests USING (request_id) LEFT JOIN ent ON ent.id = i.id LEFT JOIN rel ON rel.id = i.id"
_SQL = {
    "live": _LIVE,
    "requests": "SELECT DISTINCT conv_id AS request_id, 'src' || (conv_id % 20) AS project, 's' || (conv_id % 50) AS session, ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] AS domain_wanted, CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2023-11-01 00:00:00' END AS moment FROM conversations",
    "lane_g": "SELECT id FROM live WHERE scope = 'global' ORDER BY updated_at DESC, id LIMIT 80",
    "lane_p": "SELECT project_id, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS k FROM live WHERE scope = 'project') WHERE k <= 140",
    "lane_s": "SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, id) AS k FROM live) WHERE k <= 60",
    "cands": "SELECT request_id, id FROM requests, lane_g UNION SELECT request_id, id FROM requests JOIN lane_p ON project = project_id UNION SELECT request_id, id FROM requests JOIN lane_s ON session = session_id",
    "ent": "SELECT a.obs_id AS id, least(count(DISTINCT b.obs_id) * 0.01, 0.16) AS entity_weight FROM links a JOIN links b ON a.name = b.name AND a.obs_id <> b.obs_id JOIN items m ON m.id = b.obs_id AND m.status = 'active' GROUP BY 1",
    "rel": f"SELECT id, greatest(-0.06, least(sum(w) + count(*) * 0.008, 0.14)) AS relation_weight FROM (SELECT from_id AS id, {_W} AS w FROM relations UNION ALL SELECT to_id, {_W} FROM relations) GROUP BY 1",
    "scored": f"SELECT request_id, i.id, body, classification, updated_at, round({' + '.join(_COMPONENTS.values())}, 6) AS score FROM {_JOINED}",
    "placed": r"""SELECT request_id, id, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, id) AS INTEGER) AS place,
        CAST(greatest(floor(len(list_filter(regexp_split_to_array(body, '\s+'), x -> x <> '')) * 1.35 + 0.5), 1) AS INTEGER) AS tokens FROM scored WHERE place_ok""".replace(" WHERE place_ok", ""),
}
_NEEDS = ("links", "relations")


def _requests(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.selectExpr(
        "conv_id AS request_id", "concat('src', conv_id % 20) AS project", "concat('s', conv_id % 50) AS session", "element_at(array('en', 'de', 'fr', 'es'), int(conv_id % 4) + 1) AS domain_wanted",
        "CASE WHEN conv_id % 3 = 0 THEN timestamp'2023-11-01 00:00:00' END AS asof",
    )


def _rows(spark, d):
    """Candidates with what their score needs. Texts are counted and weights taken once for each record that is a candidate at all, and no text
    goes on to the requests."""
    items, requests = memory_items(spark, d), _requests(spark, d)
    found = written(P.candidates(items, requests), "candidates")
    some = written(found.select("id").distinct(), "records")
    chosen = items.join(some, "id", "left_semi").withColumn("tokens", X.token_estimate("body")).drop("title", "body")
    weights = chosen.join(G.comentions(entity_links(spark, d), items, of=some).select("id", F.col("weight").alias("entity_weight")), "id", "left")
    weights = weights.join(G.relation_weight(relations(spark, d), of=some).select("id", F.col("weight").alias("relation_weight")), "id", "left")
    return found.join(written(weights, "weights"), "id").join(requests, "request_id")


def _placed(rows):
    scored = rows.select("request_id", "id", "updated_at", "tokens", F.round(P.total(P.score()), 6).alias("score"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    return scored.withColumn("place", F.row_number().over(w)).select("request_id", "id", "score", "place", "tokens")


@query(sql("SELECT request_id, id FROM cands", "items", **{k: _SQL[k] for k in ("live", "requests", "lane_g", "lane_p", "lane_s", "cands")}))
def p1_d2_candidates(spark, d):
    return P.candidates(memory_items(spark, d), _requests(spark, d))


@query(sql("""SELECT request_id, i.id FROM cands c JOIN items i ON i.id = c.id JOIN requests USING (request_id) WHERE i.domain = domain_wanted AND (moment IS NULL OR ((valid_from IS NULL OR valid_from <= moment) AND (valid_to IS NULL OR valid_to > moment)))""",
    "items", **{k: _SQL[k] for k in ("live", "requests", "lane_g", "lane_p", "lane_s", "cands")}))
def f10_pack_filter(spark, d):
    """Candidates of the wanted domain alone that held at the request's moment, if it names one."""
    requests = _requests(spark, d)
    rows = P.candidates(memory_items(spark, d), requests).join(memory_items(spark, d).select("id", "domain", "valid_from", "valid_to"), "id").join(requests, "request_id")
    return P.fitting(rows).select("request_id", "id")


@query(sql("SELECT * FROM placed", *_NEEDS, **_SQL))
def p2_pack_scores(spark, d):
    return _placed(_rows(spark, d))


_USED = """SELECT request_id, CAST(NULL AS BIGINT) AS id, 0 AS place, 380 AS remaining, 0 AS used, '' AS verdict FROM requests UNION ALL
        SELECT p.request_id, p.id, p.place, w.remaining - u, u, v FROM walk w JOIN placed p ON p.request_id = w.request_id AND p.place = w.place + 1,
        LATERAL (SELECT CASE WHEN p.tokens <= w.remaining THEN p.tokens WHEN p.tokens <= w.remaining + 200 AND w.remaining > 60 THEN w.remaining - 50 ELSE 0 END AS u,
                        CASE WHEN p.tokens <= w.remaining THEN 'included' WHEN p.tokens <= w.remaining + 200 AND w.remaining > 60 THEN 'truncated' ELSE 'excluded' END AS v)"""


@query(sql("""SELECT request_id, id, place, CAST(used AS INTEGER) AS used, verdict FROM walk WHERE place > 0""", *_NEEDS, **_SQL,
    walk=_USED))
def p4_n5_greedy_pack(spark, d):
    return P.greedy(_placed(_rows(spark, d)), 400)


_WALK = """SELECT request_id, CAST(NULL AS BIGINT) AS id, 0 AS place, 380 AS remaining, '' AS verdict FROM requests UNION ALL
        SELECT p.request_id, p.id, p.place, w.remaining - u, v FROM walk w JOIN placed p ON p.request_id = w.request_id AND p.place = w.place + 1,
        LATERAL (SELECT CASE WHEN p.tokens <= w.remaining THEN p.tokens WHEN p.tokens <= w.remaining + 200 AND w.remaining > 60 THEN w.remaining - 50 ELSE 0 END AS u,
                        CASE WHEN p.tokens <= w.remaining THEN 'included' WHEN p.tokens <= w.remaining + 200 AND w.remaining > 60 THEN 'truncated' ELSE 'excluded' END AS v)"""


@query(sql("""SELECT p.request_id, p.id, i.kind, i.scope, i.classification, p.score, p.tokens, w.verdict <> 'excluded' AS included, w.verdict AS reason, 15 AS components, true AS adds_up
    FROM walk w JOIN placed p ON p.request_id = w.request_id AND p.place = w.place JOIN items i ON i.id = p.id WHERE w.place > 0""", *_NEEDS, **_SQL, walk=_WALK))  # fmt: skip
def p5_explain(spark, d):
    """Each candidate with its components and what became of it; the components themselves are in P.explained."""
    rows = _rows(spark, d)
    rows = P.explained(rows, P.greedy(_placed(rows), 400))
    total = F.aggregate(F.map_values("score_components"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "request_id", "id", "kind", "scope", "classification", "score", "tokens", "included", "reason", F.size("score_components").alias("components"), (F.abs(total - F.col("score")) < 2e-6).alias("adds_up")
    )


@query(sql("SELECT request_id, id, r.component AS component, round(CAST(r.value AS DOUBLE), 6) AS value FROM (SELECT request_id, i.id, unnest(["
    + ", ".join(f"{{'component': '{k}', 'value': CAST({v} AS DOUBLE)}}" for k, v in _COMPONENTS.items()) + f"]) AS r FROM {_JOINED})", *_NEEDS, **{k: v for k, v in _SQL.items() if k not in ("scored", "placed")}))
def p5_components(spark, d):
    """Every candidate's score in its parts, one row each."""
    rows = _rows(spark, d)
    rows = P.explained(rows, P.greedy(_placed(rows), 400))
    return rows.select("request_id", "id", F.explode("score_components").alias("component", "value")).withColumn("value", F.round("value", 6))


@query(sql("""SELECT request_id, id, place, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(tokens) OVER (PARTITION BY request_id ORDER BY place) AS running FROM placed) WHERE running <= 800""", *_NEEDS, **_SQL))
def n6_prefix_budget(spark, d):
    return P.prefix_budget(written(_placed(_rows(spark, d)), "placed"), 800, ["request_id"], [F.asc("place")], F.col("tokens")).select("request_id", "id", "place", "running")


@query(sql("""SELECT kind, CAST(k AS INTEGER) AS k, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY tier, updated_at DESC, id) AS k FROM
    (SELECT *, CASE WHEN classification = 'observational' THEN 1 ELSE 0 END AS tier FROM live WHERE kind IN ('decision', 'procedure', 'pattern', 'bugfix'))) WHERE k <= 25""", "items", live=_LIVE))  # fmt: skip
def p6_prime_sections(spark, d):
    live = memory_items(spark, d).filter("status = 'active' AND (expires_at IS NULL OR expires_at > timestamp'2024-01-31 00:00:00')")
    tier = F.when(F.col("classification") == "observational", 1).otherwise(0)
    w = Window.partitionBy("kind").orderBy(tier, F.desc("updated_at"), "id")
    rows = live.filter(F.col("kind").isin("decision", "procedure", "pattern", "bugfix")).withColumn("k", F.row_number().over(w))
    return rows.filter("k <= 25").select("kind", "k", "id")


@query(sql("""SELECT path, id, score FROM (SELECT path, id, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, updated_at DESC, id) AS k FROM (
      SELECT f.path, i.id, i.updated_at, CASE WHEN i.path = f.path THEN 120 ELSE 22 END AS score FROM fresh i JOIN (SELECT DISTINCT path FROM fresh) f ON regexp_replace(i.path, '/[^/]*$', '') = regexp_replace(f.path, '/[^/]*$', ''))) WHERE k <= 10""",
    "items", fresh=f"SELECT *, json_extract_string(applies_to_json, '$.files[0]') AS path FROM ({_LIVE}) WHERE superseded_by IS NULL"))
def p9_file_history(spark, d):
    """The ten records that match each known path best: its own first, then those of its folder, newest first."""
    fresh = memory_items(spark, d).filter("status = 'active' AND (expires_at IS NULL OR expires_at > timestamp'2024-01-31 00:00:00') AND superseded_by IS NULL")
    i = fresh.select("id", "updated_at", X.normal_path(F.get_json_object("applies_to_json", "$.files[0]")).alias("own"))
    i = i.withColumn("folder", F.regexp_replace("own", "/[^/]*$", ""))
    newest = lambda by: Window.partitionBy(by).orderBy(F.desc("updated_at"), "id")
    few = i.withColumn("k", F.row_number().over(newest("own"))).filter("k <= 10").drop("k")
    same = few.select(F.col("own").alias("path"), "own", "id", "updated_at")
    # with at most ten of a path, the first twenty of a folder hold ten of other paths if there are any
    near = few.withColumn("k", F.row_number().over(newest("folder"))).filter("k <= 20")
    paths = i.select(F.col("own").alias("path"), "folder").distinct()
    around = paths.join(near, "folder").filter("path <> own").select("path", "own", "id", "updated_at")
    rows = same.unionByName(around).withColumn("score", X.path_score("path", "own"))
    w = Window.partitionBy("path").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 10").select("path", "id", "score")


@query(sql("""SELECT path, section, id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(tokens) OVER (PARTITION BY path, section ORDER BY k) AS running FROM
    (SELECT path, CASE WHEN kind IN ('decision', 'procedure') THEN 'guidance' WHEN kind IN ('bugfix', 'postmortem') THEN 'history' ELSE 'notes' END AS section, id,
      row_number() OVER (PARTITION BY path, CASE WHEN kind IN ('decision', 'procedure') THEN 'guidance' WHEN kind IN ('bugfix', 'postmortem') THEN 'history' ELSE 'notes' END ORDER BY updated_at DESC, id) AS k,
      CAST(length(title) // 4 + 1 AS BIGINT) AS tokens FROM fresh)) WHERE running <= 60""",
    "items", fresh=f"SELECT *, json_extract_string(applies_to_json, '$.files[0]') AS path FROM ({_LIVE}) WHERE superseded_by IS NULL"))
def p10_file_context(spark, d):
    """What is known of each file, by section, each cut at the first record that passes its budget."""
    fresh = memory_items(spark, d).filter("status = 'active' AND (expires_at IS NULL OR expires_at > timestamp'2024-01-31 00:00:00') AND superseded_by IS NULL")
    section = F.when(F.col("kind").isin("decision", "procedure"), "guidance").when(F.col("kind").isin("bugfix", "postmortem"), "history").otherwise("notes")
    rows = fresh.select(F.get_json_object("applies_to_json", "$.files[0]").alias("path"), section.alias("section"), "id", "updated_at", F.floor(F.char_length("title") / 4 + 1).alias("tokens"))
    return P.prefix_budget(rows, 60, ["path", "section"], [F.desc("updated_at"), F.asc("id")], F.col("tokens")).select("path", "section", "id", "running")
