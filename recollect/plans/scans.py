"""Scans, predicates, projections, sorts and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import scans as O
from recollect.operators.intervals import holding
from recollect.operators.prefix import running
from recollect.plans.base import query
from recollect.sources.scratch import written
from recollect.sources.tables import memory_items, outcomes, prompts, sessions, sql, table, usage

LIVE = "status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00')"
FRESH = LIVE + " AND (superseded_by IS NULL OR superseded_by = 0)"


@query(sql(
    """SELECT id, access_count + CAST(coalesce(n, 0) AS BIGINT) AS access_count, CAST(greatest(last_accessed, last) AS VARCHAR) AS last_accessed
    FROM items LEFT JOIN (SELECT memory_id, count(*) AS n, max(date_trunc('second', ts)) AS last FROM usage GROUP BY 1) u ON u.memory_id = id""", "items", "usage"
))
def s1_lookup_with_usage(spark, d):
    seen = usage(spark, d).withColumn("ts", F.date_trunc("second", "ts"))
    return O.fold_usage(memory_items(spark, d), seen).select("id", "access_count", F.col("last_accessed").cast("string").alias("last_accessed"))


@query(sql(f"SELECT id, title, CAST(updated_at AS VARCHAR) AS updated_at FROM items WHERE {LIVE} AND project_id = 'src1' ORDER BY items.updated_at DESC, id LIMIT 20", "items"))
def s2_recent(spark, d):
    return O.recent(memory_items(spark, d), project_id="src1").select("id", "title", F.col("updated_at").cast("string").alias("updated_at"))


@query(sql(f"""SELECT session_id, id, CAST(k AS INTEGER) AS k FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, id) AS k
    FROM items WHERE {LIVE}) WHERE k <= 60""", "items"))  # fmt: skip
def s3_session_scan(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("updated_at"), "id")
    return memory_items(spark, d).filter(O.unexpired() & (F.col("status") == "active")).withColumn("k", F.row_number().over(w)).filter("k <= 60").select("session_id", "id", "k")


@query(sql("SELECT id, title, kind FROM items WHERE id IN (SELECT item_id * 3 FROM benchmark)", "items"))
def s4_multi_get(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return O.by_ids(memory_items(spark, d), ids).select("id", "title", "kind")


@query(sql("""SELECT memory_id, event_id, status, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS INTEGER) AS step FROM outcomes""", "outcomes"))
def s5_history(spark, d):
    """Steps of each record's history, counted over ranges of it."""
    o = outcomes(spark, d).select("memory_id", "ts", "event_id", "status")
    out = running(o, ["memory_id"], [F.asc("ts"), F.asc("event_id")], sums={"step": F.lit(1)})
    return out.select("memory_id", "event_id", "status", F.col("step").cast("int").alias("step"))


@query(sql("""SELECT project, id, content FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS k FROM prompts) WHERE k <= 20""", "prompts"))
def s6_recent_prompts(spark, d):
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), "id")
    return prompts(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 20").select("project", "id", "content")


@query(sql("SELECT id, project, directory, CAST(started_at AS VARCHAR) AS started_at, CAST(coalesce(ended_at, started_at) AS VARCHAR) AS last_seen FROM sessions", "sessions"))
def s7_s9_session_export(spark, d):
    return sessions(spark, d).select("id", "project", "directory", F.col("started_at").cast("string").alias("started_at"), F.coalesce("ended_at", "started_at").cast("string").alias("last_seen"))


@query("""SELECT conv_id * 1000 + turn AS fact_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS title, text AS body
    FROM (SELECT *, split_part(trim(text), chr(10), 1) AS t FROM conversations WHERE trim(text) <> '')""")  # fmt: skip
def s14_messages_to_facts(spark, d):
    from recollect.functions.text import clip

    c = table(spark, d, "conversations").filter(F.trim("text") != "").withColumn("t", F.split_part(F.trim("text"), F.lit("\n"), F.lit(1)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), clip("t", 80).alias("title"), F.col("text").alias("body"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid FROM events""")
def s12_json_payloads(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(sql("""SELECT CAST(q.t AS VARCHAR) AS asof, i.id FROM items i JOIN (SELECT DISTINCT CAST(updated_at AS DATE) AS t FROM items) q
    ON (i.valid_from IS NULL OR i.valid_from <= q.t) AND (i.valid_to IS NULL OR i.valid_to > q.t)""", "items"))  # fmt: skip
def f2_as_of_join(spark, d):
    """What held on every day on which a record changed; most records are still valid and have no end."""
    i = memory_items(spark, d)
    days = i.select(F.to_date("updated_at").alias("t")).distinct().select("t", F.col("t").cast("timestamp").alias("moment"))
    found = holding(i.select("id", "valid_from", "valid_to"), days, "valid_from", "valid_to", "moment")
    return found.select(F.col("t").cast("string").alias("asof"), "id")


@query(sql("""SELECT id, session_id FROM items WHERE updated_at >= TIMESTAMP '2023-12-01 00:00:00' AND ingested_at <= TIMESTAMP '2024-01-20 00:00:00' AND session_id = 's7'""", "items"))
def f3_since_and_ingested(spark, d):
    i = memory_items(spark, d)
    return i.filter((F.col("updated_at") >= O.at("2023-12-01 00:00:00")) & (F.col("ingested_at") <= O.at("2024-01-20 00:00:00")) & (F.col("session_id") == "s7")).select("id", "session_id")


@query(sql("SELECT id, applies_to_json FROM items WHERE lower(applies_to_json) LIKE '%src3/f3%'", "items"))
def f4_path_predicate(spark, d):
    return O.touching(memory_items(spark, d), "SRC3/f3").select("id", "applies_to_json")


@query(sql(f"SELECT id, kind, domain FROM items WHERE {FRESH} AND scope = 'project' AND kind = 'decision' AND written_by = 'agent1'", "items"))
def f5_f7_facets(spark, d):
    return O.facets(O.live(memory_items(spark, d)), scope="project", kind="decision", written_by="agent1").select("id", "kind", "domain")


@query(sql("""SELECT id, trust_level, CASE WHEN length(body) > 200 THEN left(body, 200) || '...' ELSE body END AS body, '' AS applies_to_json
    FROM items WHERE trust_level IN ('low', 'untrusted')""", "items"))  # fmt: skip
def f8_masked(spark, d):
    return O.masked(memory_items(spark, d)).select("id", "trust_level", "body", "applies_to_json")


@query(sql("SELECT id, project_id FROM items WHERE project_id IN (SELECT DISTINCT project FROM sessions WHERE directory = '/home/3')", "items", "sessions"))
def f9_allowed_projects(spark, d):
    mine = sessions(spark, d).filter("directory = '/home/3'").select(F.col("project").alias("project_id"))
    return O.allowed(memory_items(spark, d), mine).select("id", "project_id")


@query(sql("SELECT id, title, 'memory://' || id AS uri, left(body, 600) AS text, project_id, kind FROM items", "items"))
def f13_compact(spark, d):
    return O.compact(memory_items(spark, d))


@query(sql("SELECT id, CASE WHEN length(body) > 300 THEN left(body, 300) || '...' ELSE body END AS preview FROM items", "items"))
def f14_preview(spark, d):
    from recollect.functions.text import clip

    return memory_items(spark, d).select("id", clip("body", 300).alias("preview"))


@query(sql("SELECT id FROM sessions WHERE started_at > (SELECT max(started_at) - INTERVAL 5 DAY FROM sessions)", "sessions"))
def f15_newer_than_last_chunk(spark, d):
    s = sessions(spark, d)
    last = s.agg((F.max("started_at") - F.expr("interval 5 days")).alias("last"))  # one row
    return s.join(F.broadcast(last), F.col("started_at") > F.col("last")).select("id")


@query(sql("""SELECT id, CAST(k AS INTEGER) AS k, coalesce(prev, -1) AS prev, coalesce(next, -1) AS next, n FROM (SELECT id, project_id, row_number() OVER w AS k, lag(id, 1) OVER w AS prev, lead(id, 1) OVER w AS next,
    count(*) OVER (PARTITION BY project_id) AS n FROM items WINDOW w AS (PARTITION BY project_id ORDER BY updated_at, id))""", "items"))  # fmt: skip
def n1_timeline(spark, d):
    """Places are counted within ranges, which each add the rows of the project's ranges before them, so no task holds a project."""
    i = memory_items(spark, d).select("id", "project_id", "updated_at").repartitionByRange("project_id", "updated_at", "id")
    i = written(i.withColumn("part", F.spark_partition_id()), "timeline")
    ranges = i.groupBy("project_id", "part").agg(F.count("*").alias("m"), *[f(F.struct("updated_at", "id")).alias(x) for x, f in (("low", F.min), ("high", F.max))])
    p = Window.partitionBy("project_id").orderBy("part")  # a project has at most one row a range here
    edges = ranges.select(
        F.col("project_id").alias("p"), F.col("part").alias("r"), (F.sum("m").over(p) - F.col("m")).alias("before"), F.lag("high.id").over(p).alias("left"),
        F.lead("low.id").over(p).alias("right"), F.sum("m").over(Window.partitionBy("project_id")).alias("n"),
    )
    w = Window.partitionBy("project_id", "part").orderBy("updated_at", "id")
    rows = i.select("id", "project_id", "part", F.row_number().over(w).alias("k"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))
    both = rows.join(edges, F.col("project_id").eqNullSafe(F.col("p")) & (F.col("part") == F.col("r")))
    near = lambda c, edge: F.coalesce(c, edge, F.lit(-1)).alias(c)
    return both.select("id", (F.col("k") + F.col("before")).cast("int").alias("k"), near("prev", "left"), near("next", "right"), "n")


@query(sql("""SELECT a.id, max_by(b.id, (b.started_at, b.id)) AS previous FROM sessions a JOIN sessions b ON a.project = b.project AND b.ended_at IS NOT NULL AND b.started_at < a.started_at
    GROUP BY a.id""", "sessions"))  # fmt: skip
def n3_previous_session(spark, d):
    """The last completed session that started earlier: a running maximum over a project's moments, each with its best session."""
    s = sessions(spark, d).select("project", "id", "started_at", "ended_at")
    done = F.max(F.when(F.col("ended_at").isNotNull(), F.struct("started_at", "id"))).alias("done")
    moments = s.groupBy("project", "started_at").agg(done)
    before = running(moments, ["project"], [F.asc("started_at")], maxima={"p": F.col("done")}, inclusive=False).drop("done")
    return s.join(before.filter("p IS NOT NULL"), ["project", "started_at"]).select("id", F.col("p.id").alias("previous"))


@query("""SELECT conv_id, turn AS from_turn, lead(turn) OVER w AS to_turn FROM conversations QUALIFY lead(turn) OVER w IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""".replace("QUALIFY lead(turn) OVER w IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", "WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY to_turn IS NOT NULL"))
def n7_chain_edges(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("from_turn"), F.lead("turn").over(w).alias("to_turn"))
    return c.filter("to_turn IS NOT NULL")


@query("""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def n4_top_k_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query(sql("""SELECT session_id, id, CAST(hits AS INTEGER) AS hits, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, original) AS place FROM
    (SELECT r.session_id, r.id, original, len(list_filter(h.hints, x -> contains(lower(r.applies_to_json), x))) AS hits FROM
      (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, id) AS original FROM items) r
      JOIN (SELECT session_id, list(DISTINCT file) AS hints FROM (SELECT session_id, 'f' || (id % 20) || '.py' AS file, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, id) AS k FROM items) WHERE k <= 3 GROUP BY 1) h USING (session_id)
      WHERE original <= 60))""", "items"))  # fmt: skip
def l3_hint_sort(spark, d):
    """The 60 newest records of a session, those first that touch more of the files of its three newest; else as they were."""
    i = memory_items(spark, d)
    w = Window.partitionBy("session_id").orderBy(F.desc("updated_at"), "id")
    rows = i.select("session_id", "id", "updated_at", F.lower("applies_to_json").alias("touched")).withColumn("original", F.row_number().over(w)).filter("original <= 60")
    file = F.concat(F.lit("f"), F.col("id") % 20, F.lit(".py"))
    hints = rows.filter("original <= 3").groupBy("session_id").agg(F.collect_set(file).alias("hints"))  # at most three
    hits = F.size(F.filter("hints", lambda x: F.contains("touched", x)))
    out = rows.join(hints, "session_id").withColumn("hits", hits)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("hits"), "original"))).select("session_id", "id", "hits", "place")


@query(sql("""SELECT project, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT project_id AS project, title AS name FROM items UNION ALL SELECT project, id FROM sessions UNION ALL SELECT project, session_id FROM prompts) GROUP BY 1""", "items", "sessions", "prompts"))
def d1_union(spark, d):
    parts = memory_items(spark, d).selectExpr("project_id AS project", "title AS name").unionByName(sessions(spark, d).selectExpr("project", "id AS name")).unionByName(prompts(spark, d).selectExpr("project", "session_id AS name"))
    return parts.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query(sql("""SELECT md5(lower(body)) AS body_hash, min(id) AS id, count(*) AS n FROM items GROUP BY 1""", "items"))
def d5_body_hash_dedup(spark, d):
    return memory_items(spark, d).groupBy(F.md5(F.lower("body")).alias("body_hash")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(sql("SELECT project_id, left(body, 64) AS head, min(id) AS id FROM items GROUP BY 1, 2", "items"))
def d4_prefix_dedup(spark, d):
    return memory_items(spark, d).groupBy("project_id", F.substring("body", 1, 64).alias("head")).agg(F.min("id").alias("id"))


@query(sql("SELECT id FROM items EXCEPT SELECT doc_id FROM labels", "items"))
def d1_except(spark, d):
    """Records without a label."""
    return memory_items(spark, d).select("id").exceptAll(table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct())
