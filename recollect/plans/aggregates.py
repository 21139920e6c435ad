"""Aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.prefix import percentiles
from recollect.operators.search import outcome_counts
from recollect.plans.base import query
from recollect.sources.tables import memory_items, outcomes, prompts, relations, sessions, sql, table


@query(sql("""SELECT kind, scope, status, domain, classification, written_by, count(*) AS n FROM items
    GROUP BY GROUPING SETS ((kind), (scope), (status), (domain), (classification), (written_by), ())""", "items"))  # fmt: skip
def a1_grouped_counts(spark, d):
    """One pass over the records for all six groupings and the total."""
    i = memory_items(spark, d).select("kind", "scope", "status", "domain", "classification", "written_by")
    cols = [F.col(c) for c in i.columns]
    return i.groupingSets([[c] for c in cols] + [[]], *cols).agg(F.count("*").alias("n"))


@query(sql("""SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM items WHERE status = 'active') AS active, (SELECT count(*) FROM prompts) AS prompts,
    (SELECT array_to_string(list_sort(list(DISTINCT project_id)), ',') FROM items) AS projects""", "items", "sessions", "prompts"))  # fmt: skip
def a2_global_counts(spark, d):
    one = memory_items(spark, d).agg(F.count_if(F.col("status") == "active").alias("active"), F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("projects"))
    two = sessions(spark, d).agg(F.count("*").alias("sessions"))
    three = prompts(spark, d).agg(F.count("*").alias("prompts"))
    return one.join(F.broadcast(two)).join(F.broadcast(three)).select("sessions", "active", "prompts", "projects")  # one row each


@query(sql("""SELECT project, coalesce(memories, 0) AS memories, coalesce(sessions, 0) AS sessions, coalesce(prompts, 0) AS prompts, coalesce(directories, 0) AS directories
    FROM (SELECT project_id AS project, count(*) AS memories FROM items GROUP BY 1) FULL JOIN (SELECT project, count(*) AS sessions, count(DISTINCT directory) AS directories FROM sessions GROUP BY 1) USING (project)
    FULL JOIN (SELECT project, count(*) AS prompts FROM prompts GROUP BY 1) USING (project)""", "items", "sessions", "prompts"))  # fmt: skip
def a3_project_rollup(spark, d):
    a = memory_items(spark, d).groupBy(F.col("project_id").alias("project")).agg(F.count("*").alias("memories"))
    b = sessions(spark, d).groupBy("project").agg(F.count("*").alias("sessions"), F.countDistinct("directory").alias("directories"))
    c = prompts(spark, d).groupBy("project").agg(F.count("*").alias("prompts"))
    return a.join(b, "project", "full_outer").join(c, "project", "full_outer").fillna(0).select("project", "memories", "sessions", "prompts", "directories")


@query(sql("SELECT project FROM sessions UNION SELECT project_id FROM items", "items", "sessions"))
def a4_project_names(spark, d):
    return sessions(spark, d).select("project").union(memory_items(spark, d).select("project_id")).distinct()


@query(sql("SELECT DISTINCT project_id, domain FROM items WHERE status = 'active' AND domain <> ''", "items"))
def a5_domains(spark, d):
    return memory_items(spark, d).filter("status = 'active' AND domain <> ''").select("project_id", "domain").distinct()


@query(sql("""SELECT memory_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failure') AS failure, count(*) FILTER (status = 'unknown') AS unknown FROM outcomes GROUP BY 1""", "outcomes"))
def a6_j18_outcome_counts(spark, d):
    return outcome_counts(outcomes(spark, d))


@query(sql("""SELECT s.id, count(m.id) AS memories, CAST(coalesce(max(m.created_at), max(s.started_at)) AS VARCHAR) AS last_activity FROM sessions s LEFT JOIN items m ON m.session_id = 's' || substr(s.id, 2) AND m.status = 'active' GROUP BY s.id""", "items", "sessions"))
def a7_j7_session_activity(spark, d):
    m = memory_items(spark, d).filter("status = 'active'").groupBy("session_id").agg(F.count("*").alias("memories"), F.max("created_at").alias("last"))
    s = sessions(spark, d).withColumn("session_id", F.concat(F.lit("s"), F.substring("id", 2, 20)))
    out = s.join(m, "session_id", "left")
    return out.select("id", F.coalesce("memories", F.lit(0)).alias("memories"), F.coalesce("last", "started_at").cast("string").alias("last_activity"))


@query(sql("""SELECT conv_id, count(*) FILTER (role = 'user') AS prompts, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max_by(text, turn) AS last_text FROM conversations GROUP BY 1"""))
def a11_session_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("prompts"), F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), F.max_by("text", "turn").alias("last_text")
    )


@query(sql("""SELECT written_by, count(*) AS chunks, CAST(sum(access_count) AS BIGINT) AS accesses FROM items GROUP BY ROLLUP (written_by)""", "items"))
def a13_manifest_summary(spark, d):
    return memory_items(spark, d).rollup("written_by").agg(F.count("*").alias("chunks"), F.sum("access_count").alias("accesses"))


@query(sql(f"""SELECT check_name, n FROM (SELECT count(*) FILTER (kind NOT IN ({", ".join(repr(k) for k in S.KINDS)})) AS bad_kind, count(*) FILTER (NOT json_valid(applies_to_json)) AS bad_json,
    count(*) FILTER (updated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 180 DAY) AS stale_180d, count(*) FILTER (updated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 90 DAY) AS stale_90d,
    count(*) FILTER (domain IS NULL OR domain = '') AS no_domain, count(*) FILTER (superseded_by IS NOT NULL) AS superseded FROM items)
    UNPIVOT (n FOR check_name IN (bad_kind, bad_json, stale_180d, stale_90d, no_domain, superseded))""", "items"))  # fmt: skip
def a15_integrity(spark, d):
    i = memory_items(spark, d)
    now = F.lit(S.NOW).cast("timestamp")
    row = i.agg(
        F.count_if(~F.col("kind").isin(S.KINDS)).alias("bad_kind"), F.count_if(F.try_parse_json("applies_to_json").isNull()).alias("bad_json"),
        F.count_if(F.col("updated_at") < now - F.expr("interval 180 days")).alias("stale_180d"), F.count_if(F.col("updated_at") < now - F.expr("interval 90 days")).alias("stale_90d"),
        F.count_if(F.coalesce("domain", F.lit("")) == "").alias("no_domain"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"),
    )
    return row.unpivot([], row.columns, "check_name", "n")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")  # fmt: skip
def a_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")  # fmt: skip
def a8_revenue_by_nation(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.countDistinct("c_custkey").alias("customers"))


@query("""SELECT event_type, CAST(quantile_cont(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(value, 0.95) AS DOUBLE) AS p95, max(value) AS top FROM events GROUP BY 1""")
def b4_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    return percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "top": 1.0})


@query(sql("SELECT relation, count(*) AS n, count(DISTINCT from_id) AS sources FROM relations GROUP BY 1", "relations"))
def a12_relation_counts(spark, d):
    return relations(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("sources"))
