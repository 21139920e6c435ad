"""Memory tables derived from the supplied tables, as DataFrames and as the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(values: list[str], index: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"int({index}) + 1"))


def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` read as memory records; every derived column is a function of doc_id."""
    d = table(spark, sf_dir, "documents")
    day = lambda e: F.expr(f"timestamp'2023-06-01 00:00:00' + make_dt_interval(int({e}))")
    items = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.col("lang").alias("domain"),
        F.expr("left(text, 60)").alias("title"), F.col("text").alias("body"), _element(S.KINDS, "doc_id % 10").alias("kind"),
        F.expr("CASE WHEN doc_id % 13 = 0 THEN 'archived' WHEN doc_id % 19 = 5 THEN 'candidate' ELSE 'active' END").alias("status"),
        F.expr("CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END").alias("superseded_by"),
        day("doc_id * 37 % 244").alias("updated_at"), F.col("doc_id"),
    )
    items = items.withColumn("created_at", F.expr("updated_at - make_dt_interval(int(doc_id % 7))"))
    return items.select(
        "id", "project_id", "domain", "title", "body", "kind", "status", "superseded_by", "updated_at", "created_at",
        F.when(F.col("kind").isin(S.GLOBAL_KINDS), "global").otherwise("project").alias("scope"),
        S.lookup("kind", S.CLASS_OF_KIND, "tactical").alias("classification"),
        F.expr("CASE kind WHEN 'discovery' THEN created_at + interval 90 days WHEN 'postmortem' THEN created_at + interval 30 days END").alias("expires_at"),
        F.col("created_at").alias("valid_from"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN created_at + interval 10 days END").alias("valid_to"),
        F.expr("created_at + interval 1 day").alias("ingested_at"),
        F.expr("int(doc_id % 9)").alias("access_count"),
        F.expr("CASE WHEN doc_id % 4 <> 0 THEN updated_at + make_dt_interval(int(doc_id % 3)) END").alias("last_accessed"),
        F.expr("double(doc_id % 5) / 4").alias("utility_weight"),
        _element(S.TRUST, "doc_id % 4").alias("trust_level"),
        F.expr("concat('agent', doc_id % 3)").alias("written_by"), F.expr("concat('s', doc_id % 50)").alias("session_id"),
        F.expr("concat('{\"files\":[\"src/', project_id, '/f', doc_id % 20, '.py\"]}')").alias("applies_to_json"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    one = d.selectExpr("doc_id AS from_id", "doc_id * 7 div 11 AS to_id", "doc_id % 6 AS r")
    two = d.filter("doc_id % 3 = 0").selectExpr("doc_id AS from_id", "doc_id div 2 AS to_id", "(doc_id + 2) % 6 AS r")
    return one.unionByName(two).select("from_id", "to_id", _element(S.RELATIONS, "r").alias("relation"))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, name) of records and the words of four letters and more in their titles, lower-cased."""
    words = memory_items(spark, sf_dir).select(F.col("id").alias("obs_id"), F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(title), '[a-z]{4,}', 0)"))).alias("name"))
    return words


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.expr("user_id").alias("memory_id"), "ts",
        F.expr("CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'unknown' END").alias("status"),
    ).filter("status IS NOT NULL")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("memory_id"), "ts", F.expr("CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'click' THEN 'used' END").alias("event")).filter("event IS NOT NULL")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(
        F.expr("conv_id * 1000 + turn").alias("id"), F.expr("concat('c', conv_id)").alias("session_id"), F.col("text").alias("content"),
        F.expr("concat('src', conv_id % 20)").alias("project"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(int(conv_id % 30), int(turn))").alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.select(
        F.expr("concat('c', conv_id)").alias("id"), F.expr("concat('src', conv_id % 20)").alias("project"), F.expr("concat('/home/', conv_id % 7)").alias("directory"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(int(conv_id % 30))").alias("started_at"),
        F.expr("CASE WHEN conv_id % 4 <> 0 THEN timestamp'2024-01-01 00:00:00' + make_dt_interval(int(conv_id % 30), int(turns)) END").alias("ended_at"),
    )


def _pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INTEGER) + 1]"


_DEFINED = {
    "items0": f"""SELECT doc_id AS id, source AS project_id, lang AS domain, left(text, 60) AS title, text AS body, {_pick(S.KINDS, "doc_id % 10")} AS kind,
        CASE WHEN doc_id % 13 = 0 THEN 'archived' WHEN doc_id % 19 = 5 THEN 'candidate' ELSE 'active' END AS status,
        CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END AS superseded_by,
        TIMESTAMP '2023-06-01 00:00:00' + to_days(CAST(doc_id * 37 % 244 AS INTEGER)) AS updated_at FROM documents""",
    "items1": "SELECT *, updated_at - to_days(CAST(id % 7 AS INTEGER)) AS created_at FROM items0",
    "items": f"""SELECT *, CASE WHEN kind IN ('identity', 'user_preference', 'glossary') THEN 'global' ELSE 'project' END AS scope,
        {S.lookup_sql("kind", S.CLASS_OF_KIND, "tactical")} AS classification,
        CASE kind WHEN 'discovery' THEN created_at + INTERVAL 90 DAY WHEN 'postmortem' THEN created_at + INTERVAL 30 DAY END AS expires_at,
        created_at AS valid_from, CASE WHEN id % 11 = 0 THEN created_at + INTERVAL 10 DAY END AS valid_to, created_at + INTERVAL 1 DAY AS ingested_at,
        CAST(id % 9 AS INTEGER) AS access_count, CASE WHEN id % 4 <> 0 THEN updated_at + to_days(CAST(id % 3 AS INTEGER)) END AS last_accessed,
        CAST(id % 5 AS DOUBLE) / 4 AS utility_weight, {_pick(S.TRUST, "id % 4")} AS trust_level, 'agent' || (id % 3) AS written_by, 's' || (id % 50) AS session_id,
        '{{"files":["src/' || project_id || '/f' || (id % 20) || '.py"]}}' AS applies_to_json FROM items1""",
    "relations": f"""SELECT doc_id AS from_id, doc_id * 7 // 11 AS to_id, {_pick(S.RELATIONS, "doc_id % 6")} AS relation FROM documents
        UNION ALL SELECT doc_id, doc_id // 2, {_pick(S.RELATIONS, "(doc_id + 2) % 6")} FROM documents WHERE doc_id % 3 = 0""",
    "links": "SELECT DISTINCT id AS obs_id, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS name FROM items",
    "outcomes": """SELECT event_id, user_id AS memory_id, ts, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'unknown' END AS status
        FROM events WHERE event_type IN ('purchase', 'error', 'signup')""",
    "usage": "SELECT event_id, user_id AS memory_id, ts, CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'click' THEN 'used' END AS event FROM events WHERE event_type IN ('view', 'click')",
    "prompts": """SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS session_id, text AS content, 'src' || (conv_id % 20) AS project,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_hours(CAST(turn AS INTEGER)) AS created_at FROM conversations WHERE role = 'user'""",
    "sessions": """SELECT 'c' || conv_id AS id, 'src' || (conv_id % 20) AS project, '/home/' || (conv_id % 7) AS directory,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) AS started_at,
        CASE WHEN conv_id % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_hours(CAST(count(*) AS INTEGER)) END AS ended_at
        FROM conversations GROUP BY conv_id""",
}
_NEEDS = {"items": ["items0", "items1"], "links": ["items0", "items1", "items"]}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` after the definitions of the named memory tables, then those given in full."""
    wanted = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    defined = [(n, _DEFINED[n]) for n in wanted] + list(more.items())
    if not defined:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n == 'walk' else 'MATERIALIZED '}({d})" for n, d in defined) + "\n" + body
