"""Writes, maintenance, the journal and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.operators import lifecycle as L
from recollect.plans.base import query
from recollect.plans.texts import redact_sql
from recollect.sources.scratch import shared_folder, written
from recollect.sources.tables import entity_links, memory_items, outcomes, prompts, relations, sessions, sql, table


def _cleaned(col: str) -> str:
    return redact_sql(rf"trim(regexp_replace({col}, '(?is)<private>.*?</private>', '[REDACTED]', 'g'), ' ')")


@query(sql(rf"""SELECT id, project_id, kind, {S.lookup_sql("kind", S.CLASS_OF_KIND, "tactical")} AS classification, sha256(project_id || '|' || sha256(lower(trim(regexp_replace(body, '\s+', ' ', 'g'), ' '))) || '|' || lower(trim(title, ' '))) AS idempotency_key
    FROM (SELECT id, project_id, kind, title, CASE WHEN body = '' OR greatest(floor(len(w) * 1.35 + 0.5), 1) <= lim THEN body ELSE array_to_string(w[:CAST(floor((lim - 5) / 1.35) AS INTEGER)], ' ') || '... [truncated]' END AS body FROM
      (SELECT *, {S.lookup_sql("kind", S.BODY_LIMIT, 1000)} AS lim, list_filter(regexp_split_to_array(body, '\s+'), x -> x <> '') AS w FROM
        (SELECT id, project_id, kind, {_cleaned("title")} AS title, {_cleaned("body")} AS body FROM items)))""", "items"))  # fmt: skip
def w1_prepare_insert(spark, d):
    """Records as they are written: secrets and private parts gone, cut to their kind's limit, classed and keyed."""
    rows = memory_items(spark, d).select("id", "project_id", "kind", "title", "body")
    return L.prepare_insert(rows).select("id", "project_id", "kind", "classification", "idempotency_key")


@query(sql("""SELECT id, field, old_value, new_value FROM (SELECT id, 'title' AS field, title AS old_value, CASE WHEN id % 5 = 0 THEN lower(title) END AS new_value FROM items
    UNION ALL SELECT id, 'kind', kind, CASE WHEN id % 7 = 0 THEN 'config' END FROM items) WHERE new_value IS NOT NULL AND new_value IS DISTINCT FROM old_value""", "items"))  # fmt: skip
def w2_revisions(spark, d):
    i = memory_items(spark, d).select("id", "title", "kind")
    patch = i.select("id", F.when(F.col("id") % 5 == 0, F.lower("title")).alias("title"), F.when(F.col("id") % 7 == 0, F.lit("config")).alias("kind"))
    return L.revisions(i, patch, ["title", "kind"])


@query(sql("SELECT id, CASE WHEN id % 5 = 0 THEN lower(title) ELSE title END AS title, CASE WHEN id % 7 = 0 THEN 'config' ELSE kind END AS kind FROM items", "items"))
def w2_patched(spark, d):
    i = memory_items(spark, d).select("id", "title", "kind")
    patch = i.filter("id % 5 = 0 OR id % 7 = 0").select("id", F.when(F.col("id") % 5 == 0, F.lower("title")).alias("title"), F.when(F.col("id") % 7 == 0, F.lit("config")).alias("kind"))
    return L.patched(i, patch, ["title", "kind"])


@query(sql("""SELECT id, CASE WHEN id % 6 = 0 THEN 'archived' ELSE status END AS status, CAST(CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE valid_to END AS VARCHAR) AS valid_to FROM items""", "items"))
def w4_w5_forget_and_latest(spark, d):
    """A forget appends a version; the newest version of each record is its state."""
    i = memory_items(spark, d).select("id", "status", "valid_to", F.lit(1).alias("version"))
    gone = i.filter("id % 6 = 0").select("id", F.lit("archived").alias("status"), F.lit(S.NOW).cast("timestamp").alias("valid_to"), F.lit(2).alias("version"))
    return L.latest(i.unionByName(gone)).select("id", "status", F.col("valid_to").cast("string").alias("valid_to"))


@query(sql("SELECT id, max(project) AS project, max(nullif(directory, '')) AS directory, count(*) AS writes FROM (SELECT id, project, '' AS directory FROM sessions UNION ALL SELECT id, project, directory FROM sessions) GROUP BY 1", "sessions"))
def w6_upsert_sessions(spark, d):
    s = sessions(spark, d)
    writes = s.select("id", "project", F.lit("").alias("directory")).unionByName(s.select("id", "project", "directory"))
    return writes.groupBy("id").agg(F.max("project").alias("project"), F.max(F.nullif("directory", F.lit(""))).alias("directory"), F.count("*").alias("writes"))


@query(sql("SELECT id, CAST(ended_at AS VARCHAR) AS ended_at, CASE WHEN ended_at IS NULL THEN 'open' ELSE 'done' END AS state FROM sessions", "sessions"))
def w7_end_sessions(spark, d):
    return sessions(spark, d).select("id", F.col("ended_at").cast("string").alias("ended_at"), F.when(F.col("ended_at").isNull(), "open").otherwise("done").alias("state"))


@query(sql("SELECT id, session_id, left(trim(content), 50000) AS content FROM prompts", "prompts"))
def w8_insert_prompts(spark, d):
    return prompts(spark, d).select("id", "session_id", F.substring(X.strip_private("content"), 1, 50_000).alias("content"))


@query(sql("SELECT id FROM sessions WHERE 's' || substr(id, 2) NOT IN (SELECT session_id FROM items)", "items", "sessions"))
def w9_guarded_delete(spark, d):
    """Sessions that may go: no record names them."""
    s = sessions(spark, d).select("id", F.concat(F.lit("s"), F.substring("id", 2, 20)).alias("session_id"))
    return s.join(memory_items(spark, d).select("session_id").distinct(), "session_id", "left_anti").select("id")


@query(sql("""SELECT project_id, title, min(id) AS id FROM items WHERE id NOT IN (SELECT doc_id FROM labels) AND (project_id, title) NOT IN (SELECT project_id, title FROM items WHERE id IN (SELECT doc_id FROM labels)) GROUP BY 1, 2""", "items"))
def w10_insert_or_ignore(spark, d):
    """Records without a label go to a table that holds those with one, unless project and title are there."""
    i = memory_items(spark, d).select("project_id", "title", "id")
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return L.ignore_known(i.join(labelled, "id", "left_anti"), i.join(labelled, "id", "left_semi"), ["project_id", "title"])


@query(sql("SELECT from_id, to_id, relation FROM relations WHERE (from_id, to_id, relation) NOT IN (SELECT from_id, to_id, relation FROM relations WHERE relation = 'caused' AND from_id % 2 = 0)", "relations"))
def w11_remove_relations(spark, d):
    r = relations(spark, d)
    return r.join(r.filter("relation = 'caused' AND from_id % 2 = 0").distinct(), ["from_id", "to_id", "relation"], "left_anti")


@query(sql("SELECT name, project_id, min(CAST(created_at AS VARCHAR)) AS first_seen, max(CAST(updated_at AS VARCHAR)) AS last_seen, count(*) AS n FROM links JOIN items ON obs_id = id GROUP BY 1, 2", "links"))
def w12_entity_upsert(spark, d):
    rows = entity_links(spark, d).join(memory_items(spark, d).select("id", "project_id", "created_at", "updated_at"), F.col("obs_id") == F.col("id"))
    return rows.groupBy("name", "project_id").agg(F.min("created_at").cast("string").alias("first_seen"), F.max("updated_at").cast("string").alias("last_seen"), F.count("*").alias("n"))


@query(sql("""SELECT memory_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(greatest(-1.0, least((CAST(event_id * 37 % 41 AS DOUBLE) - 20) / 10, 1.0)) * 0.2::DOUBLE ORDER BY ts, event_id)), (a, x) -> greatest(0.1::DOUBLE, a + x)), 6) AS utility FROM outcomes GROUP BY 1""", "outcomes"))
def w16_feedback_fold(spark, d):
    e = outcomes(spark, d).withColumn("reward", (F.col("event_id") * 37 % 41 - 20).cast("double") / 10)
    return L.feedback_fold(e).select("memory_id", F.round("utility", 6).alias("utility"))


@query(sql("SELECT event_id, CASE WHEN json_valid(raw) THEN raw ELSE '{\"raw\":\"' || raw || '\"}' END AS payload FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN event_type ELSE props END AS raw FROM events)"))
def w17_raw_observations(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(F.col("props"))
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(F.to_json(F.struct("raw"))).alias("payload"))


@query(sql("SELECT event_id, memory_id, '{\"status\":\"' || status || '\",\"memory_id\":' || memory_id || '}' AS snapshot FROM outcomes", "outcomes"))
def w18_audit_rows(spark, d):
    return outcomes(spark, d).select("event_id", "memory_id", F.to_json(F.struct("status", "memory_id")).alias("snapshot"))


@query(sql("""SELECT project, count(*) AS rows, CAST(max(created_at) AS VARCHAR) AS newest FROM prompts WHERE created_at > (SELECT max(created_at) - INTERVAL 10 DAY FROM prompts) GROUP BY 1""", "prompts"))
def w20_chunk_export(spark, d):
    p = prompts(spark, d)
    last = p.agg((F.max("created_at") - F.expr("interval 10 days")).alias("last"))  # one row
    new = p.join(F.broadcast(last), F.col("created_at") > F.col("last"))
    return new.groupBy("project").agg(F.count("*").alias("rows"), F.max("created_at").cast("string").alias("newest"))


@query(sql("SELECT id FROM items WHERE status = 'active' AND classification <> 'foundational' AND expires_at < TIMESTAMP '2024-01-31 00:00:00'", "items"))
def e1_archive_expired(spark, d):
    return L.archive_expired(memory_items(spark, d)).select("id")


@query(sql("""SELECT id, CASE WHEN hit THEN round(utility_weight * 0.9, 4) ELSE utility_weight END AS utility_weight, hit AS decayed FROM
    (SELECT *, coalesce(status = 'active' AND classification <> 'foundational' AND coalesce(last_accessed, updated_at) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 90 DAY AND utility_weight > 0, false) AS hit FROM items)""", "items"))  # fmt: skip
def e2_decay(spark, d):
    return L.decayed(memory_items(spark, d))


@query(sql("SELECT id FROM items WHERE status = 'candidate' AND created_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY", "items"))
def e3_stale_candidates(spark, d):
    return L.stale_candidates(memory_items(spark, d)).select("id")


@query(sql("SELECT id FROM items WHERE status = 'active' AND classification <> 'foundational' AND utility_weight > 0 AND utility_weight < 0.3", "items"))
def e4_low_utility(spark, d):
    return L.low_utility(memory_items(spark, d), 0.3).select("id")


@query(sql("""SELECT count(*) FILTER (a AND expires_at < t) AS expired, count(*) FILTER (a AND coalesce(last_accessed, updated_at) < t - INTERVAL 90 DAY AND utility_weight > 0) AS decayed,
    count(*) FILTER (status = 'candidate' AND created_at < t - INTERVAL 30 DAY) AS stale_candidates, count(*) FILTER (a AND utility_weight > 0 AND utility_weight < 0.05) AS low_utility
    FROM (SELECT *, status = 'active' AND classification <> 'foundational' AS a, TIMESTAMP '2024-01-31 00:00:00' AS t FROM items)""", "items"))  # fmt: skip
def e5_maintenance(spark, d):
    return L.maintenance(memory_items(spark, d))


@query(sql("""SELECT project_id, domain, kind, count(*) AS n, CAST(max(updated_at) AS VARCHAR) AS newest, min(id) AS first_id, count(DISTINCT lower(trim(title))) AS titles FROM items WHERE status = 'active' AND superseded_by IS NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3""", "items"))
def a9_e6_consolidation(spark, d):
    return L.consolidation_groups(memory_items(spark, d))


@query(sql("SELECT id, job, CASE WHEN a >= 6 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN a < 6 THEN least(5 * CAST(power(2, a - 1) AS BIGINT), 900) ELSE -1 END AS wait FROM (SELECT id, unnest(['embed', 'entities', 'link', 'score']) AS job, id % 8 AS a FROM items) WHERE a > 0", "items"))
def e7_e8_jobs(spark, d):
    jobs = memory_items(spark, d).select("id", F.explode(F.array(*[F.lit(j) for j in ("embed", "entities", "link", "score")])).alias("job"), (F.col("id") % 8).alias("a")).filter("a > 0")
    return jobs.select("id", "job", F.when(F.col("a") >= 6, "failed").otherwise("pending").alias("state"), F.coalesce(L.retry(F.col("a")), F.lit(-1)).alias("wait"))


@query("SELECT event_id AS seq, user_id FROM events WHERE event_id > 100 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def e9_e10_pending_journal(spark, d):
    j = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return L.pending(j.select("seq", "user_id"), j.filter("event_type = 'click'"), 100)


@query("""WITH c AS (SELECT user_id AS id, max_by(event_type, event_id) AS op, max_by(value, event_id) FILTER (event_type <> 'view') AS value, max_by(event_type, event_id) FILTER (event_type <> 'view') AS kind FROM events GROUP BY 1),
    b AS (SELECT c_custkey AS id, c_acctbal AS value, c_mktsegment AS kind FROM customer)
    SELECT id, coalesce(c.value, b.value) AS value, coalesce(c.kind, b.kind) AS kind FROM b FULL JOIN c USING (id) WHERE op IS NULL OR op <> 'error'""")  # fmt: skip
def e11_apply_changes(spark, d):
    """Events as change records onto customers: views change nothing, an error last of all deletes."""
    e = table(spark, d, "events")
    seen = F.col("event_type") != "view"
    changes = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.when(seen, F.col("value")).alias("value"), F.when(seen, F.col("event_type")).alias("kind"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("kind"))
    return L.apply_changes(base, changes, columns=("value", "kind"))


@query(sql("SELECT id FROM prompts WHERE project = 'src3' UNION SELECT p.id FROM prompts p JOIN sessions s ON s.id = p.session_id WHERE s.project = 'src3'", "prompts", "sessions"))
def e13_chunk_project_filter(spark, d):
    p = prompts(spark, d)
    direct = p.filter("project = 'src3'").select("id")
    by_session = p.join(sessions(spark, d).filter("project = 'src3'").select(F.col("id").alias("session_id")), "session_id", "left_semi").select("id")
    return direct.union(by_session).distinct()


@query(sql("""SELECT id, project, coalesce(summary, 'none') AS summary, coalesce(revision, 0) AS revision FROM (SELECT id, project, NULL AS summary, NULL AS revision FROM sessions WHERE ended_at IS NULL
    UNION ALL SELECT s.id, s.project, first, n FROM sessions s LEFT JOIN (SELECT session_id, CAST(count(*) AS INTEGER) AS n, min(left(content, 40)) AS first FROM prompts WHERE id % 1000 > 1 GROUP BY 1) p ON p.session_id = s.id WHERE ended_at IS NOT NULL)""", "sessions", "prompts"))  # fmt: skip
def e14_migrate(spark, d):
    """Rows of an old schema (open sessions) under the new one, whose rows (ended sessions) have a summary and a revision of their prompts after the first, if they have any."""
    s = sessions(spark, d)
    told = prompts(spark, d).filter("id % 1000 > 1").groupBy(F.col("session_id").alias("id")).agg(F.min(F.substring("content", 1, 40)).alias("summary"), F.count("*").cast("int").alias("revision"))
    new = s.filter("ended_at IS NOT NULL").select("id", "project").join(told, "id", "left")
    old = s.filter("ended_at IS NULL").select("id", "project")
    return L.migrated(old, new, {"summary": "none", "revision": 0})


@query(sql(r"""SELECT project, n AS rows, left(sha256(CAST(d AS VARCHAR) || '|' || n), 8) AS chunk_id FROM (SELECT project, count(*) AS n,
    sum(CAST(('0x' || left(sha256(id || chr(1) || session_id || chr(1) || content), 15)) AS HUGEINT)) AS d FROM prompts GROUP BY 1)""", "prompts"))  # fmt: skip
def d7_chunk_addresses(spark, d):
    return L.chunk_id(prompts(spark, d), "project", ["id", "session_id", "content"])


@query(sql("""SELECT g.group_id, i.id, i.title FROM (SELECT min(id) AS group_id, unnest(list(id)) AS id FROM items WHERE status = 'candidate' GROUP BY project_id, kind) g JOIN items i USING (id)""", "items"))
def j17_candidate_sources(spark, d):
    """The source records of each group of candidates, one row each; a group is named by its smallest id."""
    i = memory_items(spark, d)
    candidates = i.filter("status = 'candidate'").select("project_id", "kind", "id")
    groups = candidates.groupBy(F.col("project_id").alias("p"), F.col("kind").alias("k")).agg(F.min("id").alias("group_id"))
    same = F.col("project_id").eqNullSafe(F.col("p")) & F.col("kind").eqNullSafe(F.col("k"))
    sources = candidates.join(groups, same).select("group_id", "id")
    return sources.join(i.select("id", "title"), "id").select("group_id", "id", "title")


@query(sql(f"""SELECT id, {S.lookup_sql("kind", {"pattern": "procedure", "glossary": "identity"}, "discovery")} AS kind, 'ported' AS came FROM items WHERE id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT id, kind, 'kept' FROM items WHERE id IN (SELECT doc_id FROM labels)""", "items"))  # fmt: skip
def s16_legacy_port(spark, d):
    """Rows of an old table (all records) that the new one (the labelled) lacks, with their kinds mapped, beside those that it has."""
    i, labelled = memory_items(spark, d).select("id", "kind"), table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return L.ported(i, i.join(labelled, "id", "left_semi"), {"pattern": "procedure", "glossary": "identity"}, "discovery")


@query(sql("""SELECT project, string_agg('- ' || left(content, 80), chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS k FROM prompts) WHERE k <= 5 GROUP BY 1""", "prompts"))
def p8_session_context(spark, d):
    """The five newest prompts of each project as one text."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy(F.desc("created_at"), "id")
    rows = prompts(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 5")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("content", 1, 80).alias("line")))), lambda x: F.concat(F.lit("- "), x["line"]))
    return rows.groupBy("project").agg(F.array_join(lines, "\n").alias("context"))


@query(sql("""SELECT s.id, CAST(coalesce(e.at, s.ended_at) AS VARCHAR) AS ended_at, e.summary FROM sessions s LEFT JOIN
    (SELECT session_id AS id, max(created_at) AS at, max_by(left(content, 30), created_at) AS summary FROM prompts WHERE CAST(substr(session_id, 2) AS INTEGER) % 2 = 0 GROUP BY 1) e USING (id)""", "sessions", "prompts"))  # fmt: skip
def w7_ended_sessions(spark, d):
    """End events, one a prompt of every second session, applied: the last one of a session counts."""
    ends = prompts(spark, d).filter("CAST(substr(session_id, 2) AS INT) % 2 = 0").select(F.col("session_id").alias("id"), F.col("created_at").alias("ended_at"), F.substring("content", 1, 30).alias("summary"))
    return L.ended(sessions(spark, d), ends).select("id", F.col("ended_at").cast("string").alias("ended_at"), "summary")


@query(sql("""SELECT id, access_count + coalesce(n, 0) AS access_count, CAST(greatest(last_accessed, last) AS VARCHAR) AS last_accessed FROM items LEFT JOIN
    (SELECT x AS memory_id, count(*) AS n, max(t) AS last FROM (SELECT DISTINCT event_id, date_trunc('second', ts) AS t, unnest([user_id, user_id + 1, user_id, user_id * 50]) AS x FROM events WHERE event_type = 'click') GROUP BY 1) ON memory_id = id""", "items"))  # fmt: skip
def w14_used_lists(spark, d):
    """Clicks that each name several records, some twice and some that aren't there: counters after all of them."""
    e = table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.date_trunc("second", "ts").alias("ts"), F.expr("array(user_id, user_id + 1, user_id, user_id * 50)").alias("ids"))
    return L.used(e, memory_items(spark, d))[1].select("id", F.col("access_count").cast("long").alias("access_count"), F.col("last_accessed").cast("string").alias("last_accessed"))


@query(sql("""SELECT memory_id, action, count(*) AS n FROM (SELECT memory_id, 'outcome' AS action FROM outcomes WHERE status = 'success' UNION ALL SELECT memory_id, 'outcome' FROM outcomes WHERE status = 'failure'
    UNION ALL SELECT id, 'archive' FROM items WHERE status = 'archived') GROUP BY 1, 2""", "items", "outcomes"))  # fmt: skip
def w18_audit_trail(spark, d):
    """Three batches appended to one trail, one of them twice."""
    folder, o = shared_folder(spark, "audit"), outcomes(spark, d)
    for status in ("success", "failure", "success"):
        L.append_audit(o.filter(F.col("status") == status).select("memory_id", "event_id"), folder, "outcome", "agent", status)
    gone = memory_items(spark, d).filter("status = 'archived'").select(F.col("id").alias("memory_id"), "title")
    return L.append_audit(gone, folder, "archive", "system", "archived").groupBy("memory_id", "action").agg(F.count("*").alias("n"))


@query(sql("SELECT DISTINCT project FROM sessions WHERE ended_at IS NULL ORDER BY project", "sessions"))
def s8_enrolled_projects(spark, d):
    """The table of enrolled projects, written once and read in order."""
    enrolled = sessions(spark, d).filter("ended_at IS NULL").groupBy("project").agg(F.min("started_at").alias("since"))
    return written(enrolled, "enrolled").select("project").orderBy("project")
