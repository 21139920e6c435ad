"""Query strings with operators, envelopes, seeds, imports, embeddings, and what else is written from outside."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import imports as I
from recollect.operators import lifecycle as L
from recollect.operators import search as O
from recollect.operators import vector as V
from recollect.plans.base import query
from recollect.plans.searches import _PARTS, _live, search_terms
from recollect.sources.scratch import written
from recollect.sources.tables import memory_items, outcomes, prompts, sessions, sql, table

_STRINGS = """SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'asof:2023-09-01 ' || text WHEN 1 THEN split_part(text, ' ', 1) || ' since:2023-08-01 ' || substr(text, length(split_part(text, ' ', 1)) + 2)
    WHEN 2 THEN text || ' session:s' || (item_id % 50) WHEN 3 THEN 'file:src' || (item_id % 20) || '/ ' || text || ' path:.py' WHEN 4 THEN 'ingested_asof:2023-12-01 ' || text || ' profile:x'
    ELSE text || ' ingested_asof:2023-12-15 asof:2023-10-01' END AS q FROM benchmark"""
_PARSED = r"""SELECT item_id, nullif(regexp_extract(q, '(?:^|\s)asof:(\S*)', 1), '') AS asof, nullif(regexp_extract(q, '(?:^|\s)since:(\S*)', 1), '') AS since,
    nullif(regexp_extract(q, '(?:^|\s)ingested_asof:(\S*)', 1), '') AS ingested_asof, nullif(regexp_extract(q, '(?:^|\s)session:(\S*)', 1), '') AS session, nullif(regexp_extract(q, '(?:^|\s)file:(\S*)', 1), '') AS file,
    nullif(regexp_extract(q, '(?:^|\s)path:(\S*)', 1), '') AS path, array_to_string(list_filter(regexp_split_to_array(q, '\s+'), x -> x <> '' AND NOT regexp_matches(x, '^(asof|since|ingested_asof|session|file|path):')), ' ') AS terms FROM strings"""


def _strings(spark, d):
    """The texts of ``benchmark`` with operators at the beginning, in the middle or at the end, and words that only look like one."""
    b = table(spark, d, "benchmark")
    k, word, f = F.col("item_id") % 6, F.split_part("text", F.lit(" "), F.lit(1)), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) and y != "text" else y for y in x])
    q = F.when(k == 0, f("asof:2023-09-01 ", "text")).when(k == 1, f(word, " since:2023-08-01 ", F.substring("text", F.char_length(word) + 2, F.char_length("text"))))
    q = q.when(k == 2, f("text", " session:s", F.col("item_id") % 50)).when(k == 3, f("file:src", F.col("item_id") % 20, "/ ", "text", " path:.py"))
    q = q.when(k == 4, f("ingested_asof:2023-12-01 ", "text", " profile:x")).otherwise(f("text", " ingested_asof:2023-12-15 asof:2023-10-01"))
    return b.select("item_id", q.alias("q"))


@query(sql("SELECT * FROM parsed", strings=_STRINGS, parsed=_PARSED))
def f1_query_operators(spark, d):
    out = I.parsed_queries(_strings(spark, d), "q")
    return out.select("item_id", "asof", "since", "ingested_asof", "session", "file", "path", "terms")


_PASSING = f"""SELECT m.* FROM ({_PARTS["matched"]}) m JOIN parsed p ON p.item_id = m.query_id JOIN live i ON i.id = m.id WHERE (p.since IS NULL OR i.updated_at >= CAST(p.since AS TIMESTAMP))
      AND (p.asof IS NULL OR ((valid_from IS NULL OR valid_from <= CAST(p.asof AS TIMESTAMP)) AND (valid_to IS NULL OR valid_to > CAST(p.asof AS TIMESTAMP)))) AND (p.ingested_asof IS NULL OR ingested_at <= CAST(p.ingested_asof AS TIMESTAMP))
      AND (p.session IS NULL OR p.session = session_id) AND (p.file IS NULL OR contains(lower(applies_to_json), lower(p.file))) AND (p.path IS NULL OR contains(lower(applies_to_json), lower(p.path)))"""
_ASKED = {"strings": _STRINGS, "parsed": _PARSED} | _PARTS | {"queries": _PARTS["queries"].replace("text", "terms").replace("benchmark", "parsed"), "matched": _PASSING}


@query(sql("SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10", "items", "outcomes", **_ASKED))
def f1_operator_search(spark, d):
    """The ten best of each query among the records that its operators let pass; others neither match nor rank."""
    strings = written(I.parsed_queries(_strings(spark, d), "q").withColumnRenamed("item_id", "query_id"), "asked")
    facts = memory_items(spark, d).select("id", "valid_from", "valid_to", "updated_at", "ingested_at", "session_id", "applies_to_json")
    docs = _live(spark, d)
    passing = lambda rows: I.matching_operators(rows.join(strings.drop("q", "terms"), "query_id").join(facts, "id"))
    found = O.matches(docs, strings.select("query_id", search_terms("terms").alias("terms")), passing=passing)
    scored = O.relevance(found, docs, outcomes(spark, d)).withColumn("score", F.round("score", 6))
    return O.top(scored, 10).select("query_id", "id", "rank")


_GIVEN = """SELECT id, CASE WHEN id % 40 = 1 THEN '' ELSE title END AS title, body, CASE WHEN id % 10 = 7 THEN 'note' WHEN id % 50 = 3 THEN 'rumour' ELSE kind END AS kind, CASE WHEN id % 5 = 0 THEN '' ELSE scope END AS scope,
    CASE WHEN id % 2 = 0 THEN classification END AS classification, ['CLI', ' mcp', 'import', 'tool', 'passive', NULL][CAST(id % 6 AS INTEGER) + 1] AS client, CASE WHEN id % 3 = 0 THEN 'c0ffee' END AS "commit",
    CASE WHEN id % 4 <> 0 THEN '/home' END AS cwd, CASE WHEN id % 7 = 0 THEN 'Consolidation' END AS written_by FROM items"""


@query(sql(f"""SELECT id, kind, scope, coalesce(classification, {S.lookup_sql("kind", S.CLASS_OF_KIND, "tactical")}) AS classification, w AS written_by, trust, reason,
    CASE WHEN trust = 'low' THEN 'untrusted' WHEN c IN ('tool', 'passive') THEN 'tool' ELSE 'system' END AS trust_level,
    CASE WHEN title = '' OR body = '' OR body IS NULL THEN 'title and content are required' WHEN kind = 'rumour' THEN 'kind' END AS invalid FROM
    (SELECT *, CASE WHEN w IN ('import', 'consolidation') THEN 'low' WHEN "commit" IS NOT NULL AND c IN ('cli', 'mcp') THEN 'high' WHEN cwd IS NOT NULL THEN 'medium' ELSE 'low' END AS trust,
       CASE WHEN "commit" IS NOT NULL AND c IN ('cli', 'mcp') THEN 'commit' WHEN cwd IS NOT NULL THEN 'path' ELSE 'none' END AS reason FROM
      (SELECT id, title, body, CASE kind WHEN 'note' THEN 'discovery' ELSE kind END AS kind, CASE scope WHEN '' THEN 'project' ELSE scope END AS scope, classification, "commit", cwd, lower(trim(coalesce(client, 'unknown'))) AS c,
         coalesce(lower(written_by), CASE lower(trim(coalesce(client, 'unknown'))) WHEN 'cli' THEN 'user' WHEN 'import' THEN 'import' ELSE 'agent' END) AS w FROM given))""", "items", given=_GIVEN))  # fmt: skip
def x10_envelopes(spark, d):
    i = memory_items(spark, d)
    client = F.element_at(F.array(*[F.lit(c) for c in ("CLI", " mcp", "import", "tool", "passive")], F.lit(None).cast("string")), (F.col("id") % 6 + 1).cast("int"))
    when = lambda c, v: F.when(c, v)
    given = i.select(
        "id", F.when(F.col("id") % 40 == 1, "").otherwise(F.col("title")).alias("title"), "body", F.when(F.col("id") % 10 == 7, "note").when(F.col("id") % 50 == 3, "rumour").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.col("scope")).alias("scope"), when(F.col("id") % 2 == 0, F.col("classification")).alias("classification"), client.alias("client"),
        when(F.col("id") % 3 == 0, F.lit("c0ffee")).alias("commit"), when(F.col("id") % 4 != 0, F.lit("/home")).alias("cwd"), when(F.col("id") % 7 == 0, F.lit("Consolidation")).alias("written_by"),
    )
    return I.enveloped(given).select("id", "kind", "scope", "classification", "written_by", "trust", "reason", "trust_level", "invalid")


@query(sql("SELECT id, title, 'active' AS status, utility_weight FROM items UNION ALL SELECT conv_id * 100 + turn + (SELECT max(id) + 1 FROM items), left(text, 60), 'active', 1.0 FROM conversations", "items"))
def w3_bulk_seed(spark, d):
    """All records and, numbered on, the turns of conversations as seeds."""
    i = memory_items(spark, d)
    start = i.agg((F.max("id") + 1).alias("start"))  # one row
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("row"), F.substring("text", 1, 60).alias("title"))
    seeds = I.seeded(c.join(F.broadcast(start)), F.col("start")).select("id", "title", "status", "utility_weight")
    return i.select("id", "title", F.lit("active").alias("status"), "utility_weight").unionByName(seeds)


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN 1 ELSE 0 END AS version, len(embedding) AS dim, round(CASE WHEN vec_id % 10 = 3 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings""")
def w13_embedding_upsert(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    new = v.filter("id % 10 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return I.upserted(v, new).select("id", "version", F.size("embedding").cast("long").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query(sql("""SELECT 'session' AS kind, id, '' AS sync_id FROM sessions WHERE ended_at IS NOT NULL UNION ALL
    SELECT 'prompt', CAST(min(id) AS VARCHAR), sync_id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'given-' || (id // 8 * 8) ELSE 'p-' || left(sha256(id || '|' || content), 16) END AS sync_id FROM prompts WHERE id % 5 <> 0)
      WHERE sync_id NOT IN (SELECT 'given-' || (id // 8 * 8) FROM prompts WHERE id % 10 = 0) GROUP BY sync_id""", "sessions", "prompts"))  # fmt: skip
def w19_import(spark, d):
    """An export, parts of it twice, imported where the open sessions and every tenth prompt are known: what comes in."""
    s = sessions(spark, d)
    p = prompts(spark, d).withColumn("sync_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("given-"), F.floor(F.col("id") / 8) * 8)))
    new = p.filter("id % 5 <> 0")
    fresh, every = I.imported(s.unionByName(s.filter("project = 'src3'")), new.unionByName(new.filter("id % 3 = 0")), s.filter("ended_at IS NULL"), p.filter("id % 10 = 0"))
    return fresh.select(F.lit("session").alias("kind"), "id", F.lit("").alias("sync_id")).unionByName(every.select(F.lit("prompt").alias("kind"), F.col("id").cast("string").alias("id"), "sync_id"))


@query(sql("SELECT id, name, CAST(128 AS INTEGER) AS dim, CASE WHEN body = '' OR NOT regexp_matches(body, '[\\p{L}\\p{Nd}]') THEN 0.0 WHEN name = 'static' THEN round(sqrt(128 * power(0.5 / 128, 2)), 4) ELSE 1.0 END AS norm FROM items, (SELECT unnest(['hashed', 'static']) AS name) WHERE body IS NOT NULL".replace("WHEN body = ''", "WHEN name = 'hashed' AND (body = ''", 1).replace("[\\p{L}\\p{Nd}]') THEN", "[\\p{L}\\p{Nd}]')) THEN", 1), "items"))
def u1_v5_embedders(spark, d):
    """Every record embedded by each embedder of the registry."""
    I.register_embedder("hashed", lambda c: V.hashed_embedding(c, 128))
    I.register_embedder("static", lambda c: V.static_embedding(128))
    out = None
    for name in ("hashed", "static"):
        rows = memory_items(spark, d).filter("body IS NOT NULL").select("id", F.lit(name).alias("name"), I.embedder(name)(F.col("body")).alias("e"))
        one = rows.select("id", "name", F.size("e").alias("dim"), F.round(F.sqrt(V.dot(F.col("e"), F.col("e"))), 4).alias("norm"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT project_id, count(*) AS candidates FROM items WHERE status = 'candidate' GROUP BY 1", "items"))
def a10_candidate_counts(spark, d):
    return memory_items(spark, d).filter("status = 'candidate'").groupBy("project_id").agg(F.count("*").alias("candidates"))


_GROUP = "SELECT project_id, domain, kind, count(*) AS n, min(id) AS first_id, list(id ORDER BY id) AS ids FROM items WHERE status = 'active' AND superseded_by IS NULL AND @ GROUP BY 1, 2, 3 HAVING count(*) >= 3"


@query(sql("SELECT project_id, domain, kind, n, first_id FROM now WHERE ids NOT IN (SELECT ids FROM before)",
    "items", now=_GROUP.replace("@", "true"), before=_GROUP.replace("@", "updated_at < TIMESTAMP '2024-01-05 00:00:00'")))
def d6_new_candidates(spark, d):
    """Groups worth merging that weren't there, record for record, before the year's first days."""
    i = memory_items(spark, d)
    return L.new_groups(i, i.filter(F.col("updated_at") < F.lit("2024-01-05 00:00:00").cast("timestamp"))).select("project_id", "domain", "kind", "n", "first_id")


@query(sql("""SELECT id, CASE WHEN id = first_id THEN 'active' ELSE 'archived' END AS status, CASE WHEN id <> first_id THEN first_id ELSE -1 END AS superseded_by FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n
    FROM items WHERE status = 'active' AND superseded_by IS NULL WINDOW w AS (PARTITION BY project_id, domain, kind)) WHERE n >= 3""", "items"))  # fmt: skip
def e6_consolidated(spark, d):
    """Groups worth merging, merged: the first record of each stands for the others, which are archived."""
    return L.consolidated(memory_items(spark, d)).withColumn("superseded_by", F.coalesce("superseded_by", F.lit(-1)))


@query(sql("""SELECT DISTINCT e.* FROM (SELECT first_id AS from_id, id AS to_id, unnest(['supersedes', 'implements']) AS relation FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n
    FROM items WHERE status = 'active' AND superseded_by IS NULL WINDOW w AS (PARTITION BY project_id, domain, kind)) WHERE n >= 3 AND id <> first_id) e""", "items"))  # fmt: skip
def e6_edges(spark, d):
    gone = L.consolidated(memory_items(spark, d)).filter("superseded_by IS NOT NULL")
    return gone.select(F.col("superseded_by").alias("from_id"), F.col("id").alias("to_id"), F.explode(F.array(F.lit("supersedes"), F.lit("implements"))).alias("relation"))


_TOP = "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS newest FROM items WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00')"
_LINES = """SELECT project_id, id, section, CAST(octet_length(encode('- **' || title || '** (' || kind || ')' || chr(10) || body || chr(10) || chr(10))) // 4 + 1 AS INTEGER) AS tokens,
    row_number() OVER (PARTITION BY project_id ORDER BY section, CASE WHEN classification = 'observational' THEN 1 ELSE 0 END, newest) AS place FROM
    (SELECT *, list_position(['decision', 'pattern', 'bugfix', 'procedure'], kind) AS section FROM newest WHERE newest <= 100) WHERE section > 0"""


@query(sql("SELECT project_id, id, CAST(section AS INTEGER) AS section, CAST(place AS INTEGER) AS place, used FROM walk WHERE taken", "items", newest=_TOP, lines=_LINES,
    walk="""SELECT project_id, id, section, place, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used, tokens <= 2000 AS taken, CASE WHEN tokens <= 2000 THEN 0 ELSE section END AS shut FROM lines WHERE place = 1
      UNION ALL SELECT l.project_id, l.id, l.section, l.place, CASE WHEN t THEN w.used + l.tokens ELSE w.used END, t, CASE WHEN t THEN 0 ELSE l.section END
      FROM walk w JOIN lines l ON l.project_id = w.project_id AND l.place = w.place + 1, LATERAL (SELECT l.section <> w.shut AND w.used + l.tokens <= 2000 AS t)"""))  # fmt: skip
def p7_prime(spark, d):
    """Of the 100 newest records of each project the four known sections, each up to the first line that passes the budget."""
    w = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), "id")
    live = memory_items(spark, d).filter("status = 'active' AND (expires_at IS NULL OR expires_at > timestamp'2024-01-31 00:00:00')")
    rows = live.withColumn("newest", F.row_number().over(w)).filter("newest <= 100").withColumn("section", F.array_position(F.array(*[F.lit(k) for k in ("decision", "pattern", "bugfix", "procedure")]), F.col("kind")).cast("int"))
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), "kind", F.lit(")\n"), "body", F.lit("\n\n"))
    tier = F.when(F.col("classification") == "observational", 1).otherwise(0)
    rows = rows.filter("section > 0").select("project_id", F.struct("section", tier.alias("tier"), "newest", "id", F.floor(F.octet_length(line) / 4 + 1).cast("int").alias("tokens")).alias("r"))
    lists = rows.groupBy("project_id").agg(F.array_sort(F.collect_list("r")).alias("all"))  # at most a hundred
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("shut"), F.array().cast("array<struct<id:bigint,section:int,place:int,used:int>>").alias("out"), F.lit(0).alias("place"))

    def step(acc, x):
        fits = (x["section"] != acc["shut"]) & (acc["used"] + x["tokens"] <= 2000)
        used, place = F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]), acc["place"] + 1
        entry = F.struct(x["id"].alias("id"), x["section"].alias("section"), place.alias("place"), used.alias("used"))
        return F.struct(used.alias("used"), F.when(fits, 0).otherwise(x["section"]).alias("shut"), F.when(fits, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"), place.alias("place"))

    return lists.select("project_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("e")).select("project_id", "e.*")
