"""Text and scalar functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.plans.base import query
from recollect.sources.tables import memory_items, sql, table


def redact_sql(col: str) -> str:
    out = col
    for p in S.SECRET_PATTERNS:
        quoted = p.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '[SECRET]', 'g')"
    return rf"regexp_replace({out}, '(\[SECRET\])+', '[SECRET]', 'g')"


@query(f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def x1_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact("text").alias("redacted"))


@query(r"""SELECT page_id, trim(regexp_replace(h, '(?is)<private>.*?</private>', '[REDACTED]', 'g'), ' ') AS text
    FROM (SELECT page_id, replace(replace(html, '<b>', '<private>'), '<br>', '</private>') AS h FROM pages)""")  # fmt: skip
def x2_strip_private(spark, d):
    h = F.replace(F.replace("html", F.lit("<b>"), F.lit("<private>")), F.lit("<br>"), F.lit("</private>"))
    return table(spark, d, "pages").select("page_id", X.strip_private(h).alias("text"))


@query(r"""SELECT doc_id, CAST(n AS INTEGER) AS words, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(floor(n * 1.35 + 0.5), 1) END AS INTEGER) AS tokens,
    CAST(CASE WHEN text = '' THEN 0 ELSE floor(n * 1.5 + 0.5) END AS INTEGER) AS strict_tokens
    FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), x -> x <> '')) AS n FROM documents)""")  # fmt: skip
def x3_token_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.word_count("text").alias("words"), X.token_estimate("text").alias("tokens"), X.token_estimate("text", 1.5, 0).alias("strict_tokens"))


@query(r"""SELECT doc_id, CASE WHEN greatest(floor(len(w) * 1.35 + 0.5), 1) <= 300 OR text = '' THEN text ELSE array_to_string(w[:CAST(floor(295 / 1.35) AS INTEGER)], ' ') || '... [truncated]' END AS body
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), x -> x <> '') AS w FROM documents)""")  # fmt: skip
def x4_clip_to_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clip_to_tokens("text", 300).alias("body"))


@query(r"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_\-/]{2,}')) AS m FROM documents UNION
      SELECT doc_id, 'date-' || unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) FROM documents UNION
      SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([\w.\-]+)', 1)) FROM documents)
    SELECT doc_id, CASE WHEN contains(name, '/') THEN 'path' WHEN contains(name, 'api') OR contains(name, 'http') THEN 'component' ELSE 'token' END AS type, name
    FROM (SELECT DISTINCT doc_id, lower(m) AS name FROM u WHERE length(m) >= 3)""")  # fmt: skip
def x6_entities(spark, d):
    """Names in whole texts, by rows rather than lists: a long text has many."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(X.entities("text")).alias("name"))
    return rows.select("doc_id", X.entity_type("name").alias("type"), "name")


def _family_sql() -> str:
    parts = " ".join(f"WHEN kind IN ({', '.join(repr(n) for n in names.split())}) THEN '{family}'" for family, names in S.TOPIC_BY_TYPE.items())
    words = " ".join(f"WHEN regexp_matches(lower(title || ' ' || body), '{'|'.join(w)}') THEN '{family}'" for family, w in S.TOPIC_BY_WORD.items())
    return f"CASE {parts} {words} ELSE regexp_replace(kind, '[^a-z0-9]+', '-', 'g') END"


@query(sql(rf"""SELECT id, family || '/' || CASE WHEN s = '' OR s = family THEN 'general' ELSE s END AS topic FROM (SELECT id, family, CASE WHEN starts_with(seg, family || '-') THEN substr(seg, length(family) + 2, 100) ELSE seg END AS s FROM
    (SELECT id, family, left(trim(regexp_replace(CASE WHEN regexp_matches(title, '[A-Za-z0-9]') THEN lower(title) ELSE array_to_string(list_filter(regexp_split_to_array(lower(body), '\s+'), x -> x <> '')[:8], ' ') END, '[^a-z0-9]+', '-', 'g'), '-'), 100) AS seg
     FROM (SELECT *, {_family_sql()} AS family FROM items)))""", "items"))  # fmt: skip
def x8_topic_keys(spark, d):
    return memory_items(spark, d).select("id", X.topic_key("kind", "title", "body").alias("topic"))


@query(sql(f"""SELECT id, {S.lookup_sql("alias", S.KIND_ALIAS, "none")} AS kind FROM (SELECT id, ['learned', 'preference', 'manual', 'note', 'architecture', 'session_summary', 'other'][CAST(id % 7 AS INTEGER) + 1] AS alias FROM items)""", "items"))
def x9_aliases(spark, d):
    names = ["learned", "preference", "manual", "note", "architecture", "session_summary", "other"]
    alias = F.element_at(F.array(*[F.lit(n) for n in names]), F.expr("int(id % 7) + 1"))
    return memory_items(spark, d).select("id", S.lookup(alias, S.KIND_ALIAS, "none").alias("kind"))


@query(sql("SELECT id, CAST(expires_at AS VARCHAR) AS expires_at, CAST(date_diff('day', created_at, expires_at) AS BIGINT) AS days FROM items WHERE expires_at IS NOT NULL", "items"))
def x11_x17_expiry(spark, d):
    i = memory_items(spark, d).filter("expires_at IS NOT NULL")
    return i.select("id", F.col("expires_at").cast("string").alias("expires_at"), F.expr("timestampdiff(DAY, created_at, expires_at)").alias("days"))


@query(r"""SELECT page_id, lower(regexp_replace(p, '/$', '')) AS path, contains(p, '/') AS path_like FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p FROM pages)""")
def x12_paths(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", X.normal_path(p).alias("path"), X.path_like(p).alias("path_like"))


@query(sql(r"""SELECT id, CAST(CASE WHEN a = b THEN 120 WHEN ends_with(a, '/' || b) OR ends_with(b, '/' || a) THEN 100
      WHEN split_part(a, '/', -1) = split_part(b, '/', -1) THEN 75 WHEN fa = fb THEN 22 WHEN starts_with(fa, fb || '/') OR starts_with(fb, fa || '/') THEN 62 WHEN contains(a, b) OR contains(b, a) THEN 48 ELSE 0 END AS INTEGER) AS score
    FROM (SELECT id, a, b, regexp_replace(a, '/[^/]*$', '') AS fa, regexp_replace(b, '/[^/]*$', '') AS fb FROM
      (SELECT id, 'src/' || project_id || '/f' || (id % 20) || '.py' AS a, 'src/src' || (id % 7) || CASE WHEN id % 2 = 0 THEN '/sub' ELSE '' END || '/f' || (id % 5) || '.py' AS b FROM items))""", "items"))  # fmt: skip
def x13_path_scores(spark, d):
    i = memory_items(spark, d)
    a = F.get_json_object("applies_to_json", "$.files[0]")
    b = F.expr("concat('src/src', id % 7, CASE WHEN id % 2 = 0 THEN '/sub' ELSE '' END, '/f', id % 5, '.py')")
    return i.select("id", a.alias("a"), b.alias("b")).select("id", X.path_score("a", "b").alias("score"))


@query(sql("SELECT id, json_extract_string(applies_to_json, '$.files[0]') AS file FROM items", "items"))
def x14_json_paths(spark, d):
    i = memory_items(spark, d)
    files = F.from_json("applies_to_json", "files array<string>")
    return i.select("id", F.explode_outer(files["files"]).alias("file"))


@query(sql("""SELECT id, '### ' || title || chr(10) || body || chr(10) || '[weight: ' || printf('%.2f', utility_weight) || ']' AS section FROM items""", "items"))
def x15_pack_text(spark, d):
    return memory_items(spark, d).select("id", F.format_string("### %s\n%s\n[weight: %.2f]", "title", "body", "utility_weight").alias("section"))


@query(sql("SELECT id, sha256(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) ) AS body_key, left(sha256(project_id), 8) AS project_key FROM items", "items"))
def x16_d3_keys(spark, d):
    body = F.lower(F.trim(F.regexp_replace("body", r"\s+", " ")))
    return memory_items(spark, d).select("id", F.sha2(body, 256).alias("body_key"), F.substring(F.sha2("project_id", 256), 1, 8).alias("project_key"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log1p, round(sqrt(l_extendedprice), 6) AS root, greatest(-0.06, least(l_discount * 2 - 0.05, 0.1)) AS clamped,
    round(log2(l_quantity), 6) AS log2, nullif(l_returnflag, 'N') AS flag FROM lineitem""")  # fmt: skip
def x18_x19_math(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.round(F.log1p("l_quantity"), 6).alias("log1p"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.greatest(F.lit(-0.06), F.least(F.col("l_discount") * 2 - 0.05, F.lit(0.1))).alias("clamped"), F.round(F.log2("l_quantity"), 6).alias("log2"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, left(sha256(url), 12) AS short_hash FROM pages""")
def x20_identity(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.substring(F.sha2("url", 256), 1, 12).alias("short_hash"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'tool_use' WHEN 'error' THEN 'command' ELSE 'file_change' END AS kind FROM events""")
def x21_tool_classes(spark, d):
    kinds = {"view": "file_read", "click": "tool_use", "error": "command"}
    return table(spark, d, "events").select("event_id", S.lookup("event_type", kinds, "file_change").alias("kind"))


_REMOTES = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.git' WHEN 1 THEN 'git@' || replace(regexp_extract(url, '^https?://(.*)$', 1), '/', ':') || '.git' WHEN 2 THEN ' ' || upper(url) || '/ ' WHEN 3 THEN '' ELSE url END AS remote FROM pages"""


@query(sql(r"""SELECT page_id, coalesce(trim(list_filter(regexp_split_to_array(regexp_replace(remote, '\.git$', ''), '[/:]'), x -> x <> '')[-1]), '') AS name, regexp_replace(regexp_replace(lower(trim(remote)), '\.git$', ''), '/+$', '') AS normal,
    CASE WHEN regexp_matches(lower(remote), '[a-z0-9]') THEN regexp_replace(regexp_replace(lower(trim(remote)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE 'unknown' END AS slug,
    left(sha256(regexp_replace(regexp_replace(lower(trim(remote)), '\.git$', ''), '/+$', '')), 8) AS short_hash FROM remotes""", remotes=_REMOTES))  # fmt: skip
def x20_repositories(spark, d):
    """Name, normal form, slug and hash of repositories, whose addresses are those of pages in several spellings."""
    p, k = table(spark, d, "pages"), F.col("page_id") % 5
    ssh = F.concat(F.lit("git@"), F.replace(F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("/"), F.lit(":")), F.lit(".git"))
    remote = F.when(k == 0, F.concat("url", F.lit(".git"))).when(k == 1, ssh).when(k == 2, F.concat(F.lit(" "), F.upper("url"), F.lit("/ "))).when(k == 3, "").otherwise(F.col("url"))
    rows = p.select("page_id", remote.alias("r"))
    return rows.select("page_id", X.repo_name("r").alias("name"), X.normal_remote("r").alias("normal"), X.slug("r").alias("slug"), X.short_hash(X.normal_remote("r")).alias("short_hash"))


_TOOLS = ["write", "edit", "patch", "bash", "read", "view", "grep", "glob", "ls", "fetch", ""]


@query(f"""SELECT event_id, CASE tool WHEN 'write' THEN 'file_change' WHEN 'edit' THEN 'file_change' WHEN 'patch' THEN 'file_change' WHEN 'bash' THEN 'command' WHEN 'read' THEN 'file_read' WHEN 'view' THEN 'file_read'
    WHEN 'grep' THEN 'search' WHEN 'glob' THEN 'search' WHEN 'ls' THEN 'search' ELSE 'tool_use' END AS kind FROM (SELECT event_id, {_TOOLS}[CAST(event_id % 11 AS INTEGER) + 1] AS tool FROM events)""")
def x21_tool_names(spark, d):
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.tool_class(tool).alias("kind"))


_REPLIES = r"""SELECT conv_id, turn, CASE (conv_id + turn) % 6
      WHEN 0 THEN 'Done.' || chr(10) || '## Key Learnings:' || chr(10) || chr(10) || '1. **' || left(t, 30) || '** and `' || right(t, 30) || '` again' || chr(10) || '2) short' || chr(10) || ' 3. *' || t || '* once more'
      WHEN 1 THEN '### Learning' || chr(10) || '1. too few' || chr(10) || '- ' || t || ' kept as a bullet' || chr(10) || '* so is ' || left(t, 20) || '   with spaces' || chr(10) || chr(10) || '# Next' || chr(10) || '- ' || t || ' outside of it'
      WHEN 2 THEN '## Aprendizajes Clave' || chr(10) || '- the first of ' || t || chr(10) || '## Key learnings:  ' || chr(10) || '- nothing'
      WHEN 3 THEN '##  LEARNINGS' || chr(10) || '- an earlier one of ' || t || chr(10) || '## Aprendizajes' || chr(10) || '1. the later one of ' || t
      WHEN 4 THEN '#### Key Learnings' || chr(10) || '- no section at all ' || t || chr(10) || 'see ## Learnings' || chr(10) || '- nor this ' || t
      ELSE text END AS reply FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant')"""
_HEADER = r"(?im)^#{2,3}\s+(?:Aprendizajes(?:\s+Clave)?|Key\s+Learnings?|Learnings?):?\s*$"
_ITEMS = r"""list_filter(list_transform(regexp_extract_all(x, '(?m)^\s*@\s+(.+)', 1), i -> trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(i, '\*\*([^*]+)\*\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\s+', ' ', 'g'))),
    i -> octet_length(encode(i)) >= 20 AND len(string_split(i, ' ')) >= 4)"""
_LEARNED = rf"""SELECT conv_id, turn, unnest(list_filter(list_transform(list_transform(regexp_split_to_array(reply, '{_HEADER}')[2:], s -> regexp_split_to_array(s, '\n#{{1,3}} ')[1]),
    x -> CASE WHEN len({_ITEMS.replace("@", "[0-9]+[.)]")}) > 0 THEN {_ITEMS.replace("@", "[0-9]+[.)]")} ELSE {_ITEMS.replace("@", "[-*]")} END), y -> len(y) > 0)[-1]) AS item FROM replies"""


def replies(spark, d):
    """The replies of conversations, most of them with sections of learnings put about their text."""
    c = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    k, t, join = (F.col("conv_id") + F.col("turn")) % 6, F.col("t"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    reply = F.when(k == 0, join("Done.\n## Key Learnings:\n\n1. **", F.left(t, F.lit(30)), "** and `", F.right(t, F.lit(30)), "` again\n2) short\n 3. *", t, "* once more"))
    reply = reply.when(k == 1, join("### Learning\n1. too few\n- ", t, " kept as a bullet\n* so is ", F.left(t, F.lit(20)), "   with spaces\n\n# Next\n- ", t, " outside of it"))
    reply = reply.when(k == 2, join("## Aprendizajes Clave\n- the first of ", t, "\n## Key learnings:  \n- nothing"))
    reply = reply.when(k == 3, join("##  LEARNINGS\n- an earlier one of ", t, "\n## Aprendizajes\n1. the later one of ", t))
    reply = reply.when(k == 4, join("#### Key Learnings\n- no section at all ", t, "\nsee ## Learnings\n- nor this ", t)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", reply.alias("reply"))


@query(sql("SELECT * FROM learned", replies=_REPLIES, learned=_LEARNED))
def x7_learnings(spark, d):
    """The learnings of every reply, from its last section that has any."""
    return replies(spark, d).select("conv_id", "turn", F.explode(X.learnings("reply")).alias("item"))


@query(sql("""SELECT project, substr(item, 1, 64) AS head, count(*) > 0 AS saved FROM (SELECT 'src' || (conv_id % 20) AS project, item FROM learned) GROUP BY 1, 2""", replies=_REPLIES, learned=_LEARNED))
def z5_passive_capture(spark, d):
    """Learnings captured as replies arrive, in several batches, each once a project by its first 64 characters."""
    from recollect.streaming import flows as Z

    rows = replies(spark, d).select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("project"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("reply").alias("content"))
    stream = Z.staged(rows.withColumn("part", F.pmod(F.col("id"), F.lit(3))), "part")
    out = Z.capture(stream)
    return out.select("project", F.substring("body", 1, 64).alias("head"), (F.col("kind") == "discovery").alias("saved"))


_NESTED = """SELECT id, CASE WHEN id % 11 = 3 THEN '{"files": [' WHEN id % 11 = 5 THEN '[]' ELSE '{"files":["a' || id || '",{" Path ":["b' || id || '",7,null]}],"meta":{"note":"c/' || id || '","plain":"d","deep":[[{"x":{"renamed_to":"e' || id || '"}}]]},"file":"' || project_id || '"}' END AS j FROM items"""


@query(sql("""SELECT id, key, value, CAST(depth AS INTEGER) AS depth FROM (SELECT id, unnest([{'key': 'files', 'value': 'a' || id, 'depth': 2}, {'key': 'path', 'value': 'b' || id, 'depth': 4}, {'key': 'note', 'value': 'c/' || id, 'depth': 2},
    {'key': 'renamed_to', 'value': 'e' || id, 'depth': 6}, {'key': 'file', 'value': project_id, 'depth': 1}]) AS r FROM items WHERE id % 11 NOT IN (3, 5)), LATERAL (SELECT r.key AS key, r.value AS value, r.depth AS depth)""", "items"))  # fmt: skip
def x14_path_hints(spark, d):
    """Paths at any depth of nested JSON: strings under a key that names paths, and others that look like one."""
    from recollect.operators.json_walk import path_hints

    i = memory_items(spark, d)
    text = F.concat(F.lit('{"files":["a'), "id", F.lit('",{" Path ":["b'), "id", F.lit('",7,null]}],"meta":{"note":"c/'), "id", F.lit('","plain":"d","deep":[[{"x":{"renamed_to":"e'), "id", F.lit('"}}]]},"file":"'), "project_id", F.lit('"}'))
    rows = i.select("id", F.when(F.col("id") % 11 == 3, '{"files": [').when(F.col("id") % 11 == 5, "[]").otherwise(text).alias("j"))
    return path_hints(rows, "j")


@query("""SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM events WHERE event_id % 7 <> 3""")
def x16_sync_payloads(spark, d):
    """Payloads of a journal, every second of them encoded twice, every seventh broken off."""
    from recollect.operators.json_walk import decoded

    e = table(spark, d, "events").withColumn("once", F.to_json(F.struct("event_id", "event_type", "value")))
    twice = F.concat(F.lit('"'), F.replace(F.col("once"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    payload = F.when(F.col("event_id") % 7 == 3, F.substring("once", 1, 9)).when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), twice)).otherwise(F.col("once"))
    return e.select(decoded(payload, "event_id long, event_type string, value double").alias("p")).filter("p IS NOT NULL").select("p.*")


@query(r"""SELECT conv_id, turn, item FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n')) AS item FROM conversations WHERE role = 'assistant')
    WHERE octet_length(encode(item)) >= 20 AND len(list_filter(regexp_split_to_array(item, '\s+'), x -> x <> '')) >= 4""")  # fmt: skip
def x7_z5_learnings(spark, d):
    """Lines of replies that are long enough to be learned."""
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    rows = c.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("item"))
    return rows.filter((F.octet_length("item") >= S.LEARNING_BYTES) & (X.word_count("item") >= S.LEARNING_WORDS))
