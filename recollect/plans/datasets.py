"""Exchange formats, written from the tables and read back: chunks with a manifest, JSON lines, JSON arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import lifecycle as L
from recollect.plans.base import query
from recollect.sources import readers as R
from recollect.sources.scratch import shared_folder
from recollect.sources.tables import prompts, sql, table

_PROMPTS = "id long, session_id string, project string, content string"


def _chunked(spark, d):
    """The prompts of each project as a chunk, in a folder with its manifest; chunks of even projects were there before."""
    rows = prompts(spark, d).select("id", "session_id", "project", "content")
    ids = L.chunk_id(rows, "project", ["id", "session_id", "content"]).select("project", "chunk_id")
    folder = shared_folder(spark, "chunks")
    known = F.col("project").substr(4, 9).cast("int") % 2 == 0
    keyed = rows.join(ids, "project")
    R.write_chunks(keyed.filter(known), folder, "agent0")
    R.write_chunks(keyed, folder, "agent1", R.read_manifest(spark, folder))
    return folder, ids.filter(known).select(F.col("chunk_id").alias("id"))


@query(sql("SELECT id, session_id, project, content FROM prompts WHERE CAST(substr(project, 4) AS INTEGER) % 2 <> 0", "prompts"))
def s10_chunks(spark, d):
    """What the chunks hold that a registry of known ones lacks."""
    folder, known = _chunked(spark, d)
    return R.read_chunks(spark, folder, _PROMPTS, known).drop("chunk_id")


@query(sql("SELECT 'agent' || (CAST(substr(project, 4) AS INTEGER) % 2) AS created_by, count(DISTINCT project) AS chunks, count(*) AS rows FROM prompts GROUP BY 1", "prompts"))
def s11_a13_manifest(spark, d):
    """The manifest of the chunks, by author; chunks that are there already are written and listed once."""
    folder, _ = _chunked(spark, d)
    return R.read_manifest(spark, folder).groupBy("created_by").agg(F.count("*").alias("chunks"), F.sum("rows").alias("rows"))


def _lines(spark, d):
    """A line for each turn, of which every ninth conversation's first is broken off."""
    c = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.col("conv_id").alias("question_id"), F.array(F.struct(F.col("turn").alias("t"), F.col("role").alias("r"))).alias("questions"), F.col("text").alias("body")))
    broken = (F.col("conv_id") % 9 == 0) & (F.col("turn") == 0)
    folder = shared_folder(spark, "lines")
    c.select(F.when(broken, F.substring(line, 1, 15)).otherwise(line).alias("value")).write.text(folder)
    return folder


@query("""SELECT 'fact' AS kind, conv_id, count(*) AS n, sum(turn) AS turns FROM conversations WHERE conv_id % 9 <> 0 OR turn <> 0 GROUP BY conv_id
    UNION ALL SELECT 'bad', -1, count(*), 0 FROM conversations WHERE conv_id % 9 = 0 AND turn = 0""")  # fmt: skip
def s12_json_lines(spark, d):
    """Facts with nested questions, one a line; bad lines are counted and passed over."""
    rows, bad = R.read_lines(spark, _lines(spark, d), "question_id long, questions array<struct<t:bigint,r:string>>, body string")
    each = rows.select("question_id", F.explode("questions").alias("q")).groupBy(F.col("question_id").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("q.t").alias("turns"))
    good = each.select(F.lit("fact").alias("kind"), "conv_id", "n", "turns")
    return good.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), F.lit(-1).cast("long").alias("conv_id"), "n", F.lit(0).cast("long").alias("turns")))


def _arrays(spark, d):
    """Questions over ten conversations each, in files of one JSON array a hundred questions."""
    c = table(spark, d, "conversations")
    said = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("s"))
    group = F.floor(F.col("conv_id") / 10)
    some = said.groupBy(group.alias("question_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("conv_id").cast("string").alias("i"), "s"))).alias("all"))
    record = F.to_json(
        F.struct(
            "question_id", F.transform("all", lambda x: x["i"]).alias("session_ids"), F.transform("all", lambda x: x["s"]).alias("sessions"),
            F.transform(F.filter("all", lambda x: x["i"].cast("long") % 4 == 1), lambda x: x["i"]).alias("answer_ids"),
        )
    )
    files = some.select(F.floor(F.col("question_id") / 100).alias("file"), record.alias("r")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value"))
    folder = shared_folder(spark, "arrays")
    files.repartition("file").write.partitionBy("file").text(folder)
    return folder


_RECORDS = "question_id long, session_ids array<string>, sessions array<string>, answer_ids array<string>"
_SAID = r"SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id // 10 AS question_id, array_to_string(list_filter(regexp_split_to_array(string_agg(text, chr(10) ORDER BY turn), '\s+'), x -> x <> ''), ' ') AS body FROM conversations GROUP BY conv_id"


@query(sql("SELECT session_id, body FROM said WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY sha1(lower(body)) ORDER BY session_id) = 1", said=_SAID))
def s13_array_facts(spark, d):
    return R.sessions_of(R.read_any(spark, _arrays(spark, d), _RECORDS))[0]


@query(sql("""SELECT question_id, count(*) FILTER (hit) AS answers, CAST(greatest(max(k) - max(k) FILTER (hit), 1) AS INTEGER) AS gap FROM
    (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY session_id) AS k, CAST(session_id AS BIGINT) % 4 = 1 AS hit FROM said) GROUP BY 1""", said=_SAID))  # fmt: skip
def s13_array_gaps(spark, d):
    return R.sessions_of(R.read_any(spark, _arrays(spark, d), _RECORDS))[1]


@query("""SELECT 'array' AS found, count(*) AS rows FROM (SELECT DISTINCT conv_id // 10 FROM conversations) UNION ALL SELECT 'lines', count(*) FROM conversations WHERE conv_id % 9 <> 0 OR turn <> 0""")
def s15_detected(spark, d):
    """Both forms read without being told which they are."""
    out = None
    for path, schema in ((_arrays(spark, d), _RECORDS), (_lines(spark, d), "question_id long, body string")):
        found = "array" if R.is_array(spark, path) else "lines"
        one = R.read_any(spark, path, schema).agg(F.count("*").alias("rows")).select(F.lit(found).alias("found"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT id, session_id, project, content FROM prompts", "prompts"))
def u3_chunk_transport(spark, d):
    """All prompts through the chunk data source, in two writes, of which the second leaves out what is known."""
    from recollect.sources import chunks

    chunks.register(spark)
    rows = prompts(spark, d).select("id", "session_id", "project", "content")
    ids = L.chunk_id(rows, "project", ["id", "session_id", "content"]).select("project", "chunk_id")
    keyed, folder = rows.join(ids, "project"), shared_folder(spark, "transport")
    first = F.substring("project", 4, 9).cast("int") % 2 == 0
    save = lambda df, **more: df.repartition("chunk_id").write.format("chunks").options(by="chunk_id", maxBytes=4_096, **more).mode("append").save(folder)
    save(keyed.filter(first), createdBy="agent0")
    save(keyed, createdBy="agent1", known=",".join(sorted({e.id for e in chunks.manifests(folder)})))
    return spark.read.format("chunks").schema(_PROMPTS).option("partitionBytes", 1 << 20).load(folder)
