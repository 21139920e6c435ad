"""Readers and writers of exchange formats: chunks of gzipped JSON lines with a manifest, JSON lines, JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a line that can't be read is put.
CORRUPT = "_corrupt"


def write_chunks(rows: DataFrame, folder: str, created_by: str, known: DataFrame | None = None, by: str = "chunk_id") -> DataFrame:
    """Write rows as gzipped JSON lines under ``folder``/chunks, a folder for each value of ``by``; gives the manifest's entries.

    Chunks of the ids in ``known`` (id) are there already and aren't written again. The manifest is JSON lines, an entry a
    chunk: id, created_by, rows.
    """
    fresh = rows if known is None else rows.join(known.select(F.col("id").alias(by)).distinct(), by, "left_anti")
    fresh.repartition(by).write.mode("append").partitionBy(by).option("compression", "gzip").json(f"{folder}/chunks")
    entries = fresh.groupBy(F.col(by).alias("id")).agg(F.lit(created_by).alias("created_by"), F.count("*").alias("rows"))
    entries.write.mode("append").json(f"{folder}/manifest")
    return read_manifest(rows.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(id, created_by, rows): a manifest of one entry a line, or of one object with a list of them."""
    entry = "id string, created_by string, rows long"
    whole = spark.read.schema(f"{entry}, chunks array<struct<id:string,created_by:string,rows:bigint>>").option("multiLine", not _lines(spark, f"{folder}/manifest")).json(f"{folder}/manifest*")
    listed = whole.filter("chunks IS NOT NULL").select(F.explode("chunks").alias("c")).select("c.*")
    return whole.filter("chunks IS NULL AND id IS NOT NULL").select("id", "created_by", "rows").unionByName(listed)


def _lines(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder of line files rather than one document."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_chunks(spark: SparkSession, folder: str, schema: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of the chunks that the manifest lists and a registry ``known`` (id) lacks, with their chunk_id.

    A listed chunk without files has no rows; a chunk that isn't listed isn't read.
    """
    wanted = read_manifest(spark, folder).select("id").distinct()
    if known is not None:
        wanted = wanted.join(known.select("id"), "id", "left_anti")
    rows = spark.read.schema(f"{schema}, chunk_id string").json(f"{folder}/chunks")
    return rows.join(wanted.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, bad): lines that can't be read come as text in ``bad`` (line); empty lines are nothing."""
    full = T._parse_datatype_string(schema).add(CORRUPT, T.StringType())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col(f"r.{CORRUPT}").alias("line"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether what ``path`` holds begins, after white space, with a bracket: a JSON array, else JSON lines."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_array(spark, path, schema) if is_array(spark, path) else read_lines(spark, path, schema)[0]


def sessions_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of parallel arrays (question_id, session_ids, sessions, answer_ids) as (facts, questions).

    facts: (session_id, body), each session once, and of sessions with the same body (whatever its case) that with the
    smallest id. questions: (question_id, answers, gap): how many answers are among the facts' bodies, and how many
    sessions follow the last answer, one at least; null without any.
    """
    flat = records.select("question_id", "answer_ids", F.posexplode(F.arrays_zip("session_ids", "sessions")).alias("at", "s"))
    body = F.array_join(F.filter(F.split("s.sessions", r"\s+"), lambda x: x != ""), " ")
    flat = flat.select("question_id", "answer_ids", "at", F.col("s.session_ids").alias("session_id"), body.alias("body"))
    facts = flat.filter("body <> ''").groupBy("session_id").agg(F.min("body").alias("body"))
    facts = facts.groupBy(F.sha1(F.lower("body")).alias("h")).agg(F.min(F.struct("session_id", "body")).alias("f")).select("f.*")
    hits = flat.withColumn("hit", F.array_contains("answer_ids", F.col("session_id")))
    gaps = hits.groupBy("question_id").agg(F.max(F.when(F.col("hit"), F.col("at"))).alias("last"), F.max("at").alias("end"), F.count_if("hit").alias("answers"))
    gap = F.greatest(F.col("end") - F.col("last"), F.lit(1))
    return facts, gaps.select("question_id", "answers", gap.alias("gap"))
