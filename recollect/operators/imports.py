"""Writes from outside: query strings with operators, envelopes, bulk seeds, imports, embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S

#: Operators of a query string. Each is a word of its own: ``asof:`` within ``ingested_asof:`` or ``file:`` within ``profile:`` is none.
QUERY_OPERATORS = ("asof", "since", "ingested_asof", "session", "file", "path")


def parsed_queries(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``queries`` with a column for each operator (null without it) and ``terms``, what is left of the text.

    An operator begins a word and its value ends with the word. Of repeated ones the first counts; all are taken out. An
    operator without a value sets nothing, and as the end of the text it is a word like any other. The words that are left are
    joined by single spaces.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = {name: F.nullif(F.regexp_extract(text, rf"(?:^|\s){name}:(\S*)", 1), F.lit("")) for name in QUERY_OPERATORS}
    rest = F.regexp_replace(text, rf"(^|\s)(?:{'|'.join(QUERY_OPERATORS)}):(?!$)\S*", " ")
    return queries.withColumns(values | {"terms": F.trim(F.regexp_replace(rest, r"\s+", " "))})


def matching_operators(pairs: DataFrame) -> DataFrame:
    """Of joined queries and records, the rows that the query's operators let pass."""
    at = lambda c: F.try_to_timestamp(F.col(c))
    path = lambda c: F.col(c).isNull() | F.contains(F.lower("applies_to_json"), F.lower(F.col(c)))
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= at("asof"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > at("asof")))
    keep = (F.col("asof").isNull() | holds) & (F.col("since").isNull() | (F.col("updated_at") >= at("since")))
    keep &= F.col("ingested_asof").isNull() | (F.col("ingested_at") <= at("ingested_asof"))
    return pairs.filter(keep & (F.col("session").isNull() | (F.col("session_id") == F.col("session"))) & path("file") & path("path"))


def enveloped(rows: DataFrame) -> DataFrame:
    """``rows`` with written_by, trust, reason, trust_level and, where one can't be written, ``invalid`` saying why.

    Columns read: title, body, kind, scope, classification, client, commit, cwd, written_by (null where unknown).
    """
    client = F.lower(F.trim(F.coalesce("client", F.lit("unknown"))))
    by = F.coalesce(F.lower(F.trim("written_by")), F.when(client == "cli", "user").when(client == "import", "import").otherwise("agent"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    level = F.when(by.isin("import", "consolidation"), "low").when(has("commit") & client.isin(*S.LOCAL_CLIENTS), "high").when(has("cwd"), "medium").otherwise("low")
    reason = F.when(has("commit") & client.isin(*S.LOCAL_CLIENTS), "commit").when(has("cwd"), "path").otherwise("none")
    kind = F.coalesce(S.lookup("kind", S.KIND_ALIAS, ""), F.lit(""))
    kind = F.when(kind != "", kind).otherwise(F.col("kind"))
    scope = F.coalesce(F.nullif("scope", F.lit("")), F.lit("project"))
    wrong = F.when(~has("title") | ~has("body"), "title and content are required").when(~kind.isin(S.KINDS), "kind").when(~scope.isin("project", "global", "task", "personal"), "scope")
    out = rows.withColumn("kind", kind).withColumn("scope", scope).withColumn("classification", F.coalesce("classification", S.lookup("kind", S.CLASS_OF_KIND, "tactical")))
    out = out.withColumn("trust", level).withColumn("reason", reason).withColumn("invalid", wrong)
    told = F.when(F.col("trust") == "low", "untrusted").when(client.isin("tool", "passive"), "tool").otherwise("system")
    return out.withColumn("trust_level", told).withColumn("written_by", by)


def seeded(rows: DataFrame, start: Column) -> DataFrame:
    """Rows of a bulk seed as records: numbered on from ``start``, with a weight of one, uncut and unredacted."""
    return rows.withColumn("id", start + F.col("row")).withColumn("utility_weight", F.lit(1.0)).withColumn("status", F.lit("active")).drop("row")


def imported(sessions: DataFrame, prompts: DataFrame, known: DataFrame, known_prompts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions that are new, prompts that are new), each once, so that importing the same again brings nothing.

    Prompts without a sync id get one from their id and content. A prompt is known if its sync id is; of those that repeat one
    that with the smallest id comes in.
    """
    fresh = sessions.join(known.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])
    sync = F.when(F.coalesce("sync_id", F.lit("")) != "", F.col("sync_id")).otherwise(F.concat(F.lit("p-"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "content"), 256), 1, 16)))
    named = prompts.withColumn("sync_id", sync)
    if known_prompts is not None:
        named = named.join(known_prompts.select("sync_id").distinct(), "sync_id", "left_anti")
    others = [c for c in prompts.columns if c != "sync_id"]
    first = named.groupBy("sync_id").agg(F.min_by(F.struct(*others), F.col("id")).alias("v"))
    return fresh, first.select(*[F.col(f"v.{c}").alias(c) if c != "sync_id" else F.col(c) for c in prompts.columns])


def upserted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """(id, embedding, version): embeddings after an upsert; a new one replaces that of its record."""
    both = vectors.select("id", "embedding", F.lit(0).alias("version")).unionByName(new.select("id", "embedding", F.lit(1).alias("version")))
    return both.groupBy("id").agg(F.max_by(F.struct("embedding", "version"), "version").alias("v")).select("id", "v.*")


_embedders: dict[str, Callable[[Column], Column]] = {}


def register_embedder(name: str, embed: Callable[[Column], Column]) -> None:
    """Make an embedder known: a function from a text column to a column of arrays. It may replace one of its name."""
    _embedders[name] = embed


def embedder(name: str) -> Callable[[Column], Column]:
    if name not in _embedders:
        raise KeyError(f"no embedder {name!r}; there are {sorted(_embedders)}")
    return _embedders[name]
