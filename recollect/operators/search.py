"""Ranked lexical search in batches: every query of a table against every document, as joins on terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.functions.stems import stems
from recollect.sources.scratch import written


#: The columns of a record that are searched, as far as a table has them.
FIELDS = ("title", "body", "domain")


def _counted(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, dl, term, tf), written: the distinct words of the fields, which a null one has none of; dl is how many there are in all.

    Documents are dealt by id before they are split, so that words are counted where they are split: texts are read and moved once, their
    words never.
    """
    held = [X.tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields if c in docs.columns]
    dealt = docs.select(F.col(id_col).alias("id"), *[c for c in fields if c in docs.columns and c != "id"]).repartition("id")
    words = dealt.select("id", F.concat(*held).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return written(words.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "words")


def postings(docs: DataFrame, id_col: str = "id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(term, id, dl, tf) by stems. Words are counted by document, and distinct words stemmed once."""
    counted = _counted(docs, id_col, fields)
    known = written(stems(counted), "stems")
    return counted.join(known, "term").groupBy(F.col("stem").alias("term"), "id", "dl").agg(F.sum("tf").alias("tf"))


def matches(docs: DataFrame, queries: DataFrame, id_col: str = "id", fields: Sequence[str] = FIELDS, passing: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, hits, bm25, lane) of the documents that hold all terms of a query, or if there are none, any of them.

    ``passing`` takes rows (query_id, id, ...) and keeps those that a query's filters let pass; it is applied to what matches,
    before it is settled whether any document has all terms and before anything is ranked.
    ``queries`` has query_id and terms (an array). Terms meet by stems: the distinct words of documents and queries are stemmed once, and
    those with an asked stem are what postings are made of, which are written; all else reads these. Frequencies and
    lengths are added up over ``fields``. Documents with all terms are found through each query's rarest one. ``lane`` says which it was.
    """
    raw = queries.select("query_id", F.explode("terms").alias("term"))
    asked = raw.join(stems(raw), "term").select("query_id", F.col("stem").alias("term")).distinct()
    asked = written(asked.join(asked.groupBy("query_id").agg(F.count("*").cast("int").alias("n_terms")), "query_id").select("query_id", "n_terms", "term"), "asked")
    counted = _counted(docs, id_col, fields)
    known = written(stems(counted).join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi"), "stems")
    found = counted.join(known, "term").groupBy(F.col("stem").alias("term"), "id", "dl").agg(F.sum("tf").alias("tf"))
    found = written(found, "postings")
    size = docs.agg(F.count("*").cast("double").alias("n")).join(F.broadcast(counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))))  # one row each
    size = size.select("n", F.try_divide("words", "n").alias("avgdl"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(S.IDF_FLOOR))
    weights = written(df.join(F.broadcast(size)).select("term", "df", idf.alias("idf"), "avgdl"), "weights")  # size is one row
    part = F.col("idf") * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("dl") / F.col("avgdl")))
    scored = found.join(weights, "term").select("term", "id", part.alias("part"))
    counted = asked.join(weights.select("term", "df"), "term", "left")
    rarest = counted.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    first = rarest.filter("r.df > 0").select("query_id", F.col("r.term").alias("term")).join(found.select("term", "id"), "term").select("query_id", "id")
    whole = first.join(asked, "query_id").join(scored, ["term", "id"]).groupBy("query_id", "n_terms", "id").agg(F.count("*").alias("hits"), F.sum("part").alias("bm25"))
    passing = passing or (lambda rows: rows)
    whole = written(passing(whole.filter("hits = n_terms").drop("n_terms")).select("query_id", "id", "hits", "bm25"), "whole")
    missing = asked.join(whole.select("query_id").distinct(), "query_id", "left_anti")
    some = missing.join(scored, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"), F.sum("part").alias("bm25"))
    some = passing(some).select("query_id", "id", "hits", "bm25")
    return whole.withColumn("lane", F.lit("all")).unionByName(some.withColumn("lane", F.lit("any")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.groupBy("memory_id").agg(is_("success"), is_("failure"), is_("unknown"))


def boost(now: str = S.NOW) -> Column:
    """Kind, class, recency, outcome and utility boosts of a record joined with its outcome counts."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")) / 86400
    return (
        S.lookup("kind", S.SEARCH_BOOST, 1.0)
        * S.lookup("classification", S.CLASS_BOOST, 1.0)
        * F.when(age <= 7, 1.15).when(age <= 30, 1.05).otherwise(1.0)
        * F.greatest(F.lit(0.1), 1 + 0.2 * F.coalesce("success", F.lit(0)) - 0.3 * F.coalesce("failure", F.lit(0)))
        * F.when(F.col("utility_weight") > 0, F.col("utility_weight")).otherwise(1.0)
    )


def relevance(matches: DataFrame, items: DataFrame, outcomes: DataFrame, now: str = S.NOW) -> DataFrame:
    """(query_id, id, hits, lane, score, updated_at): match quality times boosts. bm25 / (1 + bm25) grows with the match."""
    counts = outcome_counts(outcomes)
    facts = items.join(counts, items["id"] == counts["memory_id"], "left").select("id", "updated_at", boost(now).alias("boost"))
    out = matches.join(facts, "id")
    return out.select("query_id", "id", "hits", "lane", (F.col("bm25") / (1 + F.col("bm25")) * F.col("boost")).alias("score"), "updated_at")


def top(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank; ties end in id."""
    w = Window.partitionBy(by).orderBy(*(order or (F.desc("score"), F.asc("id"))))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap_rank(candidates: DataFrame, queries: DataFrame, text: Column) -> DataFrame:
    """Fallback candidates ranked by the rarity, among the candidates of their query, of the terms that they contain.

    ``candidates``: query_id, id, score and the columns of ``text``; ``queries``: query_id, terms. Up to five candidates
    are ranked by the number of terms alone.
    """
    pairs = candidates.join(queries, "query_id")
    lower = F.lower(text)
    terms = pairs.select("query_id", "id", "score", F.size("terms").alias("n_terms"), F.filter("terms", lambda t: lower.contains(t)).alias("held"))
    per_query = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    df = terms.select("query_id", F.explode("held").alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("df"))
    weight = F.ln(1 + F.col("n") / (1 + F.col("df")))
    each = terms.select("query_id", "id", "score", "n_terms", F.size("held").alias("overlap"), F.explode_outer("held").alias("t"))
    each = each.join(df, ["query_id", "t"], "left").join(per_query, "query_id")
    out = each.groupBy("query_id", "id", "score", "n_terms", "overlap", "n").agg(F.sum(weight).alias("w"))
    out = out.filter(F.col("overlap") >= F.when(F.col("n_terms") >= 12, 2).otherwise(1))
    return out.select("query_id", "id", "overlap", F.when(F.col("n") > 5, F.col("w")).otherwise(F.col("overlap").cast("double")).alias("fallback_score"), "score")
