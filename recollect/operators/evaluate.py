"""Retrieval quality from ranked results and relevant documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.sources.scratch import written


def containing(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, id) of documents (id, text) that contain a phrase (query_id, lead).

    Texts and phrases are cut at single spaces and nowhere else. A phrase may begin and end inside other pieces, but its pieces between the
    first and the last are whole pieces of any document that contains it: a phrase meets documents on the rarest of these. Phrases of
    one or two pieces meet documents on the pieces that their last one is part of, as ``_short_phrases`` finds them. Of the pieces of
    documents only those that a phrase asks for go on. Texts come in when pairs are known. What is found is written, as evaluations read
    it several times.
    """
    pieces = lambda c: F.split(F.col(c), " ")
    asked = written(phrases.filter("lead IS NOT NULL").select("query_id", "lead", pieces("lead").alias("w")), "phrases")
    inner = asked.filter(F.size("w") > 2).select("query_id", F.explode(F.array_distinct(F.expr("slice(w, 2, size(w) - 2)"))).alias("term"))
    short = asked.filter(F.size("w") <= 2)
    split = docs.select("id", F.explode(F.array_distinct(pieces("text"))).alias("term"))
    some = None if short.isEmpty() else written(_short_phrases(split.select("term").distinct(), short), "short")
    terms = inner.select("term") if some is None else inner.select("term").union(some.select("term"))
    held = written(split.join(terms.distinct(), "term", "left_semi"), "words")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    # a piece that no document has rules its phrase out
    rare = inner.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).filter("r.df > 0")
    met = rare.select("query_id", F.col("r.term").alias("term")).join(held, "term").select("query_id", "id")
    if some is not None:
        met = met.unionByName(some.join(held, "term").select("query_id", "id").distinct())
    met = written(met, "met")
    both = met.join(docs.select("id", "text"), "id").join(asked.select("query_id", "lead"), "query_id")
    return written(both.filter(F.contains("text", "lead")).select("query_id", "id"), "relevant")


def _short_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, term): the pieces, of distinct ones (term), that the last piece of a phrase (query_id, w) of one or two may be part of.

    The last piece of a phrase of two begins a piece, and one of one may lie inside a piece. They meet on its first three characters, or
    all, at any place of pieces. Each distinct piece is cut once, however many documents have it.
    """
    last = F.element_at("w", -1)
    p = phrases.select("query_id", (F.size("w") == 1).alias("inside"), last.alias("last"), F.substring(last, 1, 3).alias("part"))
    sizes = F.broadcast(p.select(F.char_length("part").alias("n")).distinct())  # 0 to 3
    places = words.select("term", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("term"), F.lit(1)))).alias("at"))
    parts = places.join(sizes).select("term", F.substring("term", F.col("at"), F.col("n")).alias("part"))
    fits = F.startswith("term", "last") | (F.col("inside") & F.contains("term", "last"))
    return parts.join(p, "part").filter(fits).select("query_id", "term").distinct()


def per_query(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, first_rank, found, relevant, rr, ndcg) at k for each query that has relevant documents."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.join(relevant, ["query_id", "id"])
    gain = F.when(F.col("rank") <= k, 1 / F.log2(1.0 + F.col("rank"))).otherwise(0.0)
    got = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(1.0 + i))
    out = n.join(got, "query_id", "left")
    return out.select(
        "query_id", F.coalesce("first", F.lit(0)).alias("first_rank"), F.coalesce("found", F.lit(0)).alias("found"), "relevant",
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def summary(cases: DataFrame, *by: str) -> DataFrame:
    at = lambda k: F.round(F.avg(F.when((F.col("first_rank") > 0) & (F.col("first_rank") <= k), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return cases.groupBy(*by).agg(F.count("*").alias("queries"), at(1), at(3), at(5), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def gates(summary_: DataFrame, floors: dict[str, float]) -> DataFrame:
    rows = summary_.unpivot([], list(floors), "gate", "value")
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]), F.col("gate"))
    return rows.select("gate", "value", (F.col("value") >= floor).alias("passed"))


def guards(rows: DataFrame, k: int, now: str = S.NOW) -> DataFrame:
    """(guard, share): places of the k best (query_id, project and the record's columns) that go to the wrong records."""
    stale = F.count_if(F.col("expires_at") <= F.lit(now).cast("timestamp"))
    old = F.count_if(F.col("status").isin("archived", "superseded") | (F.coalesce("superseded_by", F.lit(0)) != 0))
    one = rows.agg(stale.alias("stale"), old.alias("superseded"), F.count_if(F.col("project_id") != F.col("project")).alias("wrong_project"), F.countDistinct("query_id").alias("cases"))
    out = one.unpivot(["cases"], ["stale", "superseded", "wrong_project"], "guard", "hits")
    return out.select("guard", F.round(F.col("hits") / (float(k) * F.col("cases")), 6).alias("share"))


def abstention(queries: DataFrame, best: DataFrame, floor: float) -> DataFrame:
    """(score, cases, value): the share of queries that should find nothing whose best result is under the floor."""
    top = queries.join(best, "query_id", "left").groupBy("query_id").agg(F.max("score").alias("best"))
    right = F.when(F.col("best") >= floor, 0.0).otherwise(1.0)
    return top.agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg(right), F.lit(1.0)), 6).alias("value")).select(F.lit("abstention").alias("score"), "cases", "value")


def required(cases: DataFrame) -> DataFrame:
    """(score, cases, value): hits over those required, each query's hits counting as far as it requires them."""
    share = F.sum(F.least("found", "relevant")).cast("double") / F.sum("relevant")
    return cases.agg(F.count("*").alias("cases"), F.round(share, 6).alias("value")).select(F.lit("required").alias("score"), "cases", "value")


def within_budget(packs: DataFrame, budget: int) -> DataFrame:
    """(score, cases, value): the share of packs (pack, tokens) whose tokens together keep to the budget."""
    one = packs.groupBy("pack").agg(F.sum("tokens").alias("tokens"))
    return one.agg(F.count("*").alias("cases"), F.round(F.avg(F.when(F.col("tokens") <= budget, 1.0).otherwise(0.0)), 6).alias("value")).select(F.lit("pack").alias("score"), "cases", "value")


def neighbours_found(found: DataFrame, expected: DataFrame, least: int = 1) -> DataFrame:
    """(score, cases, value): hits (case, id) among those expected (case, id), each case's counting up to ``least``, over those required."""
    required_ = F.least(F.col("n"), F.lit(least))
    n = expected.groupBy("case").agg(F.count("*").alias("n"))
    hits = expected.join(found.select("case", "id").distinct(), ["case", "id"], "left_semi").groupBy("case").agg(F.count("*").alias("h"))
    rows = n.join(hits, "case", "left")
    return rows.agg(F.count("*").alias("cases"), F.round(F.sum(F.least(F.coalesce("h", F.lit(0)), required_)).cast("double") / F.sum(required_), 6).alias("value")).select(F.lit("hits").alias("score"), "cases", "value")


def audit(rows: DataFrame) -> DataFrame:
    """One row over (query_id, q, t): the terms of queries against those of the titles that they should find."""
    best = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max(X.jaccard(F.col("q"), F.col("t"))).alias("best"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return best.agg(
        F.count("*").alias("cases"), F.round(F.avg("best"), 6).alias("average_overlap"), F.round(F.max("best"), 6).alias("most_overlap"),
        rate(F.col("n") == 1).alias("weak_distractors"), rate(F.col("best") >= 0.7).alias("high_overlap"),
    )


def sweep(modes: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """(mode, queries, recall_5, mrr) of several ways of retrieval (query_id, id, rank) on the same relevant documents."""
    out = None
    for mode, ranked in modes.items():
        first = relevant.select("query_id").distinct().join(ranked.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
        hit = F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)
        one = first.agg(F.count("*").alias("queries"), F.round(F.avg(hit), 6).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
        one = one.select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def precision(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    share = F.coalesce(F.col("h"), F.lit(0)) / float(k)
    return queries.join(hits, "query_id", "left").agg(F.count("*").alias("queries"), F.round(F.avg(share), 6).alias(f"precision_{k}"))


def worst(cases: DataFrame, n: int) -> DataFrame:
    """A report of the n worst queries: relevant documents missed, then how late the first came."""
    late = F.when(F.col("first_rank") == 0, 1.0).otherwise((F.col("first_rank") - 1) / 10.0)
    rows = cases.select("query_id", F.round((F.col("relevant") - F.col("found")) / F.col("relevant") + late, 6).alias("severity")).filter("severity > 0")
    top = rows.orderBy(F.desc("severity"), "query_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), "query_id"))).select("query_id", "place", "severity")


def judged(rows: DataFrame, judge, query_col: str, retrieved_col: str, expected_col: str) -> DataFrame:
    """``rows`` with the score of any judge: a Python function of (query, retrieved, expected), called in batches."""
    from pyspark.sql import types as T

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (query_col, retrieved_col, expected_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(judge(*x)) for x in zip(*cols, strict=True)], pa.float64())], [*batch.schema.names, "judged"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("judged", T.DoubleType())]))
