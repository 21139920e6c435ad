"""Ranked search, vectors, fusion and reranking. Queries are the texts of ``benchmark``, all of them, whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.functions.stems import sql_steps
from recollect.operators import search as O
from recollect.operators import vector as V
from recollect.operators import vector_index
from recollect.operators.prefix import running
from recollect.operators.scans import not_superseded, unexpired
from recollect.plans.base import query
from recollect.sources.tables import memory_items, outcomes, prompts, sql, table

_EDGES = r"""["''.,;:!?()\[\]{}<>]+"""
_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
_FIELDS = rf"list_transform(regexp_split_to_array(lower(@), '\s+'), x -> regexp_replace(regexp_replace(x, '^{_EDGES}', ''), '{_EDGES}$', ''))"
_TOKENS = r"list_filter(regexp_split_to_array(lower(@), '[^\p{L}\p{N}]+'), x -> x <> '')"
_ALL_FIELDS = "coalesce(title, '') || ' ' || coalesce(body, '') || ' ' || coalesce(domain, '')"
_LIVE = "status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00') AND (superseded_by IS NULL OR superseded_by = 0)"
_BOOST = f"""{S.lookup_sql("kind", S.SEARCH_BOOST, 1.0)} * {S.lookup_sql("classification", S.CLASS_BOOST, 1.0)}
    * CASE WHEN date_diff('second', updated_at, TIMESTAMP '2024-01-31 00:00:00') / 86400.0 <= 7 THEN 1.15 WHEN date_diff('second', updated_at, TIMESTAMP '2024-01-31 00:00:00') / 86400.0 <= 30 THEN 1.05 ELSE 1.0 END
    * greatest(0.1, 1 + 0.2 * coalesce(success, 0) - 0.3 * coalesce(failure, 0)) * CASE WHEN utility_weight > 0 THEN utility_weight ELSE 1.0 END"""
_PARTS = {
    "live": f"SELECT * FROM items WHERE {_LIVE}",
    "queries": f"SELECT item_id AS query_id, list_distinct({_TOKENS.replace('@', 'text')}) AS terms FROM benchmark",
    "asked": f"SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM (SELECT query_id, list_filter(terms, x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP})) AS terms FROM queries)",
    "split": f"SELECT id, {_TOKENS.replace('@', _ALL_FIELDS)} AS w FROM live",
    "words": "SELECT id, len(w) AS dl, unnest(w) AS term FROM split",
    "size": "SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM split",
    "said": "SELECT term FROM words UNION SELECT term FROM asked",
    **sql_steps("said"),
    "wanted": "SELECT query_id, stem AS term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, stem FROM asked JOIN stems USING (term))",
    "found": "SELECT stem AS term, id, dl, count(*) AS tf FROM words JOIN stems USING (term) WHERE stem IN (SELECT term FROM wanted) GROUP BY ALL",
    "weights": "SELECT term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM found GROUP BY 1), size",
    "matched": "SELECT query_id, n_terms, id, count(*) AS hits, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM wanted JOIN found USING (term) JOIN weights USING (term) GROUP BY ALL",
    "counts": "SELECT memory_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failure') AS failure FROM outcomes GROUP BY 1",
    "facts": f"SELECT live.*, {_BOOST} AS boost FROM live LEFT JOIN counts ON memory_id = id",
    "lanes": "SELECT *, CASE WHEN query_id IN (SELECT query_id FROM matched WHERE hits = n_terms) THEN 'all' ELSE 'any' END AS lane FROM matched",
    "scored": "SELECT query_id, l.id, hits, lane, round(bm25 / (1 + bm25) * boost, 6) AS score, updated_at FROM lanes l JOIN facts f ON l.id = f.id WHERE lane = 'any' OR hits = n_terms",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored",
}


def _live(spark, d):
    return memory_items(spark, d).filter((F.col("status") == "active") & unexpired() & not_superseded())


def search_terms(text):
    return F.array_distinct(F.filter(X.tokens(text), lambda x: (F.octet_length(x) >= 3) & ~x.isin(S.STOPWORDS)))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), search_terms("text").alias("terms"))


def _scored(spark, d):
    docs = _live(spark, d)
    return O.relevance(O.matches(docs, _queries(spark, d)), docs, outcomes(spark, d)).withColumn("score", F.round("score", 6))


@query(sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, id, hits, lane, score FROM ranked WHERE rank <= 10", "items", "outcomes", **_PARTS))
def search_topk(spark, d):
    """T2, T4 to T9, T11, N4: match all terms or else any, rank by BM25 and boosts, the ten best of each query."""
    return O.top(_scored(spark, d), 10).select("query_id", "rank", "id", "hits", "lane", "score")


@query(sql("""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT stem AS term, id, count(*) AS tf FROM words JOIN stems USING (term) GROUP BY ALL) GROUP BY 1""",
    "items", live=_PARTS["live"], split=_PARTS["split"], words=_PARTS["words"], **sql_steps("words")))
def t1_a14_term_statistics(spark, d):
    return O.postings(_live(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(rf"""WITH f AS (SELECT item_id, list_filter({_FIELDS.replace('@', 'text')}, x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP})) AS kept FROM benchmark)
    SELECT item_id, array_to_string(list_sort(list_distinct(kept)), ' ') AS terms FROM f""")  # fmt: skip
def t2_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.query_terms("text")), " ").alias("terms"))


@query(rf"""WITH f AS (SELECT item_id, unnest(list_filter({_FIELDS.replace('@', 'text')}, x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP}))) AS t FROM benchmark),
    g AS (SELECT item_id, t FROM f UNION SELECT item_id, CASE WHEN t LIKE '%ies' AND octet_length(encode(t)) > 4 THEN left(t, length(t) - 3) || 'y'
      WHEN t LIKE '%es' AND octet_length(encode(t)) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND octet_length(encode(t)) > 3 THEN left(t, length(t) - 1) END FROM f)
    SELECT DISTINCT item_id, t AS term FROM g WHERE t IS NOT NULL AND octet_length(encode(t)) >= 3""")  # fmt: skip
def t3_fallback_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.fallback_terms("text")).alias("term"))


@query(sql(
    """, held AS (SELECT r.query_id, r.id, r.score, len(terms) AS n_terms, list_filter(terms, t -> contains(lower(title || ' ' || body), t)) AS held FROM ranked r JOIN live USING (id) JOIN kept USING (query_id) WHERE rank <= 30),
    per AS (SELECT query_id, count(*) AS n FROM held GROUP BY 1),
    df AS (SELECT query_id, t, count(*) AS df FROM (SELECT query_id, unnest(held) AS t FROM held) GROUP BY ALL),
    w AS (SELECT query_id, id, sum(ln(1 + n / (1.0 + df))) AS w FROM (SELECT query_id, id, unnest(held) AS t FROM held) JOIN df USING (query_id, t) JOIN per USING (query_id) GROUP BY ALL)
    SELECT query_id, id, CAST(len(held) AS INTEGER) AS overlap, round(CASE WHEN n > 5 THEN w ELSE len(held) END, 6) AS fallback_score FROM held JOIN per USING (query_id) JOIN w USING (query_id, id)
    WHERE len(held) >= CASE WHEN n_terms >= 12 THEN 2 ELSE 1 END""".replace(", held AS", "SELECT * FROM (WITH held AS", 1) + ")",
    "items", "outcomes", **_PARTS, kept=f"SELECT query_id, list_filter(terms, x -> octet_length(encode(x)) >= 3 AND x NOT IN ({_STOP})) AS terms FROM queries",
))
def t9_overlap_rank(spark, d):
    best = O.top(_scored(spark, d), 30).select("query_id", "id", "score")
    rows = best.join(_live(spark, d).select("id", "title", "body"), "id")
    out = O.overlap_rank(rows, _queries(spark, d), F.concat_ws(" ", "title", "body"))
    return out.select("query_id", "id", "overlap", F.round("fallback_score", 6).alias("fallback_score"))


@query(sql(rf"""SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank
    FROM (SELECT a.query_id, p.id, count(*) AS hits FROM asked a JOIN (SELECT DISTINCT id, unnest({_TOKENS.replace('@', "content")}) AS term FROM prompts) p USING (term) GROUP BY ALL)) WHERE rank <= 10""",
    "prompts", queries=_PARTS["queries"], asked=_PARTS["asked"]))
def t10_prompt_search(spark, d):
    asked = _queries(spark, d).select("query_id", F.explode("terms").alias("term"))
    words = prompts(spark, d).select("id", F.explode(F.array_distinct(X.tokens("content"))).alias("term"))
    hits = words.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    return O.top(hits, 10, F.desc("hits"), F.asc("id")).select("query_id", "id", "rank")


_COS = "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) > 0 THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 0 END"
_VEC = {
    "v": "SELECT vec_id AS id, list_transform(embedding, x -> x::DOUBLE) AS b FROM embeddings",
    "q": "SELECT id AS query_id, b AS a FROM v WHERE id % 20 = 0",
    "sim": f"SELECT query_id, id, round({_COS}, 6) AS similarity FROM q, v",
    "near": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim WHERE similarity >= 0.12",
}


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("id % 20 = 0").withColumnRenamed("id", "query_id")


@query(sql("SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 10", **_VEC))
def v1_v2_vector_search(spark, d):
    """The vectors with an id divisible by 20 against all vectors."""
    return V.nearest(_vectors(spark, d), _vector_queries(spark, d), 10)


@query(sql("""SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM
    (SELECT query_id, id, round(-list_distance(a, b), 6) + 0.0 AS similarity FROM q, v)) WHERE rank <= 5""", v=_VEC["v"], q=_VEC["q"]))  # fmt: skip
def v3_l2_search(spark, d):
    return V.nearest(_vectors(spark, d), _vector_queries(spark, d), 5, metric="l2")


@query()
def v3_index_search(spark, d):
    """The ten nearest from an inverted-file index of all vectors, to those with an id divisible by 20.

    These vectors have hardly any clusters, so three lists of four are looked into; a test measures the recall.
    """
    index = vector_index.build(_vectors(spark, d))
    return vector_index.search(index, _vector_queries(spark, d), 10, probes=-(-3 * len(index.centroids) // 4))


@query(sql(f"SELECT id, round({_COS}, 6) AS cosine FROM (SELECT id, b, lag(b) OVER (ORDER BY id) AS a FROM v) WHERE a IS NOT NULL", v=_VEC["v"]))
def v1_cosine_of_neighbours(spark, d):
    """Each vector with the one before it in order of ids, whatever gaps the ids have."""
    rows = running(_vectors(spark, d), [], [F.asc("id")], maxima={"before": F.struct("id", "embedding")}, inclusive=False)
    return rows.filter("before IS NOT NULL").select("id", F.round(V.cosine("embedding", "before.embedding"), 6).alias("cosine"))


@query()
def v4_hashed_embedding(spark, d):
    vec = memory_items(spark, d).select("id", V.hashed_embedding(F.col("body"), 64).alias("embedding"))
    return vec.select("id", "embedding", F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 3).alias("norm"))


_MOD = f"""(CASE WHEN utility_weight > 0 THEN utility_weight * 0.004 ELSE 0 END + {S.lookup_sql("kind", S.HYBRID_KIND, 0.0)}
    + CASE classification WHEN 'foundational' THEN 0.002 WHEN 'observational' THEN -0.0015 ELSE 0 END - CASE WHEN status IN ('superseded', 'archived') THEN 0.004 ELSE 0 END
    - CASE WHEN coalesce(superseded_by, 0) <> 0 THEN 0.004 ELSE 0 END - CASE WHEN expires_at < TIMESTAMP '2024-01-31 00:00:00' THEN 0.004 ELSE 0 END - CASE WHEN trust_level = 'untrusted' THEN 0.002 ELSE 0 END
    + CASE WHEN date_diff('second', updated_at, TIMESTAMP '2024-01-31 00:00:00') / 86400.0 <= 7 THEN 0.002 WHEN date_diff('second', updated_at, TIMESTAMP '2024-01-31 00:00:00') / 86400.0 > 180 THEN -0.002 ELSE 0 END)"""


@query(sql(f"SELECT id, round({_MOD}, 6) AS modifier FROM items", "items"))
def v8_modifiers(spark, d):
    return memory_items(spark, d).select("id", F.round(V.modifiers(), 6).alias("modifier"))


_FUSE = _PARTS | {
    "vq": "SELECT item_id AS query_id, list_transform(embedding, x -> x::DOUBLE) AS a FROM benchmark JOIN embeddings ON vec_id = item_id",
    "vsim": f"SELECT query_id, vec_id AS id, round({_COS}, 6) AS similarity FROM vq, (SELECT vec_id, list_transform(embedding, x -> x::DOUBLE) AS b FROM embeddings)",
    "vnear": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM vsim WHERE similarity >= 0.12",
    "lex": "SELECT query_id, id, rank, score / max(score) OVER (PARTITION BY query_id) AS share FROM ranked WHERE rank <= 20",
    "fused": f"""SELECT query_id, id, round(coalesce(1 / (l.rank + 60.0), 0) + coalesce(1 / (n.rank + 60.0), 0) + CASE WHEN l.rank IS NOT NULL THEN 0.010 + 0.004 * share ELSE 0 END + {_MOD}, 6) AS fused, updated_at
        FROM lex l FULL JOIN (SELECT query_id, id, rank FROM vnear WHERE rank <= 20) n USING (query_id, id) JOIN items USING (id)""",
    "best": "SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, updated_at DESC, id) AS rank FROM fused",
}


def _lexical(spark, d):
    return O.top(_scored(spark, d), 20).select("query_id", "id", "rank", "score")


def _hybrid(spark, d, k):
    lexical = _lexical(spark, d)
    asked = table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "embedding")
    near = V.nearest(_vectors(spark, d), asked, 20)
    return V.fuse(lexical, near.select("query_id", "id", "rank"), memory_items(spark, d), k)


@query(sql("SELECT query_id, id, fused, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 10", "items", "outcomes", **_FUSE))
def v7_hybrid_search(spark, d):
    return _hybrid(spark, d, 10)


_RR = rf"list_distinct(list_filter({_FIELDS}, x -> octet_length(encode(x)) >= 2))"


@query(sql("""SELECT query_id, id, round(coalesce(s / nullif(dn * qn, 0), 0), 6) AS cosine FROM sums JOIN qn USING (query_id)""", "items", "outcomes", **_PARTS,
    docs=f"SELECT query_id, id, unnest({_RR.replace('@', 'title || chr(32) || body')}) AS t FROM ranked JOIN (SELECT id, title, body FROM live) USING (id) WHERE rank <= 20",
    n="SELECT query_id, count(DISTINCT id) AS n FROM docs GROUP BY 1", dfs="SELECT query_id, t, count(*) AS df FROM docs GROUP BY ALL",
    q=f"SELECT item_id AS query_id, unnest({_RR.replace('@', 'text')}) AS t FROM benchmark",
    idf="SELECT query_id, t, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf, q.t IS NOT NULL AS asked FROM dfs FULL JOIN q USING (query_id, t) JOIN n USING (query_id)",
    qn="SELECT query_id, sqrt(sum(idf * idf)) AS qn FROM idf WHERE asked GROUP BY 1",
    sums="SELECT query_id, id, sum(CASE WHEN asked THEN idf * idf ELSE 0 END) AS s, sqrt(sum(idf * idf)) AS dn FROM docs JOIN idf USING (query_id, t) GROUP BY ALL"))
def v9_tfidf_rerank(spark, d):
    best = O.top(_scored(spark, d), 20).select("query_id", "id")
    rows = best.join(_live(spark, d).select("id", "title", "body"), "id")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.tfidf_rerank(rows, asked, F.concat_ws(" ", "title", "body")).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query(sql("""SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, score DESC, id) AS INTEGER) AS rank
    FROM (SELECT r.query_id, r.id, r.score, CASE WHEN r.id % 3 = 0 THEN r.id END AS place FROM ranked r WHERE rank <= 10)""", "items", "outcomes", **_PARTS))  # fmt: skip
def v10_external_order(spark, d):
    """Candidates in an order given from outside: here that of the ids divisible by three, the others by score."""
    best = O.top(_scored(spark, d), 10).select("query_id", "id", "score")
    given = best.filter("id % 3 = 0").groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most ten
    return V.order_given(best, given).select("query_id", "id", "rank")


@query(sql("""SELECT r.query_id, r.id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY place NULLS LAST, r.score DESC, r.id) AS INTEGER) AS rank FROM (SELECT * FROM ranked WHERE rank <= 10) r
    LEFT JOIN (SELECT o.query_id, v.id, row_number() OVER (PARTITION BY o.query_id ORDER BY v.similarity DESC, v.id) AS place FROM (SELECT DISTINCT query_id FROM ranked) o
      JOIN (SELECT item_id AS query_id, vec_id AS id, list_dot_product(a, b) AS similarity FROM vq, (SELECT vec_id, list_transform(embedding, x -> x::DOUBLE) AS b FROM embeddings)) v USING (query_id)) p USING (query_id, id)""",
    "items", "outcomes", **_PARTS, vq="SELECT item_id, list_transform(embedding, x -> x::DOUBLE) AS a FROM benchmark JOIN embeddings ON vec_id = item_id"))
def v10_reranked(spark, d):
    """The ten best in the order that another table gives them: that of their vectors' products with the query's vector, others by score."""
    best = O.top(_scored(spark, d), 10).select("query_id", "id", "score")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("b"))
    asked = vectors.select(F.col("id").alias("query_id"), F.col("b").alias("a"))
    pairs = best.select("query_id", "id").join(vectors, "id").join(asked, "query_id").select("query_id", F.struct((-V.dot(F.col("a"), F.col("b"))).alias("s"), "id").alias("v"))
    given = pairs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["id"]).alias("ids"))  # at most ten
    return V.order_given(best, given).select("query_id", "id", "rank")


@query(sql("SELECT query_id, id, score FROM ranked WHERE rank <= 10 AND score >= 0.5 AND query_id IN (SELECT query_id FROM ranked WHERE rank = 1 AND score >= 0.9)", "items", "outcomes", **_PARTS))
def f11_f12_score_floor(spark, d):
    best = O.top(_scored(spark, d), 10)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.withColumn("top", top).filter("score >= 0.5 AND top >= 0.9").select("query_id", "id", "score")
