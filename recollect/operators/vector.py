"""Vector search, rank fusion and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.sources.scratch import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    whole = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (whole > 0), dot(a, b) / whole).otherwise(0.0)


#: Rows of a block of queries and of vectors, and the fewest of a block of vectors; cells of similarities held at once.
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCK = 4_096, 1 << 16, 1 << 11
_CELLS = 1 << 22
_NEAR = "query_id long, id long, similarity double"


def best_of_unit(queries: pa.Table, vectors: pa.Table, k: int, metric: str, floor: float) -> pa.Table:
    """(query_id, id, similarity) of the k nearest vectors of one block to each query of another, with all ties of the k-th.

    Vectors are compared with queries of their own length only; a null entry counts as zero.
    """
    found = []
    sizes = [pc.fill_null(pc.list_value_length(t.column("embedding")), -1).to_numpy() for t in (queries, vectors)]
    for wide in np.intersect1d(*map(np.unique, sizes)):
        if wide < 0:
            continue
        q_rows, v_rows = (t.filter(pa.array(size == wide)) for t, size in zip((queries, vectors), sizes, strict=True))
        asked, own = q_rows.column("query_id").to_numpy(), v_rows.column("id").to_numpy()
        q, x = (_matrix(t.column("embedding"), int(wide)) for t in (q_rows, v_rows))
        q_square, x_square = (q * q).sum(1), (x * x).sum(1)
        step = max(1, _CELLS // len(x))
        for i in range(0, len(q), step):
            dots = q[i : i + step] @ x.T
            if metric == "cosine":
                whole = np.sqrt(q_square[i : i + step, None]) * np.sqrt(x_square[None, :])
                sim = np.where(whole > 0, dots / np.where(whole > 0, whole, 1), 0.0)
            else:
                sim = -np.sqrt(np.maximum(0, q_square[i : i + step, None] + x_square[None, :] - 2 * dots))
            some = min(k, sim.shape[1])
            kth = np.partition(sim, -some, axis=1)[:, -some]
            # the exact order of ties is settled after rounding
            a, b = np.nonzero((sim >= kth[:, None] - 1e-9) & (sim >= (floor if metric == "cosine" else -np.inf)))
            found.append((asked[i : i + step][a], own[b], sim[a, b]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})


def k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query after rounding, ties by id."""
    found = found.withColumn("similarity", F.round("similarity", 6) + 0.0)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, floor: float = S.VECTOR_FLOOR, metric: str = "cosine") -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of all vectors to each query, exactly.

    ``vectors``: id, embedding; ``queries``: query_id, embedding, any number, each id once. Both are cut into blocks, and each block
    of queries meets each block of vectors as one group of bounded size: a row is copied once for each block of the other side, so
    blocks are large. A group is a matrix product, from which only k rows a query leave. No row passes through the driver.
    ``metric`` cosine keeps similarities of at least ``floor``; l2 gives negated distances.
    """
    spark = vectors.sparkSession
    numbered = lambda df, name: written(df.filter("embedding IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()), name)
    v, q = numbered(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "vectors"), numbered(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"), "queries")
    n, m = v.count(), q.count()
    spare = 3 * spark.sparkContext.defaultParallelism
    down = max(1, -(-n // min(VECTOR_BLOCK, max(LEAST_BLOCK, -(-n // spare)))))
    across = max(1, -(-m // QUERY_BLOCK))
    own = lambda blocks: F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    units = min(across * down, 20_000)
    a = q.withColumn("__i", own(across)).withColumn("__j", every(down)).drop("__row").repartition(units, "__i", "__j")
    b = v.withColumn("__i", every(across)).withColumn("__j", own(down)).drop("__row").repartition(units, "__i", "__j")
    unit = lambda x, y: best_of_unit(x, y, k, metric, floor)
    return k_best(a.groupBy("__i", "__j").cogroup(b.groupBy("__i", "__j")).applyInArrow(unit, _NEAR), k)


def _matrix(lists: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    """Lists of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float) if len(lists) else np.zeros(0)
    return np.nan_to_num(flat, copy=False).reshape(len(lists), wide)


def modifiers(now: str = S.NOW) -> Column:
    """What a record's kind, class, state, trust and age add to a fused score."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")) / 86400
    return (
        F.when(F.col("utility_weight") > 0, F.col("utility_weight") * 0.004).otherwise(0.0)
        + S.lookup("kind", S.HYBRID_KIND, 0.0)
        + F.when(F.col("classification") == "foundational", 0.002).when(F.col("classification") == "observational", -0.0015).otherwise(0.0)
        - F.when(F.col("status").isin("superseded", "archived"), 0.004).otherwise(0.0)
        - F.when(F.coalesce("superseded_by", F.lit(0)) != 0, 0.004).otherwise(0.0)
        - F.when(F.col("expires_at") < F.lit(now).cast("timestamp"), 0.004).otherwise(0.0)
        - F.when(F.col("trust_level") == "untrusted", 0.002).otherwise(0.0)
        + F.when(age <= 7, 0.002).when(age > 180, -0.002).otherwise(0.0)
    )


def fuse(lexical: DataFrame, vectors: DataFrame, items: DataFrame, k: int, constant: int = S.RRF_CONSTANT, now: str = S.NOW) -> DataFrame:
    """Reciprocal rank fusion of two ranked lanes: (query_id, id, fused, rank).

    ``lexical``: query_id, id, rank, score; ``vectors``: query_id, id, rank.
    """
    best = lexical.groupBy("query_id").agg(F.max("score").alias("best"))
    left = lexical.join(best, "query_id").select("query_id", "id", F.col("rank").alias("lr"), F.coalesce(F.try_divide("score", "best"), F.lit(0.0)).alias("share"))
    both = left.join(vectors.select("query_id", "id", F.col("rank").alias("vr")), ["query_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.col(r) + F.lit(constant)), F.lit(0.0))
    score = part("lr") + part("vr") + F.when(F.col("lr").isNotNull(), 0.010 + 0.004 * F.col("share")).otherwise(0.0) + modifiers(now)
    fused = both.join(items, "id").select("query_id", "id", F.round(score, 6).alias("fused"), "updated_at")
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("updated_at"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("updated_at")


def tfidf_rerank(candidates: DataFrame, queries: DataFrame, text: Column) -> DataFrame:
    """(query_id, id, cosine): TF-IDF likeness of each candidate to its query, with frequencies among its rivals.

    ``candidates``: query_id, id and the columns of ``text``; ``queries``: query_id, text. A term counts once a text, so
    its weight is its rarity ln((n + 1) / (df + 1)) + 1.
    """
    docs = candidates.select("query_id", "id", X.rerank_terms(text).alias("terms"))
    n = docs.groupBy("query_id").agg(F.count("*").alias("n"))
    terms = docs.select("query_id", "id", F.explode_outer("terms").alias("t"))
    df = terms.filter("t IS NOT NULL").groupBy("query_id", "t").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(X.rerank_terms("text")).alias("t")).withColumn("asked", F.lit(True))
    idf = F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weights = df.join(asked, ["query_id", "t"], "full_outer").join(n, "query_id").select("query_id", "t", idf.alias("idf"), "asked")
    norm = weights.filter("asked").groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qn"))
    squared = F.col("idf") * F.col("idf")
    sums = terms.join(weights, ["query_id", "t"], "left").groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("asked"), squared).otherwise(0.0)).alias("both"), F.sqrt(F.sum(F.coalesce(squared, F.lit(0.0)))).alias("dn")
    )
    return sums.join(norm, "query_id", "left").select("query_id", "id", F.coalesce(F.try_divide("both", F.col("dn") * F.col("qn")), F.lit(0.0)).alias("cosine"))


def order_given(candidates: DataFrame, given: DataFrame) -> DataFrame:
    """Candidates in an order that came from outside (query_id, ids); those it doesn't name follow by score."""
    places = given.select("query_id", F.posexplode("ids").alias("place", "id"))
    out = candidates.join(places, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).drop("place")


def hashed_embedding(texts: Column, dim: int = 128) -> Column:
    """A text's words hashed (FNV-1a, 64 bits) into ``dim`` signed places, earlier words more, scaled to length one."""

    def embed(series):
        import pandas as pd
        import regex

        word = regex.compile(r"[\p{L}\p{Nd}]+")
        known: dict[str, int] = {}

        def fnv(token: str) -> int:
            h = 0xCBF29CE484222325
            for byte in token.encode():
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            return h

        def placed(token: str) -> int:
            """Twice the place, and one more if it is a negative one."""
            p = known.get(token)
            if p is None:
                if len(known) > 200_000:
                    known.clear()
                h = fnv(token)
                p = known[token] = h % dim * 2 + (h >> 63)
            return p

        out = []
        for text in series:
            v = np.zeros(dim, np.float32)
            places = np.array([placed(t) for t in word.findall((text or "").lower())], np.int64)
            if len(places):
                parts = np.where(places & 1, -1.0, 1.0) / np.sqrt(np.arange(1, len(places) + 1))
                np.add.at(v, places >> 1, parts.astype(np.float32))  # in order, as rounding depends on it
            norm = float(np.sqrt((v.astype(float) ** 2).sum()))
            out.append((v / np.float32(norm) if norm else v).tolist())
        return pd.Series(out)

    return F.pandas_udf(embed, "array<float>")(texts)


def static_embedding(dim: int = 128) -> Column:
    return F.array_repeat(F.lit(0.5 / dim).cast("float"), dim)
