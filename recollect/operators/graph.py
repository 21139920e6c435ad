"""Relations, entities, lineage and Personalized PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.sources.scratch import written


def both_ways(relations: DataFrame) -> DataFrame:
    """Every relation seen from either end: (id, other, relation). Self loops go."""
    r = relations.filter("from_id <> to_id")
    return r.selectExpr("from_id AS id", "to_id AS other", "relation").unionByName(r.selectExpr("to_id AS id", "from_id AS other", "relation"))


def related(relations: DataFrame, items: DataFrame, relation: str | None = None) -> DataFrame:
    """(id, other, relation): neighbours of every record, in either direction, that exist."""
    edges = both_ways(relations)
    if relation:
        edges = edges.filter(F.col("relation") == relation)
    return edges.join(items.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other", "relation")


def successors(relations: DataFrame, items: DataFrame) -> DataFrame:
    """(id, by): active records on the far end of a supersedes edge."""
    edges = relations.filter("relation = 'supersedes' AND from_id <> to_id").selectExpr("from_id AS id", "to_id AS by").distinct()
    return edges.join(items.filter("status = 'active'").select(F.col("id").alias("by")), "by", "left_semi").select("id", "by")


def replaced_by(items: DataFrame) -> DataFrame:
    """(id, by, title): the active record that each superseded record points at."""
    new = items.filter("status = 'active'").select(F.col("id").alias("by"), F.col("title").alias("by_title"))
    return items.filter(F.coalesce("superseded_by", F.lit(0)) != 0).select("id", F.col("superseded_by").alias("by")).join(new, "by").select("id", "by", "by_title")


def context(links: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k newest records of each entity: (name, id, rank)."""
    rows = links.join(items.select("id", "updated_at"), links["obs_id"] == items["id"])
    w = Window.partitionBy("name").orderBy(F.desc("updated_at"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("name", "id", "rank")


def comentions(links: DataFrame, items: DataFrame, most: int = 16, of: DataFrame | None = None) -> DataFrame:
    """(id, weight): 0.01 for each other live record that shares an entity, up to ``most`` of them.

    Only whether there are ``most`` matters, so for each entity its first ``most + 1`` records stand for all: a record
    always finds ``most`` others there if there are any. No pair of a large entity's records is ever built. Of ``of`` (id), if given, come
    the records that are asked for; the others count as those they share entities with all the same.
    """
    live = links.join(items.filter("status = 'active'").select(F.col("id").alias("obs_id")), "obs_id", "left_semi").distinct()
    w = Window.partitionBy("name").orderBy("obs_id")
    first = live.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most + 1).select("name", F.col("obs_id").alias("other"))
    asked = links if of is None else links.join(of.select(F.col("id").alias("obs_id")), "obs_id", "left_semi")
    pairs = asked.distinct().join(first, "name").filter("obs_id <> other")
    counts = pairs.groupBy("obs_id").agg(F.countDistinct("other").alias("n"))
    return counts.select(F.col("obs_id").alias("id"), F.least(F.col("n") * 0.01, F.lit(0.01 * most)).alias("weight"))


def relation_weight(relations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, weight, degree): summed weights of a record's relations and 0.008 for each, within -0.06 and 0.14; of the records ``of`` (id), if given."""
    w = S.lookup("relation", S.RELATION_WEIGHT, 0.012)
    ends = relations.select(F.col("from_id").alias("id"), w.alias("w")).unionByName(relations.select(F.col("to_id").alias("id"), w.alias("w")))
    ends = ends if of is None else ends.join(of.select("id"), "id", "left_semi")
    sums = ends.groupBy("id").agg(F.sum("w").alias("w"), F.count("*").alias("degree"))
    return sums.select("id", F.greatest(F.lit(-0.06), F.least(F.col("w") + F.col("degree") * 0.008, F.lit(0.14))).alias("weight"), "degree")


def lineage(relations: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, id, hop): what is reached from each start over relations, at its smallest distance."""
    edges = written(both_ways(relations).select("id", "other").distinct())
    seen = start.select(F.col("id").alias("root"), "id").withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges, "id").select("root", F.col("other").alias("id")).distinct()
        front = written(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def adjacency(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): symmetric weights among the nodes of one query each; parallel relations add up."""
    w = S.lookup("relation", S.RELATION_WEIGHT, 0.012)
    edges = both_ways(relations).select(F.col("id").alias("src"), F.col("other").alias("dst"), w.alias("w"))
    inside = edges.join(nodes.select("query_id", F.col("id").alias("src")), "src").join(nodes.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"])
    return inside.groupBy("query_id", "src", "dst").agg(F.sum("w").alias("w"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seed: Column, alpha: float = 0.15, steps: int = 5) -> DataFrame:
    """(query_id, id, ppr) after ``steps`` steps of random walks with restarts, for all queries at once.

    ``nodes``: query_id, id and the columns of ``seed``; ``edges``: query_id, src, dst, w. Mass on nodes without edges
    spreads evenly over their query's nodes. Each step is one join and one aggregate on (query_id, node).
    """
    edges = written(edges)
    raw = nodes.select("query_id", "id", seed.cast("double").alias("seed"))
    totals = raw.groupBy("query_id").agg(F.sum("seed").alias("total"), F.count("*").alias("n"))
    degree = edges.groupBy("query_id", F.col("src").alias("id")).agg(F.sum("w").alias("out"))
    base = raw.join(totals, "query_id").join(degree, ["query_id", "id"], "left").select("query_id", "id", (F.col("seed") / F.col("total")).alias("p"), "n", "out")
    base = written(base)
    state = base.select("query_id", "id", F.col("p").alias("s"))
    for _ in range(steps):
        now = base.join(state, ["query_id", "id"])
        loose = now.filter("out IS NULL").groupBy("query_id").agg(F.sum("s").alias("loose"))
        sent = now.join(edges.withColumnRenamed("src", "id"), ["query_id", "id"]).groupBy("query_id", F.col("dst").alias("id")).agg(F.sum(F.col("s") * F.col("w") / F.col("out")).alias("got"))
        new = base.join(sent, ["query_id", "id"], "left").join(loose, "query_id", "left")
        score = (1 - alpha) * (F.coalesce("got", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) / F.col("n")) + alpha * F.col("p")
        state = written(new.select("query_id", "id", score.alias("s")))  # a step is read twice by the next
    return state.withColumnRenamed("s", "ppr")


def blend(scores: DataFrame, share: float = 0.15) -> DataFrame:
    """(query_id, id, blended): min-max scaled scores mixed with PageRank scaled by its largest, by query."""
    w = Window.partitionBy("query_id")
    low, high, top = F.min("score").over(w), F.max("score").over(w), F.max("ppr").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return scores.select("query_id", "id", ((1 - share) * scaled + share * F.coalesce(F.try_divide("ppr", top), F.lit(0.0))).alias("blended"))
