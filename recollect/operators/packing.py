"""Context packs: candidates, scores and the greedy budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.operators.prefix import running


def candidates(items: DataFrame, requests: DataFrame, globals_: int = 80, projects: int = 140, sessions: int = 60, now: str = S.NOW) -> DataFrame:
    """(request_id, id): the newest live records of the three lanes of each request, each once.

    ``requests``: request_id, project, session. Lanes are cut before requests join them, so a request reads as many rows
    as its lanes hold and no more.
    """
    live = items.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))).select("id", "project_id", "session_id", "scope", "updated_at")
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("updated_at"), "id")
    cut = lambda df, n, *by: df.withColumn("k", F.row_number().over(newest(*by))).filter(F.col("k") <= n)
    # the global lane is one short list: a bounded top-n, then a bounded broadcast
    shared = live.filter("scope = 'global'").orderBy(F.desc("updated_at"), "id").limit(globals_).select("id")
    a = requests.select("request_id").join(F.broadcast(shared))
    b = requests.select("request_id", F.col("project").alias("project_id")).join(cut(live.filter("scope = 'project'"), projects, "project_id").select("project_id", "id"), "project_id").select("request_id", "id")
    c = requests.select("request_id", F.col("session").alias("session_id")).join(cut(live, sessions, "session_id").select("session_id", "id"), "session_id").select("request_id", "id")
    return a.unionByName(b).unionByName(c).distinct()


def score(now: str = S.NOW) -> dict[str, Column]:
    """Components of a candidate's score, over the columns of items, requests (project, session, domain_wanted, asof),
    entity_weight and relation_weight."""
    clock = F.lit(now).cast("timestamp")
    days = lambda c: (F.unix_timestamp(clock) - F.unix_timestamp(c)) / 86400
    age, idle = days("updated_at"), days("last_accessed")
    same_session = F.coalesce(F.col("session_id") == F.col("session"), F.lit(False))
    clamp = lambda v, a, b: F.greatest(F.lit(a), F.least(v, F.lit(b)))
    usage = F.log1p(F.col("access_count").cast("double")) * 0.015 + F.when(idle <= 14, 0.03).when(idle > 120, -0.01).otherwise(0.0)
    unbound = F.col("valid_from").isNull() & F.col("valid_to").isNull()
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("asof"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("asof")))
    return {
        "project_relevance": F.when(F.col("project").isNull(), 0.0).when(F.col("project_id") == F.col("project"), 0.26).when(F.col("scope") == "global", 0.14).otherwise(-0.10),
        "session_relevance": F.when(same_session, 0.36).otherwise(0.0),
        "domain_relevance": F.when(F.col("domain_wanted").isNull(), 0.0).when(F.col("domain") == F.col("domain_wanted"), 0.16).when(F.col("domain") != "", -0.06).otherwise(0.0),
        "kind_priority": S.lookup("kind", S.PACK_KIND, 0.05),
        "classification_weight": F.when(same_session & (F.col("classification") == "observational"), 0.0).otherwise(S.lookup("classification", S.PACK_CLASS, 0.0)),
        "utility_weight_part": clamp(F.col("utility_weight") * 0.04, -0.06, 0.16),
        "structural_weight": clamp(F.coalesce("entity_weight", F.lit(0.0)), 0.0, 0.16),
        "relation_weight_part": clamp(F.coalesce("relation_weight", F.lit(0.0)), -0.06, 0.14),
        "temporal_overlap_boost": F.when(F.col("asof").isNull() | unbound, 0.0).when(holds, 0.07).otherwise(-0.03),
        "usage_weight": clamp(usage, -0.04, 0.10),
        "recency_boost": F.when(age <= 7, 0.08).when(age <= 30, 0.05).when(age <= 90, 0.02).otherwise(0.0),
        "stale_penalty": F.when(age > 365, -0.08).when(age > 180, -0.04).otherwise(0.0),
        "expiry_penalty": F.when(F.col("expires_at") <= clock, -0.40).otherwise(0.0),
        "superseded_penalty": F.when(F.col("status").isin("superseded", "archived"), -0.30).when(F.coalesce("superseded_by", F.lit(0)) != 0, -0.24).otherwise(0.0),
        "low_trust_penalty": F.when(F.lower(F.trim("trust_level")) == "untrusted", -0.05).otherwise(0.0),
    }


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for part in parts.values():
        out = out + part
    return out


def fitting(rows: DataFrame) -> DataFrame:
    """Candidates joined with their request that are of the domain it wants and held at its moment; without a wish all are."""
    held = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("asof"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("asof")))
    return rows.filter((F.col("domain_wanted").isNull() | (F.col("domain") == F.col("domain_wanted"))) & (F.col("asof").isNull() | held))


def explained(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` of candidates with score, score_components (a map), tokens (those of body, unless the rows have them), and from ``verdicts`` included and reason."""
    parts = score()
    told = F.map_from_arrays(F.array(*[F.lit(k) for k in parts]), F.array(*[v.cast("double") for v in parts.values()]))
    out = rows if "tokens" in rows.columns else rows.withColumn("tokens", X.token_estimate("body"))
    out = out.select("*", told.alias("score_components"), F.round(total(parts), 6).alias("score"))
    found = verdicts.select("request_id", "id", F.col("verdict").alias("reason"), (F.col("verdict") != "excluded").alias("included"))
    return out.join(found, ["request_id", "id"])


def greedy(ordered: DataFrame, budget: int, reserve: int = 20, window: int = 200) -> DataFrame:
    """Walk each request's candidates (request_id, place, id, tokens) in order and take what still fits.

    A candidate that doesn't fit is passed over and costs nothing, so this isn't a running sum: the remaining budget is
    folded along the ordered list. One that is at most ``window`` tokens too long is cut to fit while more than 60 tokens are left. A
    request's list is bounded by its lanes. Gives (request_id, id, place, used, verdict).
    """
    row = F.struct("place", "id", "tokens")
    lists = ordered.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    start = F.struct(F.lit(budget - reserve).alias("left"), F.array().cast("array<struct<id:bigint,place:int,used:int,verdict:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        left, tokens = acc["left"], x["tokens"]
        fits = tokens <= left
        cut = ~fits & (tokens <= left + window) & (left > 60)
        used = F.when(fits, tokens).when(cut, left - 50).otherwise(F.lit(0)).cast("int")
        verdict = F.when(fits, "included").when(cut, "truncated").otherwise("excluded")
        entry = F.struct(x["id"].alias("id"), x["place"].alias("place"), used.alias("used"), verdict.alias("verdict"))
        return F.struct((left - used).alias("left"), F.concat(acc["out"], F.array(entry)).alias("out"))

    done = lists.select("request_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("r"))
    return done.select("request_id", "r.id", "r.place", "r.used", "r.verdict")


def prefix_budget(ordered: DataFrame, budget: int, by: list[str], order: list[Column], cost: Column) -> DataFrame:
    """Rows up to the first one with which the running cost of its section passes the budget; costs aren't negative."""
    return running(ordered, by, order, sums={"running": cost}).filter(F.col("running") <= budget)
