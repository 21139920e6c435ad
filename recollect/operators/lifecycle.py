"""Versions, decay, archiving, consolidation, the sync journal and merges. Nothing is updated in place: writes append versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.operators.prefix import running


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def latest(versions: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The current row of each key: a max over structs, combined before the shuffle, so a hot key is no heavier."""
    cols = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in cols])


def patched(base: DataFrame, patch: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Base rows with the values of a sparse patch where it has any."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in base.columns])


def revisions(base: DataFrame, patch: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, field, old_value, new_value) of what a patch changes."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = base.join(p, key)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.col(f"__{c}").cast("string").alias("new_value")) for c in columns])
    out = rows.select(key, F.explode(fields).alias("f")).select(key, "f.*")
    return out.filter("new_value IS NOT NULL AND NOT (old_value <=> new_value)")


def prepare_insert(rows: DataFrame) -> DataFrame:
    """Incoming records normalised, cleaned, cut to their kind's limit and given their defaults and idempotency key."""
    kind = F.coalesce(S.lookup("kind", S.KIND_ALIAS, ""), F.lit(""))
    rows = rows.withColumn("kind", F.when(kind != "", kind).otherwise(F.col("kind")))
    body = X.redact(X.strip_private("body"))
    rows = rows.withColumn("title", X.redact(X.strip_private("title"))).withColumn("body", body).withColumn("project_id", X.normal_name("project_id"))
    rows = rows.withColumn("body", X.clip_to_tokens("body", S.lookup("kind", S.BODY_LIMIT, 1000).cast("int")))
    key = F.sha2(F.concat_ws("|", "project_id", F.sha2(F.lower(F.trim(F.regexp_replace("body", r"\s+", " "))), 256), F.lower(F.trim("title"))), 256)
    return rows.withColumn("classification", S.lookup("kind", S.CLASS_OF_KIND, "tactical")).withColumn("idempotency_key", key)


def ended(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """``sessions`` after end events (id, ended_at, summary) have been applied: the last event of a session sets both; others stay as they were."""
    last = ends.groupBy("id").agg(F.max_by(F.struct("ended_at", "summary"), "ended_at").alias("__e"))
    out = sessions.drop("summary").join(last, "id", "left")
    old = F.col("ended_at")
    return out.select(*[F.coalesce("__e.ended_at", old).alias(c) if c == "ended_at" else c for c in sessions.columns if c != "summary"], F.col("__e.summary").alias("summary"))


def used(events: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage rows, items with their counters) after events (event_id, ts, ids): each id of a list that names a record is one row, once an event."""
    rows = events.select("event_id", "ts", F.explode(F.array_distinct("ids")).alias("memory_id")).join(items.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    seen = rows.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("__n"), F.max("ts").alias("__last"))
    counted = items.join(seen, "id", "left").select("id", (F.col("access_count") + F.coalesce("__n", F.lit(0))).alias("access_count"), F.greatest("last_accessed", "__last").alias("last_accessed"))
    return rows.select("event_id", "ts", "memory_id"), counted


def append_audit(rows: DataFrame, folder: str, action: str, actor: str, batch: str) -> DataFrame:
    """Audit rows of what an action did to ``rows`` (memory_id and more), appended under ``folder`` as the part ``batch``; gives the whole trail.

    A part that is written again replaces itself, so a retry doubles nothing.
    """
    rest = [c for c in rows.columns if c != "memory_id"]
    trail = rows.select("memory_id", F.lit(action).alias("action"), F.lit(actor).alias("actor"), F.to_json(F.struct("memory_id", *rest)).alias("snapshot"))
    trail.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return rows.sparkSession.read.parquet(folder)


def ignore_known(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore: rows of ``new`` whose key is new, one for each key (the one with the smallest id)."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    cols = [c for c in fresh.columns if c not in key]
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col("id")).alias("v")).select(*key, "v.*")


def ported(old: DataFrame, new: DataFrame, kinds: dict[str, str], other: str) -> DataFrame:
    """(id, kind, came): rows of an old table that the new one lacks, with their kinds mapped, beside those that it has."""
    missing = old.join(new.select("id"), "id", "left_anti").select("id", S.lookup("kind", kinds, other).alias("kind"), F.lit("ported").alias("came"))
    return missing.unionByName(new.select("id", "kind", F.lit("kept").alias("came")))


def migrated(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of an older schema beside those of a newer one, whose columns they get with their defaults."""
    return new.unionByName(old, allowMissingColumns=True).fillna(defaults)


def archive_expired(items: DataFrame, now: str = S.NOW) -> DataFrame:
    return items.filter((F.col("status") == "active") & (F.col("classification") != "foundational") & (F.col("expires_at") < _now(now)))


def decayed(items: DataFrame, now: str = S.NOW, days: int = 90, factor: float = 0.9) -> DataFrame:
    """(id, utility_weight, decayed): weights of idle records that aren't foundational shrink."""
    idle = F.coalesce("last_accessed", "updated_at") < _now(now) - F.expr(f"interval {days} days")
    hit = (F.col("status") == "active") & (F.col("classification") != "foundational") & idle & (F.col("utility_weight") > 0)
    return items.select("id", F.when(hit, F.round(F.col("utility_weight") * factor, 4)).otherwise(F.col("utility_weight")).alias("utility_weight"), hit.alias("decayed"))


def stale_candidates(items: DataFrame, now: str = S.NOW, days: int = 30) -> DataFrame:
    return items.filter((F.col("status") == "candidate") & (F.col("created_at") < _now(now) - F.expr(f"interval {days} days")))


def low_utility(items: DataFrame, least: float = 0.05) -> DataFrame:
    return items.filter((F.col("status") == "active") & (F.col("classification") != "foundational") & (F.col("utility_weight") > 0) & (F.col("utility_weight") < least))


def maintenance(items: DataFrame, now: str = S.NOW) -> DataFrame:
    """One row of what a maintenance run would do, from one pass."""
    idle = F.coalesce("last_accessed", "updated_at") < _now(now) - F.expr("interval 90 days")
    active = (F.col("status") == "active") & (F.col("classification") != "foundational")
    return items.agg(
        F.count_if(active & (F.col("expires_at") < _now(now))).alias("expired"),
        F.count_if(active & idle & (F.col("utility_weight") > 0)).alias("decayed"),
        F.count_if((F.col("status") == "candidate") & (F.col("created_at") < _now(now) - F.expr("interval 30 days"))).alias("stale_candidates"),
        F.count_if(active & (F.col("utility_weight") > 0) & (F.col("utility_weight") < 0.05)).alias("low_utility"),
    )


def consolidation_groups(items: DataFrame, least: int = 3) -> DataFrame:
    """(project_id, domain, kind, n, newest, titles_sha256): groups of live records worth merging, named by what they hold."""
    live = items.filter("status = 'active' AND superseded_by IS NULL")
    return live.groupBy("project_id", "domain", "kind").agg(
        F.count("*").alias("n"), F.max("updated_at").cast("string").alias("newest"), F.min("id").alias("first_id"), F.countDistinct(F.lower(F.trim("title"))).alias("titles")
    ).filter(F.col("n") >= least)


_GROUP = ["project_id", "domain", "kind"]


def _members(items: DataFrame, least: int) -> DataFrame:
    """(project_id, domain, kind, id, n, first_id): the live records of groups worth merging, with their group's size and first record."""
    live = items.filter("status = 'active' AND superseded_by IS NULL").select(*_GROUP, "id")
    groups = live.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= least)
    groups = groups.select(*[F.col(c).alias(f"__{c}") for c in _GROUP], "n", "first_id")
    same = F.lit(True)
    for c in _GROUP:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return live.join(groups, same).select(*live.columns, "n", "first_id")


def new_groups(items: DataFrame, before: DataFrame, least: int = 3) -> DataFrame:
    """(project_id, domain, kind, n, first_id): groups worth merging whose records aren't exactly those of a group before.

    A record is in one group each time, so the only group before that can have the same records is the one with the same
    first record: it does if it has as many, and all of them are in it.
    """
    now = _members(items, least)
    old = _members(before, least).select("id", F.col("n").alias("old_n"), F.col("first_id").alias("old_first"))
    again = F.coalesce((F.col("old_first") == F.col("first_id")) & (F.col("old_n") == F.col("n")), F.lit(False))
    held = now.join(old, "id", "left").groupBy(*_GROUP, "n", "first_id").agg(F.count_if(again).alias("again"))
    return held.filter("again < n").drop("again")


def consolidated(items: DataFrame, least: int = 3) -> DataFrame:
    """(id, status, superseded_by) of the sources of merged groups: the first stays, the others are archived for it."""
    first = F.col("id") == F.col("first_id")
    return _members(items, least).select("id", F.when(first, "active").otherwise("archived").alias("status"), F.when(~first, F.col("first_id")).alias("superseded_by"))


def feedback_fold(events: DataFrame, start: float = 1.0) -> DataFrame:
    """(memory_id, utility): rewards folded in time order, never below 0.1 on the way.

    The floor makes this a fold, not a sum; it is one all the same over pairs (shift, floor): x -> max(x + shift, floor).
    Such maps compose, so each event is one and a running sum with a running minimum gives their composition: the fold
    ends at sum + max(start, the largest of 0.1 - prefix sums). Sums run over ranges of a record's events (see prefix).
    """
    step = F.greatest(F.lit(-1.0), F.least(F.col("reward"), F.lit(1.0))) * 0.2
    steps = events.select("memory_id", "ts", "event_id", step.alias("__step"))
    sums = running(steps, ["memory_id"], [F.asc("ts"), F.asc("event_id")], sums={"__p": F.col("__step")})
    out = sums.groupBy("memory_id").agg(F.max(F.lit(0.1) - F.col("__p")).alias("need"), F.sum("__step").alias("total"))
    return out.select("memory_id", (F.col("total") + F.greatest(F.lit(start), F.col("need"))).alias("utility"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq", columns: tuple[str, ...] = ()) -> DataFrame:
    """Change records onto a table: the last value of each column that isn't null wins, deletes remove, new keys are added."""
    last = changes.groupBy(key).agg(
        F.max_by("op", seq).alias("__op"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in columns]
    )
    out = base.join(last, key, "full_outer").filter("__op IS NULL OR __op <> 'delete'")
    return out.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def pending(journal: DataFrame, acked: DataFrame, upto: int) -> DataFrame:
    """Journal rows after the acknowledged prefix that weren't acknowledged singly."""
    return journal.filter(F.col("seq") > upto).join(acked.select("seq").distinct(), "seq", "left_anti")


def chunk_id(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """(by, rows, chunk_id): a content address for each chunk that doesn't depend on the order of its rows."""
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    digest = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    out = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(digest).alias("d"))
    return out.select(by, "rows", F.substring(F.sha2(F.concat_ws("|", "d", "rows"), 256), 1, 8).alias("chunk_id"))


def retry(attempts: Column) -> Column:
    """Seconds until a failed job runs again: 5, 10, 20, ... up to 900; null once it has failed six times."""
    return F.when(attempts < 6, F.least(F.lit(5) * F.pow(F.lit(2), attempts - 1), F.lit(900)).cast("long"))
