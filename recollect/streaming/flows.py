"""Streams over append-only event tables. Each runs on any trigger; the registered queries drain what is there and stop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions import text as X
from recollect.sources.scratch import shared_folder, written

LEVELS = ["off", "prompts", "metadata", "tools", "full"]


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, so that the table may be one file or a folder of them
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/[e]vents.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def staged(rows: DataFrame, part: str) -> DataFrame:
    """``rows`` as a stream of one file for each value of ``part``, in its order: each is a batch of its own."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "staged")
    held = written(rows, "parts")
    for value in sorted(r[0] for r in held.select(part).distinct().collect()):  # a stage setting, of few values
        held.filter(F.col(part) == value).drop(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that were written whole under ``folder``/out, as the folder itself has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def drain(stream: DataFrame, folder: str | None = None, each: Callable[[DataFrame, int], DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds, and read what it has written, now and in runs before on the same ``folder``.

    Each batch adds its rows (append mode), after ``each`` (rows, number) if given, whose rows have ``schema``; windows come out when
    the watermark has passed them, so state is no more than what may still change. Batches are written under their number, so
    one that is run again replaces itself, and which there are is asked of the folder.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        (each(batch, epoch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    done = epochs(spark, folder)
    kind = schema or stream.schema
    if not done:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{folder}/out/{e}" for e in done])


_CAPTURED = "project string, id long, kind string, title string, body string, head string"


def capture(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Learnings of arriving replies (project, id, content) as records, each once a project by its first 64 characters.

    A batch drops its own repeats (the reply with the smallest id stays) and, by an anti join, what batches with smaller numbers
    have written; so a batch that is run again after a failure comes to the same rows, and replaces what it had written.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "capture")

    def fresh(batch: DataFrame, epoch: int) -> DataFrame:
        found = batch.select("project", "id", F.posexplode(X.learnings("content")).alias("at", "body")).withColumn("head", F.substring("body", 1, 64))
        first = found.groupBy("project", "head").agg(F.min_by(F.struct("id", "body"), F.struct("id", "at")).alias("v")).select("project", "head", "v.*")
        before = [f"{folder}/out/{e}" for e in epochs(spark, folder) if e < epoch]
        if before:
            first = first.join(spark.read.schema(_CAPTURED).parquet(*before).select("project", "head"), ["project", "head"], "left_anti")
        title = F.when(F.char_length("body") > 60, F.concat(F.left("body", F.lit(60)), F.lit("..."))).otherwise(F.col("body"))
        return first.select("project", "id", F.lit("discovery").alias("kind"), title.alias("title"), "body", "head")

    return drain(stream, folder, fresh, _CAPTURED)


def windowed(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_windows(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    """The first event of each key, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def gated(stream: DataFrame, level: str, needs: Callable) -> DataFrame:
    """Only events whose kind is captured at a level."""
    return stream.filter(needs(F.col("event_type")) <= LEVELS.index(level))


def activity(stream: DataFrame, save: str = "purchase", idle: int = 6, late: str = "2 days", forget: str = "30 days") -> DataFrame:
    """(user_id, calls, saves, nudge) after each batch: running counts of a user, kept as state between batches.

    A nudge is due for a user with more than ``idle`` calls since the last save. The calls of a batch are taken in order of
    time, over all of its frames; a user without calls for as long as ``forget`` is forgotten.
    """
    days = int(forget.split()[0]) * 86_400_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        calls, saves, since = state.get if state.exists else (0, 0, 0)
        seen, last = [], None
        for f in frames:
            at = f["ts"].astype("int64").to_numpy()
            order = np.rec.fromarrays([at, f["event_id"].to_numpy()])
            seen.append(order)
            mine = order[(f["event_type"] == save).to_numpy()]
            saves += len(mine)
            if len(mine):
                top = max(mine.tolist())
                last = top if last is None else max(last, top)
        every = np.concatenate(seen)
        calls += len(every)
        after = len(every) if last is None else int(((every["f0"] > last[0]) | ((every["f0"] == last[0]) & (every["f1"] > last[1]))).sum())
        since = since + after if last is None else after
        state.update((calls, saves, since))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pd.Timestamp(int(every["f0"].max()), unit=f["ts"].dt.unit).timestamp() * 1000)) + days)
        yield pd.DataFrame({"user_id": [key[0]], "calls": [calls], "saves": [saves], "nudge": [since > idle]})

    keyed = stream.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, calls long, saves long, nudge boolean", "calls long, saves long, since long", "append", GroupStateTimeout.EventTimeTimeout)
