"""Nudges of idle users, emitted by timeouts of a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A user who has saved nothing is nudged only after more calls than this.
CALLS = 5
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "user_id long, due timestamp, calls long, saves long"


_STATE = "begun long, saved long, calls long, saves long, early long, told boolean, last long"


def idle_step(idle: int, forget: int):
    """What is done with the rows of a user, or when a user's time is up.

    State of a user: begun (first event), saved (last save, null before any), calls, saves, early (calls until idle after the beginning),
    told, last (last event). Between two saves further apart than ``idle`` a nudge was due; one is also due ``idle`` after the last save,
    or after the beginning if nothing was saved then. The latter come from the timeout: it is set again with every save and fires once
    the watermark has passed it, whether or not the user ever comes back. State travels with the rows, in Arrow batches, so a user costs
    no calls to the state store.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int, int]] = []  # due, calls, saves
        begun, saved, calls, saves, early, told, last = state.get if state.exists else (None, None, 0, 0, 0, False, 0)
        passed = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            since = begun if saved is None else saved
            if not told and (saved is not None or early > CALLS):
                found.append((since + idle, calls, saves))
            told = True
        else:
            at, event, save = (np.concatenate(x) for x in zip(*((f["at"].to_numpy(), f["event_id"].to_numpy(), f["save"].to_numpy()) for f in frames), strict=True))
            order = np.lexsort((event, at))
            at, save = at[order].tolist(), save[order].tolist()
            begun = at[0] if begun is None else begun
            for t, is_save in zip(at, save, strict=True):
                since = begun if saved is None else saved
                if t > since + idle and not told and (saved is not None or early > CALLS):
                    found.append((since + idle, calls, saves))
                    told = True
                if not is_save:
                    calls += 1
                    early += t <= begun + idle
                else:
                    saves += 1
                    if saved is None or t > saved:
                        saved, told = t, False
            last = at[-1]
        due = (begun if saved is None else saved) + idle
        gone = max(last, due) + forget
        if state.hasTimedOut and passed >= gone:
            state.remove()
        else:
            state.update((begun, saved, calls, saves, int(early), told, last))
            state.setTimeoutTimestamp(max(gone if told else due, passed + 1))
        if found:
            dues, calls_then, saves_then = zip(*found, strict=True)
            yield pd.DataFrame({"user_id": [key[0]] * len(found), "due": pd.to_datetime(list(dues), unit="ms"), "calls": calls_then, "saves": saves_then})

    return step


def nudges(stream: DataFrame, save: str = "purchase", idle: str = "6 hours", late: str = "2 days", forget: str = "30 days") -> DataFrame:
    """(user_id, due, calls, saves): when each user of an event stream (user_id, event_id, ts, event_type) was to be reminded to save.

    ``calls`` and ``saves`` are those seen by then. Each idle interval gives one row at most. State is kept for ``forget`` after the last event.
    Rows that come later than ``late`` are dropped.
    """
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    stream.sparkSession.conf.set(_STORE, _ROCKS)  # the state of many users doesn't fit the heap
    rows = stream.withWatermark("ts", late).select("user_id", "event_id", F.unix_millis("ts").alias("at"), (F.col("event_type") == save).alias("save"), "ts")
    return rows.groupBy("user_id").applyInPandasWithState(idle_step(ms(idle), ms(forget)), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
