"""Activity de-duplication by a sliding gap: window functions in batch, arbitrary state in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
KEY = ["session_id", "tool_name", "args_hash", "outcome_class", "scope_id"]


def fold(events: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """(key, first_seen, last_seen, occurrence_count, status): an event less than the gap after the last one folds into it."""
    w = Window.partitionBy(*KEY).orderBy("ts", "id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), c("ts"))
    runs = events.withColumn("new", F.when(gap < gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*KEY, "run").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("occurrence_count"))
    return out.withColumn("status", F.when(c("occurrence_count") > 1, "deduplicated").otherwise("raw")).drop("run")


def stream(events: DataFrame, gap_seconds: int = 300, late: str | None = None) -> DataFrame:
    """The same folding in a stream: state per key is the open run; each batch emits the runs it changed (update mode).

    With `late` (such as "1 hour") rows that come later than that behind the newest one are dropped, and a run's state
    ends once the watermark has passed its gap. Without it nothing is dropped and state stays.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        out = {}
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for ts in rows["ts"]:
            us = int(ts.value // 1000)
            if last is not None and us - last < gap_seconds * 1_000_000:
                last, n = us, n + 1
            else:
                first, last, n = us, us, 1
            out[first] = (last, n)
        state.update((first, last, n))
        if late is not None:
            state.setTimeoutTimestamp(max(last // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        made = [(*key, pd.Timestamp(f, unit="us"), pd.Timestamp(v[0], unit="us"), v[1]) for f, v in out.items()]
        yield pd.DataFrame(made, columns=[*KEY, "first_seen", "last_seen", "occurrence_count"])

    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", first_seen timestamp, last_seen timestamp, occurrence_count long"
    timed = events if late is None else events.withWatermark("ts", late)
    return timed.groupBy(*KEY).applyInPandasWithState(step, schema, "first long, last long, n long", "update", "NoTimeout" if late is None else "EventTimeTimeout")


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("session_id").agg(F.max_by(F.struct("scope_path", "checkpoint_at", "last_activity_id"), F.struct("checkpoint_at", "last_activity_id")).alias("x")).select("session_id", "x.*")


def filter_class(activities: DataFrame, ignore: list[str], promote: list[str]) -> DataFrame:
    """Adds `decision`: a case-folded part of the tool's name decides, ignoring before promoting."""
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("tool_name"), w))
    return activities.withColumn("decision", F.when(has(ignore), "ignore").when(has(promote), "promote").otherwise("keep"))


def recent(activities: DataFrame, k: int, session: str | None = None) -> DataFrame:
    """The newest k activities (ts, id), of one session or of all."""
    own = activities if session is None else activities.where(F.col("session_id") == session)
    return own.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(k)


def recent_checkpoints(checkpoints: DataFrame, k: int) -> DataFrame:
    return checkpoints.orderBy(F.col("checkpoint_at").desc(), F.col("last_activity_id").desc()).limit(k)
