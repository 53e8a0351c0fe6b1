"""Per-key windows that begin with a key's first event: batch and streaming rate limits, and a validated ingest stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, event_id bigint, at double, allowed boolean, retry_after int"


def decide(times: list[float], limit: int, window: float, start: float | None = None, used: int = 0) -> tuple[list[tuple[bool, int]], float | None, int]:
    """Verdicts on ordered events of one key, and the state after them. A window is anchored at the first event after the
    last window's end; refused events don't lengthen it."""
    import math

    out = []
    for t in times:
        if start is None or t >= start + window:
            start, used = t, 0
        if used < limit:
            used += 1
            out.append((True, 0))
        else:
            out.append((False, max(1, math.ceil(start + window - t))))
    return out, start, used


def paced(events: DataFrame, delay: float, key: str = "key", event_id: str = "event_id", at: str = "at") -> DataFrame:
    """(key, event_id, asked, start, waited): when each request of a host may start if starts lie ``delay`` seconds apart.

    start(i) is the larger of its own time and start(i - 1) + delay, which is the largest of time(j) + (i - j) * delay over
    j up to i: a running maximum, not a loop. Times are microseconds; null keys or times give no row."""
    gap = F.lit(int(round(delay * 1_000_000)))
    w = Window.partitionBy("key").orderBy("asked", "event_id")
    e = events.select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("asked")).where("key is not null and asked is not null")
    e = e.withColumn("i", F.row_number().over(w).cast("bigint"))
    start = F.max(F.col("asked") - F.col("i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * gap
    return e.withColumn("start", start).select("key", "event_id", "asked", "start", (F.col("start") - F.col("asked")).alias("waited"))


def rate_limit(events: DataFrame, limit: int, window: float, key: str, event_id: str, at: str) -> DataFrame:
    """Verdicts for a finished table of events: columns of :data:`OUT`. A key's events stream through the task in order of
    time and id, sorted by the shuffle; only the state is held, so a hot key needs no memory."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("key is not null and us is not null")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, used = None, None, 0
        for df in frames:
            rows = []
            for k, g in df.groupby("key", sort=False):
                if k != now:
                    now, start, used = k, None, 0
                times = (g["us"] / 1e6).tolist()
                verdicts, start, used = decide(times, limit, window, start, used)
                rows.append(pd.DataFrame({"key": k, "event_id": g["event_id"].to_numpy(), "at": times, "allowed": [v[0] for v in verdicts], "retry_after": pd.array([v[1] for v in verdicts], dtype="int32")}))
            if rows:
                yield pd.concat(rows)

    return e.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(run, OUT)


def rate_limit_stream(events: DataFrame, limit: int, window: float, key: str, event_id: str, at: str) -> DataFrame:
    """The same verdicts on a stream, with a key's window as its state; a key's state goes when its window has passed.
    Events of a micro-batch are ordered by time and id; one that comes later than a newer batch counts at its arrival."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        df = pd.concat(list(frames)).sort_values(["at", "event_id"])
        start, used = state.get if state.exists else (None, 0)
        verdicts, start, used = decide(df["at"].tolist(), limit, window, start, used)
        state.update((start, used))
        state.setTimeoutDuration(int(max(1.0, window) * 1000))
        yield pd.DataFrame({"key": k[0], "event_id": df["event_id"].to_numpy(), "at": df["at"].to_numpy(), "allowed": [v[0] for v in verdicts], "retry_after": pd.array([v[1] for v in verdicts], dtype="int32")})

    return e.groupBy("key").applyInPandasWithState(run, OUT, "start double, used int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_stream(events: DataFrame, key: str, at: str, valid, late: str = "1 hour") -> DataFrame:
    """Valid rows of a stream, each key once within the lateness bound."""
    return events.withColumn(at, F.col(at).cast("timestamp")).where(valid).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n) by gaps of inactivity; batch or stream (with a watermark of its own)."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    return e.groupBy(F.session_window("_at", gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
