"""Streams of observations: runs that gaps of silence end, and durations between points, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import columns as C


def gap_runs(points: DataFrame, id: str = "id", timestamp: str = C.TIMESTAMP, gap: int = 43200, late: str = "1 hour") -> DataFrame:
    """``(id, frag_start, frag_end, n)``: the runs of an object's points without a gap of ``gap`` seconds.

    A session window, on a batch or on a stream; on a stream a run is given out
    once the watermark, ``late`` behind the latest point, has passed its end,
    and its state is dropped then.  Points without a time or an object's id
    take no part.
    """
    at = points.select(F.col(id).alias("id"), F.timestamp_seconds(F.col(timestamp)).alias("__at")).where("id is not null and __at is not null")
    held = at.withWatermark("__at", late) if points.isStreaming else at
    runs = held.groupBy("id", F.session_window("__at", f"{gap} seconds").alias("w")).agg(F.min("__at").alias("a"), F.max("__at").alias("b"), F.count("*").alias("n"))
    return runs.select("id", F.unix_seconds("a").alias(C.START), F.unix_seconds("b").alias(C.END), "n")


def stream_durations(points: DataFrame, id: str = "id", timestamp: str = C.TIMESTAMP) -> DataFrame:
    """``(id, trk_timestamp, frag_duration_s)`` for each point of a stream: seconds since the object's latest point so far.

    State is one number an object, however many points it has.  Points of a
    micro-batch are taken in order; a point older than the latest has a null
    duration.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf["t"].tolist())
        rows = []
        for t in times:
            rows.append((key[0], t, None if last is None or t < last else t - last))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(rows, columns=["id", C.TIMESTAMP, C.DURATION]).astype({C.DURATION: "Int64"})

    ins = points.select(F.col(id).cast("string").alias("id"), F.col(timestamp).cast("bigint").alias("t")).where("id is not null and t is not null")
    return ins.groupBy("id").applyInPandasWithState(step, f"id string, {C.TIMESTAMP} bigint, {C.DURATION} bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
