"""Event streams: windowed sums with late data, and the first sustained condition as a stateful operator.

The same functions serve batch and streaming tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessellum.plans.stages import ship


def windowed(events: DataFrame, *, every: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of fixed windows; a stream drops what comes later than ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        timed = timed.withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_sustained(frames: DataFrame, *, n: int = 3, least: float = 0.0) -> DataFrame:
    """(px, first, most): for each pixel of an ordered stream of (px, frame, level), the first of n frames in a row above
    the level, once they have come; and the highest level seen by then. The state is three numbers a pixel."""
    ship(frames.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, most, done, last = state.get if state.exists else (0, float("-inf"), False, -1)
        for part in parts:
            for frame, level in part.sort_values("frame")[["frame", "level"]].itertuples(index=False):
                if done or frame <= last:
                    continue
                run = (run + 1 if frame == last + 1 or run == 0 else 1) if level > least else 0
                most, last = max(most, float(level)), int(frame)
                if run == n:
                    done = True
                    yield pd.DataFrame({"px": [key[0]], "first": [last - n + 1], "most": [most]})
        state.update((run, most, done, last))

    return frames.groupBy("px").applyInPandasWithState(step, "px long, first long, most double", "run int, most double, done boolean, last long", "append", GroupStateTimeout.NoTimeout)
