"""Streams of events: windowed criteria sums with late data, first sightings, smoothing with state.

Beyond what a sheet has; the batch operators' rules on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, late: str, length: str, slide: str | None, keys: list[str], folds: list[Column]) -> DataFrame:
    """Folds by window and key; a window is final once the watermark has passed it."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*folds).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *[f for f in _names(folds)])


def _names(folds: list[Column]) -> list[str]:
    return [f._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for f in folds]


def first_seen(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first event of each key inside the watermark's horizon; state goes with it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def smoothed(events: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """Each key's exponential level, carried from batch to batch as state."""

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[value]:
            level, seen = x if level is None else alpha * x + (1 - alpha) * level, seen + 1
        state.update((float(level), seen))
        yield pd.DataFrame({key: [k[0]], "level": [float(level)], "seen": [seen]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level double, seen long", "level double, seen long", "update", "NoTimeout")
