"""Structured Streaming forms of the view pipeline: windowed sums with late data, and decayed popularity as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.records import HALF_LIFE_DAYS


def daily_views(events: DataFrame, *, ts: str = "ts", keys: tuple[str, ...] = ("lang", "title"), late: str = "2 days") -> DataFrame:
    """Views by day and key of a stream of ``(ts, keys..., views)``; days close ``late`` after their end."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.sum("views").alias("views")).select(F.to_date("w.start").alias("day"), *keys, "views")


def decayed(daily: DataFrame, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """``lang, title, day, popularity`` per update of a stream of daily sums ``(lang, title, day, views)``.

    State per title: the popularity and its day.  Days that come late, at or before the state's day, count as one day.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pop, at = state.get if state.exists else (0.0, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("day").itertuples():
            today, ordinal = float(r.views), pd.Timestamp(r.day).toordinal()
            if pop <= 0:
                pop = max(0.0, today)
            else:
                days = ordinal - at if at is not None and ordinal > at else 1
                w = 1 - 0.5 ** (days / half_life)
                pop = w * today + (1 - w) * pop
            at = max(ordinal, at or 0)
            rows.append((key[0], key[1], r.day, pop))
        state.update((pop, at))
        yield pd.DataFrame(rows, columns=["lang", "title", "day", "popularity"])

    return daily.groupBy("lang", "title").applyInPandasWithState(update, "lang string, title string, day date, popularity double", "popularity double, day int", "append", GroupStateTimeout.NoTimeout)


def upsert_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of records to the Parquet log, exactly once per batch by the sink's own commit log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
