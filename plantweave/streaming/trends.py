"""Beyond the batch operators: event rates over a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; the same plan runs over a batch or a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")
