"""An extension beyond the batch operators: composites over a stream of acquisitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_composite(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and count per key and tumbling window; rows later than `late` behind the latest are dropped."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key))
    return g.agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "mean_value", "n")
