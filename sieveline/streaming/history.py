"""History counts kept up to date from a stream of choices.

Counts of transitions and microcategories are sums, so a stream can maintain them: late rows
within the watermark still count. Medians (centres) aren't mergeable and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, keys: list[str], time: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows for each key and window; works on batches and on streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def merged(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over all windows, in the form of the batch operators' counts."""
    return windows.groupBy(*keys).agg(F.sum("n").alias("n"))


def start(events: DataFrame, keys: list[str], path: str, checkpoint: str, **kwargs):
    """Append finished windows to Parquet at ``path``; restarts go on from the checkpoint without loss or repeats."""
    return windowed_counts(events, keys, **kwargs).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
