"""Incremental histograms of an event stream.

The engine's own workload is batch-bounded; this is the same histogram and entropy kept up to date over
event-time windows.  Windows and lateness follow Spark: rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entropy import entropy_bits


def windowed_counts(events: DataFrame, symbol: str = "event_type", time: str = "ts", width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """events (streaming or not) to counts `n` of each symbol in each tumbling window."""
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = held.groupBy(F.window(time, width).alias("w"), F.col(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "symbol", "n")


def window_entropy(counts: DataFrame) -> DataFrame:
    """Entropy of each window from its (finished) counts."""
    shares = counts.withColumn("total", F.expr("sum(n) over (partition by start)"))
    return shares.groupBy("start").agg(F.max("total").alias("n"), F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))).alias("bits"))
