"""Windowed amplitudes of a live sample stream, by watermarked event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_amplitudes(samples: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """window_start, channel, n, rms, pp per tumbling window of samples (ts, channel, value); rows later than `late`
    behind the newest are dropped by the watermark, null values do not count."""
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "channel")
    rows = grouped.agg(F.count("value").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), (F.max("value") - F.min("value")).alias("pp"))
    return rows.select(F.col("window.start").alias("window_start"), "channel", "n", "rms", "pp")
