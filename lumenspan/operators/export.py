"""Interchange rows: one per channel with network, station, sampling step and start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.model import Record


def as_traces(record: Record) -> DataFrame:
    """network, station (label padded to five digits), starttime, delta, npts, samples."""
    label = F.lpad(F.col("channel").cast("long").cast("string"), 5, "0")
    return record.traces.select(
        F.lit(record.meta.fiber).alias("network"),
        label.alias("station"),
        F.lit(record.meta.start_time).cast("timestamp_ntz").alias("starttime"),
        F.lit(record.meta.dt).alias("delta"),
        F.size("samples").cast("long").alias("npts"),
        "samples",
    )
