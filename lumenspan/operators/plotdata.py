"""The data behind each plot, as DataFrames; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.model import Record
from lumenspan.operators import spectral
from lumenspan.operators.aggregates import colour_limit
from lumenspan.operators.space import restrict_channels


def waterfall(record: Record) -> DataFrame:
    """Samples with the colour limit, the largest magnitude of the record (a one-row side)."""
    return record.samples().crossJoin(F.broadcast(colour_limit(record)))


def channel_plot(record: Record, channel: float) -> DataFrame:
    """sample_idx, time, value of a channel and the y limit, 1.2 times its largest magnitude."""
    one = record.traces.where(F.col("channel") == float(channel))
    limit = (1.2 * F.array_max(F.transform("samples", F.abs))).alias("y_limit")
    rows = one.select(limit, F.posexplode("samples").alias("sample_idx", "value"))
    micros = F.round(F.col("sample_idx") * (1e6 / record.meta.fs)).cast("long")
    stamp = F.timestamp_add("MICROSECOND", micros, F.lit(record.meta.start_time).cast("timestamp_ntz"))
    return rows.select(F.col("sample_idx").cast("long").alias("sample_idx"), stamp.alias("time"), "value", "y_limit")


def record_section(record: Record, channels: tuple[float, float]) -> DataFrame:
    """channel, sample_idx, offset_value: each trace times 1.5 over the section's largest magnitude, plus its row."""
    part = restrict_channels(record, channels)
    long = part.samples().crossJoin(F.broadcast(colour_limit(part)))
    return long.select("channel", "sample_idx", (F.col("value") * (F.lit(1.5) / F.col("limit")) + F.col("channel_pos")).alias("offset_value"))


def interactive(record: Record, channel: float) -> tuple[DataFrame, DataFrame]:
    return waterfall(record), channel_plot(record, channel)


spectrum, spectrogram, channel_spectrogram = spectral.spectrum, spectral.spectrogram, spectral.channel_spectrogram


def short_milliseconds(micros: int) -> str:
    """A tick label of microseconds as milliseconds without trailing zeros."""
    text = f"{micros / 1000:.3f}".rstrip("0").rstrip(".")
    return text or "0"
