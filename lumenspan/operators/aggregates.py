"""Aggregates over samples. They return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.model import Record
from lumenspan.operators.timeaxis import let, mean_of, total


def std(record: Record) -> DataFrame:
    """channel, std: population standard deviation of each channel, in two passes over its array."""
    n = record.meta.n
    squares = let(mean_of(F.col("samples"), n), lambda mean: F.transform("samples", lambda v: (v - mean) * (v - mean)))
    return record.traces.select("record_id", "channel", F.sqrt(mean_of(squares, n)).alias("std"))


def rmsa(record: Record, window: float | None = None) -> DataFrame:
    """channel, segment, time_idx (the sample in its middle), rms, over int(length / window) nearly equal segments, the
    longer ones first.

    A segment's place follows from its number, so the plan is as large for any record; each is a slice of the channel's
    array, and only the results are exploded. A window longer than the record is an error."""
    meta = record.meta
    parts = 1 if window is None else int(meta.time_length / window)
    if parts < 1:
        raise ValueError("the window is longer than the record")
    base, longer = divmod(meta.n, parts)

    def cell(x: Column, i: Column) -> Column:
        start, size = i * base + F.least(i, F.lit(longer)), F.lit(base) + (i < longer).cast("int")
        power = F.try_divide(total(F.transform(F.slice(x, start + 1, size), lambda v: v * v)), size.cast("double"))
        middle = (start + F.floor(size / 2)).cast("long")
        return F.struct(i.cast("long").alias("segment"), middle.alias("time_idx"), F.sqrt(power).alias("rms"))

    cells = let(F.col("samples"), lambda x: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: cell(x, i)))
    return record.traces.select("record_id", "channel", F.inline(cells))


def _range(array: Column) -> Column:
    """max - min, NaN if any value is NaN (Spark sorts NaN last, so the maximum shows it)."""
    return F.array_max(array) - F.array_min(array)


def peak_to_peak(record: Record) -> DataFrame:
    """channel, pp: max - min; if the extremes lie over half a second apart, the largest range within consecutive
    quarter-second windows instead, the samples from the last window's start on left out."""
    fs, n = record.meta.fs, record.meta.n
    step = int(fs / 4)
    if step < 1:
        raise ValueError("peak to peak needs a sampling frequency of at least 4 Hz")
    windows = max(0, -(-(n - step) // step))

    def narrow(x: Column) -> Column:
        if not windows:
            return F.lit(0.0)
        each = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: _range(F.slice(x, i * step + 1, F.lit(step))))
        return F.greatest(F.array_max(each), F.lit(0.0))

    def either(x: Column) -> Column:
        apart = F.abs(F.array_position(x, F.array_max(x)) - F.array_position(x, F.array_min(x)))
        return F.when(apart > fs / 2, narrow(x)).otherwise(_range(x))

    return record.traces.select("record_id", "channel", let(F.col("samples"), either).alias("pp"))


def colour_limit(record: Record) -> DataFrame:
    """limit: the largest magnitude of all samples."""
    own = record.traces.select(F.array_max(F.transform("samples", F.abs)).alias("m"))
    return own.agg(F.max("m").alias("limit"))
