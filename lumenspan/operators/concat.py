"""Joining two records end to end, gaps filled, overlaps decided for the earlier record."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lumenspan.model import Record


def gap_samples(first: Record, second: Record) -> int:
    """Samples missing between the records (negative: overlap), from whole microseconds."""
    late = (second.meta.start_time - first.meta.end_time).total_seconds()
    return round(late * first.meta.fs)


def concatenate(a: Record, b: Record, fill: float | None = 0.0) -> Record:
    """The earlier record, a gap of `fill` (None: NaN) or the cut-off start of the later one, then the later record.

    Channels meet by label; both records need the same sampling frequency. At equal starts a comes first."""
    first, second = (a, b) if a.meta.start_time <= b.meta.start_time else (b, a)
    if first.meta.fs != second.meta.fs:
        raise ValueError("both records need the same sampling frequency")
    gap, n1, n2 = gap_samples(first, second), first.meta.n, second.meta.n
    drop = min(max(0, -gap), n2)
    filler = F.array_repeat(F.lit(float("nan") if fill is None else float(fill)), max(0, gap))
    later = second.traces.select("channel", F.slice("samples", drop + 1, max(n2 - drop, 0)).alias("s2"))
    joined = first.traces.join(later, "channel").select(
        "record_id", "channel_pos", "channel", F.concat("samples", filler, "s2").alias("samples")
    )
    return Record(joined, replace(first.meta, n=n1 + max(0, gap) + n2 - drop))
