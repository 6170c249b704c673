"""Operators across channels. Those that need other channels' samples meet in blocks of time: each trace is cut into
arrays, dealt by record and block, and put together again; no group is larger than a block of all channels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenspan.functions.kernels import cumulative_trapezoids
from lumenspan.model import Record
from lumenspan.operators.timeaxis import let, tukey_weight


def positions(record: Record, labels: list[float]) -> list[int]:
    """Positions of channel labels; an error names a missing one. Labels are matched as doubles."""
    wanted = [float(x) for x in labels]
    rows = record.traces.where(F.col("channel").isin(wanted)).groupBy("channel").agg(F.min("channel_pos").alias("p")).collect()
    found = {r["channel"]: r["p"] for r in rows}
    missing = [x for x in wanted if x not in found]
    if missing:
        raise ValueError(f"no channel {missing[0]:g} in this record")
    return [found[x] for x in wanted]


def restrict_channels(record: Record, channels: float | tuple[float, float]) -> Record:
    """One channel, or an inclusive range by position between two labels; positions start at 0 again."""
    first, last = channels if isinstance(channels, (tuple, list)) else (channels, channels)
    low, high = positions(record, [first, last])
    kept = record.traces.where(F.col("channel_pos").between(low, high))
    return Record(kept.withColumn("channel_pos", F.col("channel_pos") - F.lit(low)), record.meta)


def get_data(record: Record, channel: float | None = None):
    """Traces of one channel, or all."""
    return record.traces if channel is None else record.traces.where(F.col("channel") == float(channel))


def downsample(record: Record) -> Record:
    """Every second channel by position; labels stay, the spacing doubles."""
    kept = record.traces.where(F.col("channel_pos") % 2 == 0)
    halved = kept.withColumn("channel_pos", F.floor(F.col("channel_pos") / 2).cast("int"))
    return Record(halved, replace(record.meta, spatial_interval=record.meta.spatial_interval * 2))


def upsample(record: Record) -> Record:
    """A channel of midpoints between neighbours: N become 2N - 1. Each trace goes to two places and the pairs meet by
    an equi-join on the position, without exploding samples."""
    t = record.traces
    after = t.select("record_id", (F.col("channel_pos") - 1).alias("channel_pos"), F.col("channel").alias("c2"), F.col("samples").alias("s2"))
    middle = t.join(after, ["record_id", "channel_pos"]).select(
        "record_id",
        (2 * F.col("channel_pos") + 1).alias("channel_pos"),
        ((F.col("channel") + F.col("c2")) / 2).alias("channel"),
        F.zip_with("samples", "s2", lambda a, b: (a + b) / 2).alias("samples"),
    )
    own = t.select("record_id", (2 * F.col("channel_pos")).alias("channel_pos"), "channel", "samples")
    return Record(own.unionByName(middle), replace(record.meta, spatial_interval=record.meta.spatial_interval / 2))


def resample(record: Record, how: str) -> Record:
    if how not in ("upsampling", "downsampling"):
        raise ValueError("the type must be upsampling or downsampling")
    return upsample(record) if how == "upsampling" else downsample(record)


def difference(record: Record, step: int, length: float, **changes) -> Record:
    """(x[j + step] - x[j]) / length by position, for channels that have such a partner; of the labels, step // 2 go at
    the left and the rest at the right."""
    if step < 1:
        raise ValueError("the gauge must be at least one channel long")
    t, left = record.traces, step // 2
    ahead = t.select("record_id", (F.col("channel_pos") - step).alias("channel_pos"), F.col("samples").alias("s2"))
    names = t.select("record_id", (F.col("channel_pos") - left).alias("channel_pos"), "channel")
    paired = t.drop("channel").join(ahead, ["record_id", "channel_pos"]).join(names, ["record_id", "channel_pos"])
    out = F.zip_with("samples", "s2", lambda a, b: (b - a) / F.lit(float(length)))
    return Record(paired.select("record_id", "channel_pos", "channel", out.alias("samples")), replace(record.meta, **changes))


#: About how many values a block of all channels has.
BLOCK_VALUES = 1_000_000
BLOCKED = "record_id string, block int, channel_pos int, channel double, part array<double>"


def across(record: Record, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], unit: int = 1, **changes) -> Record:
    """Apply a NumPy function of a (channels, samples) matrix and its channel positions to every block of time, the
    channels in order of position. Samples that belong together come in groups of `unit`. Two shuffles of arrays."""
    channels = max(1, record.traces.count())
    size = unit * max(1, BLOCK_VALUES // (channels * unit))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * size + 1, F.lit(size)))
    parts = record.traces.where(F.col("samples").isNotNull()).select("record_id", "channel_pos", "channel", F.posexplode(let(F.col("samples"), cut)).alias("block", "part"))

    def compute(table: pa.Table) -> pa.Table:
        table = table.sort_by("channel_pos").combine_chunks()
        column = table.column("part").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        out = np.ascontiguousarray(kernel(flat.reshape(len(column), -1), table.column("channel_pos").to_numpy()))
        offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
        kept = [table.column(c) for c in ("record_id", "block", "channel_pos", "channel")]
        return pa.table([*kept, pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], names=["record_id", "block", "channel_pos", "channel", "part"])

    done = parts.select("record_id", "block", "channel_pos", "channel", "part").groupBy("record_id", "block").applyInArrow(compute, BLOCKED)
    gathered = done.groupBy("record_id", "channel_pos", "channel").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("b"))
    traces = gathered.select("record_id", "channel_pos", "channel", F.flatten(F.transform("b", lambda b: b["part"])).alias("samples"))
    return Record(traces, replace(record.meta, **changes))


def line_residual(m: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """m less its least-squares line over the positions, at each sample."""
    t = positions - positions.mean()
    slope = (t @ m) / (t @ t) if len(t) > 1 else np.zeros(m.shape[1])
    return m - m.mean(axis=0) - np.outer(t, slope)


def demean_channels(record: Record) -> Record:
    """Less the mean over channels at each sample."""
    return across(record, lambda m, _: m - m.mean(axis=0))


def detrend_channels(record: Record) -> Record:
    """Less the least-squares line over channel positions at each sample."""
    return across(record, line_residual)


def taper_channels(record: Record, channels: int, frac: float = 0.05) -> Record:
    """Times a Tukey window over `channels` positions: a factor per trace, no shuffle."""
    weight = tukey_weight(F.col("channel_pos"), channels, 2 * frac)
    return record.with_samples(let(weight, lambda w: F.transform("samples", lambda v: v * w)))


def differentiate_channels(record: Record) -> Record:
    """Central differences over channel positions, one-sided at the ends, per metre of spacing; 0 for a single channel."""
    dx = record.meta.spatial_interval

    def slopes(m: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.gradient(m, dx, axis=0) if len(m) > 1 else np.zeros_like(m)

    return across(record, slopes, units="Strain rate")


def integrate_channels(record: Record, channels: int, tapered: bool = True) -> Record:
    """Cumulative trapezoids over channel positions from 0, then a linear detrend over them."""
    source, dx = taper_channels(record, channels) if tapered else record, record.meta.spatial_interval
    return across(source, lambda m, positions: line_residual(cumulative_trapezoids(m, dx, 0), positions), units="Strain")
