"""Windows over long recordings: blocks of equal size with a halo on either side, put together from whatever chunks reach
into them.

A chunk sends each block the samples that this needs, so windows may straddle edges or span many chunks, and chunks may be
of any length. The samples of a block, halo included, for some channels, meet in one task; nothing else does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import design, kernels
from lumenspan.functions.arrays import lists, repeated, vectors
from lumenspan.operators.chunks import CHUNKS, Chunked
from lumenspan.operators.filters import remez_bandpass_taps, sinc_taps

#: About as many samples meet in a task.
CELLS = 1 << 20
PIECES = "record_id string, channel_pos int, channel double, pack int, block long, at long, samples array<double>"


class Group:
    """The channels of a block: their keys, and rows that repeat these."""

    def __init__(self, record_id, positions: np.ndarray, channels: list, block: int):
        self.record_id, self.positions, self.channels, self.block = record_id, positions, channels, block

    def table(self, each: int, columns: dict[str, pa.Array]) -> pa.Table:
        """`each` rows a channel, all rows of a channel together."""
        times = [each] * len(self.channels)
        keys = {
            "record_id": pa.array([self.record_id] * (each * len(self.channels)), pa.string()),
            "channel_pos": repeated(self.positions.tolist(), times, pa.int32()),
            "channel": repeated(self.channels, times, pa.float64()),
        }
        return pa.table(keys | columns)


def windows(record: Chunked, size: int, before: int, after: int, kernel: Callable[[Group, np.ndarray], pa.Table], schema: str, length: int | None = None, cells: int = CELLS) -> DataFrame:
    """kernel(group, x) for every block of `size` samples of the first `length` (all): x (channels, before + size + after)
    begins `before` samples before the block; what lies outside of the record is 0."""
    length = record.meta.n if length is None else length
    width = before + size + after
    blocks, pack = -(-length // size), max(1, cells // width)

    def deal(batches):
        for batch in batches:
            starts, out = batch.column("start").to_pylist(), []
            for i, (s, x) in enumerate(zip(starts, vectors(batch.column("samples")))):
                first = max(0, (s - after) // size) if len(x) else 0
                last = min(blocks - 1, (s + len(x) - 1 + before) // size) if len(x) else -1
                for b in range(first, last + 1):
                    lo, hi = max(s, b * size - before), min(s + len(x), (b + 1) * size + after)
                    if lo < hi:
                        out.append((i, b, lo, x[lo - s : hi - s]))
            rows = batch.take(pa.array([o[0] for o in out], pa.int64()))
            packs = pa.array(rows.column("channel_pos").to_numpy() // pack, pa.int32())
            arrays = [rows.column(c) for c in ("record_id", "channel_pos", "channel")]
            arrays += [packs, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), lists([o[3] for o in out])]
            yield pa.RecordBatch.from_arrays(arrays, ["record_id", "channel_pos", "channel", "pack", "block", "at", "samples"])

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        positions, first, which = np.unique(table.column("channel_pos").to_numpy(), return_index=True, return_inverse=True)
        labels = table.column("channel").to_pylist()
        x = np.zeros((len(positions), width))
        for i, at, piece in zip(which, table.column("at").to_pylist(), vectors(table.column("samples"))):
            at += before - block * size
            x[i, at : at + len(piece)] = piece
        return kernel(Group(table.column("record_id")[0].as_py(), positions, [labels[i] for i in first], block), x)

    plain = record.chunks.select("record_id", "channel_pos", "channel", "start", "samples").where(F.col("samples").isNotNull())
    return plain.mapInArrow(deal, PIECES).groupBy("record_id", "pack", "block").applyInArrow(run, schema)


# --- FIR filters -----------------------------------------------------------------------------------------------
def fir_chunks(record: Chunked, taps: np.ndarray, at: tuple[int, int, int], size: int | None = None, **changes) -> Chunked:
    """Outputs sum_j taps[j] x[i - j] for i in range(*at), which may pass the record's end, in chunks of `size`.

    A block's outputs need the len(taps) - 1 samples before it, from however many chunks; long filters go through FFTs
    over a block and its halo (overlap-save), short ones and wide strides through products."""
    taps, (first, stop, stride) = np.asarray(taps, float), at
    count = max(0, -(-(stop - first) // stride))
    size = size or max(1, min(max(count, 1), CELLS // (4 * stride)))
    reach = len(taps) - 1

    def kernel(group: Group, x: np.ndarray) -> pa.Table:
        wanted = np.arange(min(size, count - group.block * size))
        rows = kernels.fir_at(x, taps, reach + wanted * stride)
        starts = pa.array([group.block * size] * len(rows), pa.int64())
        return group.table(1, {"start": starts, "samples": lists(list(rows))})

    # Output k stands at sample first + k * stride: shifted by `first`, blocks of outputs are blocks of samples.
    moved = replace(record, chunks=record.chunks.withColumn("start", F.col("start") - first))
    rows = windows(moved, size * stride, reach, 0, kernel, CHUNKS, length=count * stride)
    return Chunked(rows, replace(record.meta, n=count, **changes))


def convolve(record: Chunked, taps: np.ndarray, size: int | None = None) -> Chunked:
    """As filters.convolve: len(taps) - 1 samples more."""
    return fir_chunks(record, taps, (0, record.meta.n + len(taps) - 1, 1), size)


def remez_fir(record: Chunked, freqmin: float, freqmax: float, size: int | None = None) -> Chunked:
    return convolve(record, remez_bandpass_taps(freqmin, freqmax, record.meta.fs), size)


def lowpass_fir(record: Chunked, freq: float, winlen: int = 2048, size: int | None = None) -> Chunked:
    """As filters.lowpass_fir: one sample fewer than the record."""
    taps, half = sinc_taps(freq, record.meta.fs, winlen), winlen // 2
    return fir_chunks(record, taps, (half, record.meta.n + winlen - 1 - half, 1), size)


def fir_decimate(record: Chunked, factor: int, taps: np.ndarray | None = None, size: int | None = None) -> Chunked:
    """As filters.fir_decimate: only the samples that stay are computed."""
    taps = design.decimation_taps(factor) if taps is None else taps
    return fir_chunks(record, taps, ((len(taps) - 1) // 2, record.meta.n, factor), size, fs=record.meta.fs / factor)


# --- short-time spectra ----------------------------------------------------------------------------------------
def _frames(n: int, size: int, hop: int, cells: int) -> tuple[int, int]:
    """Whole frames of a record, and how many of them a block starts."""
    return max(0, (n - size) // hop + 1), max(1, cells // 4 // hop)


def psd(record: Chunked, n: int | None = None, norm: bool = False, cells: int = CELLS) -> DataFrame:
    """As spectral.psd without its preprocessing: record_id, channel, freq_idx, freq, power.

    A block adds up the periodograms of the segments that start in it; the sums of a channel's blocks are added by
    frequency. A segment has to fit in a task, but not in a chunk."""
    fs, total = record.meta.fs, record.meta.n
    size = min(n or 256, total)
    hop = size - size // 2
    count, each = _frames(total, size, hop, cells)
    window = design.hann(size)

    def kernel(group: Group, x: np.ndarray) -> pa.Table:
        own = min(each, count - group.block * each)
        if own <= 0:
            return group.table(0, {"power": lists([])})
        power = kernels.density(kernels.frames(x, size, hop)[:, :own], fs, window, size).sum(axis=1)
        return group.table(1, {"power": lists(list(power))})

    rows = windows(record, each * hop, 0, size - hop, kernel, "record_id string, channel_pos int, channel double, power array<double>", length=count * hop, cells=cells)
    sums = rows.select("record_id", "channel", F.posexplode("power").alias("k", "p")).groupBy("record_id", "channel", "k").agg((F.sum("p") / F.lit(float(max(count, 1)))).alias("power"))
    if norm:
        top = sums.groupBy("record_id", "channel").agg(F.max("power").alias("top"))
        sums = sums.join(top, ["record_id", "channel"]).withColumn("power", F.try_divide("power", "top"))
    return sums.select("record_id", "channel", F.col("k").cast("long").alias("freq_idx"), (F.col("k") * F.lit(fs / size)).alias("freq"), "power")


def channel_spectrogram(record: Chunked, channel: float | None = None, norm: bool = False, cells: int = CELLS) -> DataFrame:
    """As spectral.channel_spectrogram, of one channel or of all; every frame comes from the block that it starts in."""
    fs, total = record.meta.fs, record.meta.n
    size = min(int(fs / 5), total)
    if size < 2:
        raise ValueError("frames of a fifth of a second need at least two samples")
    nfft = max(int(fs), size)
    hop = size - size // 2
    count, each = _frames(total, size, hop, cells)
    window = design.tukey(size, 0.25, sym=False)

    def kernel(group: Group, x: np.ndarray) -> pa.Table:
        own = max(0, min(each, count - group.block * each))
        if not own:
            return group.table(0, {"frame": pa.array([], pa.int64()), "power": lists([])})
        power = kernels.density(kernels.frames(x, size, hop)[:, :own], fs, window, nfft)
        if norm:
            top = power.max(axis=2, keepdims=True)
            power = np.divide(power, top, out=np.full_like(power, np.nan), where=top != 0)
        frames = np.tile(group.block * each + np.arange(own), len(power))
        return group.table(own, {"frame": pa.array(frames, pa.int64()), "power": lists(list(power.reshape(-1, power.shape[2])))})

    wanted = record if channel is None else replace(record, chunks=record.chunks.where(F.col("channel") == float(channel)))
    rows = windows(wanted, each * hop, 0, size - hop, kernel, "record_id string, channel_pos int, channel double, frame long, power array<double>", length=count * hop, cells=cells)
    long = rows.select("record_id", "channel", "frame", F.posexplode("power").alias("k", "power"))
    value = F.when(F.isnan("power"), F.lit(None)).otherwise(F.col("power")) if norm else F.col("power")
    return long.select(
        "record_id", "channel", "frame", ((F.col("frame") * hop + size / 2) / F.lit(fs)).alias("time_s"),
        F.col("k").cast("long").alias("freq_idx"), (F.col("k") * F.lit(fs / nfft)).alias("freq"), value.alias("power"),
    )
