"""Long recordings: traces in chunks of time, so that no row or task holds a whole channel.

chunks: record_id STRING, channel_pos INT, channel DOUBLE, start BIGINT, samples ARRAY<DOUBLE>; start is the number of the
chunk's first sample. Chunks of a channel follow one another without gaps. Operators are narrow, or exchange only what
crosses a chunk's edge: a filter's state or the few samples before it."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import kernels
from lumenspan.functions.arrays import lists, vectors
from lumenspan.model import Record, RecordMeta
from lumenspan.operators.filters import design_band
from lumenspan.operators.timeaxis import let, total, trim_range

CHUNKS = "record_id string, channel_pos int, channel double, start long, samples array<double>"
COLUMNS = ("record_id", "channel_pos", "channel", "start")
KEY = ["record_id", "channel_pos", "start"]


@dataclass(frozen=True)
class Chunked:
    chunks: DataFrame
    meta: RecordMeta

    def with_samples(self, samples: Column, **changes) -> Chunked:
        return Chunked(self.chunks.withColumn("samples", samples), replace(self.meta, **changes))


def chunked(record: Record, size: int) -> Chunked:
    """A record's traces in chunks of `size` samples."""
    starts = lambda x: F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size))
    cut = lambda x: F.transform(starts(x), lambda s: F.struct(s.cast("long").alias("start"), F.slice(x, s + 1, F.lit(size)).alias("samples")))
    rows = record.traces.where(F.col("samples").isNotNull()).select("record_id", "channel_pos", "channel", F.inline(let(F.col("samples"), cut)))
    return Chunked(rows, record.meta)


def gathered(record: Chunked) -> Record:
    """Chunks as whole traces, for records that fit rows."""
    parts = record.chunks.groupBy("record_id", "channel_pos", "channel").agg(F.array_sort(F.collect_list(F.struct("start", "samples"))).alias("p"))
    return Record(parts.select("record_id", "channel_pos", "channel", F.flatten(F.transform("p", lambda p: p["samples"])).alias("samples")), record.meta)


def trim(record: Chunked, t0=None, tf=None, inclusive_end: bool = False) -> Chunked:
    """As timeaxis.trim; only chunks that reach into the range are looked at."""
    first, count = trim_range(record.meta, t0, tf, inclusive_end)
    begin = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    end = F.least(F.lit(first + count) - F.col("start"), F.size("samples").cast("long"))
    kept = record.chunks.where(F.lit(count > 0) & (F.col("start") < first + count) & (F.col("start") + F.size("samples") > first))
    rows = kept.select("record_id", "channel_pos", "channel", F.greatest(F.col("start") - first, F.lit(0)).alias("start"), F.slice("samples", (begin + 1).cast("int"), (end - begin).cast("int")).alias("samples"))
    return Chunked(rows, replace(record.meta, start_time=record.meta.time_of(first), n=count))


def scale(record: Chunked, factor: float, **changes) -> Chunked:
    return record.with_samples(F.transform("samples", lambda v: v * F.lit(factor)), **changes)


def demean(record: Chunked) -> Chunked:
    """Less the mean of the whole channel, added up chunk by chunk."""
    means = record.chunks.groupBy("record_id", "channel_pos").agg((F.sum(total(F.col("samples"))) / F.lit(float(max(record.meta.n, 1)))).alias("mean"))
    rows = record.chunks.join(means, ["record_id", "channel_pos"])
    return Chunked(rows.select(*COLUMNS, F.transform("samples", lambda v: v - F.col("mean")).alias("samples")), record.meta)


def rms(record: Chunked) -> DataFrame:
    """channel, rms of the whole channel."""
    power = F.sum(total(F.transform("samples", lambda v: v * v))) / F.lit(float(max(record.meta.n, 1)))
    return record.chunks.groupBy("record_id", "channel").agg(F.sqrt(power).alias("rms"))


def cascade(x: np.ndarray, sos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections over (channels, samples) from a state (channels, 2 a section); the outputs and the state after them."""
    after = []
    for k, row in enumerate(sos):
        x, z = kernels.section(x, row, state[:, 2 * k : 2 * k + 2])
        after.append(z)
    return x, np.concatenate(after, axis=1)


def silent_step(sos: np.ndarray) -> np.ndarray:
    """The matrix that takes the cascade's state over one sample of silence."""
    size = 2 * len(sos)
    step, through = np.zeros((size, size)), np.zeros(size)  # through: what of the state reaches a section's input
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        own = np.zeros(size)
        own[2 * k] = 1
        step[2 * k] = (b1 - a1 * b0) * through - a1 * own
        step[2 * k, 2 * k + 1] += 1
        step[2 * k + 1] = (b2 - a2 * b0) * through - a2 * own
        through = b0 * through + own
    return step


def sos_filter(record: Chunked, sos: np.ndarray, backward: bool = False) -> Chunked:
    """Sections over whole channels from zero state, chunk by chunk.

    Each chunk gives the state that it alone would leave behind; a channel's states, a few numbers a chunk, are chained
    in one row; then every chunk is filtered from the state before it. Chunks never wait for one another's samples."""
    size = 2 * len(sos)
    turn = (lambda x: x[::-1]) if backward else (lambda x: x)

    def together(chunks: list[np.ndarray], before: list[np.ndarray] | None = None):
        """Numbers of equally long chunks, these as rows of a matrix, and their states."""
        lengths = np.array([len(x) for x in chunks])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            states = np.zeros((len(at), size)) if before is None else np.array([before[i] for i in at])
            yield at, cascade(np.array([turn(chunks[i]) for i in at]), sos, states)

    def alone(batches):
        for batch in batches:
            chunks = vectors(batch.column("samples"))
            out = np.zeros((len(chunks), size))
            for at, (_, after) in together(chunks):
                out[at] = after
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array([len(x) for x in chunks], pa.int64()), lists(list(out))], [*KEY, "n", "state"])

    left = record.chunks.select(*KEY, "samples").mapInArrow(alone, "record_id string, channel_pos int, start long, n long, state array<double>")
    rows = left.groupBy("record_id", "channel_pos").agg(F.array_sort(F.collect_list(F.struct("start", "n", "state"))).alias("c"))
    step = silent_step(sos)

    def chain(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = turn(batch.column("c")[i].as_py())
                state, before = np.zeros(size), []
                for part in parts:
                    before.append(state)
                    state = np.linalg.matrix_power(step, part["n"]) @ state + np.array(part["state"])
                k = len(parts)
                keys = [pa.array([batch.column(c)[i].as_py()] * k, batch.column(c).type) for c in ("record_id", "channel_pos")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([p["start"] for p in parts], pa.int64()), pa.array(before, pa.list_(pa.float64()))], [*KEY, "before"])

    states = rows.mapInArrow(chain, "record_id string, channel_pos int, start long, before array<double>")

    def filtered(batches):
        for batch in batches:
            chunks, out = vectors(batch.column("samples")), [np.zeros(0)] * batch.num_rows
            for at, (y, _) in together(chunks, vectors(batch.column("before"))):
                for i, row in zip(at, y):
                    out[i] = turn(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), lists(out)], [*COLUMNS, "samples"])

    return Chunked(record.chunks.join(states, KEY).select(*COLUMNS, "samples", "before").mapInArrow(filtered, CHUNKS), record.meta)


def band_filter(record: Chunked, f_type: str, freq, corners: int = 4, zerophase: bool = False) -> Chunked:
    """As filters.band_filter."""
    sos = design_band(f_type, freq, record.meta.fs, corners)
    once = sos_filter(record, sos)
    return sos_filter(once, sos, backward=True) if zerophase else once


def fir_filter(record: Chunked, taps: np.ndarray) -> Chunked:
    """Causal FIR over whole channels, as many samples as before. Each chunk lends the next one its last len(taps) - 1
    samples, so all but a channel's last chunk need as many; shorter ones are an error."""
    reach = len(taps) - 1
    tails = record.chunks.select("record_id", "channel_pos", (F.col("start") + F.size("samples")).alias("start"), F.slice("samples", -F.least(F.size("samples"), F.lit(max(reach, 1))), F.lit(max(reach, 1))).alias("tail"))
    rows = record.chunks.join(tails, KEY, "left").select(*COLUMNS, "samples", "tail")

    def run(batches):
        for batch in batches:
            out = []
            for start, own, tail in zip(batch.column("start").to_pylist(), batch.column("samples"), batch.column("tail")):
                before = np.zeros(0) if tail.values is None or not reach else np.asarray(tail.values, float)
                if len(before) < min(reach, start):
                    raise ValueError(f"chunks shorter than {reach} samples cannot feed this filter")
                x = np.concatenate([before, np.asarray(own.values, float)])[None]
                out.append(kernels.fir_outputs(x, taps, np.arange(len(before), x.shape[1]))[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), pa.array(out, pa.list_(pa.float64()))], [*COLUMNS, "samples"])

    return Chunked(rows.mapInArrow(run, CHUNKS), record.meta)
