"""Mathematics of long recordings from what chunks can add up: moments, sums, extremes.

Every chunk gives a few numbers; those of a channel meet in one row (a few numbers a chunk), which gives each chunk what it
needs of the others; then chunks are worked on alone. Sums by segment or window are grouped by channel and number."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import design
from lumenspan.functions.arrays import NUMBERS, lists, vectors
from lumenspan.operators.chunks import CHUNKS, COLUMNS, KEY, Chunked, cascade, silent_step
from lumenspan.operators.timeaxis import let, tukey_weight

GIVEN = "record_id string, channel_pos int, start long, given array<double>"


def chained(record: Chunked, alone: Callable[[np.ndarray, int], np.ndarray], chain: Callable[[np.ndarray, np.ndarray], np.ndarray], work: Callable[[np.ndarray, int, np.ndarray], np.ndarray]) -> Chunked:
    """alone(x, start): a chunk's numbers. chain(starts, numbers): of all chunks of a channel, in order, the numbers that
    each is given. work(x, start, given): the chunk's new samples."""
    plain = record.chunks.where(F.col("samples").isNotNull())

    def first(batches):
        for batch in batches:
            pairs = zip(vectors(batch.column("samples")), batch.column("start").to_pylist())
            out = [alone(x, s) for x, s in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), lists(out)], [*KEY, "given"])

    def between(batches):
        for batch in batches:
            for record_id, position, parts in zip(*(batch.column(c).to_pylist() for c in ("record_id", "channel_pos", "c"))):
                starts = np.array([p["start"] for p in parts], np.int64)
                given = chain(starts, np.array([p["given"] for p in parts], float))
                keys = [pa.array([record_id] * len(parts), pa.string()), pa.array([position] * len(parts), pa.int32()), pa.array(starts)]
                yield pa.RecordBatch.from_arrays([*keys, lists(list(given))], [*KEY, "given"])

    def last(batches):
        for batch in batches:
            parts = zip(vectors(batch.column("samples")), batch.column("start").to_pylist(), vectors(batch.column("given")))
            out = [work(x, s, g) for x, s, g in parts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), lists(out)], [*COLUMNS, "samples"])

    numbers = plain.select(*KEY, "samples").mapInArrow(first, GIVEN)
    rows = numbers.groupBy("record_id", "channel_pos").agg(F.array_sort(F.collect_list(F.struct("start", "given"))).alias("c"))
    return Chunked(plain.join(rows.mapInArrow(between, GIVEN), KEY).select(*COLUMNS, "samples", "given").mapInArrow(last, CHUNKS), record.meta)


def basis(start: int, count: int, n: int, order: int) -> np.ndarray:
    """Legendre polynomials up to an order over the whole record, at samples start, start + 1, ..."""
    t = (2.0 * np.arange(start, start + count) - (n - 1)) / max(n - 1, 1)
    return np.polynomial.legendre.legvander(t, order)


def detrend(record: Chunked, order: int = 1) -> Chunked:
    """Less the least-squares polynomial of the sample number.

    A chunk gives its mean, and of what is left the moments in a basis that all chunks share, with its part of the Gram
    matrix; sums of both solve for the channel. As means are taken off first, a large offset costs no digits: it comes
    back by the basis' own sums."""
    n = record.meta.n
    order = min(order, max(n - 1, 0))
    size = order + 1

    def alone(x, start):
        p = basis(start, len(x), n, order)
        mean = float(np.mean(x)) if len(x) else 0.0
        return np.concatenate([[mean], (x - mean) @ p, p.sum(axis=0), (p.T @ p).ravel()])

    def chain(starts, parts):
        level = parts[np.argmax(np.isfinite(parts[:, 0])), 0]  # means are added around one of them
        moments = (parts[:, 1 : 1 + size] + (parts[:, :1] - level) * parts[:, 1 + size : 1 + 2 * size]).sum(axis=0)
        gram = parts[:, 1 + 2 * size :].sum(axis=0).reshape(size, size)
        fit = np.linalg.solve(gram, moments) if np.isfinite(moments).all() else np.full(size, np.nan)
        return np.tile(np.concatenate([[level], fit]), (len(starts), 1))

    return chained(record, alone, chain, lambda x, start, given: (x - given[0]) - basis(start, len(x), n, order) @ given[1:])


def taper(record: Chunked, frac: float = 0.05) -> Chunked:
    """As timeaxis.taper, by the number of each sample in the record; chunks that lie inside stay as they are."""
    n = record.meta.n
    width = math.floor(min(2 * frac, 1.0) * (n - 1) / 2)
    edge = (F.col("start") <= width) | (F.col("start") + F.size("samples") >= n - width)
    tapered = let(F.col("start"), lambda s: F.transform("samples", lambda v, i: v * tukey_weight(i + s, n, 2 * frac)))
    return record.with_samples(F.when(edge, tapered).otherwise(F.col("samples")))


def preprocess(record: Chunked, order: int = 1) -> Chunked:
    """Detrend, demean, 10 % Tukey window; what detrend leaves has no mean."""
    return taper(detrend(record, order), 0.05)


def integrate(record: Chunked, tapered: bool = True) -> Chunked:
    """As timeaxis.integrate: cumulative trapezoids from 0 less their line.

    A chunk gives its own integral, its first and last sample, and the moments of its running integral; a scan over these
    gives every chunk what lies before it, and the line of the whole follows from moments shifted by as much."""
    n, dt = record.meta.n, record.meta.dt
    source = taper(record) if tapered else record

    def inner(x):
        steps = (x[1:] + x[:-1]) * (dt / 2)
        return np.concatenate([[0.0], np.cumsum(steps)]) if len(x) else x

    def alone(x, start):
        c, p = inner(x), basis(start, len(x), n, min(1, n - 1))
        edges = [c[-1], x[0], x[-1]] if len(x) else [0.0, np.nan, np.nan]
        return np.concatenate([edges, c @ p, p.sum(axis=0), (p.T @ p).ravel()])

    def chain(starts, parts):
        size = min(1, n - 1) + 1
        joints = (parts[:-1, 2] + parts[1:, 1]) * (dt / 2)
        before = np.concatenate([[0.0], np.cumsum(parts[:-1, 0] + joints)])
        moments = (parts[:, 3 : 3 + size] + before[:, None] * parts[:, 3 + size : 3 + 2 * size]).sum(axis=0)
        gram = parts[:, 3 + 2 * size :].sum(axis=0).reshape(size, size)
        fit = np.linalg.solve(gram, moments) if np.isfinite(moments).all() else np.full(size, np.nan)
        return np.column_stack([before, np.tile(fit, (len(starts), 1))])

    def work(x, start, given):
        return inner(x) + given[0] - basis(start, len(x), n, min(1, n - 1)) @ given[1:]

    done = chained(source, alone, chain, work)
    return Chunked(done.chunks, replace(record.meta, units="Strain"))


def rmsa(record: Chunked, window: float | None = None) -> DataFrame:
    """As aggregates.rmsa: record_id, channel, segment, time_idx, rms. A chunk is split at the segments' bounds; its sums of
    squares are added by channel and segment."""
    meta = record.meta
    parts = 1 if window is None else int(meta.time_length / window)
    if parts < 1:
        raise ValueError("the window is longer than the record")
    base, longer = divmod(meta.n, parts)
    if base < 1:
        raise ValueError("more segments than samples")

    def bounds(segment):
        return segment * base + np.minimum(segment, longer)

    def run(batches):
        for batch in batches:
            rows, numbers, sums = [], [], []
            for i, (s, x) in enumerate(zip(batch.column("start").to_pylist(), vectors(batch.column("samples")))):
                if not len(x):
                    continue
                ends = np.array([s, s + len(x) - 1])
                long = longer * (base + 1)
                a, b = np.where(ends < long, ends // (base + 1), longer + (ends - long) // base)
                own = np.arange(a, b + 1)
                cuts = np.maximum(bounds(own) - s, 0)
                rows += [i] * len(own)
                numbers += own.tolist()
                sums += np.add.reduceat(x * x, cuts).tolist()
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("record_id"), part.column("channel"), pa.array(numbers, pa.int64()), pa.array(sums, pa.float64())], ["record_id", "channel", "segment", "power"])

    plain = record.chunks.where(F.col("samples").isNotNull()).select("record_id", "channel", "start", "samples")
    sums = plain.mapInArrow(run, "record_id string, channel double, segment long, power double").groupBy("record_id", "channel", "segment").agg(F.sum("power").alias("power"))
    size = F.lit(base) + (F.col("segment") < longer).cast("long")
    middle = F.col("segment") * base + F.least("segment", F.lit(longer)) + F.floor(size / 2)
    return sums.select("record_id", "channel", "segment", middle.cast("long").alias("time_idx"), F.sqrt(F.col("power") / size).alias("rms"))


def peak_to_peak(record: Chunked) -> DataFrame:
    """As aggregates.peak_to_peak: record_id, channel, pp.

    Quarter-second windows of a channel keep (min, first place, max, first place), parts of a window in several chunks are
    put together; the channel's own extremes follow from its windows."""
    fs, n = record.meta.fs, record.meta.n
    step = int(fs / 4)
    if step < 1:
        raise ValueError("peak to peak needs a sampling frequency of at least 4 Hz")
    windows = max(0, -(-(n - step) // step))

    def cell(s, x, k):
        first = F.greatest(k * step - s, F.lit(0)).cast("int")
        last = F.least((k + 1) * step - s, F.size(x).cast("long")).cast("int")

        def found(part):
            low, high = F.array_min(part), F.array_max(part)
            at = lambda v: s + first + F.array_position(part, v)
            return F.struct(k.alias("window"), low.alias("low"), at(low).alias("low_at"), high.alias("high"), at(high).alias("high_at"))

        return let(F.slice(x, first + 1, last - first), found)

    rows = record.chunks.where(F.size("samples") > 0)
    ends = F.floor(F.col("start") / step), F.floor((F.col("start") + F.size("samples") - 1) / step)
    cells = let(F.struct(F.col("start").alias("s"), F.col("samples").alias("x")), lambda c: F.transform(F.sequence(*ends), lambda k: cell(c["s"], c["x"], k)))
    parts = rows.select("record_id", "channel", F.inline(cells))
    low, high = F.min(F.struct("low", "low_at")).alias("lo"), F.max(F.struct("high", (-F.col("high_at")).alias("at"))).alias("hi")
    each = parts.groupBy("record_id", "channel", "window").agg(low, high)
    narrow = F.coalesce(F.max(F.when(F.col("window") < windows, F.col("hi.high") - F.col("lo.low"))), F.lit(0.0)).alias("narrow")
    whole = each.groupBy("record_id", "channel").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), narrow)
    apart = F.abs(F.col("hi.at") + F.col("lo.low_at"))
    pp = F.when(apart > fs / 2, F.greatest("narrow", F.lit(0.0))).otherwise(F.col("hi.high") - F.col("lo.low"))
    return whole.select("record_id", "channel", pp.alias("pp"))


# --- zero-phase decimation -------------------------------------------------------------------------------------
def steady_pass(record: Chunked, sos: np.ndarray, backward: bool) -> Chunked:
    """Sections over whole channels, begun in the steady state of the first sample they meet."""
    size = 2 * len(sos)
    step, turn = silent_step(sos), (lambda x: x[::-1]) if backward else (lambda x: x)
    steady, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * level
        steady += [(b1 - a1 * gain) * level + z2, z2]
        level *= gain
    steady = np.array(steady)

    def alone(x, start):
        state = cascade(turn(x)[None], sos, np.zeros((1, size)))[1][0] if len(x) else np.zeros(size)
        return np.concatenate([[len(x), turn(x)[0] if len(x) else 0.0], state])

    def chain(starts, parts):
        order = turn(np.arange(len(starts)))
        order = order[parts[order, 0] > 0]
        given, state = np.zeros((len(starts), size)), None
        for i in order:
            state = steady * parts[i, 1] if state is None else state
            given[i] = state
            state = np.linalg.matrix_power(step, int(parts[i, 0])) @ state + parts[i, 2:]
        return given

    return chained(record, alone, chain, lambda x, start, given: turn(cascade(turn(x)[None], sos, given[None])[0][0]) if len(x) else x)


def decimate_cheby(record: Chunked, factor: int, pad: int = 27) -> Chunked:
    """As filters.decimate with None: Chebyshev I forward and backward over the record and its odd extension by `pad`
    samples, then every factor-th sample, counted over the whole record.

    Only the few samples at either end are exchanged for the extension; states run along the chunks, once each way."""
    n = record.meta.n
    pad = min(pad, n - 1)
    sos = design.iir_sos("cheby1", 8, 0.8 / factor, "lowpass", 0.05)
    rows = record.chunks.where(F.size("samples") > 0)
    near = rows.where((F.col("start") <= pad) | (F.col("start") + F.size("samples") >= n - pad))
    placed = F.transform("samples", lambda v, i: F.struct((F.col("start") + i).alias("at"), v.alias("v")))
    own = near.select("record_id", "channel_pos", "channel", F.inline(F.filter(placed, lambda p: (p["at"] <= pad) | (p["at"] >= n - 1 - pad))))
    ends = own.groupBy("record_id", "channel_pos", "channel").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("e"))

    def extended(batches):
        for batch in batches:
            ids, positions, channels, parts = (batch.column(c).to_pylist() for c in ("record_id", "channel_pos", "channel", "e"))
            out = []
            for e in parts:
                at = {p["at"]: p["v"] for p in e}
                head, tail = np.array([at[k] for k in range(pad + 1)]), np.array([at[k] for k in range(n - 1 - pad, n)])
                out += [2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]]
            twice = lambda values, kind: pa.array([v for v in values for _ in range(2)], kind)
            starts = pa.array([-pad, n] * len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([twice(ids, pa.string()), twice(positions, pa.int32()), twice(channels, pa.float64()), starts, pa.array(out, NUMBERS)], [*COLUMNS, "samples"])

    longer = rows.select(*COLUMNS, "samples")
    if pad:
        longer = longer.unionByName(ends.mapInArrow(extended, CHUNKS))
    both = steady_pass(steady_pass(Chunked(longer, record.meta), sos, False), sos, True).chunks
    inside = both.where((F.col("start") >= 0) & (F.col("start") < n))

    def strided(batches):
        for batch in batches:
            starts = batch.column("start").to_numpy()
            out = [x[-s % factor :: factor] for s, x in zip(starts, vectors(batch.column("samples")))]
            keys = [batch.column(c) for c in ("record_id", "channel_pos", "channel")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(-(-starts // factor)), lists(out)], [*COLUMNS, "samples"])

    picked = inside.select(*COLUMNS, "samples").mapInArrow(strided, CHUNKS)
    return Chunked(picked.where(F.size("samples") > 0), replace(record.meta, fs=record.meta.fs / factor, n=-(-n // factor)))
