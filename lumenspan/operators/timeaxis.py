"""Operators along time: each channel on its own, narrow, no shuffle.

Higher-order functions keep these inside the JVM; only polynomials of an order over one use a NumPy kernel. A null
samples array stays null; NaN spreads to what depends on it, as in floating-point arithmetic."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspan.functions.kernels import cumulative_trapezoids, polynomial_residual
from lumenspan.model import Record, RecordMeta


def _x() -> Column:
    return F.col("samples")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _moment(time) -> datetime:
    return datetime.fromisoformat(time) if isinstance(time, str) else time


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is never inlined into inner lambdas, as a projected
    column would be, once for each of their elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean_of(array: Column, n: int) -> Column:
    return total(array) / F.lit(float(max(n, 1)))


def trim_range(meta: RecordMeta, t0=None, tf=None, inclusive_end: bool = False) -> tuple[int, int]:
    """First sample and number of samples of a trim."""
    index = lambda t: math.floor((t - meta.start_time).total_seconds() * meta.fs + 1e-6)
    start = 0 if t0 is None else max(0, index(_moment(t0)))
    if tf is not None and _moment(tf) < meta.start_time:
        raise ValueError("the trim ends before the record starts")
    end = meta.n - 1 if tf is None else min(meta.n - 1, index(_moment(tf)))
    return start, max(0, end + inclusive_end - start)


def trim(record: Record, t0=None, tf=None, inclusive_end: bool = False) -> Record:
    """Samples from the last one at or before t0 up to, not including, the last one at or before tf.

    Bounds are clamped to the record; None is an open bound; ISO strings are accepted. A full-range trim therefore
    drops the last sample unless inclusive_end. tf before the start is an error; t0 beyond the end gives no samples."""
    start, count = trim_range(record.meta, t0, tf, inclusive_end)
    cut = F.slice(_x(), start + 1, count) if count else F.array().cast("array<double>")
    return record.with_samples(cut, start_time=record.meta.time_of(start), n=count)


def integer_decimation(record: Record, factor: int) -> Record:
    """Every factor-th sample from the first on."""
    if not isinstance(factor, int) or factor < 1:
        raise TypeError("the factor must be a positive integer")
    kept = F.filter(_x(), lambda v, i: i % factor == 0)
    return record.with_samples(kept, fs=record.meta.fs / factor, n=-(-record.meta.n // factor))


def scale(record: Record, factor: float, **changes) -> Record:
    return record.with_samples(F.transform(_x(), lambda v: v * F.lit(factor)), **changes)


def demean(record: Record) -> Record:
    centred = let(mean_of(_x(), record.meta.n), lambda mean: F.transform("samples", lambda v: v - mean))
    return record.with_samples(centred)


def detrend(record: Record, order: int = 1) -> Record:
    """Less the least-squares polynomial of the sample number."""
    n = record.meta.n
    if order != 1 or n < 2:
        return record.map_traces(lambda m: polynomial_residual(m, order))
    middle, spread = (n - 1) / 2, n * (n * n - 1) / 12
    lever = F.transform("samples", lambda v, i: v * (i - F.lit(middle)))
    line = F.struct(mean_of(_x(), n).alias("mean"), (total(lever) / F.lit(spread)).alias("slope"))
    flat = let(line, lambda p: F.transform("samples", lambda v, i: v - p["mean"] - p["slope"] * (i - F.lit(middle))))
    return record.with_samples(flat)


def tukey_weight(index: Column, m: int, alpha: float) -> Column:
    """Symmetric Tukey window of m points as an expression of the point's number."""
    if alpha <= 0 or m <= 1:
        return F.lit(1.0)
    alpha = min(alpha, 1.0)
    width, span = math.floor(alpha * (m - 1) / 2), alpha * (m - 1)
    left = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * (2 * index / F.lit(float(span)) - 1)))
    right = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * (2 * index / F.lit(float(span)) - F.lit(2 / alpha) + 1)))
    return F.when(index <= width, left).when(index >= m - width - 1, right).otherwise(F.lit(1.0))


def taper(record: Record, frac: float = 0.05) -> Record:
    n = record.meta.n
    return record.with_samples(F.transform(_x(), lambda v, i: v * tukey_weight(i, n, 2 * frac)))


def detaper(record: Record, frac: float = 0.05) -> Record:
    """Divide by the taper; where it is 0, the result is infinite, or NaN for 0 and NaN."""

    def divide(v: Column, i: Column) -> Column:
        w = tukey_weight(i, record.meta.n, 2 * frac)
        at_zero = F.when(F.isnan(v) | (v == 0), F.lit(math.nan)).when(v > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
        return F.when(w == 0, at_zero).otherwise(F.try_divide(v, w))

    return record.with_samples(F.transform(_x(), divide))


def preprocess(record: Record, order: int = 1) -> Record:
    """Detrend, demean, 10 % Tukey window."""
    return taper(demean(detrend(record, order)), 0.05)


def integrate(record: Record, method: str = "cum_trapezoid", tapered: bool = True) -> Record:
    """Cumulative trapezoids from 0, then a linear detrend, in one kernel a channel: nothing is shuffled."""
    if method != "cum_trapezoid":
        raise ValueError("the method must be cum_trapezoid")
    dt = record.meta.dt
    source = taper(record) if tapered else record
    return source.map_traces(lambda m: polynomial_residual(cumulative_trapezoids(m, dt, 1), 1), units="Strain")


def differentiate(record: Record) -> Record:
    """Central differences over 2 dt inside, one-sided over dt at the ends; needs two samples."""
    n, x = record.meta.n, _x()
    if n < 2:
        raise ValueError("a gradient needs at least two samples")
    ahead = F.concat(F.slice(x, 2, n - 1), F.slice(x, n, 1))
    behind = F.concat(F.slice(x, 1, 1), F.slice(x, 1, n - 1))
    gap = F.zip_with(ahead, behind, lambda a, b: a - b)
    dt = record.meta.dt
    edge = lambda v, i: v / F.when((i == 0) | (i == n - 1), F.lit(dt)).otherwise(F.lit(2 * dt))
    return record.with_samples(F.transform(gap, edge), units="Strain rate")
