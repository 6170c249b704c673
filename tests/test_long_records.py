"""Operators on chunks against the same operators on whole traces: uneven chunks, every edge, tiny tasks."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import kernels
from lumenspan.model import RecordMeta, from_matrix
from lumenspan.operators import aggregates, chunkmath, chunks, filters, longfft, pyramid, spectral, sweep, timeaxis, windows

META = RecordMeta(fs=100.0, n=0, start_time=datetime(2024, 1, 1))


def uneven(record, cuts):
    """Chunks that begin at the given samples."""
    cuts = [c for c in cuts if c < record.meta.n]
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.slice("samples", a + 1, b - a).alias("samples")) for a, b in zip(cuts, [*cuts[1:], record.meta.n])])
    return chunks.Chunked(record.traces.select("record_id", "channel_pos", "channel", F.inline(bounds)), record.meta)


def made(spark, n, channels=3, seed=1):
    return from_matrix(spark, np.random.default_rng(seed).normal(size=(n, channels)).cumsum(axis=0) + 5, META)


def matrix(record):
    return np.array([r["samples"] for r in record.traces.orderBy("channel_pos").collect()])


def held(x):
    return matrix(chunks.gathered(x))


CUTS = [[0], [0, 1, 2, 3, 50, 51, 170, 400], list(range(0, 600, 7))]


@pytest.fixture(scope="module", params=range(len(CUTS)), ids=["one chunk", "uneven", "sevens"])
def pair(request, spark):
    record = made(spark, 437)
    return record, uneven(record, CUTS[request.param])


def bins_of(frame, n, channels):
    out = np.zeros((channels, n), complex)
    for r in frame.collect():
        at = r["first"] + r["step"] * np.arange(len(r["re"]))
        out[r["channel_pos"], at] = np.array(r["re"]) + 1j * np.array(r["im"])
    return out


@pytest.mark.parametrize("n", [1, 2, 30, 97, 210, 256, 331, 437])
@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_transform_of_any_length(spark, n, cells):
    """Factors, primes (by chirps where a row would not fit), and squares of primes, in tasks of 40 numbers."""
    record = made(spark, n, seed=n)
    got = bins_of(longfft.transform(uneven(record, [0, 1, 9, 100, 101, 300]), cells=cells), n, 3)
    want = np.fft.fft(matrix(record), axis=1)
    assert np.allclose(got, want, atol=1e-9 * np.abs(want).max())


def test_shapes():
    assert (longfft.shape_of(720, 64).rows, longfft.shape_of(720, 64).columns) == (24, 30)
    assert longfft.shape_of(719, 64) is None
    assert longfft.shape_of(719, 719).rows == 1
    big = longfft.shape_of(10**10, longfft.CELLS)
    assert (big.rows, big.columns, big.width) == (100000, 100000, 10)


@pytest.mark.parametrize("options", [{}, {"norm": True}, {"pre": False, "nfft": 2}, {"pad": 11, "order": 3}])
def test_spectrum(pair, options):
    record, cut = pair
    got = {(r.channel, r.freq_idx): (r.freq, r.amplitude) for r in longfft.spectrum(cut, cells=100, **options).collect()}
    want = {(r.channel, r.freq_idx): (r.freq, r.amplitude) for r in spectral.spectrum(record, **options).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [437, 420, 419])
def test_hilbert_and_envelopes(spark, n):
    record = made(spark, n)
    cut = uneven(record, CUTS[1])
    for mine, other in ((longfft.envelope, spectral.envelope), (longfft.envelope_ref, spectral.envelope_ref)):
        got = mine(cut, size=50, cells=60)
        assert got.chunks.agg(F.max(F.size("samples"))).first()[0] <= 50
        assert np.allclose(held(got), matrix(other(record)), atol=1e-8)
    assert np.allclose(held(longfft.band_kept(cut, (3.0, 20.0), 64, 60)), matrix(spectral.fk_filter(record, 3, (3.0, 20.0), (0.0, 9.0))), atol=1e-8)


@pytest.mark.parametrize("n", [60, 97])
@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_fk(spark, n, cells):
    record = made(spark, n, channels=7)
    cut = uneven(record, [0, 1, 9, 50])
    key = lambda r: (r.k_idx, r.freq_idx)
    got, want = sorted(longfft.fk_spectrum(cut, 7, cells).collect(), key=key), sorted(spectral.fk_spectrum(record, 7).collect(), key=key)
    assert [tuple(r)[1:5] for r in got] == [tuple(r)[1:5] for r in want]
    assert np.allclose([r.magnitude for r in got], [r.magnitude for r in want], atol=1e-8)
    bands = (3.0, 30.0), (0.1, 0.3)
    assert np.allclose(held(longfft.fk_filter(cut, 7, *bands, cells)), matrix(spectral.fk_filter(record, 7, *bands)), atol=1e-8)


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 5])
def test_detrend(pair, order):
    record, cut = pair
    assert np.allclose(held(chunkmath.detrend(cut, order)), kernels.polynomial_residual(matrix(record), order), atol=1e-9)


def test_detrend_with_a_large_offset(spark):
    rng = np.random.default_rng(3)
    small, t = rng.normal(size=20_000), np.linspace(-1, 1, 20_000)
    x = small + 1e6 + 3e4 * t - 2e3 * t**3
    record = from_matrix(spark, x[:, None], META)
    got = held(chunkmath.detrend(chunks.chunked(record, 999), 3))[0]
    assert np.abs(got - kernels.polynomial_residual(small[None], 3)[0]).max() < 1e-9


def test_preprocess_and_integrate(pair):
    record, cut = pair
    assert np.allclose(held(chunkmath.preprocess(cut, 2)), matrix(timeaxis.preprocess(record, 2)), atol=1e-9)
    for tapered in (True, False):
        got = chunkmath.integrate(cut, tapered)
        assert got.meta.units == "Strain"
        assert np.allclose(held(got), matrix(timeaxis.integrate(record, tapered=tapered)), atol=1e-9)


@pytest.mark.parametrize("window", [None, 0.03, 1.0, 4.37])
def test_rms_of_segments(pair, window):
    record, cut = pair
    got = sorted(map(tuple, chunkmath.rmsa(cut, window).select("channel", "segment", "time_idx", "rms").collect()))
    want = sorted(map(tuple, aggregates.rmsa(record, window).select("channel", "segment", "time_idx", "rms").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_peak_to_peak(pair, spark):
    record, cut = pair
    bumps = np.zeros((437, 4))
    bumps[[25, 60], 0] = 3, -1  # near one another
    bumps[[25, 300], 1] = 3, -1  # far apart
    bumps[:, 2] = np.tile([1.0, -1.0, 0.0], 146)[:437]  # ties: first places count
    bumps[[430, 100], 3] = 9, -1  # the highest within the last window
    other = from_matrix(spark, bumps, META)
    for whole, parts in ((record, cut), (other, uneven(other, [0, 24, 26, 61, 299, 431]))):
        got = sorted(map(tuple, chunkmath.peak_to_peak(parts).select("channel", "pp").collect()))
        assert np.allclose(got, sorted(map(tuple, aggregates.peak_to_peak(whole).select("channel", "pp").collect())))


@pytest.mark.parametrize("n", [None, 50, 333, 1000])
@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_welch(pair, n, cells):
    """Segments longer than chunks and than blocks."""
    record, cut = pair
    got = sorted(map(tuple, windows.psd(cut, n, cells=cells).select("channel", "freq_idx", "freq", "power").collect()))
    want = sorted(map(tuple, spectral.psd(record, pre=False, n=n).select("channel", "freq_idx", "freq", "power").collect()))
    assert np.allclose(got, want)


@pytest.mark.parametrize("norm", [False, True])
def test_short_time_spectra(pair, norm):
    record, cut = pair
    columns = ["channel", "frame", "freq_idx", "time_s", "freq", "power"]
    for cells in (30, 1 << 20):
        got = windows.channel_spectrogram(cut, 1, norm, cells).select(*columns).collect()
        want = spectral.channel_spectrogram(record, 1, norm).select(*columns).collect()
        assert len(got) == len(want)
        assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)))
    assert windows.channel_spectrogram(cut).select("channel").distinct().count() == 3


@pytest.mark.parametrize("size", [None, 9, 100])
def test_long_fir_filters(pair, size):
    """Filters longer than chunks and than blocks of outputs."""
    record, cut = pair
    assert np.allclose(held(windows.lowpass_fir(cut, 10.0, 128, size)), matrix(filters.lowpass_fir(record, 10.0, 128)), atol=1e-9)
    assert np.allclose(held(windows.remez_fir(cut, 8.0, 16.0, size)), matrix(filters.remez_fir(record, 8.0, 16.0)), atol=1e-9)
    whole, mine = filters.decimate(record, 25.0), windows.fir_decimate(cut, 4, size=size)
    assert (whole.meta.n, whole.meta.fs) == (mine.meta.n, mine.meta.fs)
    assert np.allclose(held(mine), matrix(whole), atol=1e-9)


@pytest.mark.parametrize("n,factor", [(437, 4), (437, 3), (20, 2), (2, 2)])
def test_zero_phase_decimation(spark, n, factor):
    record = made(spark, n)
    for cuts in CUTS:
        got = chunkmath.decimate_cheby(uneven(record, cuts), factor)
        want = filters.decimate(record, 100.0 / factor, None)
        assert (got.meta.n, got.meta.fs) == (want.meta.n, want.meta.fs)
        assert np.allclose(held(got), matrix(want), atol=1e-8)


def test_no_chunks(spark):
    record = made(spark, 30)
    none = replace(uneven(record, [0]), chunks=uneven(record, [0]).chunks.limit(0))
    for frame in (longfft.transform(none), longfft.hilbert(none), chunkmath.detrend(none).chunks, chunkmath.rmsa(none), chunkmath.peak_to_peak(none), windows.psd(none), windows.lowpass_fir(none, 10.0, 16).chunks, chunkmath.decimate_cheby(none, 2).chunks):
        assert frame.count() == 0


# --- many recordings ---------------------------------------------------------------------------------------------
def joined(parts, fill):
    """parts: (id, first, {channel: values}); the earliest recording that covers a sample speaks."""
    total = max(first + len(next(iter(v.values()))) for _, first, v in parts)
    channels = sorted({c for _, _, v in parts for c in v})
    out = np.full((len(channels), total), fill)
    for i, c in enumerate(channels):
        taken = np.zeros(total, bool)
        for _, first, values in sorted((p for p in parts if c in p[2]), key=lambda p: (p[1], p[0])):
            span = np.arange(first, first + len(values[c]))
            free = ~taken[span]
            out[i, span[free]] = values[c][free]
            taken[span] = True
    return out


@pytest.mark.parametrize("seed", range(3))
def test_concatenate_all(spark, seed):
    """Overlaps in every way, recordings within others, equal starts, gaps, channels that some recordings lack."""
    rng = np.random.default_rng(seed)
    parts = []
    for r in range(12):
        first = int(rng.integers(0, 300)) if r else 0
        n = int(rng.integers(1, 60))
        labels = [1.0, 2.0, 7.5] if r % 4 else [2.0, 7.5]
        parts.append((f"r{r:02d}", first, {c: rng.normal(size=n) for c in labels}))
    parts.append(("r99", parts[3][1], {c: rng.normal(size=70) for c in (1.0, 2.0)}))
    rows, records = [], []
    for k, first, values in parts:
        n = len(next(iter(values.values())))
        records.append((k, datetime(2024, 1, 1) + first * (datetime(2024, 1, 2) - datetime(2024, 1, 1)) / 86400 / 100, 100.0, n))
        for i, (c, x) in enumerate(values.items()):
            at = 0
            while at < n:
                size = int(rng.integers(1, 25))
                rows.append((k, i, c, at, [float(v) for v in x[at : at + size]]))
                at += size
    frame = spark.createDataFrame(rows, "record_id string, channel_pos int, channel double, start long, samples array<double>")
    table = spark.createDataFrame(records, "record_id string, start_time timestamp_ntz, fs double, n long")
    got = sweep.concatenate_all(frame, table, META, -3.0, gap_row=7)
    whole = np.array([r["samples"] for r in chunks.gathered(got).traces.orderBy("channel").collect()])
    assert got.meta.n == whole.shape[1]
    assert np.array_equal(whole, joined(parts, -3.0))
    ends = got.chunks.selectExpr("channel", "start", "start + size(samples) AS end").orderBy("channel", "start").collect()
    for a, b in zip(ends, ends[1:]):
        assert a.channel != b.channel or a.end == b.start


def test_concatenate_all_needs_one_frequency(spark):
    table = spark.createDataFrame([("a", META.start_time, 1.0, 5), ("b", META.start_time, 2.0, 5)], "record_id string, start_time timestamp_ntz, fs double, n long")
    frame = spark.createDataFrame([], "record_id string, channel_pos int, channel double, start long, samples array<double>")
    with pytest.raises(ValueError, match="sampling frequency"):
        sweep.concatenate_all(frame, table, META)
    assert sweep.concatenate_all(frame, table.limit(0), META).chunks.count() == 0


# --- pyramids ------------------------------------------------------------------------------------------------------
def test_pyramid_and_views(spark, tmp_path):
    record = made(spark, 437, channels=9)
    cut, x = uneven(record, CUTS[1]), matrix(record)
    path = str(tmp_path / "pyramid")
    pyramid.write(cut, path, 3, base=5, factor=3)
    rows = pyramid.pyramid(cut, 3, 5, 3).collect()
    written = spark.read.parquet(path)
    assert sorted(map(tuple, written.select("level", "record_id", "channel_block", "time_block", "low", "high").collect())) == sorted(map(tuple, rows))
    for r in rows:
        f = 3**r.level
        cell = x[r.channel_block * f : (r.channel_block + 1) * f, r.time_block * 5 * f : (r.time_block + 1) * 5 * f]
        assert (r.low, r.high) == (cell.min(), cell.max())
    assert len(rows) == 9 * 88 + 3 * 30 + 1 * 10
    seen = pyramid.view(spark, path, 3, (100, 250), (2, 8), (11, 4), base=5, factor=3)
    assert {(r.first_sample, r.first_channel) for r in seen.collect()} == {(s, c) for s in range(90, 250, 15) for c in (0, 3, 6)}
    files = seen.inputFiles()
    assert files and all("level=1" in f for f in files)
    assert pyramid.level_for(437, 9, (1, 1), 3, 5, 3) == 2
    assert pyramid.level_for(437, 9, (88, 9), 3, 5, 3) == 0
