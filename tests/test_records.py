from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest

from lumenspan.model import RecordMeta, from_matrix, from_samples
from lumenspan.operators import aggregates, concat, correct, export, filters, plotdata, space, spectral, timeaxis

START = datetime(2024, 5, 1)


def make(spark, matrix, fs=100.0, **meta):
    return from_matrix(spark, np.asarray(matrix, float), RecordMeta(fs=fs, n=len(matrix), start_time=START, **meta))


def back(record):
    return np.array([r["samples"] for r in record.traces.orderBy("channel_pos").collect()], float).T


def test_trim_edges(spark):
    r = make(spark, np.arange(10)[:, None])
    assert back(timeaxis.trim(r)).ravel().tolist() == list(range(9))
    assert back(timeaxis.trim(r, inclusive_end=True)).ravel().tolist() == list(range(10))
    cut = timeaxis.trim(r, START.replace(microsecond=25_000), START.replace(microsecond=60_000))
    assert back(cut).ravel().tolist() == [2, 3, 4, 5] and cut.meta.start_time.microsecond == 20_000 and cut.meta.n == 4
    assert timeaxis.trim(r, datetime(2030, 1, 1)).meta.n == 0
    with pytest.raises(ValueError):
        timeaxis.trim(r, None, datetime(2000, 1, 1))


def test_channels(spark):
    r = make(spark, np.arange(12).reshape(2, 6))
    part = space.restrict_channels(r, (2, 4))
    assert back(part).tolist() == [[2, 3, 4], [8, 9, 10]]
    with pytest.raises(ValueError):
        space.restrict_channels(r, 77)
    up = space.resample(r, "upsampling")
    assert back(space.resample(up, "downsampling")).tolist() == back(r).tolist()
    assert back(up)[0].tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5] and up.meta.spatial_interval == 0.5
    assert space.get_data(up, 1.5).count() == 1
    with pytest.raises(ValueError):
        space.resample(r, "sideways")


@pytest.mark.parametrize("late,n,expected", [(0, 10, "01234" "abcde"), (3, 13, "01234---abcde"), (-2, 8, "01234cde")])
def test_concatenate(spark, late, n, expected):
    a, b = make(spark, np.arange(5)[:, None]), make(spark, np.arange(10, 15)[:, None])
    b = type(b)(b.traces, replace(b.meta, start_time=a.meta.time_of(5 + late)))
    joined = concat.concatenate(b, a, None)
    values = back(joined).ravel()
    assert joined.meta.n == n == len(values)
    code = {**{float(i): str(i) for i in range(5)}, **{10.0 + i: "abcde"[i] for i in range(5)}}
    assert "".join("-" if np.isnan(v) else code[v] for v in values) == expected
    other = type(b)(b.traces, replace(b.meta, fs=1.0))
    with pytest.raises(ValueError):
        concat.concatenate(a, other)


def test_nan_is_kept_and_spreads(spark):
    x = np.ones((8, 2))
    x[3, 1] = np.nan
    r = make(spark, x)
    assert np.isnan(back(timeaxis.demean(r))[:, 1]).all() and (back(timeaxis.demean(r))[:, 0] == 0).all()
    assert np.isnan(back(r.map_traces(lambda m: m))[3, 1])


def test_mathematics(spark):
    t = np.arange(200)
    r = make(spark, np.stack([3 + 2 * t, 5 - 0.1 * t], axis=1))
    assert abs(back(timeaxis.detrend(r))).max() < 1e-9
    assert np.allclose(back(timeaxis.differentiate(r))[:, 0], 200)
    sine = np.sin(2 * np.pi * t / 50)[:, None]
    gradient = back(timeaxis.differentiate(timeaxis.integrate(make(spark, sine), tapered=False)))
    assert np.allclose(gradient[5:-5], sine[5:-5], atol=0.05)
    square = make(spark, (t**3)[:, None].astype(float))
    assert abs(back(timeaxis.detrend(square, 3))).max() < 1e-5
    inf = back(timeaxis.detaper(make(spark, [[1.0], [2.0], [-1.0]])))
    assert np.isposinf(inf[0, 0]) and np.isneginf(inf[2, 0])
    with pytest.raises(ValueError):
        timeaxis.integrate(r, "simpson")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_records(spark, n):
    r = make(spark, np.arange(1, n + 1)[:, None])
    assert back(timeaxis.taper(r)).shape == (n, 1)
    assert back(timeaxis.detrend(r)).shape == (n, 1)
    assert aggregates.std(r).first()["std"] == pytest.approx(np.arange(1, n + 1).std())


def test_aggregates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(103, 3))
    r = make(spark, x, fs=10.0)
    rms = {(a["channel"], a["segment"]): a["rms"] for a in aggregates.rmsa(r, 2.0).collect()}
    for s, part in enumerate(np.array_split(x, 5)):
        assert rms[1.0, s] == pytest.approx(np.sqrt((part[:, 1] ** 2).mean()))
    with pytest.raises(ValueError):
        aggregates.rmsa(r, 1000.0)
    with pytest.raises(ValueError):
        aggregates.peak_to_peak(make(spark, x, fs=3.0))
    assert aggregates.colour_limit(r).first()["limit"] == pytest.approx(abs(x).max())


def test_corrections(spark):
    x = np.arange(20, dtype=float).reshape(2, 10)
    r = make(spark, x, company="terra15", units="m/s", gauge_length=3.0)
    done = correct.instr_correct(r)
    assert np.allclose(back(done), 1) and [t["channel"] for t in done.traces.orderBy("channel").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert correct.instr_correct(done) is done and done.meta.units == "strain-rate"
    same = correct.instr_correct(make(spark, x, company="febus"))
    assert back(same).tolist() == x.tolist() and same.meta.units is None
    with pytest.raises(ValueError):
        correct.instr_correct(make(spark, x, company="terra15", units="m/s", gauge_length=0.1))


def test_filters(spark):
    t = np.arange(1000) / 100
    r = make(spark, (np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 30 * t))[:, None])
    low = back(filters.band_filter(r, "lowpass", 10.0, zerophase=True)).ravel()
    assert np.allclose(low[200:-200], np.sin(2 * np.pi * 2 * t)[200:-200], atol=0.01)
    with pytest.warns(UserWarning):
        filters.band_filter(r, "bandpass", (10.0, 60.0))
    for bad in (("lowpass", 60.0), ("bandpass", (70.0, 80.0)), ("bandstop", (10.0, 60.0)), ("notch", 3.0)):
        with pytest.raises(ValueError):
            filters.band_filter(r, *bad)
    halved = filters.decimate(r, 50.0)
    assert halved.meta.fs == 50 and back(halved).shape[0] == halved.meta.n
    chebyshev = back(filters.decimate(r, 25.0, None)).ravel()
    assert np.allclose(chebyshev[30:-30], np.sin(2 * np.pi * 2 * t)[::4][30:-30], atol=0.02)
    for bad in ({"new_freq": 300.0}, {"new_freq": 50.0, "ftype": "fir235"}, {"new_freq": 50.0, "ftype": "x"}):
        with pytest.raises(ValueError):
            filters.decimate(r, **bad)


def test_plane_wave_and_fk_filter(spark):
    n, c = 64, 16
    wave = np.cos(2 * np.pi * (5 * np.arange(n)[:, None] / n - 3 * np.arange(c)[None] / c))
    r = make(spark, wave, fs=64.0)
    top = spectral.fk_spectrum(r, c).orderBy("magnitude", ascending=False).limit(2).collect()
    assert {(round(t["freq"]), round(t["k"] * c)) for t in top} == {(5, -3), (-5, 3)}
    assert np.allclose(back(spectral.fk_filter(r, c, (4, 6), (2 / c, 4 / c))), wave, atol=1e-9)
    assert np.allclose(back(spectral.fk_filter(r, c, (10, 20), (0, 1))), 0, atol=1e-9)


def test_times_metadata_export(spark):
    r = make(spark, np.arange(8).reshape(4, 2), fs=4.0)
    assert [x["time"] for x in r.times("isoformat").orderBy("sample_idx").collect()][1] == "2024-05-01T00:00:00.250000Z"
    with pytest.raises(ValueError):
        r.times("julian")
    assert {x["key"] for x in r.metadata().collect()} >= {"fs", "dt", "end_time", "units"}
    row = export.as_traces(r).orderBy("station").first()
    assert row["station"] == "00000" and row["npts"] == 4 and row["delta"] == 0.25
    assert r.copy() is r
    assert back(from_samples(r.samples(), r.meta)).tolist() == back(r).tolist()
    assert plotdata.short_milliseconds(1500) == "1.5" and plotdata.short_milliseconds(0) == "0"
    assert plotdata.interactive(r, 1)[1].count() == 4
