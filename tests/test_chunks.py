"""Chunks against whole traces."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from lumenspan.functions import kernels
from lumenspan.model import RecordMeta, from_matrix
from lumenspan.operators import chunks, filters, timeaxis
from lumenspan.sources import datasource

META = RecordMeta(fs=100.0, n=0, start_time=datetime(2024, 1, 1))


@pytest.fixture(scope="module")
def record(spark):
    return from_matrix(spark, np.random.default_rng(1).normal(size=(537, 3)).cumsum(axis=0), META)


def matrix(record):
    return np.array([r["samples"] for r in record.traces.orderBy("channel_pos").collect()])


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_filters_carry_their_state(record, size):
    held = chunks.chunked(record, size)
    assert np.array_equal(matrix(chunks.gathered(held)), matrix(record))
    for zerophase in (False, True):
        got = matrix(chunks.gathered(chunks.band_filter(held, "bandpass", (2.0, 20.0), zerophase=zerophase)))
        assert np.allclose(got, matrix(filters.band_filter(record, "bandpass", (2.0, 20.0), zerophase=zerophase)), atol=1e-9)


def test_fir_borrows_from_the_chunk_before(record):
    taps = np.hanning(9)
    want = kernels.fir_outputs(matrix(record), taps, np.arange(537))
    assert np.allclose(matrix(chunks.gathered(chunks.fir_filter(chunks.chunked(record, 50), taps))), want)
    with pytest.raises(Exception, match="cannot feed"):
        chunks.fir_filter(chunks.chunked(record, 5), taps).chunks.collect()


@pytest.mark.parametrize("bounds", [(None, None), (0.7, 3.2), (1.0, 1.0), (4.99, 99.0)])
def test_trim_and_the_rest(record, bounds):
    t0, tf = (None if b is None else META.start_time + timedelta(seconds=b) for b in bounds)
    whole, held = timeaxis.trim(record, t0, tf), chunks.trim(chunks.chunked(record, 64), t0, tf)
    assert (held.meta.n, held.meta.start_time) == (whole.meta.n, whole.meta.start_time)
    if whole.meta.n:
        assert np.array_equal(matrix(chunks.gathered(held)), matrix(whole))
        assert np.allclose(matrix(chunks.gathered(chunks.demean(held))), matrix(timeaxis.demean(whole)))
        got = [r["rms"] for r in chunks.rms(held).orderBy("channel").collect()]
        assert np.allclose(got, np.sqrt((matrix(whole) ** 2).mean(axis=1)))
    else:
        assert held.chunks.count() == 0


def test_a_channel_of_four_gigabytes(spark, tmp_path):
    """Half a billion doubles a channel, mostly a hole in the file; only the wanted range is read, then filtered."""
    n = 540_000_000
    x = np.lib.format.open_memmap(tmp_path / "long.npy", mode="w+", dtype="<f8", shape=(n, 1))
    at = 400_000_000
    x[at : at + 3000, 0] = np.random.default_rng(2).normal(size=3000)
    x.flush()
    datasource.register(spark)
    rows = spark.read.format("lumenspan_chunks").options(path=str(tmp_path / "long.npy"), size=1000, first=at, last=at + 3000).load()
    assert rows.rdd.getNumPartitions() == 3
    held = chunks.Chunked(rows, RecordMeta(fs=100.0, n=3000, start_time=META.start_time))
    cut = chunks.trim(held, None, META.start_time + timedelta(seconds=25))
    got = matrix(chunks.gathered(chunks.band_filter(cut, "lowpass", 10.0)))
    sos = filters.design_band("lowpass", 10.0, 100.0)
    assert np.allclose(got, kernels.sos_filter(np.array(x[at : at + 2500].T), sos), atol=1e-9)
    planned = datasource.ChunkReader({"path": str(tmp_path / "long.npy")}).partitions()
    assert len(planned) == 540 and planned[-1].end == n
