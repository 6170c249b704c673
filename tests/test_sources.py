import io
import struct
from datetime import datetime

import numpy as np
import pytest

from lumenspan.sources import parsers, recordings
from lumenspan.streaming.live import live_amplitudes


class Group(dict):
    def __init__(self, attrs=None, **children):
        super().__init__(children)
        self.attrs = attrs or {}


class Data:
    def __init__(self, value, attrs=None):
        self.value, self.attrs = value, attrs or {}

    def __getitem__(self, key):
        return self.value


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def tdms(channels, properties, interleaved=False):
    objects = [(b"/", properties, None), (b"/'Measurement'", {}, None)]
    objects += [(f"/'Measurement'/'{name}'".encode(), {}, values) for name, values in channels.items()]
    meta = struct.pack("<I", len(objects))
    for path, props, values in objects:
        meta += text(path.decode())
        meta += struct.pack("<I", 0xFFFFFFFF) if values is None else struct.pack("<IIIQ", 20, 2, 1, len(values))
        meta += struct.pack("<I", len(props))
        for k, v in props.items():
            meta += text(k) + (struct.pack("<I", 0x20) + text(v) if isinstance(v, str) else struct.pack("<Id", 10, v))
    table = np.array(list(channels.values()), "<i2")
    raw = (table.T if interleaved else table).copy().tobytes()
    toc = 2 | 4 | 8 | (32 if interleaved else 0)
    return b"TDSm" + struct.pack("<IIQQ", toc, 4713, len(meta) + len(raw), len(meta)) + meta + raw


PROPERTIES = {"name": "fibre_7", "SamplingFrequency[Hz]": 1000.0, "ISO8601 Timestamp": "2024-01-02T03:04:05.250Z", "SpatialResolution[m]": 0.25, "GaugeLength": 10.0, "OffsetLength": 3.0}


@pytest.mark.parametrize("interleaved", [False, True])
def test_tdms(spark, tmp_path, interleaved):
    data = tdms({"2": [5, 6, 7], "10": [1, 2, 3]}, PROPERTIES, interleaved)
    path = tmp_path / "a.tdms"
    path.write_bytes(data + data)
    record = recordings.open_recording(spark, str(path), "silixa", channels=[10])
    rows = record.traces.collect()
    assert [(r["channel"], r["samples"]) for r in rows] == [(10.0, [1, 2, 3, 1, 2, 3])]
    assert record.meta.start_time == datetime(2024, 1, 2, 3, 4, 5, 250000) and record.meta.fiber == "fibre" and record.meta.n == 6
    assert parsers.silixa_tdms(data)[2] == [2, 10]


def test_numpy_files(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", ph=x, distance=np.array([0, 0.5, 1]), freq=np.array(200.0), time=np.arange(6))
    a = recordings.open_recording(spark, str(tmp_path / "a.npy"), "bam")
    b = recordings.open_recording(spark, str(tmp_path / "b.npz"), "bam")
    assert a.meta.fs == 100_000 and b.meta.fs == 200 and b.meta.spatial_interval == 0.5 and b.meta.n == 4
    assert [r["samples"] for r in b.traces.orderBy("channel").collect()] == x.T.tolist()
    recordings.write_parquet(a, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert recordings.metas_of(spark, str(tmp_path / "*.npy"), "bam").count() == 1


def test_unknown_vendor():
    with pytest.raises(ValueError, match="known are"):
        parsers.parse("x.csv", "acme", b"")


def test_hdf5_layouts():
    x = np.arange(6.0).reshape(3, 2)
    raw = Group({"OutputDataRate": 500, "RawDataUnit": b"rad * 2^16", "NumberOfLoci": 2}, RawData=Data(x, {"Count": 3, "PartStartTime": "2024-01-01T00:00:00+00:00"}))
    attrs = {"MeasurementStartTime": b"2024-01-01T01:00:00.5+01:00", "SpatialSamplingInterval": 2.0, "GaugeLength": 10.0, "StartLocusIndex": 4, "SpatialResolution": 1.0, "PreTriggerSamples": -7}
    f = Group(Acquisition=Group(attrs, **{"Raw[0]": raw}))
    meta, matrix, labels = parsers.quantx_h5(f)
    assert meta.start_time == datetime(2024, 1, 1, 0, 0, 0, 500000) and meta.units.endswith("2^16") and labels == [0, 1] and (matrix == x).all()
    meta = parsers.silixa_h5(f)[0]
    assert meta.fs == 500 and meta.channel_offset == 7 and meta.units == "counts"
    blocks = np.arange(2 * 5 * 2.0).reshape(2, 5, 2)
    febus = Group(A=Group(Source1=Group(time=Data([10.5]), Zone1=Group({"Spacing": [0.8, 2.0], "GaugeLength": [5.0]}, SR=Data(blocks)))))
    meta, matrix, _ = parsers.febus_h5(febus, lag=3)
    assert meta.fs == 500 and matrix.shape == (6, 2) and matrix[3, 0] == 10 and meta.n == 6
    terra = Group({"dt_computer": 0.01, "dx": 2.0, "gauge_length": 8.0, "file_start_gps_time": 0, "file_start_computer_time": 86400.0, "sensing_range_start": 9.0, "data_product_units": "m/s"}, data_product=Group(data=Data(x)))
    meta = parsers.terra15_h5(terra)[0]
    assert meta.start_time == datetime(1970, 1, 2) and meta.channel_offset == 4 and meta.fs == pytest.approx(100)
    head = {"dt": 0.002, "time": 5.0, "dx": 1.0, "gaugeLength": 4.0, "sensitivityUnits": b"rad/(strain*m)", "sensitivities": [[9.0]], "channels": [8, 12]}
    meta = parsers.asn_h5(Group(data=Data(x), header=Group(**{k: Data(v) for k, v in head.items()})))[0]
    assert meta.spatial_interval == 4 and meta.conv_factor == 9 and meta.channel_offset == 8
    aragon = Group({"trigger_frequency": 100.0, "Global_FileSaveIO_TimeStamp_s": 1.0, "spatial_sampling": 10.0, "Global_RAM_User_SET_Pulse_Width_(meter)": 10.0, "fiber_position_offset": 2}, strain=Data(x))
    assert np.allclose(parsers.aragon_h5(aragon)[1], x * 1e-9)
    assert ("/Acquisition/Raw[0]", "group") in list(parsers.scan_tree(f)) and parsers.h5_to_dict(f)["Acquisition"]["Raw[0]"]["RawData"] is x


def test_live_amplitudes(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), 1.0, float(v)) for s, v in ((0, 3), (0, -4), (1, 1), (30, 0))]
    spark.createDataFrame(rows, "ts timestamp, channel double, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, channel double, value double").parquet(str(tmp_path / "in"))
    sink = live_amplitudes(stream).writeStream.outputMode("append").format("memory").queryName("live").start()
    sink.processAllAvailable()
    sink.stop()
    first = spark.sql("SELECT * FROM live ORDER BY window_start").first()
    assert first["n"] == 2 and first["pp"] == 7 and first["rms"] == pytest.approx(np.sqrt(12.5))


def test_bytes_are_not_pickled():
    buffer = io.BytesIO()
    np.save(buffer, np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        parsers.bam_npy(buffer.getvalue())


def test_data_source(spark, tmp_path):
    from lumenspan.sources.datasource import register

    x = np.arange(12.0).reshape(4, 3)
    for name in ("a", "b"):
        np.save(tmp_path / f"{name}.npy", x)
    register(spark)
    reader = spark.read.format("lumenspan").option("vendor", "bam")
    rows = reader.option("channels", "0,2").load(str(tmp_path)).orderBy("record_id", "channel").collect()
    assert [(r["channel_pos"], r["channel"]) for r in rows] == [(0, 0.0), (1, 2.0)] * 2 and rows[1]["samples"] == [2, 5, 8, 11]
    with pytest.raises(Exception, match="no files"):
        reader.load(str(tmp_path / "none*")).count()


@pytest.mark.parametrize("interleaved", [False, True])
def test_tdms_in_chunks(spark, tmp_path, interleaved):
    """Chunks across segments, channels by label, filters on both pushed into the plan."""
    from lumenspan.sources import datasource

    rng = np.random.default_rng(4)
    x = rng.integers(-999, 999, size=(3, 40, 4)).astype("i2")
    data = b"".join(tdms({str(3 * c): s[:, c].tolist() for c in range(4)}, PROPERTIES, interleaved) for s in x)
    (tmp_path / "a.tdms").write_bytes(data)
    datasource.register(spark)
    whole = x.reshape(120, 4)
    rows = spark.read.format("lumenspan_chunks").options(path=str(tmp_path / "a.tdms"), size=50).load()
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.channel, r.start): r.samples for r in rows.collect()}
    assert got == {(3.0 * c, s): whole[s : s + 50, c].tolist() for c in range(4) for s in (0, 50, 100)}
    some = rows.where("channel IN (3.0, 9.0) AND start >= 50 AND size(samples) > 0")
    assert some.rdd.getNumPartitions() == 2
    assert sorted((r.channel_pos, r.channel, r.start) for r in some.collect()) == [(1, 3.0, 50), (1, 3.0, 100), (3, 9.0, 50), (3, 9.0, 100)]
    traces = spark.read.format("lumenspan").options(path=str(tmp_path / "a.tdms")).load().where("channel = 6.0").collect()
    assert [(r.channel_pos, r.samples) for r in traces] == [(2, whole[:, 2].tolist())]


def test_only_the_wanted_bytes_of_a_tdms_file_are_touched():
    """All other bytes may be anything."""
    data = tdms({"0": [1] * 50, "1": list(range(50)), "2": [3] * 50}, PROPERTIES)
    _, pieces = parsers.tdms_layout(data)
    path = "/'Measurement'/'1'"
    (piece,) = pieces[path]
    blank = bytearray(b"\xff" * len(data))
    blank[piece.offset + 20 * piece.step : piece.offset + 30 * piece.step] = data[piece.offset + 20 * piece.step : piece.offset + 30 * piece.step]
    assert parsers.piece_values(bytes(blank), pieces[path], 20, 30).tolist() == list(range(20, 30))
    assert parsers.piece_values(data, pieces[path], 45, 99).tolist() == list(range(45, 50))
    assert parsers.piece_values(data, pieces[path], 60, 70).tolist() == []
