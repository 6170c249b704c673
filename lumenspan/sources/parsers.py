"""Vendor files as bytes -> (metadata, matrix of time by channel, channel labels).

NumPy files and TDMS are read directly; HDF5 layouts need h5py, but their parsers only use mappings with attributes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np

from lumenspan.model import RecordMeta

Parsed = tuple[RecordMeta, np.ndarray, list[float]]
FEBUS_LAG = 201
EPOCH = datetime(1970, 1, 1)


def from_epoch(seconds: float) -> datetime:
    return EPOCH + timedelta(microseconds=round(float(seconds) * 1e6))


def from_iso(text) -> datetime:
    text = text.decode() if isinstance(text, bytes) else str(text)
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def bam_npy(data: bytes) -> Parsed:
    matrix = np.load(io.BytesIO(data), allow_pickle=False).astype(float)
    meta = RecordMeta(fs=100_000.0, n=len(matrix), start_time=datetime(2023, 3, 1), spatial_interval=0.4, gauge_length=2.0, company="bam", format="npy")
    return meta, matrix, list(range(matrix.shape[1]))


def bam_npz(data: bytes) -> Parsed:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        matrix, distance, fs = arrays["ph"].astype(float), arrays["distance"], float(np.ravel(arrays["freq"])[0])
    meta = RecordMeta(fs=fs, n=len(matrix), start_time=datetime(2023, 3, 1), spatial_interval=float(distance[1] - distance[0]), gauge_length=2.0, company="bam", format="npz")
    return meta, matrix, list(range(matrix.shape[1]))


# --- TDMS ---------------------------------------------------------------------------------------------------------
_TYPES = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8"}
_META, _RAW, _NEW, _INTERLEAVED, _BIG = 1 << 1, 1 << 3, 1 << 2, 1 << 5, 1 << 6


class _Reader:
    def __init__(self, data: bytes, at: int, order: str):
        self.data, self.at, self.order = data, at, order

    def take(self, kind: str):
        value = struct.unpack_from(self.order + kind, self.data, self.at)[0]
        self.at += struct.calcsize(self.order + kind)
        return value

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def value(self, kind: int):
        if kind == 0x20:
            return self.text()
        if kind == 0x21:
            return bool(self.take("B"))
        if kind == 0x44:
            parts = (self.take("Q"), self.take("q")) if self.order == "<" else (self.take("q"), self.take("Q"))
            fraction, seconds = parts if self.order == "<" else parts[::-1]
            return datetime(1904, 1, 1) + timedelta(seconds=seconds, microseconds=round(fraction * 1e6 / 2**64))
        if kind not in _TYPES:
            raise ValueError(f"TDMS property type {kind:#x} is not supported")
        return self.take({"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "i8": "q", "u8": "Q", "f4": "f", "f8": "d"}[_TYPES[kind]])


@dataclass(frozen=True)
class Piece:
    """Values of a channel in a segment: `count` of a type from byte `offset` on, `step` bytes apart."""

    offset: int
    kind: str
    count: int
    step: int


def tdms_layout(data) -> tuple[dict[str, dict], dict[str, list[Piece]]]:
    """Properties by object path, and where each channel's values lie, from the headers of all segments: of a mapped file
    nothing else is read."""
    properties: dict[str, dict] = {}
    layout: dict[str, tuple[str, int]] = {}
    active: list[str] = []
    pieces: dict[str, list[Piece]] = {}
    at = 0
    while at + 28 <= len(data):
        if bytes(data[at : at + 4]) != b"TDSm":
            raise ValueError("not a TDMS segment")
        toc = struct.unpack_from("<I", data, at + 4)[0]
        order = ">" if toc & _BIG else "<"
        following, raw = struct.unpack_from(order + "QQ", data, at + 12)
        end = len(data) if following == 0xFFFFFFFFFFFFFFFF else at + 28 + following
        reader = _Reader(data, at + 28, order)
        if toc & _META:
            if toc & _NEW:
                active = []
            for _ in range(reader.take("I")):
                path = reader.text()
                size = reader.take("I")
                if size == 20 or size == 28:
                    kind, dimension, count = reader.take("I"), reader.take("I"), reader.take("Q")
                    if kind not in _TYPES or dimension != 1:
                        raise ValueError(f"TDMS data of type {kind:#x} are not supported")
                    layout[path] = (_TYPES[kind], count)
                elif size not in (0, 0xFFFFFFFF):
                    raise ValueError("DAQmx data in TDMS are not supported")
                if size != 0xFFFFFFFF and path not in active:
                    active.append(path)
                elif size == 0xFFFFFFFF and path in active:
                    active.remove(path)
                own = properties.setdefault(path, {})
                for _ in range(reader.take("I")):
                    name = reader.text()
                    own[name] = reader.value(reader.take("I"))
        if toc & _RAW and active:
            start = at + 28 + raw
            width = sum(np.dtype(layout[p][0]).itemsize * layout[p][1] for p in active)
            for _ in range((end - start) // width if width else 0):
                if toc & _INTERLEAVED:
                    sizes = [np.dtype(layout[p][0]).itemsize for p in active]
                    places = start + np.cumsum([0, *sizes[:-1]])
                    found = [Piece(int(o), order + layout[p][0], layout[active[0]][1], sum(sizes)) for p, o in zip(active, places)]
                else:
                    sizes = [np.dtype(layout[p][0]).itemsize * layout[p][1] for p in active]
                    places = start + np.cumsum([0, *sizes[:-1]])
                    found = [Piece(int(o), order + layout[p][0], layout[p][1], np.dtype(layout[p][0]).itemsize) for p, o in zip(active, places)]
                for p, piece in zip(active, found):
                    pieces.setdefault(p, []).append(piece)
                start += width
        at = end
    return properties, pieces


def piece_values(data, pieces: list[Piece], first: int = 0, last: int | None = None) -> np.ndarray:
    """A channel's values number first up to, not including, last; no byte of others is touched."""
    out, at = [], 0
    for p in pieces:
        a, b = max(first - at, 0), p.count if last is None else min(last - at, p.count)
        if a < b:
            out.append(np.ndarray(b - a, p.kind, data, p.offset + a * p.step, p.step).astype(float))
        at += p.count
    return np.concatenate(out) if out else np.zeros(0)


def tdms_objects(data) -> tuple[dict[str, dict], dict[str, np.ndarray]]:
    """Properties by object path, and values by channel path, of all segments."""
    properties, pieces = tdms_layout(data)
    return properties, {p: piece_values(data, found) for p, found in pieces.items()}


def measurement_channels(pieces: dict[str, list[Piece]]) -> list[tuple[float, str]]:
    """(label, path) of the channels of the group Measurement, by label."""
    prefix = "/'Measurement'/'"
    found = sorted((int(p[len(prefix) : -1]), p) for p in pieces if p.startswith(prefix))
    if not found:
        raise ValueError("the file has no group Measurement with channels")
    return [(float(k), p) for k, p in found]


def tdms_meta(top: dict, n: int) -> RecordMeta:
    return RecordMeta(
        fs=float(top["SamplingFrequency[Hz]"]), n=n, start_time=from_iso(top["ISO8601 Timestamp"]), spatial_interval=float(top["SpatialResolution[m]"]),
        gauge_length=float(top["GaugeLength"]), channel_offset=int(top.get("OffsetLength", 0)), company="silixa", format="tdms", units="counts",
        fiber=str(top.get("name", "")).split("_")[0], properties={k: str(v) for k, v in top.items()},
    )


def silixa_tdms(data) -> Parsed:
    properties, pieces = tdms_layout(data)
    channels = measurement_channels(pieces)
    matrix = np.stack([piece_values(data, pieces[p]) for _, p in channels], axis=1)
    return tdms_meta(properties.get("/", {}), len(matrix)), matrix, [k for k, _ in channels]


# --- HDF5 layouts ---------------------------------------------------------------------------------------------------
def h5_to_dict(node: Mapping) -> dict:
    """Groups as dictionaries, datasets as values."""
    return {k: h5_to_dict(v) if isinstance(v, Mapping) else v[()] for k, v in node.items()}


def scan_tree(node: Mapping, path: str = "", recursive: bool = True) -> Iterator[tuple[str, str]]:
    """(path, kind) of groups and datasets."""
    for k, v in node.items():
        own = f"{path}/{k}"
        yield own, "group" if isinstance(v, Mapping) else "dataset"
        if recursive and isinstance(v, Mapping):
            yield from scan_tree(v, own)


def _plain(attrs: Mapping) -> dict[str, str]:
    return {str(k): str(v.decode() if isinstance(v, bytes) else v) for k, v in attrs.items()}


def silixa_h5(f: Mapping) -> Parsed:
    acquisition, raw = f["Acquisition"], f["Acquisition"]["Raw[0]"]
    attrs: dict = {}

    def gather(node):
        attrs.update(node.attrs)
        if isinstance(node, Mapping):
            for child in node.values():
                gather(child)

    gather(acquisition)
    matrix = np.asarray(raw["RawData"][()], float)
    meta = RecordMeta(
        fs=float(attrs["OutputDataRate"]), n=len(matrix), start_time=from_iso(attrs["PartStartTime"]), spatial_interval=float(attrs["SpatialResolution"]),
        gauge_length=float(attrs["GaugeLength"]), channel_offset=abs(int(attrs["PreTriggerSamples"])), company="silixa", format="h5", units="counts", properties=_plain(attrs),
    )
    return meta, matrix, list(range(matrix.shape[1]))


def febus_h5(f: Mapping, lag: int = FEBUS_LAG) -> Parsed:
    source = next(iter(f.values()))["Source1"]
    zone = source["Zone1"]
    blocks = np.asarray(next(iter(zone.values()))[()], float)[:, :lag]
    matrix = blocks.reshape(-1, blocks.shape[2])
    spacing = zone.attrs["Spacing"]
    meta = RecordMeta(
        fs=1 / (float(spacing[1]) * 1e-3), n=len(matrix), start_time=from_epoch(np.ravel(source["time"][()])[0]), spatial_interval=float(spacing[0]),
        gauge_length=float(np.ravel(zone.attrs["GaugeLength"])[0]), company="febus", format="h5", fiber="febus", properties=_plain(zone.attrs),
    )
    return meta, matrix, list(range(matrix.shape[1]))


def terra15_h5(f: Mapping) -> Parsed:
    matrix, a = np.asarray(f["data_product"]["data"][()], float), f.attrs
    start = a["file_start_gps_time"] or a["file_start_computer_time"]
    units = a["data_product_units"]
    meta = RecordMeta(
        fs=1 / float(a["dt_computer"]), n=len(matrix), start_time=from_epoch(start), spatial_interval=float(a["dx"]), gauge_length=float(a["gauge_length"]),
        channel_offset=int(a["sensing_range_start"] / a["dx"]), company="terra15", format="h5", units=units.decode() if isinstance(units, bytes) else str(units), properties=_plain(a),
    )
    return meta, matrix, list(range(matrix.shape[1]))


def asn_h5(f: Mapping) -> Parsed:
    matrix, head = np.asarray(f["data"][()], float), f["header"]
    value = lambda k: np.ravel(head[k][()])[0]
    channels, units = np.ravel(head["channels"][()]), value("sensitivityUnits")
    meta = RecordMeta(
        fs=1 / float(value("dt")), n=len(matrix), start_time=from_epoch(value("time")), spatial_interval=float(value("dx")) * float(channels[1] - channels[0]), gauge_length=float(value("gaugeLength")),
        channel_offset=int(channels[0]), company="asn", format="h5", units=units.decode() if isinstance(units, bytes) else str(units), conv_factor=float(value("sensitivities")),
    )
    return meta, matrix, list(range(matrix.shape[1]))


def quantx_h5(f: Mapping) -> Parsed:
    acquisition, raw = f["Acquisition"], f["Acquisition"]["Raw[0]"]
    matrix, a, r = np.asarray(raw["RawData"][()], float), acquisition.attrs, raw.attrs
    units = r["RawDataUnit"]
    meta = RecordMeta(
        fs=float(r["OutputDataRate"]), n=len(matrix), start_time=from_iso(a["MeasurementStartTime"]), spatial_interval=float(a["SpatialSamplingInterval"]), gauge_length=float(a["GaugeLength"]),
        channel_offset=int(a["StartLocusIndex"]), company="quantx", format="h5", units=units.decode() if isinstance(units, bytes) else str(units), properties=_plain({**a, **r}),
    )
    return meta, matrix, list(range(matrix.shape[1]))


def aragon_h5(f: Mapping) -> Parsed:
    """Nanostrain becomes strain."""
    matrix, a = np.asarray(f["strain"][()], float) * 1e-9, f.attrs
    meta = RecordMeta(
        fs=float(np.ravel(a["trigger_frequency"])[0]), n=len(matrix), start_time=from_epoch(np.ravel(a["Global_FileSaveIO_TimeStamp_s"])[0]), spatial_interval=float(np.ravel(a["spatial_sampling"])[0]),
        gauge_length=float(np.ravel(a["Global_RAM_User_SET_Pulse_Width_(meter)"])[0]), channel_offset=int(np.ravel(a["fiber_position_offset"])[0]), company="aragon", format="h5", units="strain", properties=_plain(a),
    )
    return meta, matrix, list(range(matrix.shape[1]))


_H5 = {"silixa": silixa_h5, "febus": febus_h5, "terra15": terra15_h5, "asn": asn_h5, "quantx": quantx_h5, "aragon": aragon_h5}
_PLAIN = {("npy", "bam"): bam_npy, ("npz", "bam"): bam_npz, ("tdms", "silixa"): silixa_tdms}


def parse(path: str, company: str, data: bytes) -> Parsed:
    """By the text after the last dot of the path, and the vendor."""
    kind = path.rpartition(".")[2]
    if (kind, company) in _PLAIN:
        return _PLAIN[kind, company](data)
    if kind in ("h5", "hdf5") and company in _H5:
        try:
            import h5py
        except ImportError as error:
            raise ImportError("reading HDF5 recordings needs h5py") from error
        with h5py.File(io.BytesIO(data), "r") as f:
            return _H5[company](f)
    known = sorted([f"{v} {k}" for k, v in _PLAIN] + [f"{v} h5" for v in _H5])
    raise ValueError(f"no reader for {company} {kind}; known are: {', '.join(known)}")
