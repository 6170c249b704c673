"""Discrete Fourier transforms of channels that are longer than a row or a task.

A transform of n = R x C samples, number n1 * C + n2, goes in four steps. Chunks are dealt out by columns n2; a task
transforms the columns that it holds along n1 and turns them by their twiddle factors; the results are dealt out by rows
k1; a task transforms its rows along n2, which gives bins k1 + R * k2. Both exchanges move arrays, a tile a row. An inverse
takes the same way back, and starts where the bins are, so a filter in frequency costs two more exchanges. A task holds
about `cells` complex numbers of some channels, never a channel.

Lengths without such factors are brought to a power of two by Bluestein's chirps, whose transform is computed in the same
way and meets the data by rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.arrays import lists, repeated, vectors
from lumenspan.operators.chunkmath import preprocess
from lumenspan.operators.chunks import CHUNKS, Chunked

#: About as many complex numbers meet in a task.
CELLS = 1 << 20
KEYS = ("record_id", "channel_pos", "channel")
TILES = "record_id string, channel_pos int, channel double, pack int, block long, at long, length long, re array<double>, im array<double>"
BINS = "record_id string, channel_pos int, channel double, first long, re array<double>, im array<double>"
COMPLEX = "record_id string, channel_pos int, channel double, start long, re array<double>, im array<double>"


@dataclass(frozen=True)
class Shape:
    """A transform of rows x columns; blocks of `width` columns and of `height` rows."""

    n: int
    rows: int
    columns: int
    cells: int

    @property
    def width(self) -> int:
        return max(1, min(self.columns, self.cells // self.rows))

    @property
    def height(self) -> int:
        return max(1, min(self.rows, self.cells // self.columns))

    def pack(self, size: int) -> int:
        """Channels that share a task if each has `size` numbers there."""
        return max(1, self.cells // size)

    def block_columns(self, j: int) -> np.ndarray:
        return np.arange(j * self.width, min((j + 1) * self.width, self.columns))

    def block_rows(self, i: int) -> np.ndarray:
        return np.arange(i * self.height, min((i + 1) * self.height, self.rows))

    def turns(self, rows: np.ndarray, columns: np.ndarray, sign: int) -> np.ndarray:
        """Twiddle factors, from angles reduced as integers."""
        return np.exp((sign * 2j * np.pi / self.n) * ((rows[:, None] * columns) % self.n))

    def places(self, first: int, length: int, j: int) -> np.ndarray:
        """The samples of [first, first + length) in column block j, in order."""
        rows = np.arange(first // self.columns, (first + length - 1) // self.columns + 1)
        n = (rows[:, None] * self.columns + self.block_columns(j)).ravel()
        return n[(n >= first) & (n < first + length)]


def shape_of(n: int, cells: int) -> Shape | None:
    """The most nearly square shape of n, if a row of it fits in a task."""
    rows = next(r for r in range(isqrt(n), 0, -1) if n % r == 0)
    return Shape(n, rows, n // rows, cells) if n // rows <= cells else None


@dataclass(frozen=True)
class RowByRow(Shape):
    """Tiles of one row each."""

    @property
    def height(self) -> int:
        return 1


class Tiles:
    """Rows of TILES being gathered."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, key: tuple, pack: int, block: int, at: int, length: int, z: np.ndarray) -> None:
        self.rows.append((*key, pack, block, at, length, z.ravel()))

    def columns(self) -> list[pa.Array]:
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        plain = [pa.array([r[i] for r in self.rows], t) for i, t in enumerate(kinds)]
        return [*plain, lists([r[7].real for r in self.rows]), lists([r[7].imag for r in self.rows])]

    NAMES = ("record_id", "channel_pos", "channel", "pack", "block", "at", "length", "re", "im")

    def table(self) -> pa.Table:
        return pa.Table.from_arrays(self.columns(), list(self.NAMES))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(self.columns(), list(self.NAMES))


def complexes(table) -> list[np.ndarray]:
    return [r + 1j * i if len(i) else r.astype(complex) for r, i in zip(vectors(table.column("re")), vectors(table.column("im")))]


class Held:
    """The tiles of a group: its channels' keys, and for each tile its channel's number, `at`, length and values."""

    def __init__(self, table: pa.Table):
        positions, first, which = np.unique(table.column("channel_pos").to_numpy(), return_index=True, return_inverse=True)
        labels, record_id = table.column("channel").to_pylist(), table.column("record_id")[0].as_py()
        self.keys = [(record_id, int(p), labels[i]) for p, i in zip(positions, first)]
        self.block = table.column("block")[0].as_py()
        self.tiles = list(zip(which.tolist(), table.column("at").to_pylist(), table.column("length").to_pylist(), complexes(table)))


def to_columns(frame: DataFrame, shape: Shape) -> DataFrame:
    """Complex chunks (COMPLEX; an empty im is 0) as tiles by blocks of columns."""
    pack = shape.pack(shape.rows * shape.width)

    def run(batches):
        for batch in batches:
            out = Tiles()
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEYS, "start")))
            for (*key, start), z in zip(keys, complexes(batch)):
                block = (np.arange(start, start + len(z)) % shape.columns) // shape.width
                order = np.argsort(block, kind="stable")
                edges = np.flatnonzero(np.diff(block[order])) + 1
                for part in np.split(order, edges):
                    if len(part):
                        out.add(tuple(key), key[1] // pack, int(block[part[0]]), start, len(z), z[part])
            yield out.batch()

    return frame.mapInArrow(run, TILES)


def columns_done(tiles: DataFrame, shape: Shape) -> DataFrame:
    """Transforms along the columns, turned; tiles by blocks of rows."""
    pack, height = shape.pack(shape.height * shape.columns), shape.height

    def run(table: pa.Table) -> pa.Table:
        held = Held(table)
        columns = shape.block_columns(held.block)
        x = np.zeros((len(held.keys), shape.rows, len(columns)), complex)
        for c, at, length, z in held.tiles:
            n = shape.places(at, length, held.block)
            x[c, n // shape.columns, n % shape.columns - columns[0]] = z
        x = np.fft.fft(x, axis=1) * shape.turns(np.arange(shape.rows), columns, -1)
        out = Tiles()
        for i in range(-(-shape.rows // height)):
            rows = shape.block_rows(i)
            for key, z in zip(held.keys, x[:, rows]):
                out.add(key, key[1] // pack, i, held.block, z.size, z)
        return out.table()

    return tiles.groupBy("record_id", "pack", "block").applyInArrow(run, TILES)


def gathered_rows(table: pa.Table, shape: Shape) -> tuple[Held, np.ndarray, np.ndarray]:
    held = Held(table)
    rows = shape.block_rows(held.block)
    x = np.zeros((len(held.keys), len(rows), shape.columns), complex)
    for c, at, _, z in held.tiles:
        columns = shape.block_columns(at)
        x[c][:, columns] = z.reshape(len(rows), len(columns))
    return held, rows, x


def rows_done(tiles: DataFrame, shape: Shape, last: int | None = None) -> DataFrame:
    """Transforms along the rows: BINS, bin first + rows * index. last: only bins below it are wanted, others may come."""
    columns = shape.columns if last is None else min(shape.columns, -(-last // shape.rows))

    def run(table: pa.Table) -> pa.Table:
        held, rows, x = gathered_rows(table, shape)
        x = np.fft.fft(x, axis=2)[:, :, :columns]
        times = [len(rows)] * len(held.keys)
        flat = x.reshape(-1, columns)
        keys = [repeated([k[i] for k in held.keys], times, t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))]
        first = pa.array(np.tile(rows, len(held.keys)), pa.int64())
        return pa.table(dict(zip(KEYS, keys)) | {"first": first, "re": lists(list(flat.real)), "im": lists(list(flat.imag))})

    return tiles.groupBy("record_id", "pack", "block").applyInArrow(run, BINS)


def back_from_rows(key: tuple, rows: np.ndarray, bins: np.ndarray, block: int, shape: Shape, out: Tiles) -> None:
    """Inverse transforms along rows, turned back; tiles by blocks of columns."""
    pack = shape.pack(shape.rows * shape.width)
    x = np.fft.ifft(bins, axis=1)
    for j in range(-(-shape.columns // shape.width)):
        columns = shape.block_columns(j)
        z = x[:, columns] * shape.turns(rows, columns, 1)
        out.add(key, key[1] // pack, j, block, z.size, z)


def rows_filtered(tiles: DataFrame, shape: Shape, gain: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Transforms along the rows times gain(bin), and the inverse along the rows at once."""

    def run(table: pa.Table) -> pa.Table:
        held, rows, x = gathered_rows(table, shape)
        x = np.fft.fft(x, axis=2) * gain(rows[:, None] + shape.rows * np.arange(shape.columns))
        out = Tiles()
        for key, bins in zip(held.keys, x):
            back_from_rows(key, rows, bins, held.block, shape, out)
        return out.table()

    return tiles.groupBy("record_id", "pack", "block").applyInArrow(run, TILES)


def columns_back(tiles: DataFrame, shape: Shape, size: int, length: int) -> DataFrame:
    """Inverse transforms along the columns; tiles by chunks of `size` samples of the first `length`."""
    pack = shape.pack(size)

    def run(table: pa.Table) -> pa.Table:
        held = Held(table)
        columns = shape.block_columns(held.block)
        x = np.zeros((len(held.keys), shape.rows, len(columns)), complex)
        for c, at, _, z in held.tiles:
            rows = shape.block_rows(at)
            x[c, rows] = z.reshape(len(rows), len(columns))
        x = np.fft.ifft(x, axis=1).reshape(len(held.keys), -1)
        n = (np.arange(shape.rows)[:, None] * shape.columns + columns).ravel()
        n, x = n[n < length], x[:, : np.count_nonzero(n < length)]
        edges = np.flatnonzero(np.diff(n // size)) + 1
        out = Tiles()
        for part in np.split(np.arange(len(n)), edges):
            if len(part):
                chunk = int(n[part[0]] // size)
                for key, z in zip(held.keys, x[:, part[0] : part[-1] + 1]):
                    out.add(key, key[1] // pack, chunk, held.block, z.shape[0], z)
        return out.table()

    return tiles.groupBy("record_id", "pack", "block").applyInArrow(run, TILES)


def chunks_back(tiles: DataFrame, shape: Shape, size: int, length: int) -> DataFrame:
    """Tiles by chunks as COMPLEX chunks of `size` samples."""

    def run(table: pa.Table) -> pa.Table:
        held = Held(table)
        start = held.block * size
        own = min(size, length - start)
        x = np.zeros((len(held.keys), own), complex)
        for c, at, _, z in held.tiles:
            x[c, shape.places(start, own, at) - start] = z
        keys = [pa.array([k[i] for k in held.keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))]
        starts = pa.array([start] * len(held.keys), pa.int64())
        return pa.table(dict(zip(KEYS, keys)) | {"start": starts, "re": lists(list(x.real)), "im": lists(list(x.imag))})

    return tiles.groupBy("record_id", "pack", "block").applyInArrow(run, COMPLEX)


# --- lengths without factors -----------------------------------------------------------------------------------
def chirp(at: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi at^2 / n); squares are reduced as integers."""
    return np.exp((-1j * np.pi / n) * ((at * at) % (2 * n)))


def turned(frame: DataFrame, n: int, last: int | None = None, conjugate: bool = False, factor: float = 1.0) -> DataFrame:
    """COMPLEX chunks (or their conjugates) times the chirp and a factor; samples from `last` on are left out."""

    def run(batches):
        for batch in batches:
            starts = batch.column("start").to_pylist()
            out = []
            for s, z in zip(starts, complexes(batch)):
                z = z if last is None else z[: max(0, last - s)]
                out.append((z.conj() if conjugate else z) * chirp(np.arange(s, s + len(z)), n) * factor)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "start")), lists([z.real for z in out]), lists([z.imag for z in out])], [*KEYS, "start", "re", "im"])

    return frame.mapInArrow(run, COMPLEX)


def chirp_bins(spark: SparkSession, n: int, shape: Shape, size: int) -> DataFrame:
    """block, first, bre, bim: the transform of the conjugate chirp over -n < m < n, laid around the shape's length."""
    starts = spark.range(0, shape.n, size).select(F.lit("").alias("record_id"), F.lit(0).alias("channel_pos"), F.lit(0.0).alias("channel"), F.col("id").alias("start"))

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.column("start").to_pylist():
                m = np.arange(s, min(s + size, shape.n))
                near = np.minimum(m, shape.n - m)
                out.append(np.where(near < n, chirp(near, n).conj(), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "start")), lists([z.real for z in out]), lists([z.imag for z in out])], [*KEYS, "start", "re", "im"])

    bins = rows_done(columns_done(to_columns(starts.mapInArrow(run, COMPLEX), shape), shape), shape)
    return bins.select("first", F.col("re").alias("bre"), F.col("im").alias("bim"))


def bluestein(frame: DataFrame, n: int, size: int, cells: int, conjugate: bool = False, factor: float = 1.0) -> DataFrame:
    """The transform of n samples in COMPLEX chunks (of their conjugates if so) as COMPLEX chunks of bins, times a factor."""
    if n > 1 << 31:
        raise ValueError("lengths over 2^31 need two factors that fit in a task")
    bits = (2 * n - 2).bit_length()
    shape = Shape(1 << bits, 1 << bits // 2, 1 << (bits - bits // 2), cells)
    if shape.columns > cells:
        raise ValueError("a row of the transform does not fit in a task")
    a = rows_done(columns_done(to_columns(turned(frame, n, conjugate=conjugate), shape), shape), shape)
    met = a.join(chirp_bins(frame.sparkSession, n, shape, size), "first")
    narrow = RowByRow(shape.n, shape.rows, shape.columns, cells)

    def run(batches):
        for batch in batches:
            out = Tiles()
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEYS, "first")))
            chirps = zip(vectors(batch.column("bre")), vectors(batch.column("bim")))
            for (*key, first), z, (re, im) in zip(keys, complexes(batch), chirps):
                back_from_rows(tuple(key), np.array([first]), (z * (re + 1j * im))[None], first, narrow, out)
            yield out.batch()

    tiles = met.mapInArrow(run, TILES)
    return turned(chunks_back(columns_back(tiles, narrow, size, n), shape, size, n), n, factor=factor)


# --- transforms of recordings ----------------------------------------------------------------------------------
def as_complex(record: Chunked, shift: int = 0) -> DataFrame:
    plain = record.chunks.where(F.col("samples").isNotNull())
    return plain.select(*KEYS, (F.col("start") + shift).alias("start"), F.col("samples").alias("re"), F.array().cast("array<double>").alias("im"))


def transform(record: Chunked, n: int | None = None, shift: int = 0, last: int | None = None, cells: int = CELLS) -> DataFrame:
    """record_id, channel_pos, channel, first, step, re, im: bins first + step * index of the transform of length n (the
    record's) of each channel, moved `shift` samples back, zeros elsewhere. last: only bins below it are wanted."""
    n = record.meta.n if n is None else n
    frame, shape = as_complex(record, shift), shape_of(n, cells)
    if shape is not None:
        return rows_done(columns_done(to_columns(frame, shape), shape), shape, last).withColumn("step", F.lit(shape.rows))
    return bluestein(frame, n, cells, cells).withColumnRenamed("start", "first").withColumn("step", F.lit(1))


def filtered(record: Chunked, gain: Callable[[np.ndarray, int], np.ndarray], size: int = 1 << 16, cells: int = CELLS) -> DataFrame:
    """COMPLEX chunks of `size` samples: every channel's transform times gain(bins, n), transformed back."""
    n = record.meta.n
    frame, shape = as_complex(record), shape_of(n, cells)
    if shape is not None:
        tiles = rows_filtered(columns_done(to_columns(frame, shape), shape), shape, lambda k: gain(k, n))
        return chunks_back(columns_back(tiles, shape, size, n), shape, size, n)

    def weighed(batches):
        for batch in batches:
            out = [z * gain(np.arange(s, s + len(z)), n) for s, z in zip(batch.column("start").to_pylist(), complexes(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "start")), lists([z.real for z in out]), lists([z.imag for z in out])], [*KEYS, "start", "re", "im"])

    # The inverse is the conjugate of the conjugate's transform over n.
    bins = bluestein(frame, n, size, cells).mapInArrow(weighed, COMPLEX)
    back = bluestein(bins, n, size, cells, conjugate=True, factor=1 / n)
    return back.withColumn("im", F.transform("im", lambda v: -v))


def one_sided(k: np.ndarray, n: int) -> np.ndarray:
    """The gain that makes a signal analytic."""
    return np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))


def spectrum(record: Chunked, norm: bool = False, pre: bool = True, order: int = 1, pad: int = 0, nfft: int | None = None, cells: int = CELLS) -> DataFrame:
    """As spectral.spectrum: record_id, channel, freq_idx, freq, amplitude of every channel."""
    n = (record.meta.n + (2 * pad - 1 if pad > 0 else 0)) * (nfft or 1)
    bins = transform(preprocess(record, order) if pre else record, n, max(pad - 1, 0), n // 2, cells)
    size = F.transform(F.arrays_zip("re", "im"), lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]) * F.lit(2 / n))
    long = bins.select("record_id", "channel", "first", "step", F.posexplode(size).alias("i", "amplitude"))
    rows = long.select("record_id", "channel", (F.col("first") + F.col("step") * F.col("i")).alias("freq_idx"), "amplitude").where(F.col("freq_idx") < n // 2)
    if norm:
        top = rows.groupBy("record_id", "channel").agg(F.max("amplitude").alias("top"))
        rows = rows.join(top, ["record_id", "channel"]).withColumn("amplitude", F.try_divide("amplitude", "top"))
    return rows.select("record_id", "channel", "freq_idx", (F.col("freq_idx") * F.lit(record.meta.fs / n)).alias("freq"), "amplitude")


def spectrogram(record: Chunked, norm: bool = False, order: int = 1, nfft: int | None = None, cells: int = CELLS) -> DataFrame:
    """As spectral.spectrogram: every channel's spectrum, padded by a quarter of the record."""
    return spectrum(record, norm, True, order, int(record.meta.n / 4), nfft, cells)


def hilbert(record: Chunked, size: int = 1 << 16, cells: int = CELLS) -> DataFrame:
    """COMPLEX chunks of the analytic signal."""
    return filtered(record, one_sided, size, cells)


def _envelope(record: Chunked, value: Callable[[Column], Column], size: int, cells: int) -> Chunked:
    samples = F.transform(F.arrays_zip("re", "im"), value).alias("samples")
    return Chunked(hilbert(record, size, cells).select(*KEYS, "start", samples), record.meta)


def envelope(record: Chunked, size: int = 1 << 16, cells: int = CELLS) -> Chunked:
    """As spectral.envelope, in chunks of `size`."""
    return _envelope(record, lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]), size, cells)


def envelope_ref(record: Chunked, size: int = 1 << 16, cells: int = CELLS) -> Chunked:
    """As spectral.envelope_ref, in chunks of `size`; the analytic signal's real part is the channel itself."""
    return _envelope(record, lambda z: F.sqrt(2 * z["re"] * z["re"] + z["im"] * z["im"]), size, cells)


def band_kept(record: Chunked, band: tuple[float, float], size: int = 1 << 16, cells: int = CELLS) -> Chunked:
    """Only |frequency| within the band: the part along time of spectral.fk_filter."""
    fs = record.meta.fs
    gain = lambda k, n: ((np.minimum(k, n - k) * fs / n >= band[0]) & (np.minimum(k, n - k) * fs / n <= band[1])).astype(float)
    return Chunked(filtered(record, gain, size, cells).select(*KEYS, "start", F.col("re").alias("samples")), replace(record.meta))


# --- over channels too ---------------------------------------------------------------------------------------------
def _across(table: pa.Table, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """The channel numbers of a group and the matrix of its rows; channels that are missing are 0."""
    positions = table.column("channel_pos").to_numpy()
    parts = complexes(table)
    x = np.zeros((channels, max(len(z) for z in parts)), complex)
    for p, z in zip(positions, parts):
        x[p, : len(z)] = z
    return positions, x


def fk_spectrum(record: Chunked, channels: int, cells: int = CELLS) -> DataFrame:
    """As spectral.fk_spectrum: record_id, k_idx, freq_idx (both centred), k (per metre), freq, magnitude.

    The transform along time leaves every channel's bins in rows; pieces of these, of all channels, meet in a task and are
    transformed along the channels. A task holds `cells` numbers, or one bin of all channels."""
    n, fs, dx = record.meta.n, record.meta.fs, record.meta.spatial_interval
    width = max(1, cells // channels)
    piece = lambda c, p: F.slice(c, p * width + 1, F.lit(width))
    bins = transform(record, cells=cells)
    parts = bins.select("record_id", "channel_pos", "first", "step", "re", "im", F.explode(F.sequence(F.lit(0), F.floor((F.size("re") - 1) / width).cast("int"))).alias("part"))
    parts = parts.select("record_id", "channel_pos", "first", "step", "part", piece("re", F.col("part")).alias("re"), piece("im", F.col("part")).alias("im"))

    def run(table: pa.Table) -> pa.Table:
        _, x = _across(table, channels)
        x = np.abs(np.fft.fft(x, axis=0))
        same = lambda c, t: pa.array([table.column(c)[0].as_py()] * channels, t)
        return pa.table({
            "record_id": same("record_id", pa.string()), "first": same("first", pa.int64()), "step": same("step", pa.int64()), "part": same("part", pa.int32()),
            "m": pa.array(np.arange(channels), pa.int64()), "magnitude": lists(list(x)),
        })

    found = parts.groupBy("record_id", "first", "part").applyInArrow(run, "record_id string, first long, step long, part int, m long, magnitude array<double>")
    rows = found.select("record_id", "m", "first", "step", "part", F.posexplode("magnitude").alias("i", "magnitude"))
    centred = lambda c, size: (c + size // 2) % size
    k, f = centred(F.col("m"), channels), centred(F.col("first") + F.col("step") * (F.col("part") * width + F.col("i")), n)
    return rows.select(
        "record_id", k.cast("long").alias("k_idx"), f.cast("long").alias("freq_idx"),
        ((k - channels // 2) / F.lit(channels * dx)).alias("k"), ((f - n // 2) * F.lit(fs / n)).alias("freq"), "magnitude",
    )


def fk_filter(record: Chunked, channels: int, freq_band: tuple[float, float], k_band: tuple[float, float], cells: int = CELLS) -> Chunked:
    """As spectral.fk_filter, in chunks: |frequency| within its band over whole channels, then |wavenumber| within its band,
    where chunks of all channels meet, so long that a task holds `cells` numbers."""
    dx = record.meta.spatial_interval
    keep = (np.abs(np.fft.fftfreq(channels, dx)) >= k_band[0]) & (np.abs(np.fft.fftfreq(channels, dx)) <= k_band[1])
    timed = band_kept(record, freq_band, max(1, cells // channels), cells).chunks

    def run(table: pa.Table) -> pa.Table:
        positions, x = _across(table.append_column("re", table.column("samples")).append_column("im", pa.array([[]] * table.num_rows, pa.list_(pa.float64()))), channels)
        x = np.fft.ifft(np.fft.fft(x, axis=0) * keep[:, None], axis=0).real[positions]
        return table.set_column(table.schema.get_field_index("samples"), "samples", lists(list(x)))

    return Chunked(timed.select(*KEYS, "start", "samples").groupBy("record_id", "start").applyInArrow(run, CHUNKS), record.meta)
