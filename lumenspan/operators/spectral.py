"""Spectra, spectrograms, f-k transforms and envelopes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions import kernels
from lumenspan.model import Record
from lumenspan.operators.space import across


def _rows(record: Record, frequency_step: float, name: str, norm: bool) -> DataFrame:
    """Long frame of per-bin values, over the maximum of the channel if norm."""
    traces = record.traces.withColumn("_top", F.array_max("samples"))
    long = traces.select("record_id", "channel", "_top", F.posexplode("samples").alias("freq_idx", "v"))
    value = F.try_divide(F.col("v"), F.col("_top")) if norm else F.col("v")
    return long.select("record_id", "channel", F.col("freq_idx").cast("long").alias("freq_idx"), (F.col("freq_idx") * F.lit(frequency_step)).alias("freq"), value.alias(name))


def chosen(record: Record, channels) -> Record:
    if channels is None:
        return record
    labels = [float(c) for c in (channels if isinstance(channels, (list, tuple)) else [channels])]
    return Record(record.traces.where(F.col("channel").isin(labels)), record.meta)


def spectrum(record: Record, channels=None, norm: bool = False, pre: bool = True, order: int = 1, pad: int = 0, nfft: int | None = None) -> DataFrame:
    """channel, freq_idx, freq, amplitude: 2/n |FFT| below the Nyquist frequency, DC included. pad adds 2 pad - 1 zeros
    (one fewer before than after); nfft multiplies the length of the transform."""

    def kernel(m):
        return kernels.amplitude_spectrum(kernels.preprocess(m, order) if pre else m, pad, nfft)

    n = (record.meta.n + (2 * pad - 1 if pad > 0 else 0)) * (nfft or 1)
    return _rows(chosen(record, channels).map_traces(kernel), record.meta.fs / n, "amplitude", norm)


def spectrogram(record: Record, norm: bool = False, order: int = 1, nfft: int | None = None) -> DataFrame:
    """Space-frequency: the spectrum of every channel, padded by a quarter of the record."""
    return spectrum(record, None, norm, True, order, int(record.meta.n / 4), nfft)


def psd(record: Record, channels=None, norm: bool = False, pre: bool = True, order: int = 1, n: int | None = None) -> DataFrame:
    """channel, freq_idx, freq, power: Welch's density with segments of n (256) samples."""
    size, fs = min(n or 256, record.meta.n), record.meta.fs
    kernel = lambda m: kernels.welch(kernels.preprocess(m, order) if pre else m, fs, size)
    return _rows(chosen(record, channels).map_traces(kernel), fs / size, "power", norm)


def channel_spectrogram(record: Record, channel: float, norm: bool = False) -> DataFrame:
    """channel, frame, time_s (of the frame's middle), freq_idx, freq, power: frames of a fifth of a second, half
    overlapping, transformed to 1 Hz bins; norm divides by the maximum of the frame."""
    fs = record.meta.fs
    size = min(int(fs / 5), record.meta.n)
    if size < 2:
        raise ValueError("frames of a fifth of a second need at least two samples")
    nfft = max(int(fs), size)
    hop, bins = size - size // 2, nfft // 2 + 1
    kernel = lambda m: kernels.stft(m, fs, size, nfft).reshape(len(m), -1)
    flat = chosen(record, channel).map_traces(kernel).traces
    long = flat.select("record_id", "channel", F.posexplode("samples").alias("k", "power"))
    frame, at = F.floor(F.col("k") / bins), (F.col("k") % bins).cast("long")
    out = long.select(
        "record_id", "channel", frame.cast("long").alias("frame"), ((frame * hop + size / 2) / F.lit(fs)).alias("time_s"),
        at.alias("freq_idx"), (at * F.lit(fs / nfft)).alias("freq"), "power",
    )
    if not norm:
        return out
    top = F.max("power").over(Window.partitionBy("record_id", "channel", "frame"))
    return out.withColumn("power", F.try_divide(F.col("power"), top))


def hilbert(record: Record) -> DataFrame:
    """record_id, channel_pos, channel, analytic ARRAY<STRUCT<re, im>>."""
    kernel = lambda m: np.concatenate([m, kernels.analytic(m).imag], axis=1)
    both, n = record.map_traces(kernel).traces, record.meta.n
    pairs = F.arrays_zip(F.slice("samples", 1, n).alias("re"), F.slice("samples", n + 1, n).alias("im"))
    return both.select("record_id", "channel_pos", "channel", pairs.alias("analytic"))


def envelope(record: Record) -> Record:
    """|analytic signal|."""
    return record.map_traces(lambda m: np.abs(kernels.analytic(m)))


def envelope_ref(record: Record) -> Record:
    """sqrt(x^2 + |analytic signal|^2), which exceeds the usual envelope."""
    return record.map_traces(lambda m: np.sqrt(m**2 + np.abs(kernels.analytic(m)) ** 2))


def fk_spectrum(record: Record, channels: int) -> DataFrame:
    """k_idx, freq_idx (both centred: shifted FFT order), k (per metre), freq, magnitude of the 2-D transform.

    Separable: an FFT along time per channel, then one along channels in blocks of frequencies."""
    n, fs, dx = record.meta.n, record.meta.fs, record.meta.spatial_interval

    def along_time(m):
        f = np.fft.fft(np.fft.ifftshift(m, axes=1), axis=1)
        return np.stack([f.real, f.imag], axis=2).reshape(len(m), -1)

    def along_channels(m, _):
        return np.abs(np.fft.fft(np.fft.ifftshift(m[:, ::2] + 1j * m[:, 1::2], axes=0), axis=0))

    rows = across(record.map_traces(along_time), along_channels, unit=2).traces.select("record_id", "channel_pos", F.posexplode("samples").alias("f", "magnitude"))
    centred = lambda c, size: (c + size // 2) % size
    k, f = centred(F.col("channel_pos"), channels), centred(F.col("f"), n)
    return rows.select(
        "record_id", k.cast("long").alias("k_idx"), f.cast("long").alias("freq_idx"),
        ((k - channels // 2) / F.lit(channels * dx)).alias("k"), ((f - n // 2) * F.lit(fs / n)).alias("freq"), "magnitude",
    )


def fk_filter(record: Record, channels: int, freq_band: tuple[float, float], k_band: tuple[float, float]) -> Record:
    """Keep |frequency| and |wavenumber| within the bands: masked transforms along time, then along channels, each with
    its inverse at once."""
    n, fs, dx = record.meta.n, record.meta.fs, record.meta.spatial_interval
    keep_f = (np.abs(np.fft.fftfreq(n, 1 / fs)) >= freq_band[0]) & (np.abs(np.fft.fftfreq(n, 1 / fs)) <= freq_band[1])
    keep_k = (np.abs(np.fft.fftfreq(channels, dx)) >= k_band[0]) & (np.abs(np.fft.fftfreq(channels, dx)) <= k_band[1])
    timewise = record.map_traces(lambda m: np.fft.ifft(np.fft.fft(m, axis=1) * keep_f, axis=1).real)
    return across(timewise, lambda m, _: np.fft.ifft(np.fft.fft(m, axis=0) * keep_k[:, None], axis=0).real)
