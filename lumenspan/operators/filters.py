"""Filters along time. Coefficients are designed once on the driver; a kernel filters whole batches of traces."""

from __future__ import annotations

import bisect
import functools
import math
import warnings

import numpy as np

from lumenspan.functions import design, kernels
from lumenspan.model import Record
from lumenspan.operators import timeaxis

BANDS = ("bandpass", "bandstop", "lowpass", "highpass")


def design_band(f_type: str, freq, fs: float, corners: int = 4) -> np.ndarray:
    """Butterworth sections. A bandpass that reaches the Nyquist frequency becomes a highpass; other edges at or
    beyond it are errors."""
    if f_type not in BANDS:
        raise ValueError(f"the filter must be one of {BANDS}")
    edges = np.atleast_1d(np.asarray(freq, float)) / (fs / 2)
    if len(edges) != (2 if f_type.startswith("band") else 1):
        raise ValueError(f"{f_type} needs {'two frequencies' if f_type.startswith('band') else 'one frequency'}")
    if edges[0] >= 1:
        raise ValueError("the corner frequency is not below the Nyquist frequency")
    if f_type == "bandpass" and edges[1] - 1.0 > -1e-6:
        warnings.warn("the high corner is at or above the Nyquist frequency; using a highpass", stacklevel=2)
        return design.iir_sos("butter", corners, edges[0], "highpass")
    if edges[-1] >= 1:
        raise ValueError("the high corner is not below the Nyquist frequency")
    return design.iir_sos("butter", corners, edges, f_type)


def band_filter(record: Record, f_type: str, freq, corners: int = 4, zerophase: bool = False) -> Record:
    """From zero state; zerophase runs forward, then backward, without padding."""
    sos = design_band(f_type, freq, record.meta.fs, corners)
    return record.map_traces(lambda m: kernels.sos_filter(m, sos, zerophase))


def filter(record: Record, f_type: str, freq, pre_process: bool = True, frac: float = 0.05, order: int = 1, **options) -> Record:  # noqa: A001
    """Optional detrend, demean and taper, then a band filter."""
    if pre_process:
        record = timeaxis.taper(timeaxis.demean(timeaxis.detrend(record, order)), frac)
    return band_filter(record, f_type, freq, **options)


def fir_decimate(record: Record, factor: int, taps: np.ndarray) -> Record:
    """Causal FIR, then samples k, k + factor, ... with k half the filter's order: only these are computed. The start
    time stays, as the skipped samples are the filter's delay."""
    n, skip = record.meta.n, (len(taps) - 1) // 2
    at = np.arange(skip, n, factor)
    return record.map_traces(lambda m: kernels.fir_outputs(m, taps, at), fs=record.meta.fs / factor, n=len(at))


def decimate(record: Record, new_freq: float, ftype: str | None = "fir-remez", taps: np.ndarray | None = None) -> Record:
    """By int(fs / new_freq): equiripple FIR (fir-remez), given taps (fir235), or with None a zero-phase Chebyshev I."""
    factor = int(record.meta.fs / new_freq)
    if factor < 1:
        raise ValueError("the new frequency is above the sampling frequency")
    if ftype == "fir-remez":
        return fir_decimate(record, factor, design.decimation_taps(factor) if taps is None else taps)
    if ftype == "fir235":
        if taps is None:
            raise ValueError("fir235 needs its taps")
        return fir_decimate(record, factor, taps)
    if ftype is not None:
        raise ValueError("the filter must be fir-remez, fir235 or None")
    sos = design.iir_sos("cheby1", 8, 0.8 / factor, "lowpass", 0.05)
    kernel = lambda m: kernels.sos_zerophase_padded(m, sos, 27)[:, ::factor]
    return record.map_traces(kernel, fs=record.meta.fs / factor, n=-(-record.meta.n // factor))


def lowpass_cheby_2(record: Record, freq: float, maxorder: int = 12) -> Record:
    sos, _ = cheby_2_sections(freq, record.meta.fs, maxorder)
    return record.map_traces(lambda m: kernels.sos_filter(m, sos))


def cheby_2_sections(freq: float, fs: float, maxorder: int = 12) -> tuple[np.ndarray, float]:
    """Sections of 96 dB stop band from freq on, and the pass band edge in Hz: the widest edge, in steps of 1 % below freq,
    that maxorder allows. The order falls with every step, so the number of steps is found by bisection."""
    stop = freq / (fs / 2)
    if not 0 < stop < 1:
        raise ValueError("the corner frequency is not below the Nyquist frequency")
    needed = lambda steps: design.cheb2_order(stop * 0.99**steps, stop, 1, 96)
    most = 1
    while needed(most)[0] > maxorder:
        most *= 2
    steps = bisect.bisect_left(range(most + 1), True, lo=1, key=lambda k: needed(k)[0] <= maxorder)
    order, corner = needed(steps)
    return design.iir_sos("cheby2", order, corner, "lowpass", 96), stop * 0.99**steps * fs / 2


def cheby_2_polynomials(freq: float, fs: float, maxorder: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the whole filter, the products of its sections'."""
    sos, _ = cheby_2_sections(freq, fs, maxorder)
    product = lambda rows: functools.reduce(np.polymul, rows, np.ones(1))
    return product(sos[:, :3]), product(sos[:, 3:])


def remez_bandpass_taps(freqmin: float, freqmax: float, fs: float) -> np.ndarray:
    """Fifty taps; transitions of 10 % of either corner; the upper stop band ends 1 Hz below the Nyquist frequency."""
    edges = np.array([0, 0.9 * freqmin, freqmin, freqmax, 1.1 * freqmax, fs / 2 - 1]) / (fs / 2)
    return design.remez(50, edges, [0, 1, 0], [1, 1, 1])


def convolve(record: Record, taps: np.ndarray) -> Record:
    """Full convolution: len(taps) - 1 samples more."""
    n = record.meta.n + len(taps) - 1
    return record.map_traces(lambda m: kernels.fir_outputs(m, taps, np.arange(n)), n=n)


def remez_fir(record: Record, freqmin: float, freqmax: float) -> Record:
    return convolve(record, remez_bandpass_taps(freqmin, freqmax, record.meta.fs))


def sinc_taps(freq: float, fs: float, winlen: int = 2048) -> np.ndarray:
    """The periodic sinc that sums all bins of winlen below freq, its magnitude under a Kaiser window (beta 11.7)."""
    at = np.arange(winlen) - winlen // 2
    half = min(math.ceil(freq * winlen / fs) - 1, (winlen - 1) // 2)
    turn = np.pi * at / winlen
    with np.errstate(invalid="ignore", divide="ignore"):
        kernel = np.where(at == 0, 2 * half + 1, np.sin((2 * half + 1) * turn) / np.sin(turn)) / winlen
    if winlen % 2 == 0 and freq > fs / 2:
        kernel += np.cos(np.pi * at) / winlen  # the bin at the Nyquist frequency has no partner
    return np.abs(kernel * design.kaiser(winlen, 11.7))


def lowpass_fir(record: Record, freq: float, winlen: int = 2048) -> Record:
    """Full convolution with sinc_taps, cropped by winlen // 2 at both ends (one sample fewer than the input)."""
    taps = sinc_taps(freq, record.meta.fs, winlen)
    at = np.arange(winlen // 2, record.meta.n + winlen - 1 - winlen // 2)
    return record.map_traces(lambda m: kernels.fir_outputs(m, taps, at), n=len(at))
