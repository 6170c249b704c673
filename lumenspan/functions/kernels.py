"""NumPy kernels over (channels, samples) matrices."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumenspan.functions.design import hann, tukey


#: Samples that one matrix product filters at once.
BLOCK = 128


@lru_cache(maxsize=256)
def section_matrices(coefficients: tuple[float, ...], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a second-order section (direct form II transposed) does to a block of `size` samples: the outputs from its
    inputs and from the state before it, and the state after it from either."""
    b0, b1, b2, _, a1, a2 = coefficients
    step, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    response = np.array([b0] + [(p @ drive)[0] for p in powers[: size - 1]])
    lag = np.arange(size)[:, None] - np.arange(size)
    outputs = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    return outputs, np.array([p[0] for p in powers[:size]]), np.array([p @ drive for p in powers[size - 1 :: -1]]).T, powers[size]


def section(x: np.ndarray, coefficients: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One section over (channels, samples), from a state (channels, 2), zero unless given; the outputs and the state
    after them. Blocks go through matrix products for all channels at once; only their states follow one another.
    A value that is not finite makes its output and all later ones of the channel NaN."""
    channels, n = x.shape
    state = np.zeros((channels, 2)) if state is None else state
    if n == 0:
        return x, state
    bad = np.maximum.accumulate(~np.isfinite(x), axis=1)
    size = min(BLOCK, n)
    outputs, from_state, to_state, carry = section_matrices(tuple(map(float, coefficients)), size)
    count = -(-n // size)
    u = np.zeros((channels, count * size))
    u[:, :n] = np.where(bad, 0.0, x)
    u = u.reshape(channels, count, size)
    y, driven = u @ outputs.T, u @ to_state.T
    before, z = np.empty((channels, count, 2)), state
    for k in range(count):
        before[:, k] = z
        z = z @ carry.T + driven[:, k]
    y = (y + before @ from_state.T).reshape(channels, -1)[:, :n]
    _, b1, b2, _, a1, a2 = coefficients
    earlier = b2 * x[:, -2] - a2 * y[:, -2] if n > 1 else state[:, 1]
    after = np.stack([b1 * x[:, -1] - a1 * y[:, -1] + earlier, b2 * x[:, -1] - a2 * y[:, -1]], axis=1)
    y[bad] = np.nan
    after[bad[:, -1]] = np.nan
    return y, after


def sos_filter(x: np.ndarray, sos: np.ndarray, zerophase: bool = False) -> np.ndarray:
    """All sections from zero state; zerophase runs forward, then backward."""
    y = np.array(x, float)
    for coefficients in sos:
        y, _ = section(y, coefficients)
    return sos_filter(y[:, ::-1], sos)[:, ::-1] if zerophase else y


def sos_zerophase_padded(x: np.ndarray, sos: np.ndarray, pad: int) -> np.ndarray:
    """Forward-backward filtering with an odd extension and steady-state starts."""
    n = x.shape[1]
    pad = min(pad, n - 1)
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=1)

    def once(v):
        scale = v[:, 0].copy()
        for coefficients in sos:
            b0, b1, b2, _, a1, a2 = coefficients
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * gain) * scale
            v, _ = section(v, coefficients, np.stack([(b1 - a1 * gain) * scale + z2, z2], axis=1))
            scale = scale * gain
        return v

    y = once(once(y)[:, ::-1])[:, ::-1]
    return y[:, pad : pad + n]


def fir_outputs(x: np.ndarray, taps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Causal FIR sum_j taps[j] x[i - j] with zero history, only at the wanted samples i (i may pass the end)."""
    out = np.zeros((x.shape[0], len(at)))
    for j, b in enumerate(taps):
        source = at - j
        good = (source >= 0) & (source < x.shape[1])
        out[:, good] += b * x[:, source[good]]
    return out


def fir_at(x: np.ndarray, taps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """fir_outputs at evenly spaced samples at, by FFT where that is less work."""
    if len(taps) <= 64 or len(at) < 2 or at[1] - at[0] > 8 or not np.isfinite(x).all():
        return fir_outputs(x, taps, at)
    size = 1 << (x.shape[1] + len(taps) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:, at]


def polynomial_residual(x: np.ndarray, order: int) -> np.ndarray:
    """x less its least-squares polynomial of the sample number."""
    n = x.shape[1]
    if n == 0:
        return x
    t = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    q, _ = np.linalg.qr(np.vander(t, min(order + 1, n), increasing=True))
    return x - (x @ q) @ q.T


def cumulative_trapezoids(x: np.ndarray, step: float, axis: int) -> np.ndarray:
    """Running integral by trapezoids along an axis, from 0."""
    after, before = np.take(x, range(1, x.shape[axis]), axis), np.take(x, range(x.shape[axis] - 1), axis)
    out = np.zeros_like(x)
    inner = [slice(None)] * x.ndim
    inner[axis] = slice(1, None)
    out[tuple(inner)] = np.cumsum((after + before) * (step / 2), axis)
    return out


def preprocess(x: np.ndarray, order: int = 1) -> np.ndarray:
    """Detrend, demean, 10 % Tukey window."""
    y = polynomial_residual(x, order)
    return (y - y.mean(axis=1, keepdims=True)) * tukey(y.shape[1], 0.1)


def amplitude_spectrum(x: np.ndarray, pad: int = 0, nfft: int | None = None) -> np.ndarray:
    """2/n |FFT| of the lower half; pad puts pad-1 zeros before and pad after; nfft multiplies the length."""
    if pad > 0:
        x = np.pad(x, ((0, 0), (pad - 1, pad)))
    n = x.shape[1] * (nfft or 1)
    return 2 / n * np.abs(np.fft.fft(x, n, axis=1))[:, : n // 2]


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(channels, frames, size) view of whole frames."""
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]


def density(segments: np.ndarray, fs: float, window: np.ndarray, nfft: int) -> np.ndarray:
    y = (segments - segments.mean(axis=-1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(y, nfft, axis=-1)) ** 2 / (fs * (window**2).sum())
    last = power.shape[-1] - (nfft % 2 == 0)
    power[..., 1:last] *= 2
    return power


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> np.ndarray:
    """One-sided density: periodic Hann, half overlap, segments less their mean, averaged."""
    size = min(nperseg, x.shape[1])
    return density(frames(x, size, size - size // 2), fs, hann(size), size).mean(axis=1)


def stft(x: np.ndarray, fs: float, nperseg: int, nfft: int) -> np.ndarray:
    """(channels, frames, bins) density: periodic Tukey(0.25), half overlap, segments less their mean."""
    size = min(nperseg, x.shape[1])
    return density(frames(x, size, size - size // 2), fs, tukey(size, 0.25, sym=False), nfft)


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by FFT."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)
