"""Digital filter design in NumPy, from textbook formulas: Butterworth, Chebyshev I and II, Parks-McClellan, windows."""

from __future__ import annotations

import math

import numpy as np


def tukey(m: int, alpha: float, sym: bool = True) -> np.ndarray:
    """Tapered cosine window; periodic if not sym."""
    if m < 1:
        return np.zeros(0)
    if m == 1:
        return np.ones(1)
    total = m if sym else m + 1
    i = np.arange(total, dtype=float)
    if alpha <= 0:
        w = np.ones(total)
    elif alpha >= 1:
        w = 0.5 - 0.5 * np.cos(2 * np.pi * i / (total - 1))
    else:
        width = math.floor(alpha * (total - 1) / 2)
        w = np.ones(total)
        left, right = i <= width, i >= total - width - 1
        w[left] = 0.5 * (1 + np.cos(np.pi * (2 * i[left] / alpha / (total - 1) - 1)))
        w[right] = 0.5 * (1 + np.cos(np.pi * (2 * i[right] / alpha / (total - 1) - 2 / alpha + 1)))
    return w[:m]


def hann(m: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m) if m > 1 else np.ones(m)


def kaiser(m: int, beta: float) -> np.ndarray:
    """Periodic Kaiser window."""
    return np.kaiser(m + 1, beta)[:m]


def _lowpass_prototype(kind: str, n: int, ripple: float) -> tuple[np.ndarray, np.ndarray, float]:
    m = np.arange(-n + 1, n, 2)
    if kind == "butter":
        return np.zeros(0, complex), -np.exp(1j * np.pi * m / (2 * n)), 1.0
    if kind == "cheby1":
        eps = math.sqrt(10 ** (ripple / 10) - 1)
        mu = math.asinh(1 / eps) / n
        p = -np.sinh(mu + 1j * np.pi * m / (2 * n))
        k = np.prod(-p).real
        return np.zeros(0, complex), p, k if n % 2 else k / math.sqrt(1 + eps * eps)
    if kind == "cheby2":
        de = 1 / math.sqrt(10 ** (ripple / 10) - 1)
        mu = math.asinh(1 / de) / n
        odd = m[m != 0]
        z = -np.conj(1j / np.sin(odd * np.pi / (2 * n)))
        p = -np.exp(1j * np.pi * m / (2 * n))
        p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
        return z, p, (np.prod(-p) / np.prod(-z)).real
    raise ValueError(f"unknown filter family {kind!r}")


def iir_sos(kind: str, n: int, edges, btype: str, ripple: float = 0.0) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital filter; edges are shares of the Nyquist frequency."""
    edges = np.atleast_1d(np.asarray(edges, float))
    if n < 1 or (edges <= 0).any() or (edges >= 1).any():
        raise ValueError("the order must be positive and all edges lie strictly between 0 and the Nyquist frequency")
    z, p, k = _lowpass_prototype(kind, n, ripple)
    warped = 4 * np.tan(np.pi * edges / 2)
    extra = len(p) - len(z)
    if btype == "lowpass":
        z, p, k = z * warped[0], p * warped[0], k * warped[0] ** extra
    elif btype == "highpass":
        k *= (np.prod(-z) / np.prod(-p)).real
        z, p = np.concatenate([warped[0] / z, np.zeros(extra)]), warped[0] / p
    else:
        width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
        if btype == "bandpass":
            half = lambda r: r * width / 2
            spread = lambda r: np.concatenate([r + np.sqrt(r * r - centre2), r - np.sqrt(r * r - centre2)])
            z, p = np.concatenate([spread(half(z).astype(complex)), np.zeros(extra)]), spread(half(p).astype(complex))
            k *= width**extra
        elif btype == "bandstop":
            k *= (np.prod(-z) / np.prod(-p)).real
            half = lambda r: (width / 2) / r
            spread = lambda r: np.concatenate([r + np.sqrt(r * r - centre2), r - np.sqrt(r * r - centre2)])
            hole = 1j * math.sqrt(centre2)
            z = np.concatenate([spread(half(z).astype(complex)), np.full(extra, hole), np.full(extra, -hole)])
            p = spread(half(p).astype(complex))
        else:
            raise ValueError(f"unknown band type {btype!r}")
    k *= (np.prod(4 - z) / np.prod(4 - p)).real
    zeros = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    return _sections(zeros, (4 + p) / (4 - p), k)


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Pair poles with their conjugates, the nearest zeros with the poles next to the unit circle."""
    if len(p) % 2:
        z, p = np.append(z, 0), np.append(p, 0)
    z, p, out = list(z), list(p), []

    def pop_near(roots: list, target: complex, real: bool | None = None) -> complex:
        pool = [i for i, r in enumerate(roots) if real is None or (abs(r.imag) < 1e-10) == real] or range(len(roots))
        return roots.pop(min(pool, key=lambda i: abs(roots[i] - target)))

    def pair(roots: list, target: complex) -> list[complex]:
        first = pop_near(roots, target)
        return [first, pop_near(roots, np.conj(first)) if abs(first.imag) > 1e-10 else pop_near(roots, target, True)]

    while p:
        first = p.pop(max(range(len(p)), key=lambda i: abs(p[i])))
        second = pop_near(p, np.conj(first)) if abs(first.imag) > 1e-10 else pop_near(p, first, True)
        out.append([*np.poly(pair(z, first)).real, *np.poly([first, second]).real])
    sos = np.array(out[::-1])
    sos[0, :3] *= k
    return sos


def cheb2_order(wp: float, ws: float, rp: float, rs: float) -> tuple[int, float]:
    """Least Chebyshev II lowpass order and its edge, for rp dB at most up to wp and rs dB at least from ws on."""
    pass_edge, stop_edge = math.tan(math.pi * wp / 2), math.tan(math.pi * ws / 2)
    loss, gain = 10 ** (rs / 10) - 1, 10 ** (rp / 10) - 1
    v = math.acosh(math.sqrt(loss / gain))
    order = math.ceil(v / math.acosh(stop_edge / pass_edge))
    edge = pass_edge * math.cosh(v / order)
    return order, 2 / math.pi * math.atan(edge)


def remez(taps: int, bands, desired, weights, grid: int = 16, rounds: int = 60) -> np.ndarray:
    """Equiripple linear-phase symmetric FIR by Parks-McClellan exchange. bands: edges as shares of the Nyquist
    frequency, in pairs; desired and weights: one value a pair."""
    bands = np.asarray(bands, float).reshape(-1, 2) / 2
    odd = taps % 2 == 1
    r = taps // 2 + odd
    step = 0.5 / (grid * r)
    parts, want, weight = [], [], []
    for (low, high), d, w in zip(bands, desired, weights):
        f = np.linspace(low, high, max(3, int((high - low) / step) + 1))
        if not odd:
            f = f[f < 0.5 - 1e-9 * 0 - step / 2] if f[-1] > 0.5 - step / 2 else f
        parts.append(f)
        scale = np.ones(len(f)) if odd else np.cos(np.pi * f)
        want.append(d / scale)
        weight.append(w * scale)
    f, want, weight = np.concatenate(parts), np.concatenate(want), np.concatenate(weight)
    block = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    x = np.cos(2 * np.pi * f)
    pick = np.round(np.linspace(0, len(f) - 1, r + 1)).astype(int)

    def barycentric(nodes):
        gap = 2 * (nodes[:, None] - nodes[None, :])
        np.fill_diagonal(gap, 1)
        sign, logs = np.prod(np.sign(gap), axis=1), np.log(np.abs(gap)).sum(axis=1)
        return sign * np.exp(logs.min() - logs)

    for _ in range(rounds):
        nodes = x[pick]
        ad = barycentric(nodes)
        alternate = (-1.0) ** np.arange(r + 1)
        delta = (ad * want[pick]).sum() / (ad * alternate / weight[pick]).sum()
        value = want[pick] - alternate * delta / weight[pick]
        sub = barycentric(nodes[:-1])
        gap = x[:, None] - nodes[None, :-1]
        exact = np.argmin(np.abs(gap), axis=1)
        hit = np.abs(gap[np.arange(len(x)), exact]) < 1e-14
        gap[hit] = 1
        c = sub / gap
        amplitude = (c @ value[:-1]) / c.sum(axis=1)
        amplitude[hit] = value[exact[hit]]
        error = weight * (want - amplitude)
        new = _extremes(error, block, r + 1)
        if np.array_equal(new, pick) or np.abs(error).max() <= abs(delta) * (1 + 1e-9):
            pick = new
            break
        pick = new
    at = np.arange(taps) / taps
    if not odd:
        at = at[at < 0.5]
    half = np.minimum(at, 1 - at)
    xs = np.cos(2 * np.pi * half)
    gap = xs[:, None] - nodes[None, :-1]
    exact = np.argmin(np.abs(gap), axis=1)
    hit = np.abs(gap[np.arange(len(xs)), exact]) < 1e-14
    gap[hit] = 1
    c = sub / gap
    response = (c @ value[:-1]) / c.sum(axis=1)
    response[hit] = value[exact[hit]]
    middle = (taps - 1) / 2
    n = np.arange(taps)
    if odd:
        count = taps // 2
        return (response[0] + 2 * (response[1 : count + 1, None] * np.cos(2 * np.pi * np.arange(1, count + 1)[:, None] * (n - middle) / taps)).sum(axis=0)) / taps
    response = response * np.cos(np.pi * half)
    count = taps // 2 - 1
    return (response[0] + 2 * (response[1 : count + 1, None] * np.cos(2 * np.pi * np.arange(1, count + 1)[:, None] * (n - middle) / taps)).sum(axis=0)) / taps


def _extremes(error: np.ndarray, block: np.ndarray, count: int) -> np.ndarray:
    """`count` alternating extremes of the error, band edges included, the weakest ends dropped."""
    n = len(error)
    size = np.abs(error)
    first, last = np.r_[True, block[1:] != block[:-1]], np.r_[block[1:] != block[:-1], True]
    before = np.where(first, -np.inf, np.r_[0, np.where(error[1:] > 0, error[:-1], -error[:-1])])
    after = np.where(last, -np.inf, np.r_[np.where(error[:-1] > 0, error[1:], -error[1:]), 0])
    peak = np.flatnonzero((size >= before) & (size >= after))
    chosen: list[int] = []
    for i in peak:
        if chosen and (error[i] > 0) == (error[chosen[-1]] > 0):
            if size[i] > size[chosen[-1]]:
                chosen[-1] = i
        else:
            chosen.append(i)
    while len(chosen) > count:
        if len(chosen) - count >= 2:
            weakest = min(range(len(chosen) - 1), key=lambda j: size[chosen[j]] + size[chosen[j + 1]])
            ends = min(size[chosen[0]], size[chosen[-1]])
            if size[chosen[weakest]] + size[chosen[weakest + 1]] < 2 * ends and 0 < weakest < len(chosen) - 2:
                del chosen[weakest : weakest + 2]
                continue
        del chosen[0 if size[chosen[0]] < size[chosen[-1]] else -1]
    missing = [i for i in np.linspace(0, n - 1, 4 * count).astype(int) if i not in set(chosen)]
    while len(chosen) < count:
        chosen.append(missing.pop(0))
    return np.array(sorted(chosen))


def decimation_taps(factor: int) -> np.ndarray:
    """Anti-alias FIR for a decimation: 45 taps a factor plus one, pass to 75 % of the new Nyquist frequency, stop from
    it on, stop band weighted fifty times."""
    return remez(45 * factor + 1, [0, 0.75 / factor, 1 / factor, 1], [1, 0], [1, 50])
