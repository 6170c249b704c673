import numpy as np
import pytest

from lumenspan.functions import design, kernels


def response(sos, f):
    z = np.exp(-1j * np.pi * np.asarray(f))
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos], axis=0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("kind,edges", [("lowpass", 0.2), ("highpass", 0.3), ("bandpass", (0.2, 0.4)), ("bandstop", (0.2, 0.4))])
def test_butterworth(n, kind, edges):
    sos = design.iir_sos("butter", n, edges, kind)
    assert np.allclose(20 * np.log10(abs(response(sos, np.atleast_1d(edges)))), -10 * np.log10(2), atol=1e-6)
    passes = {"lowpass": 1e-9, "highpass": 1 - 1e-9, "bandpass": 2 / np.pi * np.arctan(np.sqrt(np.tan(0.1 * np.pi) * np.tan(0.2 * np.pi))), "bandstop": 1e-9}[kind]
    assert abs(response(sos, [passes]))[0] == pytest.approx(1, abs=1e-6)


def test_chebyshev():
    f = np.linspace(1e-6, 0.2, 2000)
    gain = 20 * np.log10(abs(response(design.iir_sos("cheby1", 8, 0.2, "lowpass", 0.05), f)))
    assert gain.max() == pytest.approx(0, abs=1e-6) and gain.min() == pytest.approx(-0.05, abs=1e-6)
    stop = 20 * np.log10(abs(response(design.iir_sos("cheby2", 7, 0.4, "lowpass", 60), np.linspace(0.4, 0.999, 4000))))
    assert stop.max() == pytest.approx(-60, abs=1e-3)


@pytest.mark.parametrize("factor", [2, 4, 5])
def test_decimation_taps_are_equiripple(factor):
    taps = design.decimation_taps(factor)
    assert len(taps) == 45 * factor + 1 and np.allclose(taps, taps[::-1])
    h = lambda f: np.abs(np.exp(-1j * np.pi * np.outer(f, np.arange(len(taps)))) @ taps)
    passing, stopping = abs(h(np.linspace(0, 0.75 / factor, 4000)) - 1).max(), h(np.linspace(1 / factor, 1, 8000)).max()
    assert passing < 0.05 and stopping == pytest.approx(passing / 50, rel=0.05)


def test_remez_even_bandpass():
    taps = design.remez(50, [0, 0.225, 0.25, 0.5, 0.55, 0.97], [0, 1, 0], [1, 1, 1])
    h = lambda f: np.abs(np.exp(-1j * np.pi * np.outer(f, np.arange(50))) @ taps)
    errors = [h(np.linspace(0, 0.225, 2000)).max(), abs(h(np.linspace(0.25, 0.5, 2000)) - 1).max(), h(np.linspace(0.55, 0.97, 2000)).max()]
    assert max(errors) < 1.05 * min(errors)


def test_kernels():
    t = np.arange(2000) / 1000
    x = 3 * np.sin(2 * np.pi * 50 * t)[None]
    a = kernels.amplitude_spectrum(x)
    assert a.argmax() == 100 and a.max() == pytest.approx(3)
    impulse = np.zeros((1, 300))
    impulse[0, 100] = 1
    taps = design.decimation_taps(2)
    assert np.allclose(kernels.fir_outputs(impulse, taps, np.arange(300))[0, 100 : 100 + len(taps)], taps)
    assert np.allclose(kernels.polynomial_residual(np.vander(np.arange(50.0), 4).T[:1], 3), 0, atol=1e-6)
    assert np.allclose(np.abs(kernels.analytic(np.cos(2 * np.pi * np.arange(64) / 8)[None])), 1)
    low = kernels.sos_zerophase_padded(np.ones((1, 200)), design.iir_sos("cheby1", 8, 0.2, "lowpass", 0.05), 27)
    assert np.allclose(low, low[0, 0], atol=1e-6) and abs(low[0, 0] - 1) < 0.012
    power = kernels.welch(x, 1000.0)
    assert power[0, 13] > 100 * np.median(power)


def test_windows():
    assert design.tukey(1, 0.1).tolist() == [1] and np.allclose(design.tukey(9, 1), np.hanning(9))
    assert np.allclose(design.tukey(8, 0), 1) and design.tukey(64, 0.1)[0] == 0


def naive_sections(x, sos, state=None):
    """Sample by sample."""
    y = np.array(x, float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = (np.zeros(len(y)), np.zeros(len(y))) if state is None else state[k].T
        for t in range(y.shape[1]):
            u = y[:, t].copy()
            y[:, t] = b0 * u + z1
            z1, z2 = b1 * u - a1 * y[:, t] + z2, b2 * u - a2 * y[:, t]
    return y


def test_blocks_filter_as_single_samples_do():
    rng = np.random.default_rng(3)
    sos = design.iir_sos("butter", 4, np.array([0.1, 0.4]), "bandpass")
    for n in (1, 2, 3, kernels.BLOCK - 1, kernels.BLOCK, 5 * kernels.BLOCK + 17):
        x = rng.normal(size=(3, n))
        assert np.allclose(kernels.sos_filter(x, sos), naive_sections(x, sos), atol=1e-12)
        cut, y, state = n // 3, [], [None] * len(sos)
        for part in (x[:, :cut], x[:, cut:]):
            for k, row in enumerate(sos):
                part, state[k] = kernels.section(part, row, state[k])
            y.append(part)
        assert np.allclose(np.concatenate(y, axis=1), naive_sections(x, sos), atol=1e-12)


def test_a_bad_value_spoils_only_what_follows():
    x = np.ones((2, 300))
    x[0, 200] = np.nan
    sos = design.iir_sos("butter", 4, np.array([0.2]), "lowpass")
    y = kernels.sos_filter(x, sos)
    assert np.isfinite(y[0, :200]).all() and np.isnan(y[0, 200:]).all() and np.isfinite(y[1]).all()
    assert np.allclose(y[0, :200], y[1, :200])


def test_the_least_number_of_steps_that_the_order_allows():
    """Bisection finds what trying step after step does; polynomials are the sections' product."""
    from lumenspan.functions import design
    from lumenspan.operators import filters

    for freq, fs, most in ((16.0, 64.0, 12), (10.0, 100.0, 12), (3.0, 500.0, 6), (30.0, 64.0, 40)):
        steps = next(k for k in range(1, 5000) if design.cheb2_order(freq / (fs / 2) * 0.99**k, freq / (fs / 2), 1, 96)[0] <= most)
        sos, edge = filters.cheby_2_sections(freq, fs, most)
        assert np.isclose(edge, freq * 0.99**steps)
        b, a = filters.cheby_2_polynomials(freq, fs, most)
        assert len(a) <= 2 * len(sos) + 1
        if freq < fs / 8 or len(a) > 13:
            continue  # polynomials of narrow filters and of high orders lose digits
        z = np.exp(-1j * np.linspace(0.01, 3.1, 50))
        by_sections = np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sos], axis=0)
        assert np.allclose(np.polyval(b[::-1], z) / np.polyval(a[::-1], z), by_sections, atol=1e-6)


def test_periodic_sinc_sums_the_passing_bins():
    from lumenspan.functions import design
    from lumenspan.operators import filters

    for freq, fs, n in ((10.0, 64.0, 64), (9.7, 64.0, 65), (0.1, 64.0, 64), (31.9, 64.0, 64), (40.0, 64.0, 64), (40.0, 64.0, 33)):
        passes = np.abs(np.fft.fftfreq(n, 1 / fs)) < freq
        kernel = np.array([sum(np.exp(2j * np.pi * k * j / n) for k in np.flatnonzero(passes)) for j in np.arange(n) - n // 2]) / n
        assert np.allclose(filters.sinc_taps(freq, fs, n), np.abs(kernel) * design.kaiser(n, 11.7), atol=1e-12)
