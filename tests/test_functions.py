import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from undula import cli
from undula.config import DIALECTS, PRESETS, MagnifyConfig
from undula.functions import coeffs, color, stencils
from undula.operators import arrays, recursive, spectral


def test_first_order_golden_values():
    b, a = coeffs.butterworth(1, 0.4, "low", 30.0)
    assert np.allclose(b, [0.04022643104648003] * 2, atol=1e-8) and np.allclose(a, [1, -0.9195471379070399], atol=1e-8)
    b, a = coeffs.butterworth(1, 3.0, "low", 30.0)
    assert np.allclose(b, [0.24523727525278557] * 2, atol=1e-8) and np.allclose(a, [1, -0.5095254494944288], atol=1e-8)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("btype", ["low", "high"])
def test_butterworth_response(order, btype):
    b, a = coeffs.butterworth(order, 2.0, btype, 30.0)
    assert len(a) == order + 1
    gain = lambda hz: abs(np.polyval(b, np.exp(2j * np.pi * hz / 30)) / np.polyval(a, np.exp(2j * np.pi * hz / 30)))
    assert math.isclose(gain(0 if btype == "low" else 15), 1, abs_tol=1e-9) and math.isclose(gain(2.0), math.sqrt(0.5), rel_tol=1e-9)


@pytest.mark.parametrize("bad", [(0, 1, "low", 30), (1, 0, "low", 30), (1, 15, "low", 30), (1, 1, "band", 30)])
def test_butterworth_rejects(bad):
    with pytest.raises(ValueError):
        coeffs.butterworth(*bad)


def test_halved_dialect_shows_a_transient_on_a_constant():
    x = np.ones((64, 1))
    right = recursive.recursive_bandpass(x, 30, 0.4, 3.0)
    wrong = recursive.recursive_bandpass(x, 30, 0.4, 3.0, kind="halved")
    assert np.abs(right[1:]).max() < 1e-12 < 0.5 < np.abs(wrong[1:]).max()


def test_bins():
    assert [k for k, _ in coeffs.kept_bins(301, 30, 0.8333, 1.0)] == [9, 10]
    assert [k for k, _ in coeffs.kept_bins(301, 30, 0.8333, 1.0, "onesided")] == [8, 9]
    assert coeffs.smooth_length(301) == 320
    assert np.allclose(coeffs.frequencies(8, 8), np.fft.fftfreq(8, 1 / 8) * 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 80), st.floats(0.05, 1.5), st.floats(0.1, 3.0))
def test_projection_is_the_masked_transform(n, low, width):
    x = np.random.default_rng(n).normal(size=(n, 3))
    f = np.abs(np.fft.fftfreq(n, 1 / 10))
    full = np.real(np.fft.ifft(np.fft.fft(x, axis=0) * ((f >= low) & (f <= low + width))[:, None], axis=0))
    assert np.allclose(spectral.fft_bandpass(x, 10, low, low + width), full, atol=1e-9)


@pytest.mark.parametrize("n", [500, 501])
def test_wide_bands_are_transformed(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    f = np.abs(np.fft.fftfreq(n, 1 / 10))
    full = np.real(np.fft.ifft(np.fft.fft(x, axis=0) * ((f >= 0) & (f <= 5))[:, None], axis=0))
    assert np.allclose(spectral.fft_bandpass(x, 10, 0, 5), full, atol=1e-9)
    one = [k for k, _ in coeffs.kept_bins(n, 10, 1, 4, "onesided")]
    spectrum = np.fft.fft(x, axis=0)
    spectrum[[k for k in range(n) if k not in one]] = 0
    assert np.allclose(spectral.fft_bandpass(x, 10, 1, 4, "onesided"), np.real(np.fft.ifft(spectrum, axis=0)), atol=1e-9)


def test_onesided_mask_is_half():
    t = np.arange(60)
    x = np.sin(2 * np.pi * 2 * t / 60)[:, None]  # 1 Hz at 30 fps
    assert np.allclose(spectral.fft_bandpass(x, 30, 0.9, 1.4), x, atol=1e-9)
    assert np.allclose(spectral.fft_bandpass(x, 30, 0.9, 1.4, "onesided"), x / 2, atol=1e-9)
    assert np.allclose(spectral.fft_bandpass(x, 30, 3, 4), 0) and spectral.fft_bandpass(x, 30, 0.9, 1.4, padding="optimal").shape == x.shape


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.sampled_from(["reflect101", "reflect"]))
def test_blur_keeps_constants(n, border):
    assert np.allclose(stencils.blur(n, border).sum(1), 1)
    assert np.allclose(stencils.down(n, (n + 1) // 2, 2, border).sum(1), 1)


def test_borders_and_sizes():
    assert stencils.mirror(np.array([-2, -1, 0, 4, 5]), 4).tolist() == [2, 1, 0, 2, 1]
    assert stencils.mirror(np.array([-2, -1, 4, 5]), 4, "reflect").tolist() == [1, 0, 3, 2]
    assert stencils.mirror(np.array([-2, 3]), 1).tolist() == [0, 0]
    assert (stencils.up_size(4), stencils.up_size(4, 7), stencils.up_size(4, 8)) == (8, 7, 8)
    assert coeffs.half(7) == 4 and coeffs.half(7, "floor") == 3
    assert coeffs.level_sizes(9, 1, 3) == [(9, 1), (5, 1), (3, 1), (2, 1)]
    assert np.allclose(stencils.bilinear(4, 8).sum(1), 1) and np.allclose(stencils.bilinear(5, 5), np.eye(5))


def test_impulse_gives_the_kernel():
    x = np.zeros((1, 9, 9, 1))
    x[0, 4, 4, 0] = 1
    m = stencils.blur(9)
    y = stencils.along(stencils.along(x, m, 1), m, 2)
    assert np.allclose(y[0, 2:7, 2:7, 0], np.outer(stencils.KERNEL, stencils.KERNEL)) and np.isclose(y.sum(), 1)


def test_chained_matrix_is_the_chain():
    x = np.random.default_rng(0).normal(size=(2, 13, 7, 3))
    m, k = stencils.gaussian(13, 2), stencils.gaussian(7, 2)
    sizes = coeffs.level_sizes(13, 7, 2)
    steps = arrays.grow(arrays.shrink(x, 2, "reflect101", "ceil"), sizes[-2::-1], "reflect101")
    assert np.allclose(stencils.along(stencils.along(x, m, 1), k, 2), steps)


def test_colour_round_trip():
    assert np.allclose(np.array(color.inverse()) @ np.array(color.YIQ), np.eye(3))
    assert np.allclose(np.array(color.inverse("constants")) @ np.array(color.YIQ), np.eye(3), atol=1e-2)


def test_gains_in_both_regimes():
    big = coeffs.level_gains(coeffs.level_sizes(592, 528, 4), 50, 16)
    assert big == [1.0, 50, 50, 50, 1.0]
    small = coeffs.level_gains(coeffs.level_sizes(592, 528, 3), 100, 1000)
    assert np.allclose(small[1:3], [39.1, 19.0], atol=0.1)


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"levels": 11}, {"alpha": -1.0}, {"fps": 0.0}, {"low_hz": 2.0}, {"mode": "laplacian", "high_hz": 15.0, "fps": 30.0}, {"mode": "laplacian", "levels": 0}])
def test_config_rejects(bad):
    with pytest.raises(ValueError):
        MagnifyConfig(**bad)


def test_cli_options():
    args = cli.parser().parse_args(["magnify", "a", "b", "--preset", "baby", "--alpha", "7", "--residual", "false"])
    made = cli.config_of(args)
    assert made.mode == "laplacian" and made.alpha == 7 and made.residual is False and made.attenuation == 0.1
    assert set(DIALECTS) == {"cpp", "python", "cuda"} and "heart_rate" in PRESETS
