import math

import numpy as np
import pytest

from cellorium.functions import special as sp


def test_tails_against_tables():
    assert sp.norm_sf2(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert sp.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert sp.f_sf(3.354130829, 2, 27) == pytest.approx(0.05, abs=1e-8)
    assert sp.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert sp.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert sp.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)


def test_tails_against_closed_forms():
    x = np.array([0.1, 1.0, 5.0, 20.0])
    np.testing.assert_allclose(sp.chi2_sf(x, 2), np.exp(-x / 2), rtol=1e-10)
    np.testing.assert_allclose(sp.chi2_sf(x, 4), np.exp(-x / 2) * (1 + x / 2), rtol=1e-10)
    np.testing.assert_allclose(sp.t_sf2(x, 1), 1 - 2 / math.pi * np.arctan(x), rtol=1e-9)
    np.testing.assert_allclose(sp.t_sf2(x, 2), 1 - x / np.sqrt(2 + x * x), rtol=1e-8)
    np.testing.assert_allclose(sp.f_sf(x, 2, 8), (1 + x / 4) ** -4.0, rtol=1e-9)
    np.testing.assert_allclose(sp.t_sf2(x, np.inf), sp.norm_sf2(x))


@pytest.mark.parametrize("q,k,df", [(3.506, 3, 27), (3.877, 3, 10), (4.602, 3, 5), (3.958, 4, 20), (4.232, 5, 20), (8.331, 3, 2), (3.314, 3, 1e9)])
def test_studentized_range_table(q, k, df):
    assert sp.ptukey_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)


def test_studentized_range_of_two_is_t():
    for t in (0.5, 1.5, 3.0):
        assert sp.ptukey_sf(t * math.sqrt(2), 2, 12) == pytest.approx(float(sp.t_sf2(t, 12)), abs=2e-5)


def test_gamma_derivatives():
    assert sp.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert sp.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-8)
    assert sp.trigamma_inverse(float(sp.trigamma(3.7))) == pytest.approx(3.7, rel=1e-6)


def test_fisher_and_rank_sum():
    o, p = sp.fisher_exact([3, 10, 0, 5], [1, 2, 5, 0], [1, 3, 4, 0], [3, 15, 0, 5])
    assert o[0] == pytest.approx(6.408309, abs=1e-4) and p[0] == pytest.approx(34 / 70)
    assert p[1] == pytest.approx(0.000536724, abs=1e-7) and o[2] == 0 and math.isinf(o[3])
    assert sp.wilcoxon_exact_p(0, 4, 4) == pytest.approx(2 / 70)
    assert sp.wilcoxon_exact_p(12, 5, 5) == 1.0


def test_bad_input_is_nan():
    assert np.isnan(sp.f_sf(np.nan, 1, 2)) and np.isnan(sp.t_sf2(1.0, 0)) and np.isnan(sp.chi2_sf(1.0, 0))
    assert sp.f_sf(np.inf, 1, 2) == 0 and sp.chi2_sf(-1, 3) == 1
