"""Array windows against plain loops."""

import time

import numpy as np
import pytest

from kinetrail.functions.kernel import Chunks, Decay, Ranks, after, decaying, filled, lagged


def draw(rng, coarse):
    n = int(rng.integers(0, 60))
    x = rng.normal(size=n) * 10
    x = np.round(x / 10) if coarse else x
    x[rng.random(n) < 0.3] = np.nan
    return x


@pytest.mark.parametrize("seed", range(6))
def test_windows(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        x = draw(rng, seed % 2)
        n, (back, ahead) = len(x), map(int, rng.integers(0, 20, 2))
        y = rng.normal(size=n)
        chunks, ranks = Chunks(n, back, ahead), Ranks(x)
        one, two = chunks.moments(x), chunks.moments(x, y)
        high, low, (counted, median), (trailing, share) = chunks.extreme(x, np.fmax), chunks.extreme(x, np.fmin), ranks.median(back, ahead), ranks.share(back)
        for i in range(n):
            w, z = x[max(0, i - back) : i + ahead + 1], y[max(0, i - back) : i + ahead + 1]
            v, u = w[~np.isnan(w)], z[~np.isnan(w)]
            assert one[0][i] == two[0][i] == counted[i] == len(v)
            if len(v):
                want = (v.mean(), ((v - v.mean()) ** 2).sum(), u.mean(), ((v - v.mean()) * (u - u.mean())).sum())
                assert np.allclose([m[i] for m in two[1:]], want, atol=1e-9) and np.allclose([one[1][i], one[2][i]], want[:2], atol=1e-9)
                assert (high[i], low[i]) == (v.max(), v.min()) and np.isclose(median[i], np.median(v))
            v = x[max(0, i - back) : i + 1]
            v = v[~np.isnan(v)]
            if not np.isnan(x[i]):
                assert trailing[i] == len(v) and np.isclose(share[i], ((v < x[i]).sum() + ((v == x[i]).sum() + 1) / 2) / len(v))


def test_no_cancellation():
    """Spreads of small numbers stay exact next to very large ones."""
    x = np.concatenate([np.full(50, 1e12), np.tile([1.0, 2.0], 50)])
    count, mean, squares, _, _ = Chunks(len(x), 9, 0).moments(x)
    assert np.allclose(squares[60:] / count[60:], 0.25, rtol=1e-12) and np.allclose(mean[60:], 1.5, rtol=1e-12)


@pytest.mark.parametrize("span", [1, 2, 5, 60, 400.0])
def test_decays(span):
    """Against the sum of all weights; in parts, carried from part to part in both ways."""
    rng = np.random.default_rng(int(span))
    for _ in range(20):
        x = draw(rng, False)
        got, _ = decaying(x, span)
        last, d = np.nan, 1 - 2 / (span + 1)
        for i in range(len(x)):
            if not np.isnan(x[i]):
                ok = ~np.isnan(x[: i + 1])
                w = (d ** (i - np.arange(i + 1.0)))[ok]
                last = (x[: i + 1][ok] * w).sum() / w.sum()
            assert np.isclose(got[i], last, rtol=1e-12, equal_nan=True)
        state, other, found = Decay(), Decay(), []
        for part in np.array_split(x, 4):
            means, new = decaying(part, span, state)
            found.append(means)
            other = after(other, len(part), decaying(part, span)[1], span)
            state = new
            assert np.allclose([state.mean, state.weight, state.age], [other.mean, other.weight, other.age], equal_nan=True)
        assert np.allclose(np.concatenate(found), got, rtol=1e-12, equal_nan=True)


def test_decay_outlasts_a_long_gap():
    """A mean is kept over more missing rows than its weight survives, and the next value replaces it."""
    x = np.concatenate([[5.0], np.full(40_000, np.nan), [7.0]])
    got, _ = decaying(x, 5)
    assert (got[:-1] == 5.0).all() and abs(got[-1] - 7.0) < 1e-12
    parts, state = [], Decay()
    for part in np.array_split(x, 7):
        means, state = decaying(part, 5, state)
        parts.append(means)
    assert np.allclose(np.concatenate(parts), got, rtol=1e-14)


def test_width_costs_nothing():
    x = np.random.default_rng(0).normal(size=200_000)
    took = []
    for width in (240, 60_000):
        began = time.process_time()
        ranks = Ranks(x)
        ranks.share(width - 1)
        ranks.median(width - 1, 0)
        Chunks(len(x), width - 1, 0).moments(x)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0]


def test_lags_and_fills():
    x = np.array([1.0, np.nan, 3.0])
    assert np.array_equal(lagged(x, 1), [np.nan, 1.0, np.nan], equal_nan=True) and np.array_equal(lagged(x, -2), [3.0, np.nan, np.nan], equal_nan=True)
    assert np.isnan(lagged(x, 7)).all() and np.array_equal(filled(x), [1.0, 1.0, 3.0]) and not len(filled(x[:0]))
