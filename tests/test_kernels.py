"""Kernels against hand values and pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from volumetra.functions import kernels as K
from volumetra.functions import learn as L
from volumetra.functions import normal
from volumetra.operators import research as Q
from volumetra.operators.trading import fold
from volumetra.sources import synthetic


def walk(n=200, seed=1):
    f = synthetic.survivor(n, seed)
    return tuple(f[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume"))


def test_series_equal_pandas():
    o, h, l, c, v = walk()
    s = pd.Series(c)
    pc = s.shift()
    tr = pd.concat([pd.Series(h - l), (pd.Series(h) - pc).abs(), (pd.Series(l) - pc).abs()], axis=1).max(axis=1)
    np.testing.assert_allclose(K.atr(h, l, c), tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), equal_nan=True)
    np.testing.assert_allclose(K.rolling_mean(v, 20, 10), pd.Series(v).rolling(20, min_periods=10).mean(), equal_nan=True)
    rank = s.rolling(50, min_periods=12).apply(lambda x: (x <= x[-1]).mean(), raw=True)
    np.testing.assert_allclose(K.percentile_rank(c, 50), rank, equal_nan=True)
    slope = s.rolling(20, min_periods=10).apply(lambda x: np.polyfit(np.arange(len(x)), x, 1)[0], raw=True)
    np.testing.assert_allclose(K.rolling_slope(c, 20), slope, rtol=1e-7, equal_nan=True)
    r = s.rolling(20, min_periods=10)
    np.testing.assert_allclose(K.bandwidth(c), 4 * r.std(ddof=0) / r.mean(), equal_nan=True)


def test_peaks():
    x = np.array([0, 3, 1, 2, 2, 2, 0, 5, 4.5, 6, 0])
    assert K.peaks(x, 0.5, 1).tolist() == [1, 4, 7, 9]  # the middle of a plateau
    assert K.peaks(x, 0.6, 1).tolist() == [1, 4, 9]  # five stands only half above what lies before six
    assert K.peaks(x, 0, 3).tolist() == [1, 4, 9]
    assert K.gaussian(np.ones(20)) == pytest.approx(np.ones(20))


def test_profile_conserves_volume():
    o, h, l, c, v = walk()
    for mode in ("fixed", "auto"):
        p = K.profile(h, l, c, v, mode)
        assert p["hist"].sum() == pytest.approx(v.sum()) and p["val"] <= p["poc"] <= p["vah"]
        assert p["va_volume"] >= 0.7 * p["total"] and p["hvn"][0][0] == pytest.approx(p["poc"])
    one = np.full(30, 50.0)
    p = K.profile(one, one, one, np.full(30, 1000.0))
    assert p["poc"] == pytest.approx(50, abs=1e-3) and p["total"] == 30_000
    assert K.profile(one, one, one, np.zeros(30)) is None
    bad = h.copy()
    bad[0] = np.nan
    assert K.profile(bad, l, c, v)["n_bars"] == 199


def test_value_area_takes_pairs_and_ties_up():
    assert K.value_area(np.array([1, 2, 10, 2, 1.0]), 2, 0.7, 16)[:2] == (2, 4)
    assert K.value_area(np.array([5, 5, 10, 1, 1.0]), 2, 0.7, 22)[:2] == (0, 2)


def test_score_is_bounded_and_no_future_is_seen():
    o, h, l, c, v = walk(400, 5)
    for t in (150, 260, 399):
        w = slice(t - 119, t + 1)
        a = K.analyse(o[w], h[w], l[w], c[w], v[w])
        later = [x.copy() for x in (o, h, l, c, v)]
        for x in later:
            x[t + 1 :] *= 3
        b = K.analyse(*(x[w] for x in later))
        assert a[3] == b[3] and a[4] == b[4]
        assert abs(a[3]["bias_score"]) <= a[3]["quality"] + 0.01


def test_fill_machine():
    rows = [(10, 10, 10, 10), (10, 11, 9, 10), (10, 10.5, 9.5, 10), (8, 8, 7, 7.5)]
    bars = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).assign(ts=pd.date_range("2020-01-01", periods=4))
    trades, curve = fold(bars, {0: (1, 9.0, 20.0)}, lookback=1, slippage=0.0)
    assert (trades[0][1], trades[0][6], trades[0][13]) == (1, 9.0, "stop")  # the stop on the entry bar, at its price
    trades, _ = fold(bars, {1: (1, 9.0, 20.0)}, lookback=1, slippage=0.0)
    assert (trades[0][6], trades[0][13]) == (8, "stop")  # a later gap fills at the open
    trades, curve = fold(bars, {0: (1, 10.0, 20.0)}, lookback=1, slippage=0.0)
    assert not trades and all(x[2] == 10_000 for x in curve)  # an open at the stop is no entry


def test_splits_purge_and_embargo():
    for tr, te in L.splits(100, 6, 2, purge=5, embargo=0.02):
        assert not set(tr) & set(te)
        edges = [t for t in te if t - 1 not in te]
        assert not any(set(range(a - 5, a)) & set(tr) for a in edges)
        ends = [t for t in te if t + 1 not in te]
        assert not any(set(range(b + 1, b + 3)) & set(tr) for b in ends)
    assert len(list(L.splits(100))) == 15


def test_planted_signal_and_null():
    rng = np.random.default_rng(1)
    X, noise = rng.normal(size=(400, 3)), rng.normal(size=400)
    cv = list(L.splits(400, purge=3))
    assert np.mean([f["ic"] for f in L.factor_eval(X, X[:, 0] + noise, X[:, 0], cv)]) > 0.5
    assert abs(np.mean([f["ic"] for f in L.factor_eval(X, noise, X[:, 0], cv)])) < 0.15
    y = (X[:, 0] + 0.5 * noise > 0).astype(int)
    rows = L.meta_eval(X, y, np.where(y, 0.02, -0.02), cv)
    assert L.mean_of(rows, "auc") > 0.8 and L.mean_of(rows, "meta") > L.mean_of(rows, "primary")
    assert L.buckets(X, X[:, 0] + noise, cv)["rank_corr"] > 0.9


def test_overfitting_of_noise_and_skill():
    rng = np.random.default_rng(2)
    M = rng.normal(size=(240, 12))
    assert L.overfitting(M, 8)["pbo"] > 0.2
    M[:, 3] += 0.6
    assert L.overfitting(M, 8)["pbo"] == 0


def test_regimes_are_causal():
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(m, 0.3, (150, 2)) for m in (0, 6, 12)])[rng.permutation(450)]
    a = L.walk_forward(X, first=200, every=50)
    b = L.walk_forward(np.vstack([X[:350], X[350:] + 9]), first=200, every=50)
    assert (a[:200] == -1).all() and (a[:350] == b[:350]).all() and set(a[200:]) == {0, 1, 2}


def test_normal_tails():
    assert normal.cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    for x in (0.5, 3, 8, 20):
        assert normal.isf(normal.sf(x)) == pytest.approx(x, rel=1e-6)


def test_sharpe_identities():
    assert Q.psr(0.0, 100, 0, 3)[0] == pytest.approx(0.5)
    assert Q.expected_max(1, 0.1) == 0 and Q.expected_max(100, 0.1) > Q.expected_max(10, 0.1)
    n = Q.min_track_record(0.1)
    assert Q.psr(0.1, round(n), 0, 3)[0] == pytest.approx(0.95, abs=0.005)
    assert Q.lo_factor(252, [0.0] * 10) == pytest.approx(math.sqrt(252))
    h = Q.haircut(0.2, 1000, 20)
    assert h["p_adjusted"] == pytest.approx(20 * h["p_single"]) and 0 < h["haircut_sr"] < 0.2
    assert Q.haircut(-0.2, 1000, 20)["haircut_sr"] < 0
    with pytest.raises(ValueError):
        Q.haircut(0.2, 1000, 20, "holm")


def test_synthetic_names():
    a, b = synthetic.survivor(100, 7), synthetic.survivor(100, 7)
    assert a.equals(b)
    many = [synthetic.dead(500, s, terminal=0.1, rally="strong") for s in range(30)]
    assert np.mean([np.log(d.close.iloc[-1] / d.close.iloc[0]) for d in many]) == pytest.approx(np.log(0.1), abs=0.6)
    assert all((d.low > 0).all() and (d.high >= d.low).all() for d in many)
    assert synthetic.n_dead(10, 0.5) == 10 and synthetic.n_dead(5, 0.2) == 1
