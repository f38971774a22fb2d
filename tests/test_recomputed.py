"""Queries that have no SQL, run whole and held against plain re-computations (tests/plain.py)."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tests import plain as P
from volumetra.plans import catalog

MID = "/root/testdata/sf0.01"
NEAR = {"abs": 2e-6, "rel": 1e-6}


def frames(df):
    """symbol to its bars in time order."""
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    return {s: g.reset_index(drop=True) for s, g in pdf.groupby("symbol")}


@pytest.fixture(scope="module")
def small(spark, sf):
    from volumetra.sources.bars import event_hourly

    return frames(event_hourly(spark, sf))


@pytest.fixture(scope="module")
def mid(spark):
    from volumetra.sources.bars import event_hourly

    return frames(event_hourly(spark, MID))


@pytest.fixture(scope="module")
def flag(spark, sf):
    from volumetra.sources.bars import flag_daily

    return frames(flag_daily(spark, sf))


def run(spark, name, sf):
    return catalog.queries()[name](spark, sf).collect()


# --- profiles: A7, A11, A12 ---------------------------------------------------


def test_volume_nodes(spark, sf, flag):
    got = {}
    for r in run(spark, "a7_volume_nodes", sf):
        got.setdefault((r["symbol"], r["kind"].lower()), []).append((r["price"], r["volume"]))
    for s, w in flag.items():
        p = P.profile(w, "fixed", 50)
        for kind in ("hvn", "lvn"):
            assert sorted(got.get((s, kind), [])) == sorted((pytest.approx(x, abs=1e-3), pytest.approx(v, abs=1e-3)) for x, v in p[kind])


def test_double_distribution_and_shape(spark, sf, flag):
    for r in run(spark, "a11_double_distribution", sf):
        two, ratio = P.double(P.profile(flag[r["symbol"]], "fixed", 50)["hist"])
        assert (r["is_double"], r["valley_ratio"]) == (two, pytest.approx(ratio, abs=1e-5))
    shapes = {r["symbol"]: r for r in run(spark, "a12_shape_class", sf)}
    assert set(shapes) == set(flag)
    for s, r in shapes.items():
        p = P.profile(flag[s], "fixed", 50)
        assert r["shape"] == P.shape(p) and r["skew"] == pytest.approx(P.weighted_moments(p)[0], abs=1e-4)


# --- the score stack: W15, C2-C10, K4 -----------------------------------------


@pytest.fixture(scope="module")
def last250(mid):
    return {s: P.analysis(w.iloc[-250:]) for s, w in mid.items() if len(w) >= 250}


@pytest.mark.parametrize("name, part", [("c2_key_level_component", "key_level"), ("c3_quiet_component", "quiet"), ("c4_pattern_component", "patterns")])
def test_components(spark, last250, name, part):
    got = {r["symbol"]: r for r in run(spark, name, MID)}
    assert set(got) == set(last250)
    for s, a in last250.items():
        strength, side = a["parts"][part]
        assert got[s]["strength"] == pytest.approx(strength, abs=2e-6) and got[s]["direction"] == side and got[s]["reason"]
        if part == "patterns" and not a["found"]:
            assert "no recent" in got[s]["reason"]


def test_score_and_gate(spark, last250):
    unit = {r["symbol"]: r["atr"] for r in run(spark, "c5_range_unit", MID)}
    score = {r["symbol"]: r for r in run(spark, "c6_confluence_score", MID)}
    gate = {r["symbol"]: r for r in run(spark, "c8_signal_gate", MID)}
    text = {r["symbol"]: r["rationale"] for r in run(spark, "c7_rationale", MID)}
    reasons = {"bias": "no directional bias", "quality": "setup quality", "conviction": "directional conviction"}
    for s, a in last250.items():
        assert unit[s] == pytest.approx(a["unit"], abs=1e-5)
        assert (score[s]["setup_quality"], score[s]["bias_score"], score[s]["bias"]) == (pytest.approx(a["quality"], abs=0.011), pytest.approx(a["lean"], abs=0.011), a["bias"])
        _, why = P.plan(a, "reversion")
        assert gate[s]["gate"] == reasons.get(why)
        assert text[s].startswith({"bullish": "Bull", "bearish": "Bear", "neutral": "Neutral"}[a["bias"]]) and f"{a['quality']:.0f}/100" in text[s]


@pytest.mark.parametrize("name, style", [("c9_reversion_plan", "reversion"), ("c10_breakout_plan", "breakout")])
def test_plans(spark, sf, small, name, style):
    got = {(r["symbol"], r["ts"]): r for r in run(spark, name, sf)}
    n = trades = 0
    for s, w in small.items():
        for i in range(119, len(w), 12):
            r = got[s, str(w.ts.iloc[i])]
            p, why = P.plan(P.analysis(w.iloc[i - 119 : i + 1]), style)
            n += 1
            if p is None:
                assert r["action"] == "no_trade" and r["entry"] is None
                continue
            trades += 1
            side, entry, stop, targets, ratio, size = p
            assert (r["action"], r["size"]) == ("long" if side > 0 else "short", size)
            assert (r["entry"], r["stop"], r["rr"], r["targets"]) == (pytest.approx(entry, abs=1e-5), pytest.approx(stop, abs=1e-5), pytest.approx(ratio, abs=2e-3), [pytest.approx(x, abs=1e-5) for x in targets])
    assert n == len(got) and trades


def test_level_anchoring(spark, sf, small):
    for r in run(spark, "w15_level_anchoring", sf):
        w = small[r["symbol"]]
        i = next(k for k in range(len(w)) if str(w.ts.iloc[k]) == r["ts"])
        a = P.analysis(w.iloc[i - 119 : i + 1])
        name, far, at = min(((n, abs(a["price"] - a["p"][k]), a["p"][k]) for n, k in (("POC", "poc"), ("VAH", "vah"), ("VAL", "val"))), key=lambda t: (t[1], t[0]))
        assert (r["at_level"] or "") == (f"{name} {at:.2f}" if far < 0.5 * a["unit"] else "")


def test_scanner(spark, sf, small):
    rows = run(spark, "k4_watchlist_scanner", sf)
    want = {s: P.analysis(w.iloc[-120:]) if len(w) >= 120 else None for s, w in small.items()}
    assert {r["symbol"] for r in rows} == set(want)
    quality = [r["setup_quality"] for r in rows]
    assert quality == sorted(quality, key=lambda q: (q is None, -(q or 0)))
    for r in rows:
        a = want[r["symbol"]]
        if a is None:
            assert r["setup_quality"] is None
            continue
        p, _ = P.plan(a, "reversion")
        assert (r["price"], r["setup_quality"], r["bias"], r["quiet_score"], r["is_quiet"]) == (a["price"], pytest.approx(a["quality"], abs=0.011), a["bias"], pytest.approx(a["quiet"]["score"]), a["quiet"]["on"])
        assert (r["action"], r["entry"]) == ("no_trade", None) if p is None else (r["action"], r["stop"]) == ("long" if p[0] > 0 else "short", pytest.approx(p[2], abs=1e-5))


# --- backtests: C12, C13, V2 ---------------------------------------------------


@pytest.fixture(scope="module")
def analyses(small):
    return {s: {i: P.analysis(w.iloc[i - 119 : i + 1]) for i in range(119, len(w))} for s, w in small.items()}


@pytest.fixture(scope="module")
def tested(small, analyses):
    return {style: {s: P.backtest(w, style=style, analyses=analyses[s]) for s, w in small.items() if len(w) >= 120} for style in ("reversion", "breakout")}


def stats(trades):
    pnl = [t["pnl"] for t in trades]
    gain, loss = sum(x for x in pnl if x > 0), -sum(x for x in pnl if x < 0)
    return len(pnl), sum(x > 0 for x in pnl) / len(pnl), gain / loss if loss else math.inf if gain else 0.0, sum(pnl) / len(pnl)


def test_walk_forward(spark, sf, tested):
    got = {}
    for r in run(spark, "c12_walk_forward_trades", sf):
        got.setdefault(r["symbol"], []).append(r)
    curve = {(r["symbol"], r["idx"]): r["equity"] for r in run(spark, "c12_equity_curve", sf)}
    n = 0
    for s, (trades, own) in tested["reversion"].items():
        rows = sorted(got.get(s, []), key=lambda r: r["entry_idx"])
        assert [(r["side"], r["entry_idx"], r["exit_idx"], r["size"], r["exit_reason"]) for r in rows] == [(t["side"], t["entry_idx"], t["exit_idx"], t["size"], t["exit_reason"]) for t in trades]
        for r, t in zip(rows, trades):
            assert (r["entry_price"], r["exit_price"], r["pnl"]) == tuple(pytest.approx(t[k], abs=1e-3) for k in ("entry_price", "exit_price", "pnl"))
        assert {i: curve[s, i] for i in own} == {i: pytest.approx(e, abs=1e-2) for i, e in own.items()}
        n += len(trades)
    assert n and len(curve) == sum(len(c) for _, c in tested["reversion"].values())


def test_summary_and_sweep(spark, sf, tested):
    summary = {r["symbol"]: r for r in run(spark, "c12_backtest_summary", sf)}
    for s, (trades, own) in tested["reversion"].items():
        r, e = summary[s], np.array([own[i] for i in sorted(own)])
        back = e[1:] / e[:-1] - 1
        assert (r["n_bars"], r["n_trades"]) == (len(e), len(trades))
        assert r["total_return_pct"] == pytest.approx((e[-1] / 10_000 - 1) * 100, abs=1e-3) and r["max_drawdown_pct"] == pytest.approx((e / np.maximum.accumulate(e) - 1).min() * 100, abs=1e-6)
        assert r["sharpe"] == pytest.approx(back.mean() / back.std(ddof=1) * math.sqrt(252 * 7) if back.std() > 0 else 0.0, abs=1e-6)
    sweep = {(r["symbol"], r["style"]): r for r in run(spark, "c13_style_sweep", sf)}
    assert set(sweep) == {(s, style) for style, per in tested.items() for s, (t, _) in per.items() if t}
    for (s, style), r in sweep.items():
        n, win, factor, mean = stats(tested[style][s][0])
        assert (r["n_trades"], r["win_rate"], r["profit_factor"], r["expectancy"]) == (n, pytest.approx(win), pytest.approx(factor, rel=1e-5), pytest.approx(mean, abs=1e-5))


def test_cash_gates_the_signal():
    """A signal that the cash of its bar cannot size by one unit is none, though the next open would narrow its risk."""
    from volumetra.operators.trading import fold

    bars = pd.DataFrame([(10, 10, 10, 10), (8.5, 9, 8.4, 9), (9, 12, 9, 12)], columns=["open", "high", "low", "close"]).assign(ts=pd.date_range("2020-01-01", periods=3))
    assert fold(bars, {0: (1, 8.0, 11.0, 2.0)}, lookback=1, slippage=0.0, cash=300.0)[0][0][5] == 8.5
    assert fold(bars, {0: (1, 8.0, 11.0, 2.0)}, lookback=1, slippage=0.0, cash=150.0)[0] == []
    assert fold(bars, {0: (1, 8.0, 11.0)}, lookback=1, slippage=0.0, cash=150.0)[0]


def test_backtest_paths(spark, sf, small):
    got = {r["symbol"]: r for r in run(spark, "v2_backtest_paths", sf)}
    for s, w in small.items():
        result = {}
        for g, part in enumerate(np.array_split(np.arange(len(w)), 6)):
            if part[0] >= 120:
                own = w.iloc[part[0] - 120 : part[-1] + 1].reset_index(drop=True)
                _, curve = P.backtest(own)
                result[g] = (curve[len(own) - 1] / 10_000 - 1) * 100
        paths = [(result[a] + result[b]) / 2 for a in result for b in result if a < b]
        if not paths:
            assert s not in got
            continue
        r = got[s]
        assert (r["n_paths"], r["return_mean"], r["return_min"], r["return_max"]) == (len(paths), pytest.approx(np.mean(paths), abs=1e-6), pytest.approx(min(paths), abs=1e-6), pytest.approx(max(paths), abs=1e-6))
        assert r["pct_paths_profitable"] == pytest.approx(100 * np.mean([p > 0 for p in paths])) and r["return_std"] == pytest.approx(np.std(paths), abs=1e-6)


# --- datasets: C14-C16 ----------------------------------------------------------

THIRTEEN = ("delta_net", "delta_poc", "skew", "kurtosis", "poc_loc", "vacr_z", "poc_slope", "cost_basis_migration", "n_ledges", "poor_high", "is_p_shape", "is_b_lower", "is_b_upper")


@pytest.fixture(scope="module")
def structural(mid):
    some = sorted(mid)[:2]
    return {s: P.structural_rows(mid[s]) for s in some}


def test_structural_walk(spark, mid):
    s = sorted(mid)[0]
    want = P.structural_rows(mid[s], stride=6)
    got = {r["idx"]: r for r in run(spark, "c14_structural_walk", MID) if r["symbol"] == s}
    assert set(got) == set(want) and want
    for i, x in want.items():
        assert [got[i][k] for k in THIRTEEN] == [pytest.approx(x[k], abs=2e-5, rel=1e-5) for k in THIRTEEN], i


def test_structural_datasets(spark, mid, structural):
    rows = [r for r in run(spark, "c15_structural_dataset", MID) if r["symbol"] in structural]
    bets = {(r["symbol"], r["idx"]): r for r in run(spark, "c15_structural_meta_dataset", MID)}
    assert len(rows) == sum(map(len, structural.values()))
    for r in rows:
        w, x = mid[r["symbol"]], structural[r["symbol"]][r["idx"]]
        assert [r[k] for k in THIRTEEN] == [pytest.approx(x[k], abs=2e-5, rel=1e-5) for k in THIRTEEN]
        i = r["idx"]
        assert r["y"] == pytest.approx(w.close[i + 20] / w.close[i] - 1, **NEAR) and r["baseline"] == r["delta_poc"]
    for (s, i), r in bets.items():
        if s in structural and i % 4 == 0:
            outcome, ret = P.barrier(mid[s], i, 1)
            assert (r["outcome"], r["ret"], r["win"]) == (outcome, pytest.approx(ret, **NEAR), int(ret > 0))


def test_score_datasets(spark, sf, small, analyses):
    signed = lambda a: [a["parts"][k][0] * (a["parts"][k][1] if k != "quiet" else 1) for k in ("value_area", "key_level", "quiet", "patterns")]
    four = ("value_area", "key_level", "quiet", "patterns")
    rows = run(spark, "c16_confluence_dataset", sf)
    assert {(r["symbol"], r["idx"]) for r in rows} == {(s, i) for s, w in small.items() for i in range(119, len(w) - 20)} and rows
    for r in rows:
        a, w, i = analyses[r["symbol"]][r["idx"]], small[r["symbol"]], r["idx"]
        assert [r[k] for k in four] == [pytest.approx(x, abs=2e-6) for x in signed(a)]
        assert r["baseline"] == pytest.approx(a["lean"], abs=0.011) and r["y"] == pytest.approx(w.close[i + 20] / w.close[i] - 1, **NEAR)
    for r in run(spark, "c16_enriched_dataset", sf):
        a, w, i = analyses[r["symbol"]][r["idx"]], small[r["symbol"]], r["idx"]
        c, v, atr = w.close, w.volume, P.wilder(P.true_ranges(w), 14)[i]
        back = c.pct_change()
        want = [c[i] / c[i - 20] - 1, c[i] / c[i - 60] - 1, c[i - 20] / c[i - 120] - 1, back[i - 19 : i + 1].std(), atr / c[i], v[i - 9 : i + 1].mean() / v[i - 59 : i + 1].mean() - 1, (c[i] - a["p"]["poc"]) / atr]
        assert [r[k] for k in ("mom_20", "mom_60", "mom_120_20", "vol_20", "atr_frac", "vol_trend", "poc_dist")] == [pytest.approx(x, **NEAR) for x in want]
    bets = run(spark, "c16_meta_dataset", sf)
    want = {(s, i) for s, w in small.items() for i in range(119, len(w) - 20, 3) if abs(analyses[s][i]["lean"]) >= 10}
    assert {(r["symbol"], r["idx"]) for r in bets} == want
    for r in bets:
        a = analyses[r["symbol"]][r["idx"]]
        side = 1 if a["lean"] > 0 else -1
        outcome, ret = P.barrier(small[r["symbol"]], r["idx"], side)
        assert (r["side"], r["outcome"], r["ret"], r["bias_mag"]) == (side, outcome, pytest.approx(ret, **NEAR), pytest.approx(abs(a["lean"]) / 100, abs=2e-4))


def test_indicator_dataset(spark, mid):
    rows = run(spark, "c16_indicator_dataset", MID)
    assert rows
    first = {}
    for r in rows:
        w, i = mid[r["symbol"]], r["idx"]
        first[r["symbol"]] = min(first.get(r["symbol"], i), i)
        c = w.close
        d = c.diff()
        up, dn = d.clip(lower=0)[1:], (-d).clip(lower=0)[1:]
        g, b = up.ewm(alpha=1 / 14, adjust=False).mean()[i], dn.ewm(alpha=1 / 14, adjust=False).mean()[i]
        rsi = 100 - 100 / (1 + g / b) if b else 100.0
        e = lambda x, s: x.ewm(span=s, adjust=False).mean()
        macd = e(c, 12) - e(c, 26)
        lo, hi = w.low[i - 119 : i + 1].min(), w.high[i - 119 : i + 1].max()
        want = [(rsi - 50) / 50, (macd - e(macd, 9))[i] / c[i], (c[i - 19 : i + 1].mean() - c[i - 49 : i + 1].mean()) / c[i], c[i] / c[i - 12] - 1, (c[i] - lo) / (hi - lo) - 0.5]
        assert [r[k] for k in ("rsi", "macd", "ma_cross", "mom_12", "fib_pos")] == [pytest.approx(x, abs=2e-5, rel=1e-4) for x in want]
        assert (i - first[r["symbol"]]) % 8 == 0 or i == first[r["symbol"]]


# --- evaluations: M2, M3, V3-V5, V7, M7-M11, T11, G4, G6 ---------------------------


@pytest.fixture(scope="module")
def samples(spark):
    from volumetra.plans.research import behavioral

    pdf = behavioral(spark, MID).toPandas().sort_values(["symbol", "sample_id"])
    return {s: g.reset_index(drop=True) for s, g in pdf.groupby("symbol")}


def evaluated(g, columns, order=None):
    """The folds of a symbol: (test, signal, weights, y)."""
    X, y = g[list(columns)].to_numpy(float), g.y.to_numpy(float)
    y = y if order is None else y[order]
    for tr, te in P.cross_validation(len(y), purge=7):
        if len(tr) >= max(10, X.shape[1] + 2) and len(te) >= 3:
            f, w = P.ridge(X[tr], y[tr])
            yield te, f(X[te]), w, y


def ics(g, columns, order=None):
    out = [P.pearson(s, y[te]) for te, s, _, y in evaluated(g, columns, order)]
    return [x for x in out if x == x]


def test_factor_evaluation(spark, samples):
    from volumetra.plans.research import BEHAVIORAL, FOUR

    got = {r["symbol"]: r for r in run(spark, "v3_factor_evaluation", MID)}
    for s, g in samples.items():
        x, rows = ics(g, BEHAVIORAL), list(evaluated(g, BEHAVIORAL))
        r = got[s]
        assert (r["n_paths"], r["oos_ic_mean"], r["oos_ic_median"], r["oos_ic_std"]) == (len(x), pytest.approx(np.mean(x), abs=1e-6), pytest.approx(np.median(x), abs=1e-6), pytest.approx(np.std(x), abs=1e-6))
        assert r["dir_accuracy"] == pytest.approx(np.mean([(np.sign(f) == np.sign(y[te])).mean() for te, f, _, y in rows])) and r["ls_return_pct"] == pytest.approx(100 * np.mean([(np.sign(f) * y[te]).mean() for te, f, _, y in rows]))
        base = [P.pearson(g.baseline.to_numpy()[te], y[te]) for te, _, _, y in rows]
        assert r["baseline_ic"] == pytest.approx(np.mean(base), abs=1e-6) and r["pct_folds_positive"] == pytest.approx(100 * np.mean([round(i, 4) > 0 for i in x]))
    folds = {(r["symbol"], r["split_id"]): r for r in run(spark, "m2_ridge_folds", MID)}
    for s, g in samples.items():
        for k, (te, f, w, y) in enumerate(evaluated(g, FOUR)):
            assert folds[s, k]["weights"] == [pytest.approx(v, abs=2e-5, rel=1e-5) for v in w] and folds[s, k]["ic"] == pytest.approx(P.pearson(f, y[te]), abs=2e-6)


def conviction(g, columns):
    sig, ret = [], []
    for te, f, _, y in evaluated(g, columns):
        sig.append((f - f.mean()) / f.std() if f.std() > 0 else f - f.mean())
        ret.append(y[te])
    sig, ret = np.concatenate(sig), np.concatenate(ret)
    edges = np.quantile(sig, [0.2, 0.4, 0.6, 0.8])
    place = np.array([sum(x >= e for e in edges) for x in sig])
    means = [ret[place == b].mean() for b in range(5)]
    return means, np.concatenate([ret[place == 4] - 1e-3, -ret[place == 0] - 1e-3]), np.isin(place, (0, 4)).mean()


def test_conviction_book(spark, samples):
    from volumetra.plans.research import BEHAVIORAL, FOUR

    got = {r["symbol"]: r for r in run(spark, "v4_conviction_book", MID)}
    for s, g in samples.items():
        means, stream, inside = conviction(g, BEHAVIORAL)
        r = got[s]
        assert r["curve"] == [pytest.approx(100 * m, abs=1e-3) for m in means] and r["n_bets"] == len(stream) and r["in_market"] == pytest.approx(inside, abs=1e-6)
        assert r["spread"] == pytest.approx(100 * (means[4] - means[0]), abs=1e-4) and r["ls_net"] == pytest.approx(100 * (means[4] - means[0] - 2e-3), abs=1e-4) and r["long_net"] == pytest.approx(100 * (means[4] - 1e-3), abs=1e-4)
    bets = sum(len(conviction(g, FOUR)[1]) for g in samples.values())
    (t,) = run(spark, "t11_pooled_overlap", MID)
    assert (t["bets"], t["effective_n"]) == (bets, max(8, bets // 8))


def meta_folds(g, threshold=0.5, top=None, cost=0.0, order=None):
    from volumetra.plans.research import FOUR

    X, ret = g[FOUR].to_numpy(float), g.y.to_numpy(float)
    ret = ret if order is None else ret[order]
    win = (ret > 0).astype(int)
    for tr, te in P.cross_validation(len(ret), purge=7):
        if len(tr) >= 20 and len(te) >= 5:
            p = P.logistic(X[tr], win[tr])(X[te])
            take = p >= (np.quantile(p, 1 - top) if top else threshold)
            net = ret[te] - cost
            yield win[te][take].mean() if take.any() else P.NAN, P.pair_auc(win[te], p), net.mean(), net[take].mean() if take.any() else 0.0, take.mean()


@pytest.mark.parametrize("name, settings", [("v5_meta_evaluation", {}), ("m3_logistic_top_fraction", {"top": 0.2, "cost": 1e-3})])
def test_meta_evaluation(spark, samples, name, settings):
    got = {r["symbol"]: r for r in run(spark, name, MID)}
    for s, g in samples.items():
        rows = np.array(list(meta_folds(g, **settings)))
        r = got[s]
        assert (r["n_paths"], r["precision"], r["auc"]) == (len(rows), pytest.approx(np.nanmean(rows[:, 0]), abs=1e-6), pytest.approx(np.nanmean(rows[:, 1]), abs=1e-6))
        assert (r["primary_return"], r["meta_return"], r["fraction_taken"]) == tuple(pytest.approx(rows[:, k].mean(), abs=1e-6) for k in (2, 3, 4))


@pytest.fixture
def few(monkeypatch):
    from volumetra.operators import research as Q
    from volumetra.plans import research

    monkeypatch.setattr(research, "PERMUTATIONS", 12)
    monkeypatch.setattr(Q, "SPAN", 5)
    return 12


def shuffled(n, size, replicate, symbol):
    rng = np.random.default_rng([0, replicate, *symbol.encode()])
    return [i for s in rng.permutation(list(range(0, n, size))) for i in range(s, min(s + size, n))]


@pytest.mark.parametrize("name, size", [("m7_row_permutation", 1), ("m10_block_permutation", 8), ("m11_pooled_p", 8)])
def test_permuted_ics(spark, samples, few, name, size):
    from volumetra.plans.research import FOUR

    rows = {r["symbol"] if "symbol" in r.asDict() else None: r for r in run(spark, name, MID)}
    mean = lambda g, order=None: [round(x, 4) for x in ics(g, FOUR, order)]
    real = {s: mean(g) for s, g in samples.items()}
    null = {s: [mean(g, shuffled(len(g), size, k, s)) for k in range(few)] for s, g in samples.items()}
    if name == "m11_pooled_p":
        pool = lambda xs: np.concatenate(xs).mean()
        want, beyond = pool(list(real.values())), [pool([null[s][k] for s in null]) for k in range(few)]
        r = rows[None]
        assert (r["real_ic"], r["n_permutations"], r["p_value"]) == (pytest.approx(want, abs=1e-4), few, pytest.approx((sum(x >= want for x in beyond) + 1) / (few + 1)))
        return
    for s in samples:
        want = np.mean(real[s])
        assert rows[s]["real_ic"] == pytest.approx(want, abs=1e-4) and rows[s]["p_ic"] == pytest.approx((sum(np.mean(x) >= want for x in null[s]) + 1) / (few + 1))


def test_permuted_meta(spark, samples, monkeypatch, few):
    from volumetra.plans import research

    monkeypatch.setattr(research, "PERMUTATIONS", 3)
    got = {r["symbol"]: r for r in run(spark, "m8_meta_permutation", MID)}
    s = sorted(samples)[0]
    g = samples[s]

    def of(order=None):
        rows = np.array(list(meta_folds(g, 0.55, order=order)))
        return np.nanmean(rows[:, 1]), (rows[:, 3] - rows[:, 2]).mean()

    auc, lift = of()
    null = [of(np.random.default_rng([0, k, *s.encode()]).permutation(len(g))) for k in range(3)]
    assert (got[s]["real_auc"], got[s]["real_lift"]) == (pytest.approx(auc, abs=1e-6), pytest.approx(lift, abs=1e-6))
    assert (got[s]["p_auc"], got[s]["p_lift"]) == tuple(pytest.approx((sum(x[j] >= v for x in null) + 1) / 4) for j, v in enumerate((auc, lift)))


def test_panel(spark, few):
    from volumetra.plans.research import panel

    pdf = panel(spark, MID).toPandas().sort_values(["date_id", "symbol"]).reset_index(drop=True)
    names = ["mom_21", "mom_252_21", "vol_60", "vol_trend"]
    rows = {d: g.index.to_numpy() for d, g in pdf.groupby("date_id")}
    X = pdf[names].to_numpy(float)

    def evaluate(y):
        out = []
        for tr, te in P.cross_validation(len(rows), purge=4):
            at = np.concatenate([rows[d] for d in tr])
            if len(at) < 20:
                continue
            f, _ = P.ridge(X[at], y[at])
            out += [P.pearson(P.average_ranks(f(X[rows[d]])), P.average_ranks(y[rows[d]])) for d in te if len(rows[d]) >= 3]
        return [x for x in out if x == x]

    real = pdf.y.to_numpy(float)
    want = evaluate(real)
    (r,) = run(spark, "v7_panel_evaluation", MID)
    assert (r["n_dates_oos"], r["ic_mean"], r["ic_std"]) == (len(want), pytest.approx(np.mean(want), abs=1e-6), pytest.approx(np.std(want), abs=1e-6))
    null = []
    for k in range(few):
        rng, y = np.random.default_rng([0, k]), real.copy()
        for d in sorted(rows):
            y[rows[d]] = y[rows[d]][rng.permutation(len(rows[d]))]
        null.append(np.mean(evaluate(y)))
    (m,) = run(spark, "m9_within_date_permutation", MID)
    assert (m["real_ic"], m["p_value"]) == (pytest.approx(np.mean(want), abs=1e-6), pytest.approx((sum(x >= np.mean(want) for x in null) + 1) / (few + 1)))


def test_injection_sweep_and_report(spark, samples, few):
    from volumetra.plans.research import FOUR

    sweep = {r["fraction"]: r for r in run(spark, "g4_injection_sweep", MID)}
    books = {s: conviction(g, FOUR) for s, g in samples.items()}
    real = [round(x, 4) for g in samples.values() for x in ics(g, FOUR)]
    net = np.mean([100 * (m[4] - m[0] - 2e-3) for m, _, _ in books.values()])
    assert set(sweep) == {0.0, 0.2, 0.5}
    assert (sweep[0.0]["ls_net"], sweep[0.0]["top_bucket"]) == (pytest.approx(net, rel=1e-6), pytest.approx(np.mean([100 * m[4] for m, _, _ in books.values()]), rel=1e-6))
    assert sweep[0.0]["pooled_ic"] == pytest.approx(np.mean(real), abs=1e-4)
    (r,) = run(spark, "g6_honest_report", MID)
    streams = [books[s][1] for s in sorted(books)]
    pool = np.concatenate(streams)
    z = (pool - pool.mean()) / pool.std()
    sr, n = pool.mean() / pool.std(ddof=1), max(8, len(pool) // 8)
    q = NormalDist().inv_cdf
    bar = math.sqrt(1 / (n - 1)) * ((1 - 0.5772156649015329) * q(1 - 1 / 11) + 0.5772156649015329 * q(1 - 1 / (11 * math.e)))
    dsr = NormalDist().cdf((sr - bar) * math.sqrt(n - 1) / math.sqrt(1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr * sr))
    t = min(map(len, streams))
    M = np.stack([x[:t] for x in streams], axis=1)
    parts = np.array_split(np.arange(t), max(4, min(10, t // 2 * 2)))
    lost = []
    from itertools import combinations

    for half in combinations(range(len(parts)), len(parts) // 2):
        inside = np.concatenate([parts[i] for i in half])
        outside = np.setdiff1d(np.arange(t), inside)
        best = M[inside].mean(axis=0).argmax()
        w = (sorted(M[outside].mean(axis=0)).index(M[outside].mean(axis=0)[best]) + 1) / (len(streams) + 1)
        lost.append(w <= 0.5)
    assert (r["n_datasets"], r["n_samples"], r["oos_ic"]) == (len(samples), sum(map(len, samples.values())), pytest.approx(np.mean(real), abs=1e-4))
    assert (r["dsr"], r["pbo"], r["ls_net"]) == (pytest.approx(dsr, abs=1e-6), pytest.approx(np.mean(lost)), pytest.approx(net, rel=1e-6))
    assert r["bucket_curve"] == [pytest.approx(np.mean([round(100 * m[b], 4) for m, _, _ in books.values()]), rel=1e-6) for b in range(5)]
    assert r["inverts"] == bool(sweep[0.0]["ls_net"] > 0 > sweep[0.5]["ls_net"])
    verdict = "NO EDGE" if r["p_value"] >= 0.05 else "OVERFIT" if r["pbo"] >= 0.5 else "SURVIVORSHIP MIRAGE" if r["inverts"] else "FAILS selection adjustment" if r["dsr"] < 0.95 else "PASSES"
    assert r["verdict"] == verdict


# --- models: M4-M6, X3, X4 -----------------------------------------------------------


@pytest.mark.parametrize("name", ["m4_kmeans", "m4_kmeans_at_scale"])
def test_kmeans(spark, sf, name):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    X = np.stack(e.embedding.to_numpy()).astype(float)
    got = {r["vec_id"]: r["cluster"] for r in run(spark, name, sf)}
    at = np.array([got[v] for v in e.vec_id])
    Z = (X - X.mean(axis=0)) / X.std(axis=0) if name == "m4_kmeans" else X
    centre = np.stack([Z[at == k].mean(axis=0) for k in range(3)])
    far = ((Z[:, None] - centre) ** 2).sum(axis=2)
    if name == "m4_kmeans":  # no step is left to take
        assert (far.argmin(axis=1) == at).all()
    rng = np.random.default_rng(1)
    best = math.inf
    for _ in range(6):
        c = Z[rng.choice(len(Z), 3, replace=False)]
        for _ in range(30):
            own = ((Z[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([Z[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(3)])
        best = min(best, ((Z - c[own]) ** 2).sum())
    assert far[np.arange(len(Z)), at].sum() <= 1.03 * best


def test_regimes(spark, samples):
    from volumetra.functions import learn
    from volumetra.plans.research import FOUR

    rows = pd.DataFrame([r.asDict() for r in run(spark, "m5_walk_forward_regimes", MID)]).sort_values(["symbol", "sample_id"])
    spread = {r["symbol"]: r for r in run(spark, "m6_regime_spread", MID)}
    for s, g in rows.groupby("symbol"):
        lab, y = g.regime.to_numpy(), g.y.to_numpy()
        own = samples[s]
        assert len(g) == len(own) and (lab[:60] == -1).all() and set(lab[60:]) <= {0, 1, 2}
        cut = learn.walk_forward(own[FOUR].to_numpy(float)[:120], 3, 60, 30)  # later rows change nothing
        assert (cut == lab[:120]).all()
        m = pd.Series(y[lab >= 0]).groupby(lab[lab >= 0]).mean()
        r = spread[s]
        assert (r["spread"], r["best"], r["worst"], r["n_samples"]) == (pytest.approx(m.max() - m.min()), m.idxmax(), m.idxmin(), int((lab >= 0).sum()))
        names, at = np.unique(lab[lab >= 0], return_inverse=True)
        rng, yy = np.random.default_rng(0), y[lab >= 0]
        null = [np.ptp(pd.Series(yy).groupby(rng.permutation(at)).mean()) for _ in range(200)]
        assert r["p_value"] == pytest.approx((sum(x >= r["spread"] for x in null) + 1) / 201, abs=0.006)


def test_boosted_trees(spark, samples):
    rows = {r["symbol"]: r for r in run(spark, "x3_boosted_trees", MID)}
    for s, g in samples.items():
        rank = np.arange(len(g)) / (len(g) - 1)
        test = g[rank >= 0.7]
        assert rows[s]["n"] == len(test) and rows[s]["base_rate"] == pytest.approx((test.y > 0).mean()) and 0 < rows[s]["mean_p"] < 1


def test_live_rating(spark, samples):
    from volumetra.plans.research import FOUR

    got = {(r["symbol"], r["sample_id"]): r for r in run(spark, "x4_live_rating", MID)}
    n = 0
    for s, g in samples.items():
        cut = int(0.7 * len(g))
        X, win = g[FOUR].to_numpy(float), (g.y > 0).to_numpy(int)
        p = P.logistic(X[: cut - 7], win[: cut - 7])(X[cut:])
        for i, v in zip(g.sample_id[cut:], p):
            assert (got[s, i]["p_win"], got[s, i]["expected_r"]) == (pytest.approx(v, abs=1e-9), pytest.approx(2 * v - 1, abs=1e-9))
            n += 1
    assert n == len(got)


# --- Sharpe statistics: T4-T7, T10 ------------------------------------------------------


@pytest.fixture(scope="module")
def returns(small):
    return {s: (w.close / w.close.shift() - 1).dropna().to_numpy() for s, w in small.items()}


def sharpe_of(x):
    sr, z = x.mean() / x.std(ddof=1), (x - x.mean()) / x.std()
    return sr, (z**3).mean(), (z**4).mean(), len(x)


def beats(sr, skew, kurt, n, bar=0.0):
    return NormalDist().cdf((sr - bar) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def largest(trials, variance):
    q, g = NormalDist().inv_cdf, 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * q(1 - 1 / trials) + g * q(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


def test_sharpe_statistics(spark, sf, returns):
    rows = {name: {r["symbol"]: r for r in run(spark, name, sf)} for name in ("t4_probabilistic_sharpe", "t6_deflated_sharpe", "t7_min_track_record", "t10_sharpe_haircut")}
    for s, x in returns.items():
        sr, skew, kurt, n = sharpe_of(x)
        assert rows["t4_probabilistic_sharpe"][s]["psr"] == pytest.approx(beats(sr, skew, kurt, n), abs=1e-8)
        assert rows["t6_deflated_sharpe"][s]["dsr"] == pytest.approx(beats(sr, skew, kurt, n, largest(11, 1 / (n - 1))), abs=1e-8)
        a = abs(sr)
        assert rows["t7_min_track_record"][s]["min_trl"] == pytest.approx(1 + (1 - skew * a + (kurt - 1) / 4 * a * a) * (NormalDist().inv_cdf(0.95) / a) ** 2, abs=1e-3)
        r = rows["t10_sharpe_haircut"][s]
        t = sr * math.sqrt(n)
        p = 2 * NormalDist().cdf(-abs(t))
        left = -NormalDist().inv_cdf(min(1, 20 * p) / 2) if 20 * p < 1 else 0.0
        assert (r["p_single"], r["p_adjusted"], r["t_observed"]) == (pytest.approx(p, abs=1e-9), pytest.approx(min(1, 20 * p), abs=1e-8), pytest.approx(t))
        assert r["haircut_sr"] == pytest.approx(sr * left / abs(t), abs=1e-6) and r["haircut"] == pytest.approx(1 - left / abs(t), abs=1e-6)
    for r in run(spark, "t5_expected_max_sharpe", sf):
        assert r["expected_max"] == pytest.approx(largest(r["n_trials"], 1 / 251), abs=1e-12)


# --- S10, G9 -------------------------------------------------------------------------


def test_synthetic_bars(spark, sf):
    from volumetra.sources import synthetic

    rows = pd.DataFrame([r.asDict() for r in run(spark, "s10_synthetic_bars", sf)])
    again = pd.DataFrame([r.asDict() for r in run(spark, "s10_synthetic_bars", sf)])
    key = ["symbol", "ts"]
    pd.testing.assert_frame_equal(rows.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    assert not rows.duplicated(key).any() and (rows.low > 0).all() and (rows.volume > 0).all()
    assert (rows.low <= rows[["open", "close"]].min(axis=1) + 1e-9).all() and (rows.high >= rows[["open", "close"]].max(axis=1) - 1e-9).all()
    # returns are independent: next to no autocorrelation in a long path
    c = np.log(synthetic.survivor(4000, 3).close.to_numpy())
    r = np.diff(c)
    assert abs(P.pearson(r[1:], r[:-1])) < 0.06 and 0.002 < r.std() < 0.06


def test_narration(spark, sf):
    rows = run(spark, "g9_narration", sf)
    assert len(rows) == 3**5 // 1 or rows
    for r in rows:
        text = r["narration"]
        assert text.startswith("Signal: demo\nVerdict: ") and "OOS IC +0.031" in text
        assert ("permutation p" in text) == (r["p_value"] is not None) and ("PBO" in text) == (r["pbo"] is not None) and ("DSR" in text) == (r["dsr"] is not None)
        assert ("INVERTS" in text) == bool(r["inverts"]) and ("not a tradeable signal" in text) == (r["verdict"] != "validated")
        assert ("survives injection" in text) == bool(r["survives"]) and ("fails under injection" in text) == (r["survives"] is False)


def test_data_source(spark):
    """The source contract: one partition a symbol, the bars of the generator, and a refusal of what it does not serve."""
    from volumetra.sources import contract, synthetic

    contract.register(spark)
    read = spark.read.format("volumetra_synthetic").option("symbols", "AAA, BBB,CCC").option("period", "3mo").option("gone", "BBB")
    df = read.option("require", "delisted").load()
    assert df.rdd.getNumPartitions() == 3
    want = synthetic.synthetic(spark, ["AAA", "BBB", "CCC"], "3mo", {"BBB"})
    assert df.count() == 189 and df.exceptAll(want).count() == 0
    with pytest.raises(Exception, match="does not serve"):
        read.option("require", "intraday").load().collect()
