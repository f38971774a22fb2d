"""Registered queries do the operators' whole work."""

import pytest

from volumetra.operators import research as Q
from volumetra.plans import catalog, research


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, operator", [("m7_row_permutation", "permuted_ic"), ("m8_meta_permutation", "permuted_meta"), ("m9_within_date_permutation", "panel_evaluation"), ("m10_block_permutation", "permuted_ic"), ("m11_pooled_p", "permuted_ic"), ("g6_honest_report", "honest_report")])
def test_replicates_are_the_references(monkeypatch, name, operator):
    def spy(*args, **kw):
        raise Seen(kw.get("n", kw.get("perms", args[3] if len(args) > 3 else None)))

    class Rungs:
        def orderBy(self, *_):
            return self

        def collect(self):
            return []

    for f in ("behavioral", "meta_data", "panel", "injection_sweep"):
        monkeypatch.setattr(research, f, lambda *_: Rungs())
    monkeypatch.setattr(Q, operator, spy)
    with pytest.raises(Seen) as seen:
        catalog.queries()[name](None, None)
    assert seen.value.args == (200,)


def test_kmeans_reads_every_dimension(spark, monkeypatch):
    from volumetra.sources import bars as B

    rows = [(i, [0.0] * 8 + [float(10 * (i % 3)) + 0.01 * i] * 56) for i in range(30)]  # only later dimensions tell the groups apart
    monkeypatch.setattr(B, "table", lambda *_: spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r["vec_id"]: r["cluster"] for r in catalog.queries()["m4_kmeans"](spark, None).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(30))


@pytest.mark.parametrize("name", ["c12_walk_forward_trades", "c12_equity_curve", "c12_backtest_summary", "c13_style_sweep", "v2_backtest_paths"])
def test_signals_on_every_bar(spark, sf, monkeypatch, name):
    from volumetra.operators import trading

    strides, real, back = [], trading.candidate_signals, trading.backtest

    def signals(bars, lookback=120, stride=1, *args, **kw):
        strides.append(stride)
        return real(bars, lookback, stride, *args, **kw)

    def backtest(*args, **kw):
        strides.append(kw.get("stride", 1))
        return back(*args, **kw)

    monkeypatch.setattr(trading, "candidate_signals", signals)
    monkeypatch.setattr(trading, "backtest", backtest)
    catalog.queries()[name](spark, sf)
    assert strides and set(strides) == {1}


@pytest.mark.parametrize("name", ["c15_structural_dataset", "c15_structural_meta_dataset", "c16_confluence_dataset", "c16_enriched_dataset", "c16_meta_dataset", "c16_indicator_dataset"])
def test_datasets_keep_their_strides(name):
    import inspect

    assert "stride" not in inspect.getclosurevars(catalog.queries()[name]).nonlocals["settings"]
