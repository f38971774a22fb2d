"""Cross-validation, evaluation, resampling, overfitting statistics and verdicts as plans.

A dataset is a table (symbol, sample_id, features, y, baseline). Evaluations group
by symbol; resampling groups by (replicate, symbol), so replicates run in parallel
and only their few numbers are brought together.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions import learn, normal

DSR_BAR, PBO_BAR, SIGNIFICANT = 0.95, 0.5, 0.05


def purge_of(horizon: int, stride: int) -> int:
    return math.ceil(horizon / stride)


def split_relation(samples: DataFrame, groups: int = 6, test: int = 2, purge: int = 0, embargo: float = 0.0) -> DataFrame:
    """(split_id, symbol, sample_id, role): train or test; purged and embargoed samples are left out.

    Groups are `ntile`; a sample is tested against the bounds of a split's groups, arrays of a few numbers, so there is no range join.
    """
    spark = samples.sparkSession
    w = W.partitionBy("symbol")
    s = samples.select("symbol", "sample_id").withColumn("g", F.ntile(groups).over(w.orderBy("sample_id")) - 1).withColumn("n", F.count("*").over(w))
    bounds = s.groupBy("symbol", "g").agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("z"))
    chosen = spark.createDataFrame([(i, g) for i, c in enumerate(combinations(range(groups), test)) for g in c], "split_id int, g int")
    held = bounds.join(F.broadcast(chosen), "g").groupBy("symbol", "split_id").agg(F.collect_list(F.struct("g", "a", "z")).alias("held"))
    j = s.join(held, "symbol")
    after = F.ceil(F.lit(embargo) * F.col("n"))
    p = F.col("sample_id")
    inside = F.exists("held", lambda x: x["g"] == F.col("g"))
    dropped = F.exists("held", lambda x: ((x["a"] > p) & (x["a"] - purge <= p)) | ((x["z"] < p) & (x["z"] + after >= p)))
    role = F.when(inside, "test").when(~dropped, "train")
    return j.select("split_id", "symbol", "sample_id", role.alias("role")).filter("role is not null")


def _arrays(pdf: pd.DataFrame, features):
    pdf = pdf.sort_values("sample_id")
    return pdf[list(features)].to_numpy(float), pdf["y"].to_numpy(float), pdf["baseline"].to_numpy(float)


def _cv(n: int, purge: int, groups: int = 6, test: int = 2):
    return list(learn.splits(n, groups, test, purge, 0.01))


FOLD = "symbol string, split_id int, ic double, accuracy double, ls double, baseline double, weights array<double>"


def fold_evaluation(data: DataFrame, features, purge: int, alpha: float = 1.0, groups: int = 6, test: int = 2) -> DataFrame:
    """V3: one row a fold that is large enough."""

    def run(pdf):
        X, y, b = _arrays(pdf, features)
        rows = learn.factor_eval(X, y, b, _cv(len(y), purge, groups, test), alpha) if len(y) >= groups else []
        return pd.DataFrame([(pdf["symbol"].iloc[0], i, r["ic"], r["accuracy"], r["ls"], r["baseline"], r["weights"]) for i, r in enumerate(rows)], columns=["symbol", "split_id", "ic", "accuracy", "ls", "baseline", "weights"])

    return data.groupBy("symbol").applyInPandas(run, FOLD)


def factor_summary(folds: DataFrame, group=("symbol",)) -> DataFrame:
    """IC figures; single ICs are rounded to four places first, as they are reported."""
    f = folds.withColumn("ic4", F.bround("ic", 4))
    return f.groupBy(*group).agg(F.avg("ic").alias("oos_ic_mean"), F.expr("percentile(ic, 0.5)").alias("oos_ic_median"), F.stddev_pop("ic").alias("oos_ic_std"), (F.avg(F.when(F.col("ic4") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_folds_positive"), F.avg("accuracy").alias("dir_accuracy"), (F.avg("ls") * 100).alias("ls_return_pct"), F.avg(F.nanvl("baseline", F.lit(None))).alias("baseline_ic"), F.count("*").alias("n_paths"))


BOOK = "symbol string, curve array<double>, top double, bottom double, spread double, ls_net double, long_net double, rank_corr double, in_market double, always_on double, stream array<double>"


def book(data: DataFrame, features, purge: int, alpha: float = 1.0, n_buckets: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """V4: the conviction book of each symbol, with the per-bet stream of its tails."""
    names = [x.split()[0] for x in BOOK.split(", ")]

    def run(pdf):
        X, y, _ = _arrays(pdf, features)
        r = learn.buckets(X, y, _cv(len(y), purge), alpha, n_buckets, cost_bps) if len(y) >= 6 else None
        return pd.DataFrame([[pdf["symbol"].iloc[0], *(r[k] for k in names[1:])]] if r else [], columns=names)

    return data.groupBy("symbol").applyInPandas(run, BOOK)


#: Replicates that one task runs over one copy of a symbol's rows.
SPAN = 25


def spans(data: DataFrame, n: int) -> DataFrame:
    """data once for every SPAN of the replicates -1 (the real one) to n - 1; span is the first of them."""
    r = data.sparkSession.range(-1, n, SPAN).select(F.col("id").cast("int").alias("span"))
    return data.crossJoin(F.broadcast(r))


def permuted_ic(data: DataFrame, features, purge: int, n: int, seed: int = 0, alpha: float = 1.0, block: int | None = None) -> DataFrame:
    """(replicate, symbol, ic, n): mean and number of fold ICs with targets shuffled by row or by block. The seed is the replicate's and the symbol's."""

    def run(key, pdf):
        first, symbol = key
        X, real, _ = _arrays(pdf, features)
        names = range(first, min(first + SPAN, n))
        if len(real) < 6 or not names:
            return pd.DataFrame([], columns=["replicate", "symbol", "ic", "n"])
        order = lambda k: learn.block_order(len(real), block or 1, np.random.default_rng([seed, k, *str(symbol).encode()]))
        Y = np.stack([real if k < 0 else real[order(k)] for k in names], axis=1)
        ics = np.round(learn.fold_ics(X, Y, _cv(len(real), purge), alpha), 4)
        whole = [c[np.isfinite(c)] for c in ics.T]
        return pd.DataFrame([(k, symbol, float(c.mean()) if len(c) else None, len(c)) for k, c in zip(names, whole)], columns=["replicate", "symbol", "ic", "n"])

    return spans(data, n).groupBy("span", "symbol").applyInPandas(run, "replicate int, symbol string, ic double, n int")


def pooled_p(ics: DataFrame) -> DataFrame:
    """Real and null IC pooled over folds of all symbols, replicate by replicate, and p = (k + 1) / (n + 1)."""
    pool = ics.filter("n > 0").groupBy("replicate").agg((F.sum(F.col("ic") * F.col("n")) / F.sum("n")).alias("ic"))
    real = pool.filter("replicate = -1").select(F.col("ic").alias("real_ic"))
    null = pool.filter("replicate >= 0").crossJoin(F.broadcast(real))
    return null.agg(F.first("real_ic").alias("real_ic"), F.avg("ic").alias("null_mean"), ((F.count_if(F.col("ic") >= F.col("real_ic")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n_permutations"))


META = "symbol string, split_id int, precision double, auc double, primary double, meta double, fraction double"


def meta_evaluation(data: DataFrame, features, purge: int, threshold: float = 0.5, l2: float = 1.0, cost_bps: float = 0.0, top: float | None = None, key: str = "symbol") -> DataFrame:
    """V5: one row a fold of the meta-model (columns win, ret)."""

    def run(pdf):
        pdf = pdf.sort_values("sample_id")
        X, y, r = pdf[list(features)].to_numpy(float), pdf["win"].to_numpy(int), pdf["ret"].to_numpy(float)
        rows = learn.meta_eval(X, y, r, _cv(len(y), purge), threshold, l2, cost_bps, top) if len(y) >= 6 else []
        return pd.DataFrame([(pdf[key].iloc[0], i, *(x[k] for k in ("precision", "auc", "primary", "meta", "fraction"))) for i, x in enumerate(rows)], columns=["symbol", "split_id", "precision", "auc", "primary", "meta", "fraction"])

    return data.groupBy(key).applyInPandas(run, META)


def meta_summary(folds: DataFrame) -> DataFrame:
    better = F.col("meta") - F.col("primary")
    value = lambda c: F.avg(F.nanvl(c, F.lit(None).cast("double")))
    return folds.groupBy("symbol").agg(F.count("*").alias("n_paths"), value("precision").alias("precision"), value("auc").alias("auc"), F.avg("primary").alias("primary_return"), F.avg("meta").alias("meta_return"), F.avg(better).alias("improvement"), (F.avg(F.when(better > 0, 1.0).otherwise(0.0)) * 100).alias("pct_folds_better"), F.avg("fraction").alias("fraction_taken"))


def permuted_meta(data: DataFrame, features, purge: int, n: int, seed: int = 0, threshold: float = 0.55) -> DataFrame:
    """M8: (replicate, symbol, auc, lift) with labels and returns shuffled together against the features."""

    def run(key, pdf):
        first, symbol = key
        pdf = pdf.sort_values("sample_id")
        X, wins, rets = pdf[list(features)].to_numpy(float), pdf["win"].to_numpy(int), pdf["ret"].to_numpy(float)
        names = range(first, min(first + SPAN, n))
        if len(wins) < 6 or not names:
            return pd.DataFrame([], columns=["replicate", "symbol", "auc", "lift"])
        order = lambda k: np.random.default_rng([seed, k, *str(symbol).encode()]).permutation(len(wins))
        at = np.stack([np.arange(len(wins)) if k < 0 else order(k) for k in names], axis=1)
        out = []
        for k, rows in zip(names, learn.meta_eval_many(X, wins[at], rets[at], _cv(len(wins), purge), threshold)):
            lift = float(np.mean([x["meta"] - x["primary"] for x in rows])) if rows else None
            out.append((k, symbol, learn.mean_of(rows, "auc") if rows else None, lift))
        return pd.DataFrame(out, columns=["replicate", "symbol", "auc", "lift"])

    return spans(data, n).groupBy("span", "symbol").applyInPandas(run, "replicate int, symbol string, auc double, lift double")


def p_by_symbol(null: DataFrame, columns: list[str]) -> DataFrame:
    """p = (k + 1) / (n + 1) of each column against its replicates."""
    real = null.filter("replicate = -1").select("symbol", *[F.col(c).alias(f"real_{c}") for c in columns])
    j = null.filter("replicate >= 0").join(real, "symbol")
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return j.groupBy("symbol").agg(*[x for c in columns for x in (F.first(f"real_{c}").alias(f"real_{c}"), ((F.count_if(ok(c) & (F.col(c) >= F.col(f"real_{c}"))) + 1) / (F.count_if(ok(c)) + 1)).alias(f"p_{c}"))])


PANEL = ("rank_mom_21", "rank_mom_252_21", "rank_vol_60", "rank_vol_trend")
PANEL_OUT = "replicate int, split_id int, date_id int, ic double"


def panel_evaluation(panel: DataFrame, features=("mom_21", "mom_252_21", "vol_60", "vol_trend"), purge: int = 4, n: int = 0, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """V7, M9: rank IC of each test date, for the real panel (replicate -1) and n copies with returns shuffled within dates.

    A task holds the panel once for a span of replicates: rebalancing dates by names, a bounded table.
    """

    def run(key, pdf):
        pdf = pdf.sort_values(["date_id", "symbol"])
        X, real, d = pdf[list(features)].to_numpy(float), pdf["y"].to_numpy(float), pdf["date_id"].to_numpy(int)
        rows = {k: np.flatnonzero(d == k) for k in np.unique(d)}
        cv = [(np.flatnonzero(np.isin(d, tr)), te) for tr, te in (_cv(len(rows), purge) if len(rows) >= 6 else ())]
        out = []
        for replicate in range(key[0], min(key[0] + SPAN, n)):
            y = real.copy()
            if replicate >= 0:
                rng = np.random.default_rng([seed, replicate])
                for g in rows.values():
                    y[g] = y[g][rng.permutation(len(g))]
            for i, (r, te) in enumerate(cv):
                if len(r) < max(20, X.shape[1] + 2):
                    continue
                m = learn.Ridge(alpha).fit(X[r], y[r])
                for k in te:
                    ic = learn.spearman(m.signal(X[rows[k]]), y[rows[k]]) if len(rows[k]) >= 3 else math.nan
                    if math.isfinite(ic):
                        out.append((replicate, i, int(k), ic))
        return pd.DataFrame(out, columns=["replicate", "split_id", "date_id", "ic"])

    return spans(panel, n).groupBy("span").applyInPandas(run, PANEL_OUT)


def regimes(data: DataFrame, features, k: int = 3, first: int = 200, every: int = 60, seed: int = 0) -> DataFrame:
    """M5: walk-forward cluster labels of every sample."""
    schema = "symbol string, sample_id long, regime int, y double"

    def run(pdf):
        pdf = pdf.sort_values("sample_id")
        lab = learn.walk_forward(pdf[list(features)].to_numpy(float), k, first, every, seed)
        return pd.DataFrame({"symbol": pdf["symbol"], "sample_id": pdf["sample_id"], "regime": lab, "y": pdf["y"]})

    return data.withColumn("sample_id", F.col("sample_id").cast("long")).groupBy("symbol").applyInPandas(run, schema)


def regime_spread(labels: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """M6: best minus worst regime's mean return, and its p under shuffled labels."""
    schema = "symbol string, spread double, best int, worst int, null_mean double, p_value double, n_samples int"

    def run(pdf):
        pdf = pdf[(pdf.regime >= 0) & pdf.y.notna()].sort_values("sample_id")
        if len(pdf) < 4:
            return pd.DataFrame([], columns=[x.split()[0] for x in schema.split(", ")])
        r, y = pdf.regime.to_numpy(), pdf.y.to_numpy(float)
        names, at = np.unique(r, return_inverse=True)
        size = np.bincount(at)
        means = lambda a: np.bincount(a, y, len(names)) / size
        real = means(at)
        rng = np.random.default_rng(seed)
        null = np.array([np.ptp(means(rng.permutation(at))) for _ in range(n)])
        return pd.DataFrame([(pdf.symbol.iloc[0], float(np.ptp(real)), int(names[real.argmax()]), int(names[real.argmin()]), float(null.mean()), learn.p_value(null, float(np.ptp(real))), len(y))], columns=[x.split()[0] for x in schema.split(", ")])

    return labels.groupBy("symbol").applyInPandas(run, schema)


def orthogonal(data: DataFrame, feature: str, a: str, b: str) -> DataFrame:
    """Feature without what a and b explain of it (least squares with intercept, per symbol), from one aggregate of moments."""
    m = data.groupBy("symbol").agg(*[F.avg(c).alias(f"m_{k}") for k, c in (("f", feature), ("a", a), ("b", b))], F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, feature).alias("af"), F.covar_pop(b, feature).alias("bf"))
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    m = m.withColumn("wa", (F.col("af") * F.col("bb") - F.col("bf") * F.col("ab")) / det).withColumn("wb", (F.col("bf") * F.col("aa") - F.col("af") * F.col("ab")) / det)
    j = data.join(m, "symbol")
    rest = (F.col(feature) - F.col("m_f")) - F.coalesce("wa", F.lit(0.0)) * (F.col(a) - F.col("m_a")) - F.coalesce("wb", F.lit(0.0)) * (F.col(b) - F.col("m_b"))
    return j.withColumn("residual", rest).select(*data.columns, "residual")


# --- Sharpe statistics ------------------------------------------------------


def sharpe_moments(returns: DataFrame, column: str, group: list[str]) -> DataFrame:
    """n, sr, skew, Pearson kurtosis of finite returns; null Sharpe for fewer than two or constant ones."""
    x = F.when(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
    g = returns.withColumn("_x", x).groupBy(*group).agg(F.count("_x").alias("n"), F.avg("_x").alias("m"), F.stddev_samp("_x").alias("sd"), F.skewness("_x").alias("sk"), F.kurtosis("_x").alias("ku"))
    sd = F.nullif("sd", F.lit(0.0))
    return g.select(*group, "n", (F.col("m") / sd).alias("sr"), F.coalesce("sk", F.lit(0.0)).alias("skew"), (F.coalesce("ku", F.lit(0.0)) + 3).alias("kurt"))


def psr(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> tuple[float, float]:
    """(probability that the true Sharpe beats the benchmark, statistic)."""
    if n < 2:
        raise ValueError("two returns at least")
    stat = (sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12))
    return normal.cdf(stat), stat


def expected_max(trials: int, variance: float) -> float:
    """Expected largest of so many Sharpe ratios that are all zero."""
    if trials < 1 or variance < 0:
        raise ValueError("at least one trial, and a variance")
    if trials == 1 or variance == 0:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * normal.ppf(1 - 1 / trials) + g * normal.ppf(1 - 1 / (trials * math.e)))


def dsr(sr: float, n: int, skew: float, kurt: float, trials: int, variance: float | None = None) -> float:
    return psr(sr, n, skew, kurt, expected_max(trials, 1 / max(n - 1, 1) if variance is None else variance))[0]


def min_track_record(sr: float, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0, prob: float = 0.95) -> float:
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if sr <= benchmark or var <= 0:
        return math.inf
    return 1 + var * (normal.ppf(prob) / (sr - benchmark)) ** 2


def lo_factor(q: int, rho: list[float]) -> float:
    """Annualisation of a Sharpe under autocorrelations rho_1, rho_2, ..."""
    var = q + 2 * sum((q - k) * r for k, r in enumerate(rho[: q - 1], 1))
    return q / math.sqrt(var) if var > 0 else math.sqrt(q)


def adjust_p(p: DataFrame, column: str = "p", group: list[str] | None = None) -> DataFrame:
    """Bonferroni, holm, bh, by of every p among its group; ties are adjusted alike."""
    group = group or []
    base = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    m = F.count("*").over(base)
    up = base.orderBy(column, "id")
    q = p.withColumn("_m", m).withColumn("_r", F.row_number().over(up))
    holm = F.least(F.lit(1.0), F.col(column) * (F.col("_m") - F.col("_r") + 1))
    bh = F.least(F.lit(1.0), F.col(column) * F.col("_m") / F.col("_r"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda s, x: s + 1.0 / x)
    by = F.least(F.lit(1.0), F.col(column) * F.col("_m") / F.col("_r") * harmonic)
    q = q.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(column) * F.col("_m")), "_h": holm, "_bh": bh, "_by": by})
    rising, falling = up.rowsBetween(W.unboundedPreceding, 0), up.rowsBetween(0, W.unboundedFollowing)
    return q.withColumns({"holm": F.max("_h").over(rising), "bh": F.min("_bh").over(falling), "by": F.min("_by").over(falling)}).drop("_m", "_r", "_h", "_bh", "_by")


def haircut(sr: float, n_obs: int, n_tests: int, method: str = "bonferroni", others: list[float] | None = None, annualization: float = 1.0) -> dict:
    """The Sharpe that is left once its p-value is adjusted for the number of tests."""
    if n_obs < 2 or n_tests < 1 or annualization < 1:
        raise ValueError("two observations, one test, annualization of at least 1")
    t = sr / math.sqrt(annualization) * math.sqrt(n_obs)
    p = 2 * normal.sf(abs(t))
    if method == "bonferroni":
        adjusted = min(1.0, p * n_tests)
    else:
        if others is None:
            raise ValueError("this method needs the other p-values")
        pool = np.array([p, *others])
        order, m = np.argsort(pool, kind="stable"), len(pool)
        k = np.arange(1, m + 1)
        if method == "holm":
            adj = np.maximum.accumulate(np.minimum(1, pool[order] * (m - k + 1)))
        else:
            scale = m / k * (float((1 / k).sum()) if method == "by" else 1.0)
            adj = np.minimum.accumulate(np.minimum(1, pool[order] * scale)[::-1])[::-1]
        adjusted = float(adj[list(order).index(0)])
    left = max(0.0, normal.isf(adjusted / 2)) if adjusted < 1 else 0.0
    share = left / abs(t) if t else 0.0
    return {"p_single": p, "p_adjusted": adjusted, "t_observed": t, "t_adjusted": left, "haircut_sr": sr * share, "haircut": max(0.0, 1 - share)}


# --- verdicts ---------------------------------------------------------------


def harness_verdict(p: Column, pbo: Column, inverts: Column, dsr_value: Column) -> Column:
    """Significance first, then overfitting, inversion, selection."""
    no = F.lit(False)
    return (
        F.when(~F.coalesce(p < SIGNIFICANT, no), "NO EDGE")
        .when(F.coalesce(pbo >= PBO_BAR, no), "OVERFIT")
        .when(F.coalesce(inverts, no), "SURVIVORSHIP MIRAGE")
        .when(~F.coalesce(dsr_value >= DSR_BAR, no), "FAILS selection adjustment")
        .otherwise("PASSES")
    )


def evidence_verdict(e: DataFrame) -> DataFrame:
    """Overfitting first, then the null, survivorship, and the selection-adjusted bar."""
    no = F.lit(False)
    sig = F.coalesce(F.col("p_value") < SIGNIFICANT, no)
    fragile = F.coalesce(F.col("inverts"), no) | (sig & F.coalesce(~F.col("survives"), no))
    whole = sig & F.coalesce(F.col("survives"), no)
    v = (
        F.when(F.coalesce(F.col("pbo") >= PBO_BAR, no), "overfit")
        .when(F.coalesce(F.col("p_value") >= SIGNIFICANT, no), "no_edge")
        .when(fragile, "survivorship_fragile")
        .when(whole & F.coalesce(F.col("dsr") >= DSR_BAR, no), "validated")
        .otherwise("weak_unvalidated")
    )
    return e.withColumn("verdict", v)


# Why a verdict is what it is.
VERDICT_REASONS = {
    "overfit": "PBO %.0f%% ≥ 50%%: selecting the best config is overfitting.",
    "no_edge": "permutation p = %.3f ≥ 0.05: does not beat its shuffled null.",
    "inverts": "signal inverts sign under survivorship injection — a survivorship mirage (the survivor pattern reverses on delisted names).",
    "lost": "significant on survivors but loses significance under survivorship injection.",
    "no_dsr": "survives injection, but the selection-adjusted Sharpe (DSR) was not computed — cannot validate without it.",
    "low_dsr": "survives injection but DSR %.2f < 0.95: not selection-proof.",
    "validated": "clears permutation, survivorship injection, and the deflated-Sharpe bar.",
    "untested": "significant on this sample but survivorship was not (or could not be) tested.",
    "no_test": "no decisive significance test available; treat as a hypothesis only.",
}
BANNER = "⚠️ AUTOMATED CORRECTION: the explanation above contained language asserting an edge that the evidence does NOT support (verdict: %s). Reason: %s Treat any such claim as unsupported."


def verdict_reason(e: DataFrame) -> DataFrame:
    """Evidence with its verdict and the reason for it."""
    no, text = F.lit(False), VERDICT_REASONS
    sig = F.coalesce(F.col("p_value") < SIGNIFICANT, no)
    whole = sig & F.coalesce(F.col("survives"), no)
    say = lambda k: F.lit(text[k])
    reason = (
        F.when(F.col("verdict") == "overfit", F.format_string(text["overfit"], F.col("pbo") * 100))
        .when(F.col("verdict") == "no_edge", F.format_string(text["no_edge"], "p_value"))
        .when(F.coalesce(F.col("inverts"), no), say("inverts"))
        .when(F.col("verdict") == "survivorship_fragile", say("lost"))
        .when(whole & F.col("dsr").isNull(), say("no_dsr"))
        .when(whole & (F.col("dsr") < DSR_BAR), F.format_string(text["low_dsr"], "dsr"))
        .when(whole, say("validated"))
        .when(sig, say("untested"))
        .otherwise(say("no_test"))
    )
    return evidence_verdict(e).withColumn("reason", reason)


def correction(text: Column, verdict: Column, reason: Column) -> Column:
    """The banner for a text that claims more than its verdict allows; null where it does not."""
    claims = (verdict != "validated") & (F.size(overclaims(text)) > 0)
    return F.when(claims, F.format_string(BANNER, verdict, reason))


# Phrases that claim an edge.
OVERCLAIMS = (
    r"\bprofitabl\w*\b", r"\b(strong|real|genuine|reliable|robust|proven|clear)\s+(edge|signal|alpha)\b", r"\b(edge|signal|alpha)\s+is\s+(real|genuine|reliable|durable|robust|proven)\b",
    r"\btradeable\s+edge\b", r"\b(guarantee\w*|certain(ly)?|sure[- ]?thing)\b", r"\b(will|should)\s+(outperform|beat the market|make money|be profitable)\b",
    r"\b(buy|sell|long|short)\s+(signal|now|this|when|here)\b", r"\bconsistently\s+(profitable|outperform\w*|wins?)\b", r"\b(reliabl\w*\s+profit\w*|profit\s+from|makes?\s+money)\b",
    r"\bhighly\s+predictive\b", r"\b(excess\s+returns?|positive\s+expectancy)\b", r"\bexploit\w*\s+(inefficienc\w*|edge|pattern|signal)\b", r"\bgenerates?\s+alpha\b",
)


def overclaims(text: Column) -> Column:
    """Distinct phrases that claim an edge, in the order of the patterns."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), 0) for p in OVERCLAIMS]))


# What a verdict is called in a narration, and how one ends.
CLOSING = "This is a research finding, not a tradeable signal or financial advice. On survivorship-biased data, apparent edges routinely vanish or invert once delisted names are present."
HEADLINES = {
    "overfit": "OVERFIT — the selection is fitting noise, not signal.",
    "no_edge": "NO EDGE — fails its own permutation null.",
    "survivorship_fragile": "SURVIVORSHIP MIRAGE — real on survivors, not survivorship-robust.",
    "weak_unvalidated": "UNVALIDATED — suggestive at best; treat as a hypothesis.",
    "validated": "VALIDATED on this data — clears the bars we can test here (not a forward guarantee).",
}


def narrate(e: DataFrame) -> DataFrame:
    """The template narration of a row of evidence with its verdict."""
    f = lambda fmt, c: F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c)))
    stats = F.concat_ws("; ", f("OOS IC %+.3f", "oos_ic"), f("permutation p = %.3f", "p_value"), f("DSR %.2f", "dsr"), F.when(F.col("pbo").isNotNull(), F.format_string("PBO %.0f%%", F.col("pbo") * 100)), F.when(F.col("survives"), "survives injection").when(~F.col("survives"), "fails under injection"), F.when(F.col("inverts"), "INVERTS off survivors"))
    head = F.element_at(F.create_map(*[x for k, v in HEADLINES.items() for x in (F.lit(k), F.lit(v))]), F.col("verdict"))
    closing = F.when(F.col("verdict") != "validated", CLOSING)
    line = F.when(stats == "", "no summary statistics provided").otherwise(stats)
    return e.withColumn("narration", F.concat_ws("\n", F.concat(F.lit("Signal: "), "name"), F.concat(F.lit("Verdict: "), head), F.concat(F.lit("Evidence: "), line, F.lit(".")), closing))


REPORT = "n_datasets long, n_samples long, oos_ic double, p_value double, bucket_curve array<double>, ls_net double, dsr double, n_trials int, pbo double, inverts boolean"


def pooled_streams(rows: DataFrame, size: int, most: int = 10) -> DataFrame:
    """One row: how many bets, their mean, deviation, skew and kurtosis, and n, sum and sum of squares by symbol and block.

    Streams of bets stay where they are: only aggregates of them meet. Blocks are those of the shortest stream (`array_split`
    of its length), an even number of them, 4 to `most`.
    """
    bets = rows.select("symbol", F.posexplode("stream").alias("at", "x"))
    moments = bets.agg(F.count("*").alias("bets"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("excess"))
    shortest = rows.agg(F.min(F.size("stream")).alias("t"), F.count("*").alias("names"))
    k = F.greatest(F.lit(4), F.least(F.lit(most), F.floor(F.col("t") / 2) * 2)).cast("int")
    shortest = shortest.withColumn("k", k).withColumn("q", F.floor(F.col("t") / F.col("k"))).withColumn("more", F.col("t") % F.col("k"))
    edge = F.col("more") * (F.col("q") + 1)
    block = F.when(F.col("at") < edge, F.floor(F.col("at") / (F.col("q") + 1))).otherwise(F.col("more") + F.floor((F.col("at") - edge) / F.greatest(F.col("q"), F.lit(1))))
    cut = bets.crossJoin(F.broadcast(shortest)).filter("names >= 2 and t >= 8 and at < t").withColumn("block", block.cast("int"))
    sums = cut.groupBy("symbol", "block").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return moments.crossJoin(sums.agg(F.array_sort(F.collect_list(F.struct("symbol", "block", "n", "s", "q"))).alias("blocks")))


def honest_report(data: DataFrame, features, horizon: int, stride: int, perms: int = 50, n_trials: int = 1, seed: int = 0, sweep: DataFrame | None = None) -> DataFrame:
    """Pooled IC, block-permutation p, bucket curve, deflated Sharpe, overfitting, verdict, in one row and one plan.

    sweep: (fraction, ls_net) rungs of the injection sweep, if one was run.
    """
    purge = purge_of(horizon, stride)
    size = learn.block_size(horizon, stride)
    p = pooled_p(permuted_ic(data, features, purge, perms, seed, block=size)).select("real_ic", "p_value")
    rows = book(data, features, purge)
    counts = data.agg(F.countDistinct("symbol").alias("n_datasets"), F.count("*").alias("n_samples"))
    places = rows.select(F.posexplode("curve").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    curve = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda x: x["x"]).alias("curve"))
    net = rows.agg(F.avg("ls_net").alias("ls_net"))
    one = counts.crossJoin(p).crossJoin(curve).crossJoin(net).crossJoin(pooled_streams(rows, size))
    if sweep is None:
        one = one.withColumn("inverts", F.lit(None).cast("boolean"))
    else:
        ends = sweep.agg(F.count("*").alias("rungs"), F.min_by("ls_net", "fraction").alias("a"), F.max_by("ls_net", "fraction").alias("z"))
        one = one.crossJoin(ends.select(F.when(F.col("rungs") > 1, (F.col("a") > 0) & (F.col("z") < 0)).alias("inverts")))

    def judge(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                deflated = overfit = None
                if r.bets >= 8 and r.sd > 0:
                    deflated = dsr(r.mean / r.sd, max(8, int(r.bets) // size), r.skew, r.excess + 3, n_trials)
                if len(r.blocks):
                    cells = pd.DataFrame([(x["symbol"], x["block"], x["n"], x["s"], x["q"]) for x in r.blocks], columns=["symbol", "block", "n", "s", "q"])
                    n, s, q = (cells.pivot(index="block", columns="symbol", values=c).to_numpy() for c in ("n", "s", "q"))
                    overfit = learn.overfitting_of(n[:, 0], s, q, "mean")["pbo"]
                out.append((r.n_datasets, r.n_samples, r.real_ic, r.p_value, list(r.curve), r.ls_net, deflated, n_trials, overfit, None if pd.isna(r.inverts) else bool(r.inverts)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")])

    one = one.mapInPandas(judge, REPORT)
    return one.withColumn("verdict", harness_verdict(F.col("p_value"), F.col("pbo"), F.col("inverts"), F.col("dsr")))
