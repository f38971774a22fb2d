"""Queries over cross-validation, models, resampling, statistics and verdicts: V, M, X, T, G, A22-A24, A27, J12, J15, L5."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions import learn
from volumetra.functions import rolling as R
from volumetra.operators import datasets
from volumetra.operators import research as Q
from volumetra.plans.registry import EVENT, FLAG, NATION, query, staged
from volumetra.plans.rolling import FACTORS
from volumetra.sources import bars as B

HORIZON, STRIDE = 20, 3
PURGE = Q.purge_of(HORIZON, STRIDE)
#: The reference's n_permutations: the least p is 1 / 201.
PERMUTATIONS = 200
_, BEHAVIORAL = R.behavioral()
FOUR = ["rvol_21", "clv_pressure_21", "accum_slope_21", "price_ext_21"]


def behavioral(spark, sf_dir):
    return datasets.behavioral(B.event_hourly(spark, sf_dir))


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# --- samples that SQL can follow: a feature, a forward return, every third bar ----

_SAMPLES = f"""{EVENT}, f AS (SELECT symbol, ts, close, lead(close, 20) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS y, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x, volume AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars),
 s AS (SELECT symbol, x, y, z, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS sample_id FROM f WHERE idx >= 5 AND (idx - 5) % 3 = 0 AND y IS NOT NULL)"""


def samples(spark, sf_dir):
    b = R.apply(B.indexed(B.event_hourly(spark, sf_dir)), [{"y": f"{R.lead('close', 20)} / close - 1", "x": f"close / {R.lag('close', 5)} - 1", "z": "volume"}])
    return datasets.sample_id(b.filter("idx >= 5 and (idx - 5) % 3 = 0 and y is not null").select("symbol", "idx", "x", "y", "z"))


_SPLITS = f"""WITH {_SAMPLES}, g AS (SELECT symbol, sample_id, ntile(6) OVER (PARTITION BY symbol ORDER BY sample_id) - 1 AS g, count(*) OVER (PARTITION BY symbol) AS n FROM s),
 b AS (SELECT symbol, g, min(sample_id) AS a, max(sample_id) AS z FROM g GROUP BY 1, 2), c AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS split_id, i, j FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j) WHERE i < j),
 h AS (SELECT split_id, symbol, b.g, a, z FROM c JOIN b ON b.g = c.i OR b.g = c.j), o AS (SELECT g.symbol, sample_id, split_id, bool_or(h.g = g.g) AS held, bool_or((a > sample_id AND a - {PURGE} <= sample_id) OR (z < sample_id AND z + ceil(0.01 * n) >= sample_id)) AS dropped FROM g JOIN h ON g.symbol = h.symbol GROUP BY 1, 2, 3)"""


@query("v1_purged_splits", f"{_SPLITS} SELECT split_id, symbol, sample_id, CASE WHEN held THEN 'test' ELSE 'train' END AS role FROM o WHERE held OR NOT dropped")
def purged_splits(spark, sf_dir):
    s = Q.split_relation(samples(spark, sf_dir), purge=PURGE, embargo=0.01)
    return s.select(F.col("split_id").cast("long").alias("split_id"), "symbol", F.col("sample_id").cast("long").alias("sample_id"), "role")


@query("j12_purge_anti_join", f"{_SPLITS} SELECT split_id, symbol, count(*) FILTER (WHERE held) AS n_test, count(*) FILTER (WHERE NOT held AND NOT dropped) AS n_train, count(*) FILTER (WHERE NOT held AND dropped) AS n_dropped FROM o GROUP BY 1, 2")
def purge_counts(spark, sf_dir):
    base = samples(spark, sf_dir)
    s = Q.split_relation(base, purge=PURGE, embargo=0.01)
    n = base.groupBy("symbol").agg(F.count("*").alias("n"))
    c = s.groupBy("split_id", "symbol").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))
    return c.join(n, "symbol").select(F.col("split_id").cast("long").alias("split_id"), "symbol", "n_test", "n_train", (F.col("n") - F.col("n_test") - F.col("n_train")).alias("n_dropped"))


_FIT = f"""{_SPLITS}, k AS (SELECT o.symbol, split_id, sample_id, held FROM o WHERE held OR NOT dropped), t AS (SELECT k.symbol, split_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS cxy FROM k JOIN s USING (symbol, sample_id) WHERE NOT held GROUP BY 1, 2),
 w AS (SELECT *, CASE WHEN sx > 0 THEN (n * cxy / sx) / (n + 1.0) ELSE 0 END AS weight FROM t)"""


def one_feature_fit(spark, sf_dir):
    """Ridge of one feature on every fold in one aggregate: sums are all that a closed form needs."""
    s = samples(spark, sf_dir)
    k = Q.split_relation(s, purge=PURGE, embargo=0.01).join(s, ["symbol", "sample_id"])
    t = k.filter("role = 'train'").groupBy("symbol", "split_id").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.count("*").alias("n"), F.covar_pop("x", "y").alias("cxy"))
    w = t.withColumn("weight", F.when(F.col("sx") > 0, F.col("n") * F.col("cxy") / F.nullif("sx", F.lit(0.0)) / (F.col("n") + 1.0)).otherwise(0.0))
    return k, w


@query("m2_ridge_one_feature", f"{_FIT} SELECT symbol, split_id, n, round(mx, 8) AS mx, round(sx, 8) AS sx, round(weight, 7) AS weight FROM w")
def ridge_one(spark, sf_dir):
    _, w = one_feature_fit(spark, sf_dir)
    return w.select("symbol", F.col("split_id").cast("long").alias("split_id"), "n", r("mx", 8), r("sx", 8), r("weight", 7))


@query("a22_pearson_ic", f"{_FIT} SELECT k.symbol, k.split_id, round(corr((x - mx) / sx * weight, y), 6) AS ic FROM k JOIN s USING (symbol, sample_id) JOIN w ON k.symbol = w.symbol AND k.split_id = w.split_id WHERE held GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop((x - mx) / sx * weight) > 0")
def pearson_ic(spark, sf_dir):
    k, w = one_feature_fit(spark, sf_dir)
    t = k.filter("role = 'test'").join(w, ["symbol", "split_id"]).withColumn("sig", (F.col("x") - F.col("mx")) / F.col("sx") * F.col("weight"))
    g = t.groupBy("symbol", "split_id").agg(F.count("*").alias("k"), F.stddev_pop("sig").alias("sd"), F.corr("sig", "y").alias("ic")).filter("k >= 3 and sd > 0")
    return g.select("symbol", F.col("split_id").cast("long").alias("split_id"), r("ic"))


_RANKS = "r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY z) + (count(*) OVER (PARTITION BY symbol, z) - 1) / 2.0 AS rz, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM s)"


@query("a23_spearman_ic", f"WITH {_SAMPLES}, {_RANKS} SELECT symbol, round(corr(rz, ry), 6) AS ic FROM r GROUP BY symbol")
def spearman_ic(spark, sf_dir):
    rank = lambda c: F.rank().over(W.partitionBy("symbol").orderBy(c)) + (F.count("*").over(W.partitionBy("symbol", c)) - 1) / 2.0
    s = samples(spark, sf_dir).withColumn("rz", rank("z")).withColumn("ry", rank("y"))
    return s.groupBy("symbol").agg(F.round(F.corr("rz", "ry"), 6).alias("ic"))


_EDGES = "q AS (SELECT symbol, quantile_cont(round(x, 6), [0.2, 0.4, 0.6, 0.8]) AS e FROM s GROUP BY symbol), u AS (SELECT s.symbol, y, len(list_filter(e, lambda v: v - 1e-9 <= round(x, 6))) AS bucket FROM s JOIN q USING (symbol))"


def bucketed(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("x", F.round("x", 6))
    e = s.groupBy("symbol").agg(F.expr("percentile(x, array(0.2, 0.4, 0.6, 0.8))").alias("e"))
    return s.join(e, "symbol").withColumn("bucket", F.size(F.filter("e", lambda v: v - 1e-9 <= F.col("x"))).cast("long"))


@query("a24_quantile_buckets", f"WITH {_SAMPLES}, {_EDGES} SELECT symbol, bucket, count(*) AS n, round(avg(y), 6) AS mean_return FROM u GROUP BY 1, 2")
def quantile_buckets(spark, sf_dir):
    """Buckets by quantile edges, which is not `ntile`."""
    return bucketed(spark, sf_dir).groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_return"))


@query("a27_book_summary", f"WITH {_SAMPLES}, {_EDGES} SELECT symbol, round(avg(CASE WHEN bucket IN (0, 4) THEN 1.0 ELSE 0 END), 6) AS in_market, round((avg(y) FILTER (WHERE bucket = 4) - avg(y) FILTER (WHERE bucket = 0)) * 100, 4) AS spread_pct FROM u GROUP BY symbol")
def book_summary(spark, sf_dir):
    b = F.col("bucket")
    return bucketed(spark, sf_dir).groupBy("symbol").agg(F.round(F.avg(F.when(b.isin(0, 4), 1.0).otherwise(0.0)), 6).alias("in_market"), F.round((F.avg(F.when(b == 4, F.col("y"))) - F.avg(F.when(b == 0, F.col("y")))) * 100, 4).alias("spread_pct"))


@query("j15_auc_by_rank_sum", f"WITH {_SAMPLES} SELECT p.symbol, round(avg(CASE WHEN p.z > q.z THEN 1.0 WHEN p.z = q.z THEN 0.5 ELSE 0 END), 6) AS auc FROM s p JOIN s q ON p.symbol = q.symbol AND p.y > 0 AND q.y <= 0 GROUP BY 1")
def auc_rank_sum(spark, sf_dir):
    """What comparing all pairs would give, from ranks: n log n."""
    rank = F.rank().over(W.partitionBy("symbol").orderBy("z")) + (F.count("*").over(W.partitionBy("symbol", "z")) - 1) / 2.0
    s = samples(spark, sf_dir).withColumn("rk", rank).withColumn("win", (F.col("y") > 0).cast("int"))
    g = s.groupBy("symbol").agg(F.sum("win").alias("p"), F.sum(1 - F.col("win")).alias("q"), F.sum(F.when(F.col("win") == 1, F.col("rk"))).alias("t"))
    return g.select("symbol", F.round((F.col("t") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


@query("x2_orthogonalised", f"WITH {_SAMPLES}, m AS (SELECT symbol, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM s GROUP BY symbol) SELECT s.symbol, sample_id, round(y - my - (xy * zz - zy * xz) / (xx * zz - xz * xz) * (x - mx) - (zy * xx - xy * xz) / (xx * zz - xz * xz) * (z - mz), 6) AS residual FROM s JOIN m USING (symbol)")
def orthogonalised(spark, sf_dir):
    o = Q.orthogonal(samples(spark, sf_dir), "y", "x", "z")
    return o.select("symbol", F.col("sample_id").cast("long").alias("sample_id"), r("residual"))


@query("x5_t_test_across_names", f"WITH {_SAMPLES}, i AS (SELECT symbol, corr(x, y) AS ic FROM s GROUP BY symbol) SELECT count(*) AS n, round(avg(ic), 6) AS mean_ic, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 5) AS t FROM i")
def t_test(spark, sf_dir):
    i = samples(spark, sf_dir).groupBy("symbol").agg(F.corr("x", "y").alias("ic"))
    return i.agg(F.count("*").alias("n"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("*"))), 5).alias("t"))


@query("x1_ablation_pool", f"WITH {_SAMPLES} SELECT 'x' AS feature, round(corr(x, y), 6) AS ic, count(*) AS n FROM s UNION ALL SELECT 'z', round(corr(z, y), 6), count(*) FROM s")
def ablation(spark, sf_dir):
    """Samples of all names pooled, one feature at a time."""
    s = samples(spark, sf_dir).selectExpr("y", "stack(2, 'x', x, 'z', z) as (feature, v)")
    return s.groupBy("feature").agg(F.round(F.corr("v", "y"), 6).alias("ic"), F.count("*").alias("n"))


# --- evaluators -------------------------------------------------------------


@query("v3_factor_evaluation")
def factor_evaluation(spark, sf_dir):
    f = Q.fold_evaluation(behavioral(spark, sf_dir), BEHAVIORAL, PURGE)
    return Q.factor_summary(f)


@query("m2_ridge_folds")
def ridge_folds(spark, sf_dir):
    f = Q.fold_evaluation(behavioral(spark, sf_dir), FOUR, PURGE)
    return f.select("symbol", "split_id", r("ic"), r("accuracy"), r("ls"), F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


@query("v4_conviction_book")
def conviction_book(spark, sf_dir):
    b = Q.book(behavioral(spark, sf_dir), BEHAVIORAL, PURGE)
    return b.select("symbol", "curve", r("spread"), r("ls_net"), r("long_net"), r("rank_corr"), r("in_market"), r("always_on"), F.size("stream").alias("n_bets"))


_PANEL = staged("nation", FACTORS, "*")
_NAMES = ("mom_21", "mom_252_21", "vol_60", "vol_trend")
_CR = ", ".join(f"(rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY ts) - 1) - 0.5 AS r_{c}" for c in _NAMES)
PANEL_SQL = f"""WITH f AS ({_PANEL}), d AS (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k FROM (SELECT DISTINCT ts FROM f)) WHERE k % 5 = 0),
 v AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM f WHERE ts IN (SELECT ts FROM d) AND mom_21 IS NOT NULL AND mom_252_21 IS NOT NULL AND vol_60 IS NOT NULL AND vol_trend IS NOT NULL AND fwd IS NOT NULL), c AS (SELECT * FROM v WHERE n >= 5),
 p AS (SELECT ts, symbol, fwd AS y, {_CR} FROM c)"""


def panel(spark, sf_dir):
    return datasets.panel(B.nation_weekly(spark, sf_dir))


@query("v6_cross_sectional_panel", f"{PANEL_SQL} SELECT dense_rank() OVER (ORDER BY ts) - 1 AS date_id, symbol, {', '.join(f'round(r_{c}, 6) AS {c}' for c in _NAMES)}, round(y, 6) AS y FROM p")
def cross_sectional_panel(spark, sf_dir):
    return panel(spark, sf_dir).select(F.col("date_id").cast("long").alias("date_id"), "symbol", *[r(c) for c in _NAMES], r("y"))


@query("v7_single_factor_ic", f"{PANEL_SQL}, r AS (SELECT ts, r_mom_21, rank() OVER (PARTITION BY ts ORDER BY y) + (count(*) OVER (PARTITION BY ts, y) - 1) / 2.0 AS ry FROM p), i AS (SELECT ts, corr(r_mom_21, ry) AS ic FROM r GROUP BY ts HAVING count(*) >= 3) SELECT count(*) AS n_dates, round(avg(ic), 6) AS mean_ic FROM i")
def single_factor_ic(spark, sf_dir):
    ry = F.rank().over(W.partitionBy("date_id").orderBy("y")) + (F.count("*").over(W.partitionBy("date_id", "y")) - 1) / 2.0
    i = panel(spark, sf_dir).withColumn("ry", ry).groupBy("date_id").agg(F.count("*").alias("k"), F.corr("mom_21", "ry").alias("ic")).filter("k >= 3")
    return i.agg(F.count("ic").alias("n_dates"), F.round(F.avg("ic"), 6).alias("mean_ic"))


@query("v7_panel_evaluation")
def panel_evaluation(spark, sf_dir):
    e = Q.panel_evaluation(panel(spark, sf_dir))
    return e.agg(F.count("*").alias("n_dates_oos"), F.avg("ic").alias("ic_mean"), F.expr("percentile(ic, 0.5)").alias("ic_median"), F.stddev_pop("ic").alias("ic_std"), (F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_positive"))


@query("m9_within_date_permutation")
def within_date(spark, sf_dir):
    e = Q.panel_evaluation(panel(spark, sf_dir), n=PERMUTATIONS).groupBy("replicate").agg(F.avg("ic").alias("ic"), F.count("*").alias("n"))
    return Q.pooled_p(e)


def meta_data(spark, sf_dir):
    """Behavioural features and the win or loss of a long bet."""
    d = behavioral(spark, sf_dir)
    return d.withColumn("win", (F.col("y") > 0).cast("int")).withColumn("ret", F.col("y"))


@query("v5_meta_evaluation")
def meta_evaluation(spark, sf_dir):
    return Q.meta_summary(Q.meta_evaluation(meta_data(spark, sf_dir), FOUR, PURGE))


@query("m3_logistic_top_fraction")
def top_fraction(spark, sf_dir):
    return Q.meta_summary(Q.meta_evaluation(meta_data(spark, sf_dir), FOUR, PURGE, top=0.2, cost_bps=10))


@query("m7_row_permutation")
def row_permutation(spark, sf_dir):
    return Q.p_by_symbol(Q.permuted_ic(behavioral(spark, sf_dir), FOUR, PURGE, PERMUTATIONS), ["ic"])


@query("m8_meta_permutation")
def meta_permutation(spark, sf_dir):
    return Q.p_by_symbol(Q.permuted_meta(meta_data(spark, sf_dir), FOUR, PURGE, PERMUTATIONS), ["auc", "lift"])


@query("m10_block_ids", f"WITH {_SAMPLES} SELECT symbol, sample_id, sample_id // {learn.block_size(HORIZON, STRIDE)} AS block FROM s")
def block_ids(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select("symbol", F.col("sample_id").cast("long").alias("sample_id"), F.floor(F.col("sample_id") / learn.block_size(HORIZON, STRIDE)).cast("long").alias("block"))


@query("m10_block_permutation")
def block_permutation(spark, sf_dir):
    return Q.p_by_symbol(Q.permuted_ic(behavioral(spark, sf_dir), FOUR, PURGE, PERMUTATIONS, block=learn.block_size(HORIZON, STRIDE)), ["ic"])


@query("m11_pooled_p")
def pooled(spark, sf_dir):
    return Q.pooled_p(Q.permuted_ic(behavioral(spark, sf_dir), FOUR, PURGE, PERMUTATIONS, block=learn.block_size(HORIZON, STRIDE)))


@query("m4_kmeans")
def kmeans(spark, sf_dir):
    """Clusters of the whole embeddings: k-means++ with six starts, as sums over the table."""
    from volumetra.operators import cluster

    e = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    c, _, mu, sd = cluster.kmeans(e, 3)
    return cluster.assigned(e, c, mu, sd).withColumnRenamed("id", "vec_id")


@query("m4_kmeans_at_scale")
def kmeans_scale(spark, sf_dir):
    """The distributed k-means, for data that no task can hold (k-means|| start: other centres than the exact one)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = B.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=3, seed=0).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@query("m5_walk_forward_regimes")
def walk_regimes(spark, sf_dir):
    return Q.regimes(behavioral(spark, sf_dir), FOUR, first=60, every=30)


@query("m6_regime_spread")
def regime_spread(spark, sf_dir):
    return Q.regime_spread(Q.regimes(behavioral(spark, sf_dir), FOUR, first=60, every=30))


@query("x3_boosted_trees")
def boosted(spark, sf_dir):
    """Gradient-boosted trees on all names, by sample order: the first 70 % train."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = meta_data(spark, sf_dir).withColumn("part", F.percent_rank().over(W.partitionBy("symbol").orderBy("sample_id")))
    d = VectorAssembler(inputCols=FOUR, outputCol="features").transform(d.withColumn("label", F.col("win").cast("double")))
    m = GBTClassifier(maxIter=5, maxDepth=3, seed=0).fit(d.filter("part < 0.7"))
    t = m.transform(d.filter("part >= 0.7")).withColumn("p", vector_to_array("probability")[1])
    return t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("base_rate"))


@query("x4_live_rating")
def live_rating(spark, sf_dir):
    """Train on the first 70 %, purge, rate the rest: chance of a win and expected R."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("sample_id")
        n = len(pdf)
        cut = int(0.7 * n)
        X, y = pdf[FOUR].to_numpy(float), pdf["win"].to_numpy(int)
        p = learn.Logistic().fit(X[: max(cut - PURGE, 1)], y[: max(cut - PURGE, 1)]).chance(X[cut:])
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[cut:], "sample_id": pdf["sample_id"].iloc[cut:].astype("int64"), "p_win": p, "expected_r": 2 * p - 1})

    return meta_data(spark, sf_dir).withColumn("sample_id", F.col("sample_id").cast("long")).groupBy("symbol").applyInPandas(run, "symbol string, sample_id long, p_win double, expected_r double")


# --- Sharpe statistics ------------------------------------------------------

_RET = f"{EVENT}, r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars)"


def returns(spark, sf_dir):
    return R.apply(B.event_hourly(spark, sf_dir), [{"r": R.RET}])


def moments(spark, sf_dir):
    return Q.sharpe_moments(returns(spark, sf_dir), "r", ["symbol"])


@query("t1_sharpe", f"WITH {_RET} SELECT symbol, count(r) AS n, round(avg(r) / stddev_samp(r), 6) AS sr FROM r GROUP BY symbol")
def sharpe(spark, sf_dir):
    return moments(spark, sf_dir).select("symbol", "n", r("sr"))


@query("t2_skew_kurtosis", f"WITH {_RET}, z AS (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m, stddev_pop(r) OVER (PARTITION BY symbol) AS sd FROM r) SELECT symbol, round(avg(power((r - m) / sd, 3)), 4) AS skew, round(avg(power((r - m) / sd, 4)), 3) AS kurt FROM z WHERE r IS NOT NULL GROUP BY symbol")
def skew_kurtosis(spark, sf_dir):
    return moments(spark, sf_dir).select("symbol", r("skew", 4), r("kurt", 3))


_LAGS = 5
_RHO = ", ".join(f"lag(x, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS x{k}" for k in range(1, _LAGS + 1))
_ACC = " + ".join(f"(252 - {k}) * sum(x * x{k}) / sum(x * x)" for k in range(1, _LAGS + 1))


@query("t3_annualised_sharpe_lo", f"WITH {_RET}, c AS (SELECT symbol, ts, r, r - avg(r) OVER (PARTITION BY symbol) AS x FROM r WHERE r IS NOT NULL), l AS (SELECT *, {_RHO} FROM c), a AS (SELECT symbol, avg(r) / stddev_samp(r) AS sr, 252 + 2 * ({_ACC}) AS v FROM l GROUP BY symbol) SELECT symbol, round(sr * sqrt(252.0), 5) AS naive, round(CASE WHEN v > 0 THEN sr * 252 / sqrt(abs(v)) ELSE sr * sqrt(252.0) END, 5) AS lo FROM a")
def lo_sharpe(spark, sf_dir):
    x = returns(spark, sf_dir).filter("r is not null").withColumn("x", F.col("r") - F.avg("r").over(W.partitionBy("symbol")))
    x = R.apply(x, [{f"x{k}": R.lag("x", k) for k in range(1, _LAGS + 1)}])
    a = x.groupBy("symbol").agg((F.avg("r") / F.stddev_samp("r")).alias("sr"), (252 + 2 * F.expr(_ACC)).alias("v"))
    naive = F.col("sr") * F.sqrt(F.lit(252.0))
    return a.select("symbol", F.round(naive, 5).alias("naive"), F.round(F.when(F.col("v") > 0, F.col("sr") * 252 / F.sqrt(F.abs("v"))).otherwise(naive), 5).alias("lo"))


def _scalars(make, schema):
    """One row a symbol from its moments: normal quantiles are no SQL, and the moments are a few numbers a symbol."""

    def run(spark, sf_dir):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]

        def frames(it):
            for pdf in it:
                yield pd.DataFrame([[m.symbol, *make(m)] for m in pdf.itertuples()], columns=names)

        return moments(spark, sf_dir).filter("sr is not null").mapInPandas(frames, schema)

    return run


query("t4_probabilistic_sharpe")(_scalars(lambda m: [*Q.psr(m.sr, m.n, m.skew, m.kurt)], "symbol string, psr double, stat double"))
query("t6_deflated_sharpe")(_scalars(lambda m: [Q.dsr(m.sr, m.n, m.skew, m.kurt, 11), 11], "symbol string, dsr double, n_trials int"))
_T7 = f"WITH {_RET}, m AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS sd, abs(avg(r) / stddev_samp(r)) AS sr FROM r GROUP BY symbol), k AS (SELECT r.symbol, any_value(sr) AS sr, avg(power((r - m) / sd, 3)) AS skew, avg(power((r - m) / sd, 4)) AS kurt FROM r JOIN m ON r.symbol = m.symbol WHERE r IS NOT NULL GROUP BY r.symbol) SELECT symbol, round(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * power(1.6448536269514722 / sr, 2), 3) AS min_trl FROM k"


@query("t7_min_track_record", _T7)
def min_track_record(spark, sf_dir):
    return _scalars(lambda m: [Q.min_track_record(abs(m.sr), m.skew, m.kurt)], "symbol string, min_trl double")(spark, sf_dir).select("symbol", r("min_trl", 3))


query("t10_sharpe_haircut")(_scalars(lambda m: list(Q.haircut(m.sr, m.n, 20).values()), "symbol string, p_single double, p_adjusted double, t_observed double, t_adjusted double, haircut_sr double, haircut double"))


@query("t5_expected_max_sharpe")
def expected_max(spark, sf_dir):
    return spark.createDataFrame([(n, Q.expected_max(n, 1 / 251)) for n in (1, 2, 5, 11, 20, 50, 100, 1000)], "n_trials int, expected_max double")


_COMMON = f"{FLAG}, c AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = 3), m AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars WHERE ts IN (SELECT ts FROM c)), k AS (SELECT symbol, r, ntile(4) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b FROM m WHERE r IS NOT NULL), a AS (SELECT symbol, b, count(*) AS n, sum(r) AS s FROM k GROUP BY 1, 2)"


@query("t8_overfitting_probability", f"WITH {_COMMON}, h AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS id, i, j FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < j), e AS (SELECT id, symbol, sum(s) FILTER (WHERE b IN (i, j)) / sum(n) FILTER (WHERE b IN (i, j)) AS ins, sum(s) FILTER (WHERE b NOT IN (i, j)) / sum(n) FILTER (WHERE b NOT IN (i, j)) AS oos FROM h, a GROUP BY 1, 2), q AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY oos) AS rk, row_number() OVER (PARTITION BY id ORDER BY ins DESC) AS best FROM e), l AS (SELECT *, ln((rk / 4.0) / (1 - rk / 4.0)) AS logit FROM q WHERE best = 1) SELECT count(*) AS n_combinations, round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0 END), 6) AS pbo, round(avg(CASE WHEN oos < 0 THEN 1.0 ELSE 0 END), 6) AS prob_oos_loss, round(regr_slope(oos, ins), 5) AS degradation_slope FROM l")
def overfitting(spark, sf_dir):
    """Block sums of each configuration, added up for every choice of halves: the long history is read once."""
    from volumetra.operators.align import common_dates

    m = R.apply(common_dates(B.flag_daily(spark, sf_dir)), [{"r": R.RET}]).filter("r is not null")
    k = m.withColumn("b", F.ntile(4).over(W.partitionBy("symbol").orderBy("ts")) - 1)
    a = k.groupBy("symbol", "b").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    halves = spark.createDataFrame([(i, list(c)) for i, c in enumerate(((i, j) for i in range(4) for j in range(i + 1, 4)))], "id int, half array<int>")
    e = a.crossJoin(F.broadcast(halves)).withColumn("i", F.array_contains("half", F.col("b")))
    e = e.groupBy("id", "symbol").agg((F.sum(F.when(F.col("i"), F.col("s"))) / F.sum(F.when(F.col("i"), F.col("n")))).alias("ins"), (F.sum(F.when(~F.col("i"), F.col("s"))) / F.sum(F.when(~F.col("i"), F.col("n")))).alias("oos"))
    q = e.withColumn("rk", F.rank().over(W.partitionBy("id").orderBy("oos"))).withColumn("best", F.row_number().over(W.partitionBy("id").orderBy(F.desc("ins")))).filter("best = 1")
    w = F.col("rk") / 4.0
    q = q.withColumn("logit", F.log(w / (1 - w)))
    return q.agg(F.count("*").alias("n_combinations"), F.round(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)), 6).alias("pbo"), F.round(F.avg(F.when(F.col("oos") < 0, 1.0).otherwise(0.0)), 6).alias("prob_oos_loss"), F.round(F.regr_slope("oos", "ins"), 5).alias("degradation_slope"))


@query("t9_adjusted_p_values", "WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 997 + 1) / 5000.0 AS p FROM supplier), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS k FROM p), h AS (SELECT sum(1.0 / i) AS c FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM p))) AS i)), a AS (SELECT id, p, k, least(1.0, p * m) AS bonferroni, least(1.0, p * (m - k + 1)) AS h0, least(1.0, p * m / k) AS b0, least(1.0, p * m / k * c) AS y0 FROM r, h) SELECT id, round(bonferroni, 6) AS bonferroni, round(max(h0) OVER (ORDER BY p, id), 6) AS holm, round(min(b0) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bh, round(min(y0) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS yekutieli FROM a")
def adjusted(spark, sf_dir):
    p = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (((F.col("s_suppkey") * 37) % 997 + 1) / 5000.0).alias("p"))
    return Q.adjust_p(p).withColumnRenamed("by", "yekutieli").select("id", *[r(c) for c in ("bonferroni", "holm", "bh", "yekutieli")])


@query("t11_pooled_overlap")
def pooled_overlap(spark, sf_dir):
    b = Q.book(behavioral(spark, sf_dir), FOUR, PURGE).select("symbol", F.size("stream").alias("bets"))
    return b.agg(F.sum("bets").alias("bets"), F.greatest(F.lit(8), F.floor(F.sum("bets") / learn.block_size(HORIZON, STRIDE))).cast("long").alias("effective_n"))


# --- verdicts ---------------------------------------------------------------

_GRID = "g AS (SELECT CAST(p.v AS DOUBLE) AS p_value, CAST(o.v AS DOUBLE) AS pbo, i.v AS inverts, CAST(d.v AS DOUBLE) AS dsr FROM (VALUES (0.01), (0.2), (NULL)) p(v), (VALUES (0.1), (0.7), (NULL)) o(v), (VALUES (true), (false), (NULL)) i(v), (VALUES (0.99), (0.5), (NULL)) d(v))"


def grid(spark, survives=False):
    axes = [(0.01, 0.2, None), (0.1, 0.7, None), (True, False, None), (0.99, 0.5, None)] + [(True, False, None)] * survives
    return spark.createDataFrame(list(product(*axes)), "p_value double, pbo double, inverts boolean, dsr double" + ", survives boolean" * survives)


@query("g5_harness_verdict", f"WITH {_GRID} SELECT *, CASE WHEN NOT coalesce(p_value < 0.05, false) THEN 'NO EDGE' WHEN coalesce(pbo >= 0.5, false) THEN 'OVERFIT' WHEN coalesce(inverts, false) THEN 'SURVIVORSHIP MIRAGE' WHEN NOT coalesce(dsr >= 0.95, false) THEN 'FAILS selection adjustment' ELSE 'PASSES' END AS verdict FROM g")
def harness_verdict(spark, sf_dir):
    return grid(spark).withColumn("verdict", Q.harness_verdict(F.col("p_value"), F.col("pbo"), F.col("inverts"), F.col("dsr")))


@query("g7_evidence_verdict", f"WITH {_GRID}, s AS (SELECT g.*, x.v AS survives FROM g, (VALUES (true), (false), (NULL)) x(v)) SELECT *, CASE WHEN coalesce(pbo >= 0.5, false) THEN 'overfit' WHEN coalesce(p_value >= 0.05, false) THEN 'no_edge' WHEN coalesce(inverts, false) OR (coalesce(p_value < 0.05, false) AND coalesce(NOT survives, false)) THEN 'survivorship_fragile' WHEN coalesce(p_value < 0.05, false) AND coalesce(survives, false) AND coalesce(dsr >= 0.95, false) THEN 'validated' ELSE 'weak_unvalidated' END AS verdict FROM s")
def evidence_verdict(spark, sf_dir):
    return Q.evidence_verdict(grid(spark, True))


_VERDICTS = f"WITH {_GRID}, s AS (SELECT g.*, x.v AS survives FROM g, (VALUES (true), (false), (NULL)) x(v)), t AS (SELECT *, coalesce(p_value < 0.05, false) AS sig, coalesce(inverts, false) AS inv, coalesce(survives, false) AS sur FROM s)"
_Q = {k: v.replace("'", "''") for k, v in Q.VERDICT_REASONS.items()}
_WHY = f"""CASE WHEN coalesce(pbo >= 0.5, false) THEN printf('{_Q["overfit"]}', pbo * 100) WHEN p_value >= 0.05 THEN printf('{_Q["no_edge"]}', p_value) WHEN inv THEN '{_Q["inverts"]}' WHEN sig AND survives = false THEN '{_Q["lost"]}' WHEN sig AND sur AND dsr IS NULL THEN '{_Q["no_dsr"]}' WHEN sig AND sur AND dsr < 0.95 THEN printf('{_Q["low_dsr"]}', dsr) WHEN sig AND sur THEN '{_Q["validated"]}' WHEN sig THEN '{_Q["untested"]}' ELSE '{_Q["no_test"]}' END"""


@query("g7_verdict_reasons", f"{_VERDICTS} SELECT p_value, pbo, inverts, dsr, survives, {_WHY} AS reason FROM t")
def verdict_reasons(spark, sf_dir):
    """Every verdict with the reason for it."""
    return Q.verdict_reason(grid(spark, True)).select("p_value", "pbo", "inverts", "dsr", "survives", "reason")


@query("g8_correction_banner", "WITH t(text, verdict) AS (VALUES ('a strong edge', 'no_edge'), ('a strong edge', 'validated'), ('nothing here', 'overfit'), ('it will outperform', 'weak_unvalidated')) SELECT text, verdict, CASE WHEN verdict <> 'validated' AND text <> 'nothing here' THEN '" + Q.BANNER.replace("%s. Reason", "' || verdict || '. Reason").replace("(verdict: %s)", "(verdict: ' || verdict || ')").replace("Reason: %s", "Reason: because.") + "' END AS banner FROM t")
def correction_banner(spark, sf_dir):
    """The banner for texts that claim more than their verdict allows."""
    t = spark.createDataFrame([("a strong edge", "no_edge"), ("a strong edge", "validated"), ("nothing here", "overfit"), ("it will outperform", "weak_unvalidated")], "text string, verdict string")
    return t.withColumn("banner", Q.correction(F.col("text"), F.col("verdict"), F.lit("because.")))


_TEXTS = ("a strong edge that is consistently profitable", "no claim at all", "This GENERATES alpha and will outperform; buy now", "highly predictive, highly predictive", "the signal is real")


@query("g8_overclaim_scan", "WITH t(id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TEXTS)) + ") SELECT id, list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i){p}')" for p in Q.OVERCLAIMS) + "))) AS phrases FROM t")
def overclaim_scan(spark, sf_dir):
    t = spark.createDataFrame(list(enumerate(_TEXTS)), "id int, text string")
    return t.select("id", F.array_sort(Q.overclaims(F.col("text"))).alias("phrases"))


@query("g9_narration")
def narration(spark, sf_dir):
    e = Q.evidence_verdict(grid(spark, True)).withColumn("name", F.lit("demo")).withColumn("oos_ic", F.lit(0.031))
    return Q.narrate(e).select("p_value", "pbo", "inverts", "dsr", "survives", "verdict", "narration")


def injection_rung(spark, sf_dir, fraction: float):
    """IC and book of the names with so many dead ones added."""
    from volumetra.sources import synthetic

    b = B.event_hourly(spark, sf_dir)
    b = synthetic.inject(b, fraction) if fraction > 0 else b
    d = datasets.behavioral(b)
    ic = Q.factor_summary(Q.fold_evaluation(d, FOUR, PURGE).withColumn("all", F.lit(1)), ("all",)).select(F.col("oos_ic_mean").alias("pooled_ic"))
    net = Q.book(d, FOUR, PURGE).agg(F.avg("ls_net").alias("ls_net"), F.avg("top").alias("top_bucket"))
    return ic.crossJoin(net).withColumn("fraction", F.lit(fraction))


@query("g4_injection_sweep")
def injection_sweep(spark, sf_dir):
    out = None
    for f in (0.0, 0.2, 0.5):
        rung = injection_rung(spark, sf_dir, f)
        out = rung if out is None else out.unionByName(rung)
    return out


@query("g6_honest_report")
def honest_report(spark, sf_dir):
    return Q.honest_report(behavioral(spark, sf_dir), FOUR, HORIZON, STRIDE, perms=PERMUTATIONS, n_trials=11, sweep=injection_sweep(spark, sf_dir))
