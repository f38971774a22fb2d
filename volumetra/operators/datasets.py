"""Feature datasets: one row a sample, features as columns, labels strictly in the future."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions import rolling as R
from volumetra.functions.ewm import ewm_columns
from volumetra.operators import trading, walk
from volumetra.sources.bars import indexed

CONFLUENCE = ("value_area", "key_level", "quiet", "patterns")
META = (*CONFLUENCE, "setup_quality", "bias_mag")
ENRICHED = (*CONFLUENCE, "mom_20", "mom_60", "mom_120_20", "vol_20", "atr_frac", "vol_trend", "poc_dist")
INDICATORS = ("rsi", "macd", "ma_cross", "mom_12", "fib_pos")


def labelled(bars: DataFrame, horizon: int) -> DataFrame:
    """bars with idx, n_bars and y, the return of the next `horizon` bars."""
    return indexed(bars).withColumn("y", F.expr(f"{R.lead('close', horizon)} / close - 1"))


def _signed(s: DataFrame) -> DataFrame:
    return s.select("symbol", "ts", "idx", *[(F.col(f"{p}_strength") * F.col(f"{p}_direction")).alias(p) for p in ("value_area", "key_level")], F.col("quiet_strength").alias("quiet"), (F.col("patterns_strength") * F.col("patterns_direction")).alias("patterns"), "bias_score", "setup_quality", "poc", "bin_size")


def sample_id(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_id", F.row_number().over(W.partitionBy("symbol").orderBy("idx")) - 1)


def confluence(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 1) -> DataFrame:
    """The four components; the baseline is the hand-weighted bias."""
    s = _signed(walk.scores(walk.chunks(bars, lookback, stride, horizon)))
    y = labelled(bars, horizon).select("symbol", "idx", "y")
    return sample_id(s.join(y, ["symbol", "idx"]).select("symbol", "ts", "idx", *CONFLUENCE, "y", F.col("bias_score").alias("baseline")))


def with_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    return ewm_columns(bars.withColumn("tr", F.expr(R.TRUE_RANGE)), {"atr": ("tr", 1.0 / period, period)}).drop("tr")


def enriched(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 3) -> DataFrame:
    """Components, momentum, volatility, volume trend, distance to the point of control."""
    s = _signed(walk.scores(walk.chunks(bars, lookback, stride, horizon)))
    stages = [{"_r": R.RET}, {"mom_20": f"close / {R.lag('close', 20)} - 1", "mom_60": f"close / {R.lag('close', 60)} - 1", "mom_120_20": f"{R.lag('close', 20)} / {R.lag('close', 120)} - 1", "vol_20": R.std("_r", 20), "vol_trend": f"{R.mean('volume', 10)} / {R.mean('volume', 60)} - 1"}]
    f = R.apply(labelled(with_atr(bars), horizon), stages).withColumn("atr_frac", F.col("atr") / F.col("close"))
    j = s.join(f.select("symbol", "idx", "y", "close", "atr", "mom_20", "mom_60", "mom_120_20", "vol_20", "atr_frac", "vol_trend"), ["symbol", "idx"])
    unit = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.greatest(F.col("bin_size"), F.lit(1e-9)))
    j = j.withColumn("poc_dist", (F.col("close") - F.col("poc")) / unit).dropna(subset=list(ENRICHED))
    return sample_id(j.select("symbol", "ts", "idx", *ENRICHED, "y", F.col("bias_score").alias("baseline")))


def behavioral(bars: DataFrame, horizon: int = 20, stride: int = 3, warmup: int = 63) -> DataFrame:
    """Fifteen behavioural columns; the baseline is the medium accumulation slope."""
    stages, names = R.behavioral()
    f = R.apply(labelled(bars, horizon), stages)
    f = f.filter((F.col("idx") >= warmup) & ((F.col("idx") - warmup) % stride == 0) & F.col("y").isNotNull()).dropna(subset=names)
    return sample_id(f.select("symbol", "ts", "idx", *names, "y", F.col("accum_slope_21").alias("baseline")))


def indicator(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 8) -> DataFrame:
    """Classic indicators; every stride-th of the rows that are whole."""
    from volumetra.plans.rolling import indicators

    span = f"CASE WHEN {R.w('count(*)', lookback)} = {lookback} THEN (close - {R.w('min(low)', lookback)}) / nullif({R.w('max(high)', lookback)} - {R.w('min(low)', lookback)}, 0) - 0.5 END"
    b = indicators(labelled(bars, horizon))
    b = R.apply(b, [{"ma_cross": f"({R.mean('close', 20)} - {R.mean('close', 50)}) / close", "mom_12": f"close / {R.lag('close', 12)} - 1", "fib_pos": span}])
    b = b.withColumns({"rsi": (F.col("rsi") - 50) / 50, "macd": F.col("macd_hist") / F.col("close")})
    b = b.filter(F.col("idx") >= lookback).dropna(subset=[*INDICATORS, "y"])
    b = b.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy("idx")) - 1).filter(F.col("_k") % stride == 0)
    return sample_id(b.select("symbol", "ts", "idx", *INDICATORS, "y", F.col("mom_12").alias("baseline")))


def structural(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 3) -> DataFrame:
    """The structural walk and forward returns; the baseline is the delta at the point of control."""
    s = structural_rows(bars, lookback, horizon, stride)
    y = labelled(bars, horizon).select("symbol", "idx", "y")
    return sample_id(s.join(y, ["symbol", "idx"]).select("symbol", "ts", "idx", *walk.STRUCTURE, "y", F.col("delta_poc").alias("baseline")))


def structural_rows(bars: DataFrame, lookback: int, horizon: int, stride: int) -> DataFrame:
    return walk.structural_walk(walk.chunks(with_atr(bars), lookback, stride, horizon, ("atr",)))


def _barriers(bars: DataFrame, samples: DataFrame, horizon: int, profit: float, stop: float) -> DataFrame:
    b = indexed(with_atr(bars))
    vol = b.select("symbol", "idx", (F.col("atr") / F.col("close")).alias("vol"))
    return sample_id(trading.triple_barrier(b.select("symbol", "idx", "high", "low", "close"), samples.join(vol, ["symbol", "idx"]), horizon, profit, stop).drop("vol", "exit_idx"))


def structural_meta(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 3, side: int = 1, profit: float = 2.0, stop: float = 2.0) -> DataFrame:
    """Structural features and the win or loss of a bet on one side."""
    s = structural_rows(bars, lookback, horizon, stride).select("symbol", "ts", "idx", *walk.STRUCTURE).withColumn("side", F.lit(side))
    return _barriers(bars, s, horizon, profit, stop)


def meta(bars: DataFrame, lookback: int = 120, horizon: int = 20, stride: int = 3, least_bias: float = 10.0, profit: float = 2.0, stop: float = 2.0) -> DataFrame:
    """Bars where the score leans, the side it leans to, and whether that bet won."""
    s = _signed(walk.scores(walk.chunks(bars, lookback, stride, horizon))).filter(F.abs("bias_score") >= least_bias)
    s = s.select("symbol", "ts", "idx", *CONFLUENCE, (F.col("setup_quality") / 100).alias("setup_quality"), (F.abs("bias_score") / 100).alias("bias_mag"), F.when(F.col("bias_score") > 0, 1).otherwise(-1).alias("side"))
    return _barriers(bars, s, horizon, profit, stop)


def panel(bars: DataFrame, horizon: int = 20, rebalance: int = 5, min_names: int = 5) -> DataFrame:
    """V6: every fifth date's names with all factors, ranked within the date: date_id, symbol, four ranks, y."""
    from volumetra.plans.rolling import FACTORS, centered_rank

    names = ("mom_21", "mom_252_21", "vol_60", "vol_trend")
    f = R.apply(bars, FACTORS)
    dates = bars.select("ts").distinct()
    # dates are few against bars: numbered in one small window
    dates = dates.withColumn("_d", F.row_number().over(W.orderBy("ts")) - 1).filter(F.col("_d") % rebalance == 0).select("ts")
    p = f.join(dates, "ts", "left_semi").dropna(subset=[*names, "fwd"])
    p = p.withColumn("_n", F.count("*").over(W.partitionBy("ts"))).filter(F.col("_n") >= min_names)
    p = centered_rank(p.select("symbol", "ts", *names, "fwd"), list(names))
    ids = p.select("ts").distinct().withColumn("date_id", F.row_number().over(W.orderBy("ts")) - 1)
    return p.join(F.broadcast(ids), "ts").select("date_id", "ts", "symbol", *[F.col(f"rank_{n}").alias(n) for n in names], F.col("fwd").alias("y"))
