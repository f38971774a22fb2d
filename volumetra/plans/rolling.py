"""Queries over rolling features: W1-W36, P4-P10, A4, A18."""

from __future__ import annotations

from pyspark.sql import functions as F

from volumetra.functions import rolling as R
from volumetra.functions.ewm import ewm_columns
from volumetra.plans.registry import DUCK, TS, query, staged
from volumetra.sources.bars import VIEWS


def feature(name: str, stages: list[R.Stage], columns: list[str], view: str = "event", digits: int = 6, where: str = "") -> None:
    """A query that returns columns, rounded, for every bar of a view, and the same in DuckDB."""
    rounded = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns]

    def run(spark, sf_dir):
        out = R.apply(VIEWS[view](spark, sf_dir), stages)
        out = out.filter(where) if where else out
        return out.select("symbol", F.col("ts").cast("string").alias("ts"), *[F.expr(x) for x in rounded])

    query(name, staged(view, stages, f"symbol, {TS}, {', '.join(rounded)}", f"WHERE {where}" if where else ""))(run)


feature("p4_close_location_clipped", [{"clv": R.CLV_CLIPPED}], ["clv"])
feature("p5_close_location", [{"clv": R.CLV}], ["clv"])
feature("p6_typical_price", [{"typical": "(high + low + close) / 3"}], ["typical"])
feature("p8_cost_model", [{"buy_fill": "close * (1 + (5.0 + 2.0 / 2) / 1e4)", "sell_fill": "close * (1 - (5.0 + 2.0 / 2) / 1e4)", "commission": "close * 100 * 1.5 / 1e4 + 100 * 0.005"}], ["buy_fill", "sell_fill", "commission"])
feature("p9_forward_return", [{"fwd": f"{R.lead('close', 20)} / close - 1"}], ["fwd"])
feature("p10_stride_from_warmup", [{"idx": f"row_number() OVER ({R.ORDER}) - 1"}], ["idx", "close"], where="idx >= 63 AND (idx - 63) % 3 = 0")
feature(
    "p10_stride_after_filter",
    [{"idx": f"row_number() OVER ({R.ORDER}) - 1", "fwd": f"{R.lead('close', 20)} / close - 1"}, {"keep": "CASE WHEN idx >= 120 AND fwd IS NOT NULL THEN 1 ELSE 0 END"}, {"k": f"sum(keep) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}],
    ["idx", "fwd"],
    where="keep = 1 AND (k - 1) % 8 = 0",
)
feature("w1_true_range", [{"tr": R.TRUE_RANGE}], ["tr"])
feature("w3_atr_sma", R.atr_sma(), ["atr_sma"])
feature("w5_rolling_slope", R.slope("close", 20), ["slope"])
feature("w6_bollinger_bandwidth", R.bandwidth(), ["bandwidth"])
feature("w16_zscore", [{"z": R.zscore("volume", 20)}], ["z"])
feature("w17_relative_volume", R.relative_volume(), ["rvol"])
feature("w18_absorption", R.absorption(), ["absorption"])
feature("w19_clv_pressure", R.clv_pressure(), ["clv_pressure"])
feature("w20_accumulation_slope", R.accumulation(), ["accum_slope"])
feature("w21_liquidity_grab", R.liquidity_grab(), ["liquidity_grab"])
feature("w22_wick_asymmetry", R.wick_asymmetry(), ["wick_asym"])
feature("w23_price_extension", R.price_extension(), ["price_ext"])
feature("w24_fomo_thrust", R.fomo_thrust(), ["fomo_thrust"])
feature("w25_volatility_expansion", R.volatility_expansion(), ["vol_expansion"])
feature("w26_trend_emergence", R.trend_emergence(), ["trend_emergence"])
feature("w27_conviction_shift", R.conviction_shift(), ["conviction_shift"])
_BEHAVIORAL, BEHAVIORAL_COLUMNS = R.behavioral()
feature("w28_behavioral_frame", _BEHAVIORAL, BEHAVIORAL_COLUMNS, view="nation")
feature(
    "w30_classic_window_indicators",
    [{"ma_cross": f"({R.mean('close', 20)} - {R.mean('close', 50)}) / close", "mom_12": f"close / {R.lag('close', 12)} - 1",
      "fib_pos": f"CASE WHEN {R.w('count(*)', 120)} = 120 THEN (close - {R.w('min(low)', 120)}) / nullif({R.w('max(high)', 120)} - {R.w('min(low)', 120)}, 0) - 0.5 END"}],
    ["ma_cross", "mom_12", "fib_pos"],
)
MOMENTUM = [
    {"_r": R.RET},
    {"mom_20": f"close / {R.lag('close', 20)} - 1", "mom_60": f"close / {R.lag('close', 60)} - 1", "mom_120_20": f"{R.lag('close', 20)} / {R.lag('close', 120)} - 1", "vol_20": R.std("_r", 20), "vol_trend": f"{R.mean('volume', 10)} / {R.mean('volume', 60)} - 1"},
]
feature("w31_momentum_volatility", MOMENTUM, ["mom_20", "mom_60", "mom_120_20", "vol_20", "vol_trend"])
FACTORS = [
    {"_r": R.RET},
    {"mom_21": f"close / {R.lag('close', 21)} - 1", "mom_252_21": f"{R.lag('close', 21)} / {R.lag('close', 252)} - 1", "vol_60": R.std("_r", 60), "vol_trend": f"{R.mean('volume', 20)} / {R.mean('volume', 60)} - 1", "fwd": f"{R.lead('close', 20)} / close - 1"},
]
feature("w32_cross_sectional_factors", FACTORS, ["mom_21", "mom_252_21", "vol_60", "vol_trend", "fwd"], view="nation")


# --- percentile ranks, quiet score, runs ------------------------------------


def rank_of(x: str, k: int) -> str:
    """Spark: share of the last k bars at or below x; missing bars count in the denominator."""
    least = max(3, k // 4)
    return f"CASE WHEN {R.w(f'count({x})', k)} >= {least} AND {x} IS NOT NULL THEN size(filter({R.w(f'collect_list({x})', k)}, v -> v <= {x})) / {R.w('count(*)', k)} END"


def duck_rank_of(x: str, k: int) -> str:
    least = max(3, k // 4)
    return f"CASE WHEN {R.w(f'count({x})', k)} >= {least} AND {x} IS NOT NULL THEN len(list_filter({R.w(f'list({x})', k)}, lambda v: v <= {x})) / {R.w('count(*)', k)} END"


def percentile_rank(spark, sf_dir):
    b = VIEWS["event"](spark, sf_dir)
    return b.withColumn("rank", F.expr(rank_of("volume", 60))).select("symbol", F.col("ts").cast("string").alias("ts"), F.round("rank", 6).alias("rank"))


query("w4_percentile_rank", staged("event", [{"rank": duck_rank_of("volume", 60)}], f"symbol, {TS}, round(rank, 6) AS rank"))(percentile_rank)


def duck_ewm(x: str, alpha: float, least: int) -> str:
    """Fold of all values so far."""
    run = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN len({run}) >= {least} THEN list_reduce({run}, lambda a, v: a + {alpha!r} * (v - a)) END"


def with_atr(bars, period: int = 14):
    return ewm_columns(bars.withColumn("tr", F.expr(R.TRUE_RANGE)), {"atr": ("tr", 1.0 / period, period)})


ATR_STAGES = [{"tr": R.TRUE_RANGE}, {"atr": duck_ewm("tr", 1.0 / 14, 14)}]


@query("w2_atr_wilder", staged("event", ATR_STAGES, f"symbol, {TS}, round(atr, 6) AS atr"))
def atr_wilder(spark, sf_dir):
    return with_atr(VIEWS["event"](spark, sf_dir)).select("symbol", F.col("ts").cast("string").alias("ts"), F.round("atr", 6).alias("atr"))


@query(
    "w29_rsi_macd",
    staged(
        "event",
        [{"d": f"close - {R.lag('close')}"}, {"up_": "greatest(d, 0.0) + 0 * d", "dn_": "greatest(-d, 0.0) + 0 * d"}, {"up": duck_ewm("up_", 1.0 / 14, 14), "dn": duck_ewm("dn_", 1.0 / 14, 14), "fast": duck_ewm("close", 2.0 / 13, 1), "slow": duck_ewm("close", 2.0 / 27, 1)}, {"macd": "fast - slow"}, {"signal": duck_ewm("macd", 2.0 / 10, 1)}],
        f"symbol, {TS}, round(CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) END, 5) AS rsi, round(macd - signal, 5) AS macd_hist",
    ),
)
def rsi_macd(spark, sf_dir):
    return indicators(VIEWS["event"](spark, sf_dir)).select("symbol", F.col("ts").cast("string").alias("ts"), F.round("rsi", 5).alias("rsi"), F.round("macd_hist", 5).alias("macd_hist"))


def indicators(bars):
    """bars with rsi and macd_hist."""
    b = bars.withColumn("d", F.expr(f"close - {R.lag('close')}"))
    b = b.withColumn("up_", F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0)))).withColumn("dn_", F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0))))
    b = ewm_columns(b, {"up": ("up_", 1.0 / 14, 14), "dn": ("dn_", 1.0 / 14, 14), "fast": ("close", 2.0 / 13, 1), "slow": ("close", 2.0 / 27, 1)})
    b = ewm_columns(b.withColumn("macd", F.col("fast") - F.col("slow")), {"signal": ("macd", 0.2, 1)})
    return b.withColumn("rsi", F.when(F.col("dn") > 0, 100 - 100 / (1 + F.col("up") / F.col("dn")))).withColumn("macd_hist", F.col("macd") - F.col("signal"))


def quiet_stages(rank, ewm) -> list[R.Stage]:
    """From bars with tr; rank and ewm are the dialect's."""
    return [
        {"volume_ma": R.mean("volume", 20, 10), **R.bandwidth()[0]},
        {"atr_pctile": rank("atr", 100), "volume_pctile": rank("volume_ma", 100), "range_pctile": rank("bandwidth", 100)},
        {"quiet_score": "100 * (3 - atr_pctile - volume_pctile - range_pctile) / 3"},
        {"is_quiet": "coalesce(round(quiet_score, 9) >= 60, false)"},
        {"breaks": f"sum(CASE WHEN is_quiet THEN 0 ELSE 1 END) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"bars_in_state": "CAST(sum(CASE WHEN is_quiet THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, breaks ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"},
    ]


def quiet_frame(bars):
    """Quiet-phase columns of every bar."""
    return R.apply(with_atr(bars), quiet_stages(rank_of, None))


DUCK_QUIET = [*ATR_STAGES, *quiet_stages(duck_rank_of, duck_ewm)]


@query("w7_quiet_score", staged("event", DUCK_QUIET, f"symbol, {TS}, round(atr_pctile, 6) AS atr_pctile, round(volume_pctile, 6) AS volume_pctile, round(range_pctile, 6) AS range_pctile, round(quiet_score, 5) AS quiet_score, is_quiet"))
def quiet_score(spark, sf_dir):
    q = quiet_frame(VIEWS["event"](spark, sf_dir))
    return q.select("symbol", F.col("ts").cast("string").alias("ts"), *[F.round(c, 6).alias(c) for c in ("atr_pctile", "volume_pctile", "range_pctile")], F.round("quiet_score", 5).alias("quiet_score"), "is_quiet")


@query("w8_run_length", staged("event", DUCK_QUIET, f"symbol, {TS}, is_quiet, bars_in_state"))
def run_length(spark, sf_dir):
    return quiet_frame(VIEWS["event"](spark, sf_dir)).select("symbol", F.col("ts").cast("string").alias("ts"), "is_quiet", "bars_in_state")


@query("w9_quiet_segments", staged("event", DUCK_QUIET, 'symbol, CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts, count(*) AS n_bars', "WHERE is_quiet GROUP BY symbol, breaks"))
def quiet_segments(spark, sf_dir):
    q = quiet_frame(VIEWS["event"](spark, sf_dir)).filter("is_quiet")
    return q.groupBy("symbol", "breaks").agg(F.min("ts").cast("string").alias("start_ts"), F.max("ts").cast("string").alias("end_ts"), F.count("*").alias("n_bars")).drop("breaks")


@query(
    "w10_latest_reading",
    staged("event", DUCK_QUIET, f"symbol, {TS}, round(coalesce(quiet_score, 0), 5) AS quiet_score, is_quiet, bars_in_state, CASE WHEN is_quiet THEN 'Quiet phase' WHEN coalesce(atr_pctile <= 0.4, false) OR coalesce(volume_pctile <= 0.4, false) OR coalesce(range_pctile <= 0.4, false) THEN 'Mixed' ELSE 'Active / normal' END AS reading", "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"),
)
def latest_reading(spark, sf_dir):
    """The last bar of each symbol, by an aggregate: no sort of the history."""
    q = quiet_frame(VIEWS["event"](spark, sf_dir))
    last = q.groupBy("symbol").agg(F.max_by(F.struct(*q.columns[1:]), "ts").alias("s")).select("symbol", "s.*")
    low = F.lit(False)
    for c in ("atr_pctile", "volume_pctile", "range_pctile"):
        low = low | F.coalesce(F.col(c) <= 0.4, F.lit(False))
    reading = F.when(F.col("is_quiet"), "Quiet phase").when(low, "Mixed").otherwise("Active / normal")
    return last.select("symbol", F.col("ts").cast("string").alias("ts"), F.round(F.coalesce("quiet_score", F.lit(0.0)), 5).alias("quiet_score"), "is_quiet", "bars_in_state", reading.alias("reading"))


# --- volume patterns --------------------------------------------------------

_RUN = "sum(CASE WHEN {f} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DRY = [{"m20": R.mean("volume", 20, 10), "m60": R.mean("volume", 60, 30)}, {"dry": "m20 / nullif(m60, 0)"}, {"flag": "coalesce(dry <= 0.9, false)"}, {"island": _RUN.format(f="flag")}]
CLIMAX = [{"m20": R.mean("volume", 20, 10)}, {"ratio": "volume / nullif(m20, 0)", "wide": "(high - low) / nullif(atr, 0)"}, {"flag": "coalesce(ratio >= 1.6 AND wide >= 1.1, false)"}, {"island": _RUN.format(f="flag")}]
_PS, _VS = R.renamed(R.slope("close", 20), "p", {"slope": "price_slope"}), R.renamed(R.slope("volume", 20), "v", {"slope": "volume_slope"})
DIVERGENCE = [
    _PS[0] | _VS[0],
    _PS[1] | _VS[1],
    {"ps": f"price_slope / {R.mean('close', 20)}", "vs": f"volume_slope / nullif({R.mean('volume', 20)}, 0)"},
    {"bear": "coalesce(ps > 5e-4 AND vs < -5e-4, false)", "bull": "coalesce(ps < -5e-4 AND vs < -5e-4, false)"},
    {"flag": "bear OR bull", "kind": "CASE WHEN bear THEN 'bearish' WHEN bull THEN 'bullish' ELSE 'none' END"},
    {"change": f"CASE WHEN kind = {R.lag('kind')} THEN 0 ELSE 1 END"},
    {"island": f"sum(change) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
]


def accumulation_stages(median: str) -> list[R.Stage]:
    return [
        {"m20": R.mean("volume", 20, 10), "base": R.mean("volume", 60), "move": f"abs(close - {R.lag('close', 20)})", "span": f"CASE WHEN {R.w('count(*)', 20)} = 20 THEN ({R.w('max(high)', 20)} - {R.w('min(low)', 20)}) / close END"},
        {"norm": R.least_seen("span", 60, 60, R.w(median, 60))},
        {"flag": "coalesce(move < 2 * atr AND span < norm AND m20 < base, false)", "depth": "greatest(0.0, least(1.0, 1 - m20 / nullif(base, 0)))"},
        {"island": _RUN.format(f="flag")},
    ]


def events_of(flagged, least: int, anchor, extra):
    g = flagged.filter("flag").groupBy("symbol", "island").agg(F.min("ts").cast("string").alias("start_ts"), F.max("ts").cast("string").alias("end_ts"), F.count("*").alias("n_bars"), anchor.cast("string").alias("anchor_ts"), *extra)
    return g.filter(F.col("n_bars") >= least).drop("island")


_SPAN = "CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts, count(*) AS n_bars"


@query("w11_pattern_dry_up", staged("event", DRY, f"symbol, {_SPAN}, CAST(arg_min(ts, row(round(dry, 9), ts)) AS VARCHAR) AS anchor_ts, round(1 - min(dry), 5) AS strength", "WHERE flag GROUP BY symbol, island HAVING count(*) >= 3"))
def dry_up(spark, sf_dir):
    b = R.apply(VIEWS["event"](spark, sf_dir), DRY)
    return events_of(b, 3, F.min_by("ts", F.struct(F.round("dry", 9), "ts")), [F.round(1 - F.min("dry"), 5).alias("strength")])


@query("w12_pattern_climax", staged("event", [*ATR_STAGES, *CLIMAX], f"symbol, {_SPAN}, CAST(arg_max(ts, row(round(ratio, 9), -epoch(ts))) AS VARCHAR) AS anchor_ts, round(max(ratio), 5) AS strength, CASE WHEN arg_max(close >= open, row(round(ratio, 9), -epoch(ts))) THEN 'bearish' ELSE 'bullish' END AS direction", "WHERE flag GROUP BY symbol, island"))
def climax(spark, sf_dir):
    b = R.apply(with_atr(VIEWS["event"](spark, sf_dir)), CLIMAX)
    first = F.struct(F.round("ratio", 9), -F.unix_timestamp("ts"))
    up = F.max_by(F.col("close") >= F.col("open"), first)
    return events_of(b, 1, F.max_by("ts", first), [F.round(F.max("ratio"), 5).alias("strength"), F.when(up, "bearish").otherwise("bullish").alias("direction")])


@query("w13_pattern_divergence", staged("event", DIVERGENCE, f"symbol, {_SPAN}, CAST(max(ts) AS VARCHAR) AS anchor_ts, min(kind) AS direction, round(abs(arg_max(vs, ts)) / 5e-4, 3) AS strength", "WHERE flag GROUP BY symbol, island HAVING count(*) >= 3"))
def divergence(spark, sf_dir):
    b = R.apply(VIEWS["event"](spark, sf_dir), DIVERGENCE)
    return events_of(b, 3, F.max("ts"), [F.min("kind").alias("direction"), F.round(F.abs(F.max_by("vs", "ts")) / 5e-4, 3).alias("strength")])


@query("w14_pattern_accumulation", staged("event", [*ATR_STAGES, *accumulation_stages("quantile_cont(span, 0.5)")], f"symbol, {_SPAN}, CAST(max(ts) AS VARCHAR) AS anchor_ts, round(arg_max(depth, ts), 5) AS strength", "WHERE flag GROUP BY symbol, island HAVING count(*) >= 5"))
def accumulation(spark, sf_dir):
    b = R.apply(with_atr(VIEWS["event"](spark, sf_dir)), accumulation_stages("percentile(span, 0.5)"))
    return events_of(b, 5, F.max("ts"), [F.round(F.max_by("depth", "ts"), 5).alias("strength")])


# --- cross-sectional rank, sampled windows, drawdown, autocorrelation -------


def centered_rank(bars, columns):
    """Centred average rank of each column among the symbols of a date."""
    n = "count(*) OVER (PARTITION BY ts)"
    for c in columns:
        r = f"(rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0 - 1)"
        bars = bars.withColumn(f"rank_{c}", F.expr(f"CAST(CASE WHEN {n} < 2 THEN 0.0 ELSE CAST({r} AS DOUBLE) / ({n} - 1) - 0.5 END AS DOUBLE)"))
    return bars


@query(
    "w33_centered_rank",
    f"WITH {DUCK['nation']} SELECT symbol, {TS}, round(CASE WHEN count(*) OVER (PARTITION BY ts) < 2 THEN 0.0 ELSE (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY ts) - 1) - 0.5 END, 6) AS rank_volume FROM bars",
)
def centered(spark, sf_dir):
    return centered_rank(VIEWS["nation"](spark, sf_dir), ["volume"]).select("symbol", F.col("ts").cast("string").alias("ts"), F.round("rank_volume", 6).alias("rank_volume"))


_SAMPLED = [{"idx": f"row_number() OVER ({R.ORDER}) - 1"}]
_Z = "CASE WHEN count(close) OVER ({o} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN coalesce((close - avg(close) OVER ({o} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) / nullif(stddev_pop(close) OVER ({o} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 0) ELSE 0 END".format(o=R.ORDER)
_POC_SLOPE = "CASE WHEN count(close) OVER ({o} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN regr_slope(close, CAST(idx AS DOUBLE) / 3) OVER ({o} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / close ELSE 0 END".format(o=R.ORDER)


@query("w34_sampled_windows", f"WITH {DUCK['event']}, i AS (SELECT *, row_number() OVER ({R.ORDER}) - 1 AS idx FROM bars), s AS (SELECT * FROM i WHERE idx % 3 = 0) SELECT symbol, {TS}, round({_Z}, 5) AS z20, round({_POC_SLOPE}, 6) AS slope5 FROM s")
def sampled_windows(spark, sf_dir):
    """Windows over every third bar: the z-score of the previous 20 samples, the slope of the last five."""
    b = R.apply(VIEWS["event"](spark, sf_dir), _SAMPLED).filter("idx % 3 = 0")
    return b.select("symbol", F.col("ts").cast("string").alias("ts"), F.round(F.expr(_Z), 5).alias("z20"), F.round(F.expr(_POC_SLOPE), 6).alias("slope5"))


_DD = [{"peak": f"max(close) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"drawdown": "close / peak - 1"}]
feature("w35_running_peak", _DD, ["peak", "drawdown"])


@query("a21_drawdown_sharpe", staged("event", [*_DD, {"r": R.RET}], "symbol, round(min(drawdown) * 100, 5) AS max_drawdown_pct, round(avg(r) / stddev_samp(r) * sqrt(252.0), 5) AS sharpe", "GROUP BY symbol"))
def drawdown_sharpe(spark, sf_dir):
    b = R.apply(VIEWS["event"](spark, sf_dir), [*_DD, {"r": R.RET}])
    return b.groupBy("symbol").agg(F.round(F.min("drawdown") * 100, 5).alias("max_drawdown_pct"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0)), 5).alias("sharpe"))


_AC = [{"r": R.RET}, {"x": "r - avg(r) OVER (PARTITION BY symbol)"}, {f"x{k}": R.lag("x", k) for k in range(1, 6)} | {"x": "x"}]
_AC_OUT = ", ".join(f"round(sum(x * x{k}) / sum(x * x), 6) AS rho_{k}" for k in range(1, 6))


@query("w36_autocorrelation", f"WITH {DUCK['event']}, a AS (SELECT *, {R.RET} AS r FROM bars), b AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol) AS x FROM a), c AS (SELECT *, {', '.join(R.lag('x', k) + f' AS x{k}' for k in range(1, 6))} FROM b) SELECT symbol, {_AC_OUT} FROM c GROUP BY symbol")
def autocorrelation(spark, sf_dir):
    b = R.apply(VIEWS["event"](spark, sf_dir), [_AC[0], _AC[1], {f"x{k}": R.lag("x", k) for k in range(1, 6)}])
    return b.groupBy("symbol").agg(*[F.expr(x.split(" AS ")[0]).alias(x.split(" AS ")[1]) for x in _AC_OUT.split(", round")[0:1]], *[F.expr("round" + x.split(" AS ")[0]).alias(x.split(" AS ")[1]) for x in _AC_OUT.split(", round")[1:]])


@query("a4_mean_true_range", staged("event", [{"tr": R.TRUE_RANGE}, {"back": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"}], "symbol, round(avg(tr), 6) AS atr", "WHERE back <= 14 GROUP BY symbol"))
def mean_true_range(spark, sf_dir):
    b = R.apply(VIEWS["event"](spark, sf_dir), [{"tr": R.TRUE_RANGE}, {"back": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"}])
    return b.filter("back <= 14").groupBy("symbol").agg(F.round(F.avg("tr"), 6).alias("atr"))


def resample_weekly(bars):
    """Calendar weeks, labelled by their Sunday."""
    end = F.date_add(F.date_trunc("week", F.date_sub(F.col("ts"), 0)).cast("date"), 6)
    return bars.groupBy("symbol", end.alias("week_end")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


_WEEKLY = "SELECT symbol, CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS VARCHAR) AS week_end, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY 1, 2"


@query("a18_calendar_resample", f"WITH {DUCK['flag']} {_WEEKLY}")
def calendar_resample(spark, sf_dir):
    w = resample_weekly(VIEWS["flag"](spark, sf_dir))
    return w.select("symbol", F.col("week_end").cast("string").alias("week_end"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])
