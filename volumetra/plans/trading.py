"""Queries over labels, backtests, datasets and streams: M1, A20, A21, C12-C17, V2, ST."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.operators import datasets, trading
from volumetra.plans.registry import EVENT, FLAG, TS, query
from volumetra.sources import bars as B


def tstr():
    return F.col("ts").cast("string").alias("ts")


_IDX = f"{EVENT}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
_BARRIERS = f"""WITH {_IDX}, e AS (SELECT symbol, idx, n, CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END AS side, close AS entry, CASE WHEN high > low THEN (high - low) / close / 4 ELSE 0.01 END AS v FROM i WHERE idx % 3 = 0),
 j AS (SELECT e.*, b.idx AS seen, b.close, CASE WHEN side = 1 THEN b.low <= entry * (1 - 2 * v) ELSE b.high >= entry * (1 + 2 * v) END AS dn, CASE WHEN side = 1 THEN b.high >= entry * (1 + 2 * v) ELSE b.low <= entry * (1 - 2 * v) END AS up FROM e LEFT JOIN i b ON e.symbol = b.symbol AND b.idx BETWEEN e.idx + 1 AND e.idx + 10),
 g AS (SELECT symbol, idx, side, any_value(entry) AS entry, any_value(v) AS v, arg_min(CASE WHEN dn THEN -1 ELSE 1 END, seen) FILTER (WHERE dn OR up) AS hit, min(seen) FILTER (WHERE dn OR up) AS hit_at, max(seen) AS last_at, arg_max(close, seen) AS last_close FROM j GROUP BY 1, 2, 3),
 r AS (SELECT *, CASE coalesce(hit, 0) WHEN 1 THEN entry * (1 + side * 2 * v) WHEN -1 THEN entry * (1 - side * 2 * v) ELSE coalesce(last_close, entry) END AS price FROM g)
 SELECT symbol, idx, side, coalesce(hit, 0) AS outcome, round(side * (price - entry) / entry, 6) AS ret, CAST(side * (price - entry) / entry > 0 AS INT) AS win, coalesce(hit_at, last_at, idx) AS exit_idx FROM r"""


def barrier_events(spark, sf_dir):
    b = B.indexed(B.event_hourly(spark, sf_dir))
    e = b.filter("idx % 3 = 0").select("symbol", "idx", F.when(F.col("idx") % 2 == 0, 1).otherwise(-1).alias("side"), F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / F.col("close") / 4).otherwise(0.0).alias("vol"))
    return trading.triple_barrier(b, e, 10)


@query("m1_triple_barrier", _BARRIERS)
def triple_barrier(spark, sf_dir):
    return barrier_events(spark, sf_dir).select("symbol", F.col("idx").cast("long").alias("idx"), "side", "outcome", F.round("ret", 6).alias("ret"), "win", F.col("exit_idx").cast("long").alias("exit_idx"))


@query("j9_first_touch", f"WITH x AS ({_BARRIERS}) SELECT symbol, outcome, count(*) AS n, round(avg(exit_idx - idx), 5) AS mean_bars FROM x GROUP BY 1, 2")
def first_touch(spark, sf_dir):
    return barrier_events(spark, sf_dir).groupBy("symbol", "outcome").agg(F.count("*").alias("n"), F.round(F.avg(F.col("exit_idx") - F.col("idx")), 5).alias("mean_bars"))


@query("a20_trade_statistics", f"WITH x AS ({_BARRIERS}) SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(sum(ret) FILTER (WHERE ret > 0) / -sum(ret) FILTER (WHERE ret < 0), 4) AS profit_factor, round(avg(ret), 6) AS expectancy FROM x GROUP BY symbol")
def trade_statistics(spark, sf_dir):
    t = barrier_events(spark, sf_dir).select("symbol", F.round("ret", 6).alias("pnl"), F.lit(0.0).alias("r_multiple"))
    s = trading.trade_stats(t, ["symbol"])
    return s.select("symbol", "n_trades", F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 4).alias("profit_factor"), F.round("expectancy", 6).alias("expectancy"))


def _trades(spark, sf_dir, what="trades", style="reversion", lookback=120, stride=1):
    b = B.event_hourly(spark, sf_dir)
    return trading.backtest(b, trading.candidate_signals(b, lookback, stride, style), what, lookback=lookback, stride=stride)


@query("c12_walk_forward_trades")
def walk_forward_trades(spark, sf_dir):
    t = _trades(spark, sf_dir)
    return t.select("symbol", "side", "entry_idx", "exit_idx", F.round("entry_price", 4).alias("entry_price"), F.round("exit_price", 4).alias("exit_price"), "size", F.round("pnl", 4).alias("pnl"), "exit_reason", "bars_held")


@query("c12_equity_curve")
def equity_curve(spark, sf_dir):
    return _trades(spark, sf_dir, "curve").select("symbol", "idx", tstr(), F.round("equity", 4).alias("equity"))


@query("c12_backtest_summary")
def backtest_summary(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir)
    s = trading.candidate_signals(b, 120)
    t = trading.trade_stats(trading.backtest(b, s, "trades"), ["symbol"])
    c = trading.curve_stats(trading.backtest(b, s, "curve"), ["symbol"], "1h")
    return c.join(t, "symbol", "left").select("symbol", "n_bars", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.round((F.col("final_equity") / 10000 - 1) * 100, 4).alias("total_return_pct"), "max_drawdown_pct", "sharpe", "win_rate", "profit_factor", "expectancy", "avg_r")


@query("c13_style_sweep")
def style_sweep(spark, sf_dir):
    """Every symbol under every style: one plan, a union of two signal sets over the same bars."""
    out = None
    for style in ("reversion", "breakout"):
        s = trading.trade_stats(_trades(spark, sf_dir, style=style), ["symbol"]).withColumn("style", F.lit(style))
        out = s if out is None else out.unionByName(s)
    return out


_FILLS = f"""WITH {_IDX}, s AS (SELECT symbol, idx, n, close * 0.6 AS stop, close * 1.3 AS target FROM i WHERE idx % 10 = 0),
 e AS (SELECT s.symbol, b.idx AS e, s.n, b.open AS entry, stop, target FROM s JOIN i b ON s.symbol = b.symbol AND b.idx = s.idx + 1 WHERE b.open > stop),
 x AS (SELECT e.*, b.idx AS seen, CASE WHEN b.idx > e AND b.open <= stop THEN row(b.open, 'stop') WHEN b.idx > e AND b.open >= target THEN row(b.open, 'target') WHEN b.low <= stop THEN row(stop, 'stop') WHEN b.high >= target THEN row(target, 'target') WHEN b.idx = e + 3 THEN row(b.close, 'time') WHEN b.idx = e.n - 1 THEN row(b.close, 'end') END AS o FROM e JOIN i b ON e.symbol = b.symbol AND b.idx BETWEEN e AND e + 3)
 SELECT symbol, e AS entry_idx, min(seen) AS exit_idx, round(any_value(entry), 5) AS entry_price, round(arg_min(o[1], seen), 5) AS exit_price, arg_min(o[2], seen) AS exit_reason FROM x WHERE o IS NOT NULL GROUP BY symbol, e"""


@query("c12_fill_machine", _FILLS)
def fill_machine(spark, sf_dir):
    """Fills of a rule that SQL can say: long at each tenth bar, out after three, so that no two trades meet."""
    b = B.event_hourly(spark, sf_dir)
    s = B.indexed(b).filter("idx % 10 = 0").select("symbol", F.col("idx").cast("int").alias("idx"), F.lit(1).alias("side"), (F.col("close") * 0.6).alias("stop"), (F.col("close") * 1.3).alias("target"))
    t = trading.backtest(b, s, "trades", lookback=1, max_hold=3, slippage=0.0, cash=1e12, risk=1e-6)
    return t.select("symbol", F.col("entry_idx").cast("long").alias("entry_idx"), F.col("exit_idx").cast("long").alias("exit_idx"), F.round("entry_price", 5).alias("entry_price"), F.round("exit_price", 5).alias("exit_price"), "exit_reason")


@query("v2_backtest_paths")
def backtest_paths(spark, sf_dir):
    """The backtest of each sixth of the history with a warm-up before it; paths are means over every two sixths."""
    b = B.indexed(B.event_hourly(spark, sf_dir))
    lookback = 120
    b = b.withColumn("g", F.ntile(6).over(W.partitionBy("symbol").orderBy("ts")) - 1)
    edge = b.groupBy("symbol", "g").agg(F.min("idx").alias("a"), F.max("idx").alias("z")).filter(F.col("a") >= lookback)
    # each group's bars and its warm-up, as a symbol of its own
    parts = b.drop("g").join(edge, "symbol").filter((F.col("idx") >= F.col("a") - lookback) & (F.col("idx") <= F.col("z")))
    parts = parts.select(F.concat_ws("#", "symbol", "g").alias("symbol"), "ts", *B.OHLCV)
    s = trading.candidate_signals(parts, lookback)
    c = trading.curve_stats(trading.backtest(parts, s, "curve"), ["symbol"], "1h")
    r = c.select(F.split("symbol", "#")[0].alias("symbol"), F.split("symbol", "#")[1].cast("int").alias("g"), ((F.col("final_equity") / 10000 - 1) * 100).alias("ret"), "sharpe")
    paths = spark.createDataFrame([(i, g) for i, k in enumerate(combinations(range(6), 2)) for g in k], "path int, g int")
    p = r.join(F.broadcast(paths), "g").groupBy("symbol", "path").agg(F.count("*").alias("k"), F.avg("ret").alias("ret"), F.avg("sharpe").alias("sharpe")).filter("k = 2")
    return p.groupBy("symbol").agg(F.count("*").alias("n_paths"), F.avg("ret").alias("return_mean"), F.expr("percentile(ret, 0.5)").alias("return_median"), F.stddev_pop("ret").alias("return_std"), F.min("ret").alias("return_min"), F.max("ret").alias("return_max"), (F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_paths_profitable"))


def _rounded(df, skip=("symbol", "ts", "idx", "sample_id", "side", "outcome", "win", "date_id")):
    return df.select(*[tstr() if c == "ts" else F.round(c, 6).alias(c) if c not in skip else F.col(c) for c in df.columns])


def _dataset(name, build, view, **settings):
    def run(spark, sf_dir):
        return _rounded(build(B.VIEWS[view](spark, sf_dir), **settings))

    query(name)(run)


_dataset("c14_structural_walk", lambda b: datasets.structural_rows(b, 120, 20, 6).drop("shape"), "event")
_dataset("c15_structural_dataset", datasets.structural, "event")
_dataset("c15_structural_meta_dataset", datasets.structural_meta, "event")
_dataset("c16_confluence_dataset", datasets.confluence, "event")
_dataset("c16_enriched_dataset", datasets.enriched, "event")
_dataset("c16_meta_dataset", datasets.meta, "event")
_dataset("c16_indicator_dataset", datasets.indicator, "event")


def _behavioral_oracle():
    from volumetra.functions import rolling as R
    from volumetra.plans.registry import staged

    stages, names = R.behavioral()
    first = [{"idx": f"row_number() OVER ({R.ORDER}) - 1", "y": f"{R.lead('close', 20)} / close - 1"}]
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    cols = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return staged("event", [*first, *stages], f"symbol, {TS}, idx, {cols}, round(y, 6) AS y, round(accum_slope_21, 6) AS baseline, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS sample_id", f"WHERE idx >= 63 AND (idx - 63) % 3 = 0 AND y IS NOT NULL AND {whole}")


@query("c16_behavioral_dataset", _behavioral_oracle())
def behavioral_dataset(spark, sf_dir):
    d = datasets.behavioral(B.event_hourly(spark, sf_dir))
    return _rounded(d.withColumns({c: F.col(c).cast("long") for c in ("idx", "sample_id")}))


@query("c17_multi_timeframe_feature", f"WITH {FLAG}, w AS (SELECT symbol, CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS TIMESTAMP) AS wk, sum(volume) AS volume FROM bars GROUP BY 1, 2), f AS (SELECT symbol, wk, CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY wk ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 8 THEN volume / (avg(volume) OVER (PARTITION BY symbol ORDER BY wk ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) + 1e-12) - 1 END AS rvol FROM w), l AS (SELECT symbol, wk, lag(rvol) OVER (PARTITION BY symbol ORDER BY wk) AS prev FROM f), z AS (SELECT * FROM l WHERE prev IS NOT NULL) SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, round(z.prev, 6) AS rvol_weekly FROM bars b ASOF LEFT JOIN z ON b.symbol = z.symbol AND b.ts >= z.wk")
def multi_timeframe(spark, sf_dir):
    """A feature of weekly bars on daily ones, a whole week late."""
    from volumetra.functions import rolling as R
    from volumetra.operators import align
    from volumetra.plans.rolling import resample_weekly

    b = B.flag_daily(spark, sf_dir)
    w = resample_weekly(b).withColumn("ts", F.col("week_end").cast("timestamp"))
    w = R.apply(w, R.relative_volume(8)).withColumn("rvol", F.lag("rvol").over(W.partitionBy("symbol").orderBy("ts")))
    return align.asof(b, w.select("symbol", "ts", "rvol"), ["rvol"]).select("symbol", tstr(), F.round("rvol", 6).alias("rvol_weekly"))


# --- streams ----------------------------------------------------------------


@query("st1_streaming_bars", f"WITH {EVENT} SELECT symbol, {TS}, round(high, 6) AS high, round(low, 6) AS low, round(volume, 6) AS volume FROM bars")
def streaming_bars(spark, sf_dir):
    """Hourly bars by a watermarked stream over the tick files, run to its end; equal to the batch."""
    from volumetra.streaming.bars import finished_bars

    return finished_bars(spark, sf_dir).select("symbol", tstr(), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), F.round("volume", 6).alias("volume"))


@query("st2_streaming_sessions", "WITH t AS (SELECT event_type AS symbol, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS gap FROM events), s AS (SELECT symbol, ts, sum(gap) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t) SELECT symbol, CAST(min(ts) AS VARCHAR) AS start_ts, count(*) AS ticks FROM s GROUP BY symbol, k")
def streaming_sessions(spark, sf_dir):
    from volumetra.streaming.bars import finished_sessions

    return finished_sessions(spark, sf_dir, "90 minutes").select("symbol", F.col("start_ts").cast("string").alias("start_ts"), "ticks")


@query("st3_streaming_fills", f"SELECT * FROM ({_FILLS}) WHERE exit_reason <> 'end'")
def streaming_fills(spark, sf_dir):
    """The fill machine over a stream of bars and signals, its state kept from one file to the next: the batch's closed trades."""
    from volumetra.streaming.bars import finished_fills

    b = B.indexed(B.event_hourly(spark, sf_dir)).withColumn("idx", F.col("idx").cast("int"))
    on = F.col("idx") % 10 == 0
    b = b.select("symbol", "idx", "n_bars", "ts", "open", "high", "low", "close", F.when(on, 1).alias("side"), F.when(on, F.col("close") * 0.6).alias("stop"), F.when(on, F.col("close") * 1.3).alias("target"))
    t = finished_fills(b, max_hold=3, slippage=0.0, cash=1e12, risk=1e-6)
    return t.select("symbol", F.col("entry_idx").cast("long").alias("entry_idx"), F.col("exit_idx").cast("long").alias("exit_idx"), F.round("entry_price", 5).alias("entry_price"), F.round("exit_price", 5).alias("exit_price"), "exit_reason")


# --- SQL faces ----------------------------------------------------------------


@query("c12_fills_udtf", _FILLS)
def fills_udtf(spark, sf_dir):
    """The fill machine called from SQL, a partition a symbol."""
    from volumetra.functions import tables

    tables.register(spark)
    b = B.indexed(B.event_hourly(spark, sf_dir))
    b.select("symbol", F.col("idx").cast("int").alias("idx"), "ts", "open", "high", "low", "close", F.when(F.col("idx") % 10 == 0, 1).alias("side"), (F.col("close") * 0.6).alias("stop"), (F.col("close") * 1.3).alias("target")).createOrReplaceTempView("volumetra_bars_and_signals")
    t = spark.sql("SELECT * FROM volumetra_fills(TABLE(volumetra_bars_and_signals) PARTITION BY symbol ORDER BY idx)")
    return t.select("symbol", F.col("entry_idx").cast("long").alias("entry_idx"), F.col("exit_idx").cast("long").alias("exit_idx"), F.round("entry_price", 5).alias("entry_price"), F.round("exit_price", 5).alias("exit_price"), "exit_reason")
