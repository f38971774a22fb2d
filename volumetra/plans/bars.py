"""Queries over sources, sinks, projections, joins and universes: S, K, P, J, A17, A19, A26, U, G."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions import rolling as R
from volumetra.operators import align, universe
from volumetra.plans.registry import DUCK, EVENT, FLAG, NATION, TS, query
from volumetra.session import shared_folder
from volumetra.sources import bars as B
from volumetra.sources import files, synthetic


def tstr():
    return F.col("ts").cast("string").alias("ts")


_HOUR = "date_trunc('hour', ts)"


def rounded(df, digits=6):
    return df.select("symbol", tstr(), *[F.round(c, digits).alias(c) for c in B.OHLCV])


def _out(digits=6):
    return f"symbol, {TS}, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in B.OHLCV)


@query("s1_bar_views", f"WITH {EVENT}, e AS (SELECT 'event' AS view, * FROM bars), f AS (WITH {FLAG} SELECT 'flag' AS view, * FROM bars), n AS (WITH {NATION} SELECT 'nation' AS view, * FROM bars) SELECT view, count(DISTINCT symbol) AS symbols, count(*) AS n_bars, round(sum(volume), 3) AS volume FROM (SELECT * FROM e UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n) GROUP BY view")
def bar_views(spark, sf_dir):
    every = None
    for n, f in B.VIEWS.items():
        d = f(spark, sf_dir).withColumn("view", F.lit(n))
        every = d if every is None else every.unionByName(d)
    return every.groupBy("view").agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("n_bars"), F.round(F.sum("volume"), 3).alias("volume"))


_TICKS = "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id, value - 5 AS open, value - 3 AS high, value - 6 AS low, value - 4 AS close, CAST(1 AS DOUBLE) AS volume FROM events"


@query("s2_bar_validation", f"WITH t AS ({_TICKS}), d AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) AS n FROM t) SELECT {_out()} FROM d WHERE n = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low")
def bar_validation(spark, sf_dir):
    """Ticks as raw bars: many share an hour, and some prices are not above zero."""
    e = B.table(spark, sf_dir, "events")
    v = F.col("value")
    t = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), "event_id", (v - 5).alias("open"), (v - 3).alias("high"), (v - 6).alias("low"), (v - 4).alias("close"), F.lit(1.0).alias("volume"))
    return rounded(B.validate(t, "event_id"))


_DAYS = ", ".join(f"('{k}', {v})" for k, v in B.INTERVAL_DAYS.items())
_PERIODS = ", ".join(f"('{k}', {v})" for k, v in B.PERIOD_DAYS.items())


@query("s3a_period_clamp", f"WITH i(interval, max_days) AS (VALUES {_DAYS}, ('1d', NULL), ('1wk', NULL)), p(period, days) AS (VALUES {_PERIODS}) SELECT interval, period, CASE WHEN max_days IS NULL OR days <= max_days THEN period ELSE coalesce((SELECT arg_max(q.period, q.days) FROM p q WHERE q.days <= i.max_days AND q.period NOT IN ('max', 'ytd')), '1d') END AS clamped FROM i, p")
def period_clamp(spark, sf_dir):
    rows = [(p, i) for i in [*B.INTERVAL_DAYS, "1d", "1wk"] for p in B.PERIOD_DAYS]
    return B.clamp_period(spark.createDataFrame(rows, "period string, interval string")).select("interval", "period", "clamped")


@query("s3c_normalise", "WITH d AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS close, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS volume, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS n FROM events) SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(close, 6) AS close, round(coalesce(volume, 0), 6) AS volume FROM d WHERE n = 1 AND close IS NOT NULL")
def normalise(spark, sf_dir):
    """Raw columns to canonical ones: the last duplicate, no bar without a close, no volume as zero."""
    e = B.table(spark, sf_dir, "events")
    t = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("Close"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("Volume"))
    t = t.withColumnsRenamed({c: c.lower() for c in t.columns})
    t = t.withColumn("n", F.row_number().over(W.partitionBy("symbol", "ts").orderBy(F.desc("event_id")))).filter("n = 1 and close is not null")
    return t.select("symbol", tstr(), F.round("close", 6).alias("close"), F.round(F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)), 6).alias("volume"))


@query("s5_aggregates_payload", f"WITH {EVENT} SELECT {_out()} FROM bars")
def aggregates_payload(spark, sf_dir):
    """Bars to one JSON payload a symbol and back."""
    b = B.event_hourly(spark, sf_dir)
    r = F.struct((F.unix_timestamp("ts") * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    p = b.groupBy("symbol").agg(F.collect_list(r).alias("results")).select(F.to_json(F.struct(F.col("symbol").alias("ticker"), F.lit("OK").alias("status"), "results")).alias("payload"))
    return rounded(files.aggregates_payload(p))


@query("s6_daily_payload", f"WITH {FLAG} SELECT {_out(9)} FROM bars")
def daily_payload(spark, sf_dir):
    b = B.flag_daily(spark, sf_dir)
    r = F.struct("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"), *B.OHLCV)
    p = b.groupBy("symbol", F.year("ts").alias("y")).agg(F.collect_list(r).alias("rs")).select(F.to_json("rs").alias("payload"))
    return rounded(files.daily_payload(p), 9)


@query("s14_chart_payload", f"WITH {EVENT} SELECT {_out()} FROM bars")
def chart_payload(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir)
    s = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", *B.OHLCV))).alias("a"))
    cols = [F.transform("a", lambda x: F.unix_timestamp(x["ts"])).alias("timestamp"), *[F.col(f"a.{c}").alias(c) for c in B.OHLCV]]
    return rounded(files.chart_payload(s.select(F.to_json(F.struct("symbol", *cols)).alias("payload"))))


@query("s14_kline_payload", f"WITH {EVENT} SELECT {_out()} FROM bars")
def kline_payload(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir)
    k = F.array((F.unix_timestamp("ts") * 1000).cast("string"), *[F.col(c).cast("string") for c in B.OHLCV])
    return rounded(files.kline_payload(b.groupBy("symbol").agg(F.to_json(F.collect_list(k)).alias("payload"))))


@query("s14_back_adjustment", f"WITH {EVENT}, a AS (SELECT *, close * (1 - 0.01 * (hour(ts) % 3)) AS adj FROM bars) SELECT symbol, {TS}, round(open * (adj / close), 6) AS open, round(high * (adj / close), 6) AS high, round(low * (adj / close), 6) AS low, round(close * (adj / close), 6) AS close, round(volume, 6) AS volume FROM a")
def back_adjustment(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir).withColumn("adj", F.col("close") * (1 - 0.01 * (F.hour("ts") % 3)))
    return rounded(B.adjust(b, "adj"))


@query("s8_csv_german", f"WITH {EVENT} SELECT symbol, {TS}, " + ", ".join(f"round({c}, 2) AS {c}" for c in B.OHLCV) + " FROM bars WHERE hour(ts) = 0")
def csv_german(spark, sf_dir):
    """Bars printed the German way (semicolons, decimal comma, dot for thousands, day first) and parsed again."""
    b = B.event_hourly(spark, sf_dir).filter("hour(ts) = 0")
    g = lambda c: F.translate(F.format_number(F.round(F.col(c), 2), 2), ",.", ".,")
    line = F.concat_ws(";", F.date_format("ts", "dd.MM.yyyy"), *[g(c) for c in B.OHLCV])
    lines = b.select("symbol", line.alias("line"))
    return rounded(files.parse_lines(lines, "Datum;Eröffnung;Hoch;Tief;Schluss;Stücke", F.col("symbol")), 2)


@query("s7_csv_bulk", f"WITH {EVENT} SELECT symbol, {TS}, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM bars WHERE hour(ts) = 0")
def csv_bulk(spark, sf_dir):
    """The bulk export's bracketed headers and packed dates."""
    b = B.event_hourly(spark, sf_dir).filter("hour(ts) = 0")
    line = F.concat_ws(",", "symbol", F.lit("D"), F.date_format("ts", "yyyyMMdd"), F.lit("000000"), *[F.round(c, 4).cast("string") for c in B.OHLCV], F.lit("0"))
    return rounded(files.parse_lines(b.select("symbol", line.alias("line")), "<TICKER>,<PER>,<DATE>,<TIM>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>", F.col("symbol")), 4)


def lake(spark, sf_dir, view="nation"):
    root = shared_folder(spark, "lake")
    files.write_lake(B.VIEWS[view](spark, sf_dir), root)
    return root


@query("s9_lake_read_pruned", f"WITH {NATION} SELECT {_out()} FROM bars WHERE ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '1997-06-30'")
def lake_read(spark, sf_dir):
    return rounded(files.read_lake(spark, lake(spark, sf_dir), "1996-03-01", "1997-06-30"))


@query("k1_lake_write_capped", f"WITH {NATION}, c AS (SELECT symbol, min(ts) + INTERVAL 400 DAY AS cap FROM bars WHERE CAST(symbol AS INT) % 2 = 0 GROUP BY symbol) SELECT symbol, count(*) AS n_bars, CAST(max(ts) AS VARCHAR) AS last_ts FROM bars LEFT JOIN c USING (symbol) WHERE cap IS NULL OR ts <= cap GROUP BY symbol")
def lake_write(spark, sf_dir):
    b = B.nation_weekly(spark, sf_dir)
    caps = b.filter("cast(symbol as int) % 2 = 0").groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 400 DAY")).alias("cap"))
    root = shared_folder(spark, "lake")
    files.write_lake(b, root, caps)
    return files.read_lake(spark, root).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("ts").cast("string").alias("last_ts"))


@query("k2_export_json", f"WITH {EVENT} SELECT symbol, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM bars GROUP BY symbol")
def export_json(spark, sf_dir):
    """Rows to JSON objects and read again by schema."""
    b = B.event_hourly(spark, sf_dir).select(F.to_json(F.struct("symbol", tstr(), *B.OHLCV)).alias("j"))
    back = b.select(F.from_json("j", "symbol string, ts string, close double").alias("r")).select("r.*")
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("k3_chart_frame", f"WITH {EVENT} SELECT symbol, {TS}, round(close, 6) AS close, round(max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS peak FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 400")
def chart_frame(spark, sf_dir):
    """What a chart shows: the last 400 bars of each symbol."""
    b = R.apply(B.event_hourly(spark, sf_dir), [{"peak": f"max(close) OVER ({R.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"back": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"}])
    return b.filter("back <= 400").select("symbol", tstr(), F.round("close", 6).alias("close"), F.round("peak", 6).alias("peak"))


@query("l6_chart_tail", f"WITH {FLAG} SELECT symbol, {TS}, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 400")
def chart_tail(spark, sf_dir):
    b = B.flag_daily(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))).filter("n <= 400")
    return b.select("symbol", tstr(), F.round("close", 6).alias("close"))


@query("s9a_lake_symbols", f"WITH {NATION} SELECT DISTINCT symbol FROM bars")
def lake_symbols(spark, sf_dir):
    root = lake(spark, sf_dir)
    return spark.read.parquet(root).select(F.col("symbol").cast("string").alias("symbol")).distinct()


_CUT = "b2 AS (SELECT * FROM bars WHERE NOT (CAST(symbol AS INT) % 5 = 0 AND ts > TIMESTAMP '1997-01-01'))"


@query("s9b_delist_inference", f"WITH {NATION}, {_CUT} SELECT symbol, CAST(max(ts) AS VARCHAR) AS last_ts, date_diff('day', CAST(max(ts) AS DATE), CAST((SELECT max(ts) FROM b2) AS DATE)) > 180 AS delisted FROM b2 GROUP BY symbol")
def delist_inference(spark, sf_dir):
    b = ended(spark, sf_dir)
    return files.delisted(b).select("symbol", F.col("last_ts").cast("string").alias("last_ts"), "delisted")


def ended(spark, sf_dir):
    """Every fifth nation's bars end early."""
    return B.nation_weekly(spark, sf_dir).filter("not (cast(symbol as int) % 5 = 0 and ts > timestamp'1997-01-01')")


@query("s10_synthetic_bars")
def synthetic_bars(spark, sf_dir):
    names = [r["n"] for r in B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("n")).collect()]  # 25 names, a dimension table
    b = synthetic.synthetic(spark, names, "1y", set(names[::5]))
    return rounded(b, 6)


@query("s11_source_fallback", f"WITH {EVENT}, a AS (SELECT *, 'first' AS source, 0 AS p FROM bars WHERE symbol < 'p'), b AS (SELECT symbol, ts, open * 2 AS open, high * 2 AS high, low * 2 AS low, close * 2 AS close, volume, 'second' AS source, 1 AS p FROM bars), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT symbol, source, count(*) AS n, round(avg(close), 6) AS mean_close FROM (SELECT *, min(p) OVER (PARTITION BY symbol) AS best FROM u) WHERE p = best GROUP BY symbol, source")
def source_fallback(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir)
    second = b.withColumns({c: F.col(c) * 2 for c in B.OHLCV[:4]})
    one = files.first_source([("first", b.filter("symbol < 'p'")), ("second", second)])
    return one.groupBy("symbol", "source").agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("mean_close"))


_SETTINGS = ({}, {"POLYGON_API_KEY": "k"}, {"FMP_API_KEY": "k"}, {"POLYGON_API_KEY": "k", "FMP_API_KEY": "k", "VPTS_FMP_DELISTED": "1"}, {"FMP_API_KEY": "k", "VPTS_FMP_DELISTED": "1"})
_CHAINS = f"""WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i}, {'POLYGON_API_KEY' in x}, {'FMP_API_KEY' in x}, {'VPTS_FMP_DELISTED' in x})" for i, x in enumerate(_SETTINGS))}) t(setting, polygon, fmp, fmp_delisted)), w AS (SELECT * FROM (VALUES (''), ('delisted'), ('intraday')) t(required)),
 c AS (SELECT setting, required, 0 AS place, 'polygon' AS source FROM s, w WHERE polygon UNION ALL SELECT setting, required, 1, 'fmp' FROM s, w WHERE fmp AND (required = '' OR (required = 'delisted' AND fmp_delisted))
  UNION ALL SELECT setting, required, 2, 'yahoo' FROM s, w WHERE required <> 'delisted' UNION ALL SELECT setting, required, 3, 'synthetic' FROM s, w WHERE required = '')
 SELECT setting, required, string_agg(source, ',' ORDER BY place) AS chain FROM c GROUP BY 1, 2"""


@query("s11a_default_chain", _CHAINS)
def default_chain(spark, sf_dir):
    """The sources that are asked, in order, under some settings and requirements."""
    rows = [(i, need, ",".join(files.default_chain(x, {need} if need else None))) for i, x in enumerate(_SETTINGS) for need in ("", "delisted", "intraday")]
    return spark.createDataFrame([r for r in rows if r[2]], "setting int, required string, chain string")


@query("s5_delisted_pages", "SELECT 'S' || s_suppkey AS ticker, CAST(DATE '2020-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS VARCHAR) AS delisted_utc FROM supplier WHERE s_suppkey % 3 <> 0")
def delisted_pages(spark, sf_dir):
    """Reference pages of tickers that are gone, put together again; the last ticker of a page stands on the next one too."""
    t = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"), (F.col("s_suppkey") % 3 == 0).alias("active"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 900).cast("int")).cast("string").alias("delisted_utc"))
    t = t.withColumn("page", F.explode(F.array_distinct(F.array(F.floor(F.col("k") / 20), F.floor((F.col("k") + 1) / 20)))))
    pages = t.groupBy("page").agg(F.collect_list(F.struct("ticker", "active", "delisted_utc")).alias("results"))
    return files.delisted_tickers(pages.select(F.to_json(F.struct("results", F.lit("next").alias("next_url"))).alias("payload")))


@query("s6_answers", "SELECT n_name AS symbol, CASE n_nationkey % 6 WHEN 0 THEN 'bars' WHEN 1 THEN 'plan_gate' WHEN 2 THEN 'plan_gate' WHEN 3 THEN 'error' WHEN 4 THEN 'empty' ELSE 'error' END AS outcome, CASE n_nationkey % 6 WHEN 1 THEN n_name || ': a higher plan is needed (402)' WHEN 2 THEN n_name || ': a higher plan is needed (403)' WHEN 3 THEN n_name || ': limit reached' WHEN 4 THEN n_name || ': no bars' WHEN 5 THEN n_name || ': request failed with 500' END AS message FROM nation")
def vendor_answers(spark, sf_dir):
    """Vendor answers told apart without an exception: bars, a plan gate, errors, nothing."""
    k = F.col("n_nationkey") % 6
    code = F.when(k == 1, 402).when(k == 2, 403).when(k == 5, 500).otherwise(200)
    body = F.when(k == 0, '[{"date":"2024-01-02","close":1.0}]').when(k == 3, '{"Error Message":"limit reached"}').when(k == 4, "[]").otherwise("")
    a = files.answers(B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), code.alias("code"), body.alias("payload")))
    return a.select("symbol", "outcome", "message")


@query("s3d_freshness", "SELECT n_name AS symbol, n_nationkey % 3 = 0 AS hit FROM nation")
def freshness(spark, sf_dir):
    """Which requests a cache of fetches answers: a third were fetched an hour ago, a third a week ago, the others never."""
    now = "2024-06-01 12:00:00"
    asked = B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), F.lit("1d").alias("interval"), "n_nationkey")
    requests = asked.drop("n_nationkey")
    keyed = files.fresh(spark.createDataFrame([], "key string, fetched_at timestamp"), requests, now, 1).select("symbol", "key").join(asked, "symbol")
    at = F.when(F.col("n_nationkey") % 3 == 0, F.lit("2024-06-01 11:00:00")).when(F.col("n_nationkey") % 3 == 1, F.lit("2024-05-25 12:00:00")).cast("timestamp")
    cache = keyed.select("key", at.alias("fetched_at")).filter("fetched_at is not null")
    return files.fresh(cache, requests, now, 86_400).select("symbol", "hit")


@query("s13_static_alt_signal", f"WITH {EVENT}, a AS (SELECT symbol, ts + INTERVAL 30 MINUTE AS seen, close AS flow FROM bars WHERE hour(ts) % 6 = 0 AND ts > (SELECT min(ts) FROM bars) + INTERVAL 2 DAY), s AS (SELECT symbol, min(seen) AS f, max(seen) AS t FROM a GROUP BY symbol) SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, round(CASE WHEN b.ts BETWEEN s.f AND s.t THEN a.flow END, 6) AS flow FROM bars b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.seen LEFT JOIN s ON b.symbol = s.symbol")
def static_alt(spark, sf_dir):
    return bounded(spark, sf_dir)


def alt_signal(b):
    first = b.agg(F.min("ts").alias("m"))
    a = b.filter("hour(ts) % 6 = 0").crossJoin(first).filter("ts > m + INTERVAL 2 DAY")
    return a.select("symbol", (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("ts"), F.col("close").alias("flow"))


def bounded(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir)
    return align.asof_within(b, alt_signal(b), ["flow"]).select("symbol", tstr(), F.round("flow", 6).alias("flow"))


query("j5_bounded_asof", f"WITH {EVENT}, a AS (SELECT symbol, ts + INTERVAL 30 MINUTE AS seen, close AS flow FROM bars WHERE hour(ts) % 6 = 0 AND ts > (SELECT min(ts) FROM bars) + INTERVAL 2 DAY), s AS (SELECT symbol, min(seen) AS f, max(seen) AS t FROM a GROUP BY symbol) SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, round(CASE WHEN b.ts BETWEEN s.f AND s.t THEN a.flow END, 6) AS flow FROM bars b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.seen LEFT JOIN s ON b.symbol = s.symbol")(bounded)


@query("j4_asof_coarse_to_base", f"WITH {FLAG}, w AS (SELECT symbol, CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS TIMESTAMP) AS wk, arg_max(close, ts) AS wclose FROM bars GROUP BY 1, 2), l AS (SELECT symbol, wk, lag(wclose) OVER (PARTITION BY symbol ORDER BY wk) AS prev FROM w) SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, round(l.prev, 6) AS coarse FROM bars b ASOF LEFT JOIN l ON b.symbol = l.symbol AND b.ts >= l.wk")
def asof_coarse(spark, sf_dir):
    """Weekly closes, one whole week late, on daily bars."""
    from volumetra.plans.rolling import resample_weekly

    b = B.flag_daily(spark, sf_dir)
    w = resample_weekly(b).withColumn("ts", F.col("week_end").cast("timestamp"))
    w = w.withColumn("coarse", F.lag("close").over(W.partitionBy("symbol").orderBy("ts"))).select("symbol", "ts", "coarse")
    return align.asof(b, w, ["coarse"]).select("symbol", tstr(), F.round("coarse", 6).alias("coarse"))


@query("j1_same_row_alignment", f"WITH {EVENT} SELECT symbol, {TS}, round(high - low, 6) AS span, round(abs(close - open), 6) AS body FROM bars")
def same_row(spark, sf_dir):
    return B.event_hourly(spark, sf_dir).select("symbol", tstr(), F.round(F.col("high") - F.col("low"), 6).alias("span"), F.round(F.abs(F.col("close") - F.col("open")), 6).alias("body"))


@query("j2_dates_across_names", f"WITH {NATION} SELECT CAST(ts AS VARCHAR) AS ts, count(*) AS names, round(avg(close), 4) AS mean_close FROM bars GROUP BY ts")
def dates_across(spark, sf_dir):
    return B.nation_weekly(spark, sf_dir).groupBy("ts").agg(F.count("*").alias("names"), F.round(F.avg("close"), 4).alias("mean_close")).select(tstr(), "names", "mean_close")


_COMMON = "c AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))"


@query("j3_common_dates", f"WITH {FLAG}, {_COMMON} SELECT symbol, {TS}, round(close, 6) AS close FROM bars WHERE ts IN (SELECT ts FROM c)")
def common(spark, sf_dir):
    return align.common_dates(B.flag_daily(spark, sf_dir)).select("symbol", tstr(), F.round("close", 6).alias("close"))


@query("u3_date_intersection", f"WITH {FLAG} SELECT CAST(ts AS VARCHAR) AS ts FROM (SELECT ts FROM bars WHERE symbol = 'A' INTERSECT SELECT ts FROM bars WHERE symbol = 'R')")
def intersection(spark, sf_dir):
    b = B.flag_daily(spark, sf_dir)
    return b.filter("symbol = 'A'").select("ts").intersect(b.filter("symbol = 'R'").select("ts")).select(tstr())


@query("a26_equal_weight_curve", f"WITH {FLAG}, {_COMMON}, r AS (SELECT symbol, ts, 100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS v FROM bars WHERE ts IN (SELECT ts FROM c)) SELECT CAST(ts AS VARCHAR) AS ts, round(avg(v), 4) AS value FROM r GROUP BY ts")
def equal_weight(spark, sf_dir):
    """Rebased to 100 on the first common date, averaged over names."""
    c = align.common_dates(B.flag_daily(spark, sf_dir))
    v = 100 * F.col("close") / F.first("close").over(W.partitionBy("symbol").orderBy("ts"))
    return c.select("ts", v.alias("v")).groupBy("ts").agg(F.round(F.avg("v"), 4).alias("value")).select(tstr(), "value")


@query("j6_conditional_columns", f"WITH {EVENT} SELECT symbol, {TS}, round(close * 2, 6) AS alt_flow FROM bars")
def conditional(spark, sf_dir):
    """An all-null signal adds no column."""
    b = B.event_hourly(spark, sf_dir).select("symbol", tstr(), F.round(F.col("close") * 2, 6).alias("alt_flow"), F.lit(None).cast("double").alias("alt_sentiment"))
    return align.non_empty(b, ["alt_flow", "alt_sentiment"])


@query("j8_window_self_join", f"WITH {EVENT}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars) SELECT d.symbol, d.idx, count(*) AS n, round(sum(b.volume), 4) AS volume, round(max(b.high), 6) AS high FROM i d JOIN i b ON d.symbol = b.symbol AND b.idx BETWEEN d.idx - 19 AND d.idx WHERE d.idx >= 19 AND (d.idx - 19) % 5 = 0 GROUP BY 1, 2")
def window_self_join(spark, sf_dir):
    from volumetra.operators.walk import windows

    w = windows(B.event_hourly(spark, sf_dir), 20, 5)
    return w.select("symbol", F.col("idx").cast("long").alias("idx"), F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("volume"), F.round(F.array_max("h"), 6).alias("high"))


@query("j13_positional_lookup", f"WITH {EVENT}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars) SELECT a.symbol, a.idx, CAST(a.ts AS VARCHAR) AS ts, round(b.close / a.close - 1, 6) AS ret FROM i a JOIN i b ON a.symbol = b.symbol AND b.idx = a.idx + 10 WHERE a.idx % 10 = 0")
def positional(spark, sf_dir):
    i = B.indexed(B.event_hourly(spark, sf_dir)).select("symbol", "ts", "idx", "close")
    later = i.select("symbol", (F.col("idx") - 10).alias("idx"), F.col("close").alias("then"))
    j = i.filter("idx % 10 = 0").join(later, ["symbol", "idx"])
    return j.select("symbol", F.col("idx").cast("long").alias("idx"), tstr(), F.round(F.col("then") / F.col("close") - 1, 6).alias("ret"))


_MEM = f"{NATION}, {_CUT}, l AS (SELECT symbol, min(ts) AS start, max(ts) AS last FROM b2 GROUP BY symbol), m AS (SELECT symbol, start, CASE WHEN date_diff('day', CAST(last AS DATE), CAST((SELECT max(last) FROM l) AS DATE)) > 180 THEN last END AS delist FROM l)"


def members(spark, sf_dir):
    b = ended(spark, sf_dir)
    return universe.memberships(b, files.delisted(b))


@query("j10_membership_asof", f"WITH {_MEM} SELECT d.symbol FROM m d WHERE (start IS NULL OR start <= TIMESTAMP '1997-06-01') AND (delist IS NULL OR delist >= TIMESTAMP '1997-06-01')")
def membership(spark, sf_dir):
    return align.active(members(spark, sf_dir), "1997-06-01").select("symbol")


@query("g1_point_in_time_universe", f"WITH {_MEM} SELECT symbol, CAST(start AS VARCHAR) AS start, CAST(delist AS VARCHAR) AS delist, delist IS NOT NULL AS delisted FROM m")
def point_in_time(spark, sf_dir):
    return members(spark, sf_dir).select("symbol", F.col("start").cast("string").alias("start"), F.col("delist").cast("string").alias("delist"), "delisted")


@query("u4_survivors_complement", f"WITH {_MEM} SELECT symbol FROM m EXCEPT SELECT symbol FROM m WHERE delist IS NOT NULL")
def survivors(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.select("symbol").exceptAll(m.filter("delisted").select("symbol"))


_AUDIT = "q AS (SELECT n_name AS symbol, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT n_name AS symbol, count(*) AS n_bars FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), au AS (SELECT q.symbol, category, coalesce(n_bars, 0) AS n_bars, CASE WHEN coalesce(n_bars, 0) >= 4 THEN 'reachable' ELSE 'dropped' END AS status FROM q LEFT JOIN s USING (symbol))"


def audited(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation")
    q = n.join(B.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("category"))
    served = B.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"))
    return universe.audit(q, served, min_bars=4)


@query("j14_requested_vs_served", f"WITH {_AUDIT} SELECT * FROM au")
def requested(spark, sf_dir):
    return audited(spark, sf_dir)


@query("a19_coverage_fractions", f"WITH {_AUDIT} SELECT category, round(avg(CASE WHEN status = 'reachable' THEN 1.0 ELSE 0 END), 6) AS fraction, count(*) AS n FROM au GROUP BY category")
def coverage(spark, sf_dir):
    return universe.coverage(audited(spark, sf_dir)).select("category", F.round("fraction", 6).alias("fraction"), "n")


@query("g3_known_delisted_audit", "SELECT category, CAST(n AS BIGINT) AS n, CAST(fraction AS DOUBLE) AS fraction FROM (VALUES ('acquisition', 15, 0.0), ('bankruptcy', 11, 0.0)) AS t(category, n, fraction)")
def known_audit(spark, sf_dir):
    """The catalogue against a feed that has none of its names."""
    return universe.coverage(universe.audit(universe.known_gone(spark).select("symbol", "category"), B.event_hourly(spark, sf_dir))).select("category", "n", "fraction")


@query("g2_survivorship_injection", f"WITH {EVENT}, l AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), s AS (SELECT count(*) AS k, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS n FROM l) SELECT symbol, n, false AS injected FROM l UNION ALL SELECT 'DEAD' || i AS symbol, n, true FROM s, (SELECT unnest(range(100)) AS i) WHERE i < round_even(0.5 / 0.5 * k, 0)")
def injection(spark, sf_dir):
    out = synthetic.inject(B.event_hourly(spark, sf_dir), 0.5)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.max(F.col("symbol").startswith("DEAD")).alias("injected"))


@query("p1_select_rename_coerce", "SELECT event_id, event_type AS symbol, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def select_coerce(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("p2_date_range", f"WITH {FLAG} SELECT {_out()} FROM bars WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1995-07-01'")
def date_range(spark, sf_dir):
    """The filter is on ticks, where it reaches the files."""
    t = B.table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp'1995-01-01' and l_shipdate < timestamp'1995-07-01'")
    return rounded(B.positive(B.bars_from_ticks(t, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), B.TICK_ORDER)))


@query("p3_valid_bars", f"WITH {EVENT}, d AS (SELECT symbol, ts, high, CASE WHEN hour(ts) = 3 THEN high + 1 ELSE low END AS low, CASE WHEN hour(ts) = 5 THEN NULL ELSE close END AS close, CASE WHEN hour(ts) = 7 THEN 0 ELSE volume END AS volume FROM bars) SELECT symbol, {TS}, round(close, 6) AS close FROM d WHERE close IS NOT NULL AND volume > 0 AND high >= low")
def valid_bars(spark, sf_dir):
    from volumetra.operators.profile import usable

    h = F.hour("ts")
    b = B.event_hourly(spark, sf_dir).withColumns({"low": F.when(h == 3, F.col("high") + 1).otherwise(F.col("low")), "close": F.when(h == 5, F.lit(float("nan"))).otherwise(F.col("close")), "volume": F.when(h == 7, F.lit(0.0)).otherwise(F.col("volume"))})
    return usable(b).select("symbol", tstr(), F.round("close", 6).alias("close"))


@query("p11_half_even", "SELECT DISTINCT l_quantity, round_even(l_quantity / 2, 0) AS half, round_even(l_quantity / 20, 1) AS tenth FROM lineitem")
def half_even(spark, sf_dir):
    q = B.table(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    return q.select("l_quantity", F.bround(F.col("l_quantity") / 2, 0).alias("half"), F.bround((F.col("l_quantity") / 20).cast("decimal(20,6)"), 1).cast("double").alias("tenth"))


@query("a17_group_summaries", f"WITH {FLAG} SELECT symbol, CAST(year(ts) AS BIGINT) AS year, count(*) AS n, round(quantile_cont(round(close, 4), 0.5), 3) AS median_close, round(avg(CASE WHEN close > open THEN 1.0 ELSE 0 END), 6) AS up_share FROM bars GROUP BY 1, 2")
def group_summaries(spark, sf_dir):
    b = B.flag_daily(spark, sf_dir)
    return b.groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.expr("percentile(round(close, 4), 0.5)"), 3).alias("median_close"), F.round(F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)), 6).alias("up_share"))


@query("a17_pivot", "SELECT l_returnflag AS flag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS f, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS o FROM lineitem GROUP BY 1")
def pivot(spark, sf_dir):
    t = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return t.select("flag", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"))


@query("u1_union_pool", f"WITH {EVENT}, f AS (WITH {FLAG} SELECT * FROM bars) SELECT symbol, count(*) AS n, round(sum(volume), 3) AS volume FROM (SELECT * FROM bars UNION ALL SELECT * FROM f) GROUP BY symbol")
def union_pool(spark, sf_dir):
    u = B.event_hourly(spark, sf_dir).unionByName(B.flag_daily(spark, sf_dir))
    return u.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 3).alias("volume"))


@query("u2_level_set", f"WITH {EVENT} SELECT symbol, {TS}, len(list_distinct([round(open, 1), round(high, 1), round(low, 1), round(close, 1)])) AS levels FROM bars")
def level_set(spark, sf_dir):
    a = F.array_union(F.array(F.round("open", 1), F.round("high", 1)), F.array(F.round("low", 1), F.round("close", 1)))
    return B.event_hourly(spark, sf_dir).select("symbol", tstr(), F.size(a).cast("long").alias("levels"))


@query("l1_sort_dedupe", "SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS VARCHAR) AS ts, max(event_id) AS event_id FROM events GROUP BY 1, date_trunc('hour', ts)")
def sort_dedupe(spark, sf_dir):
    """The last of duplicates, by an aggregate with map-side partials instead of a sort."""
    e = B.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max("event_id").alias("event_id")).select("symbol", tstr(), "event_id")


@query("l3_most_recent", f"WITH {EVENT} SELECT symbol, {TS}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS BIGINT) AS place FROM bars QUALIFY place <= 5")
def most_recent(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"))).cast("long"))
    return b.filter("place <= 5").select("symbol", tstr(), "place")


@query("l5_top_fraction", f"WITH {EVENT}, q AS (SELECT symbol, quantile_cont(volume + close / 1e6, 0.8) AS edge FROM bars GROUP BY symbol) SELECT symbol, {TS} FROM bars JOIN q USING (symbol) WHERE volume + close / 1e6 >= edge")
def top_fraction(spark, sf_dir):
    b = B.event_hourly(spark, sf_dir).withColumn("x", F.expr("volume + close / 1e6"))
    edge = b.groupBy("symbol").agg(F.expr("percentile(x, 0.8)").alias("edge"))
    return b.join(edge, "symbol").filter("x >= edge").select("symbol", tstr())


@query("l7_top_features", "SELECT label, dim, round(m, 5) AS mean FROM (SELECT label, dim, m, row_number() OVER (PARTITION BY label ORDER BY round(abs(m), 7) DESC, dim) AS n FROM (SELECT label, i - 1 AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(embedding) GROUP BY 1, 2)) WHERE n <= 3")
def top_features(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 64)).alias("dim", "x"))
    m = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    m = m.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy(F.round(F.abs("m"), 7).desc(), "dim"))).filter("n <= 3")
    return m.select("label", F.col("dim").cast("long").alias("dim"), F.round("m", 5).alias("mean"))
