"""Bars: (symbol, ts, open, high, low, close, volume), one table for all symbols.

Ticks become bars with one shuffle; open and close are taken by a full tie-break
so that they do not depend on the order of rows. Every later operator keys on
symbol, so bars stay partitioned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(c: str) -> Column:
    """NaN is no value: null from here on."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)


def bars_from_ticks(ticks: DataFrame, symbol: Column, period: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    tie = F.struct(*order)
    t = ticks.select(symbol.cast("string").alias("symbol"), period.alias("ts"), price.alias("price"), volume.alias("qty"), tie.alias("tie"))
    return t.groupBy("symbol", "ts").agg(
        F.min_by("price", "tie").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tie").alias("close"), F.sum("qty").cast("double").alias("volume")
    )


TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def raw_flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return bars_from_ticks(t, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), TICK_ORDER)


def raw_nation_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return bars_from_ticks(t, F.col("s_nationkey"), F.date_trunc("week", "l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), ["l_shipdate", *TICK_ORDER])


def raw_event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return bars_from_ticks(t, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.lit(1.0), ["ts", "event_id"])


def validate(bars: DataFrame, ingest: str | None = None) -> DataFrame:
    """Last of duplicate (symbol, ts), numbers only, prices above zero, high not below low.

    Without an ingest column the largest tuple of values is the last, so that the choice does not depend on row order.
    """
    order = F.col(ingest).desc() if ingest else F.struct(*OHLCV).desc()
    one = bars.select("symbol", "ts", *[clean(c) for c in OHLCV], *([ingest] if ingest else []))
    one = one.withColumn("_n", F.row_number().over(W.partitionBy("symbol", "ts").orderBy(order))).filter("_n = 1")
    ok = F.lit(True)
    for c in OHLCV[:4]:
        ok = ok & (F.col(c) > 0)
    return one.filter(ok & (F.col("high") >= F.col("low"))).select("symbol", "ts", *OHLCV)


def require(bars: DataFrame, min_bars: int = 1) -> DataFrame:
    """Symbols that cannot be used: symbol, reason. Empty if all is well."""
    s = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    reason = F.when(F.col("n") < min_bars, F.concat(F.lit("too few bars: "), F.col("n"))).when(F.coalesce("v", F.lit(0.0)) <= 0, F.lit("no volume"))
    return s.select("symbol", reason.alias("reason")).filter("reason is not null")


def flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive(raw_flag_daily(spark, sf_dir))


def nation_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive(raw_nation_weekly(spark, sf_dir))


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive(raw_event_hourly(spark, sf_dir))


def positive(bars: DataFrame) -> DataFrame:
    """What `validate` leaves of bars that are unique already: no shuffle."""
    return bars.filter("open > 0 and high > 0 and low > 0 and close > 0 and high >= low")


VIEWS = {"flag": flag_daily, "nation": nation_weekly, "event": event_hourly}


def indexed(bars: DataFrame) -> DataFrame:
    """idx: the bar's place in its symbol, from 0; n_bars: how many there are."""
    w = W.partitionBy("symbol")
    return bars.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n_bars", F.count("*").over(w))


def adjust(bars: DataFrame, adjusted_close: str) -> DataFrame:
    """Back-adjusted bars: prices times adjusted close over close."""
    factor = F.col(adjusted_close) / F.col("close")
    return bars.select("symbol", "ts", *[(F.col(c) * factor).alias(c) for c in OHLCV[:4]], "volume")


def clamp_period(requests: DataFrame) -> DataFrame:
    """(period, interval) with the longest standard period that the interval's day limit allows."""
    spark = requests.sparkSession
    limits = spark.createDataFrame(list(INTERVAL_DAYS.items()), "interval string, max_days int")
    periods = spark.createDataFrame(list(PERIOD_DAYS.items()), "p string, days int")
    asked = requests.join(F.broadcast(limits), "interval", "left").join(F.broadcast(periods.select(F.col("p").alias("period_key"), F.col("days").alias("asked"))), F.lower("period") == F.col("period_key"), "left")
    standard = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p")) for p, d in PERIOD_DAYS.items() if p not in ("max", "ytd")])
    best = F.array_max(F.filter(standard, lambda x: x["d"] <= F.col("max_days")))["p"]
    clamped = F.when(F.col("max_days").isNull() | F.col("asked").isNull() | (F.col("asked") <= F.col("max_days")), F.col("period")).otherwise(F.coalesce(best, F.lit("1d")))
    return asked.select("period", "interval", clamped.alias("clamped"))


# Days that an interval's history spans at most, and days of a period.
INTERVAL_DAYS = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "60m": 730, "90m": 60, "1h": 730}
PERIOD_DAYS = {"1d": 1, "5d": 5, "7d": 7, "1mo": 31, "3mo": 93, "6mo": 186, "1y": 366, "2y": 730, "5y": 1827, "10y": 3653, "ytd": 366, "max": 1000000}
