"""Point-in-time universes and coverage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names known to have left the market, why and when.
KNOWN_GONE = (
    ("ENE", "bankruptcy", 2001), ("WCOM", "bankruptcy", 2002), ("LEH", "bankruptcy", 2008), ("WAMUQ", "bankruptcy", 2008), ("GGP", "bankruptcy", 2009), ("MTLQQ", "bankruptcy", 2009),
    ("CIT", "bankruptcy", 2009), ("ABK", "bankruptcy", 2010), ("GTATQ", "bankruptcy", 2014), ("SHLDQ", "bankruptcy", 2018), ("HTZGQ", "bankruptcy", 2020), ("WFM", "acquisition", 2017),
    ("LLTC", "acquisition", 2017), ("BRCD", "acquisition", 2017), ("TWX", "acquisition", 2018), ("COL", "acquisition", 2018), ("MON", "acquisition", 2018), ("PCLN", "acquisition", 2018),
    ("CELG", "acquisition", 2019), ("STI", "acquisition", 2019), ("RTN", "acquisition", 2020), ("AGN", "acquisition", 2020), ("ARNC", "acquisition", 2020), ("TIF", "acquisition", 2021),
    ("XLNX", "acquisition", 2022), ("ATVI", "acquisition", 2023),
)


def known_gone(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_GONE), "symbol string, category string, year int")


def memberships(bars: DataFrame, gone: DataFrame) -> DataFrame:
    """symbol, start, delist, delisted: from first bars and a (symbol, delisted) table; only the delisted have an end."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("last"))
    j = span.join(gone.select("symbol", "delisted"), "symbol", "left").withColumn("delisted", F.coalesce("delisted", F.lit(False)))
    return j.select("symbol", "start", F.when(F.col("delisted"), F.col("last")).alias("delist"), "delisted")


def audit(requested: DataFrame, bars: DataFrame, errors: DataFrame | None = None, min_bars: int = 60) -> DataFrame:
    """symbol, category, n_bars, status (reachable, dropped, error) of each requested symbol."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    out = requested.join(n, "symbol", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    if errors is not None:
        out = out.join(errors.select("symbol", F.lit(True).alias("_e")).distinct(), "symbol", "left")
    else:
        out = out.withColumn("_e", F.lit(None).cast("boolean"))
    status = F.when(F.col("_e"), "error").when(F.col("n_bars") >= min_bars, "reachable").otherwise("dropped")
    return out.select("symbol", "category", "n_bars", status.alias("status"))


def coverage(audited: DataFrame) -> DataFrame:
    """Share reachable by category; errors count neither way."""
    return audited.filter("status <> 'error'").groupBy("category").agg(F.avg(F.when(F.col("status") == "reachable", 1.0).otherwise(0.0)).alias("fraction"), F.count("*").alias("n"))
