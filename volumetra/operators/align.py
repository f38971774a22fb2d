"""Joins on time: as-of, bounded as-of, membership, common dates.

An as-of join is a union and a running `last` over one sorted partition, not a
range join: linear in both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, columns: list[str], key: str = "symbol", ts: str = "ts", strict: bool = False) -> DataFrame:
    """left with the latest values of right's columns at or before (strict: before) its own time."""
    names = left.columns
    a = left.withColumn("_side", F.lit(0 if strict else 1)).withColumns({f"_{c}": F.lit(None).cast(right.schema[c].dataType) for c in columns})
    b = right.select(key, ts, *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_side", F.lit(1 if strict else 0))
    b = b.withColumns({c: F.lit(None).cast(left.schema[c].dataType) for c in names if c not in (key, ts)})
    u = a.select(*names, "_side", *[f"_{c}" for c in columns]).unionByName(b.select(*names, "_side", *[f"_{c}" for c in columns]))
    w = W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(w) for c in columns})
    return u.filter(F.col("_side") == (0 if strict else 1)).select(*names, *[F.col(f"_{c}").alias(c) for c in columns])


def asof_within(left: DataFrame, right: DataFrame, columns: list[str], key: str = "symbol", ts: str = "ts") -> DataFrame:
    """As-of, but null outside the span that right covers for the key."""
    span = right.groupBy(key).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    out = asof(left, right, columns, key, ts).join(span, key, "left")
    inside = F.col(ts).between(F.col("_from"), F.col("_to"))
    return out.withColumns({c: F.when(inside, F.col(c)) for c in columns}).drop("_from", "_to")


def active(members: DataFrame, date) -> DataFrame:
    """Members on a date: started and not yet delisted; an open end is no bound."""
    d = F.lit(date).cast("timestamp")
    return members.filter((F.col("start").isNull() | (F.col("start") <= d)) & (F.col("delist").isNull() | (F.col("delist") >= d)))


def common_dates(bars: DataFrame) -> DataFrame:
    """Bars on the dates that every symbol has."""
    n = bars.select("symbol").distinct().agg(F.count("*").alias("n"))
    full = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("k")).crossJoin(n).filter("k = n").select("ts")
    return bars.join(full, "ts", "left_semi")


def non_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without those of the columns that are null throughout."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not counts[c]])
