"""Queries over volume profiles: A1-A16, A24-A27 on histograms, J7, J11, P3, P7, L2, C1-C11, K4."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions.rolling import CLV_CLIPPED
from volumetra.operators import profile as P
from volumetra.operators import walk
from volumetra.plans.registry import DUCK, EVENT, FLAG, query, staged
from volumetra.plans.rolling import ATR_STAGES
from volumetra.sources.bars import VIEWS

BINS = 50
_G = f"g AS (SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / {BINS} AS size, sum(volume) AS total, count(*) AS n_bars FROM bars WHERE volume > 0 GROUP BY symbol)"
_K = f"(SELECT unnest(range({BINS})) AS bin) k"


def _hist(amount: str = "volume", name: str = "h", source: str = "bars") -> str:
    over = "greatest(0, least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size)) / (high - low)"
    flat = f"CASE WHEN bin = greatest(0, least({BINS - 1}, floor((low - lo) / size))) THEN 1 ELSE 0 END"
    return f"{name} AS (SELECT b.symbol, bin, lo + (bin + 0.5) * size AS center, sum({amount} * CASE WHEN high > low THEN {over} ELSE {flat} END) AS volume FROM {source} b JOIN g USING (symbol), {_K} GROUP BY 1, 2, 3)"


BASE = f"WITH {FLAG}, {_G}, {_hist()}"
_POC = "p AS (SELECT symbol, arg_max(center, row(round(volume, 6), -bin)) AS poc, max(volume) AS poc_volume, arg_max(bin, row(round(volume, 6), -bin)) AS poc_bin FROM h GROUP BY symbol)"


def base(spark, sf_dir, padded=True):
    """(bars, grid, dense histogram) of the daily view."""
    b = P.usable(VIEWS["flag"](spark, sf_dir))
    g = P.grid(b, BINS, padded=padded)
    return b, g, P.dense(P.histogram(b, g), g)


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


@query("a1_volume_histogram", f"{BASE} SELECT symbol, bin, round(center, 4) AS center, round(volume, 4) AS volume FROM h")
def volume_histogram(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    return d.select("symbol", F.col("bin").cast("long").alias("bin"), r("center"), r("volume"))


@query("j7_bar_bin_overlap", f"WITH {FLAG}, {_G} SELECT symbol, {'CAST(ts AS VARCHAR)'} AS ts, count(*) AS n_bins, round(sum(greatest(0, least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size))), 4) AS covered FROM bars JOIN g USING (symbol), {_K} WHERE least(high, lo + (bin + 1) * size) - greatest(low, lo + bin * size) > 1e-9 GROUP BY 1, 2")
def bar_bin_overlap(spark, sf_dir):
    b = P.usable(VIEWS["flag"](spark, sf_dir))
    g = P.grid(b, BINS)
    j = b.join(g.select("symbol", "e0", "size"), "symbol")
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(x) - F.col("e0")) / F.col("size")).cast("int")))
    j = j.withColumn("bin", F.explode(F.sequence(F.greatest(F.lit(0), at("low") - 1), F.least(F.lit(BINS - 1), at("high") + 1))))
    over = F.least("high", F.col("e0") + (F.col("bin") + 1) * F.col("size")) - F.greatest("low", F.col("e0") + F.col("bin") * F.col("size"))
    return j.withColumn("o", over).filter("o > 1e-9").groupBy("symbol", F.col("ts").cast("string").alias("ts")).agg(F.count("*").alias("n_bins"), F.round(F.sum("o"), 4).alias("covered"))


@query("a2_typical_price_histogram", f"WITH {FLAG}, {_G} SELECT symbol, CAST(greatest(0, least({BINS - 1}, floor(((high + low + close) / 3 - lo) / size))) AS BIGINT) AS bin, round(sum(volume), 4) AS volume FROM bars JOIN g USING (symbol) GROUP BY 1, 2")
def typical_histogram(spark, sf_dir):
    b = P.usable(VIEWS["flag"](spark, sf_dir))
    return P.histogram(b, P.grid(b, BINS), typical=True).select("symbol", F.col("bin").cast("long").alias("bin"), r("volume"))


_ATR = "t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars)"


@query("a3_auto_bins", f"WITH {EVENT}, {_ATR}, a AS (SELECT symbol, avg(tr) AS atr FROM t WHERE back <= 14 GROUP BY symbol), g AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol), n AS (SELECT symbol, lo, hi, greatest(20, least(500, round_even((hi - lo) / (atr * 0.25), 0))) AS n FROM g JOIN a USING (symbol)) SELECT symbol, CAST(n AS BIGINT) AS n_bins, round((hi - lo) / n, 6) AS size, round(lo, 6) AS price_low, round(hi, 6) AS price_high FROM n")
def auto_bins(spark, sf_dir):
    g = P.grid(VIEWS["event"](spark, sf_dir), mode="auto")
    return g.select("symbol", F.col("n_bins").cast("long").alias("n_bins"), r("size", 6), r("price_low", 6), r("price_high", 6))


@query("a5_point_of_control", f"{BASE}, {_POC} SELECT symbol, round(poc, 4) AS poc, round(poc_volume, 4) AS poc_volume, round(total, 4) AS total_volume, round(lo, 4) AS price_low, round(hi, 4) AS price_high FROM p JOIN g USING (symbol)")
def poc(spark, sf_dir):
    _, g, d = base(spark, sf_dir, padded=False)
    p = P.point_of_control(d).join(g, "symbol")
    return p.select("symbol", r("poc"), r("poc_volume"), r("total_volume"), r("price_low"), r("price_high"))


_LISTS = "l AS (SELECT symbol, list(volume ORDER BY bin) AS hist, list(center ORDER BY bin) AS centers FROM h GROUP BY symbol)"
_VA = f"""va AS (SELECT symbol, hist, centers, CAST(list_position(hist, list_max(hist)) AS BIGINT) AS lo, CAST(list_position(hist, list_max(hist)) AS BIGINT) AS hi, list_max(hist) AS inside, 0.7 * list_sum(hist) AS target FROM l
 UNION ALL SELECT symbol, hist, centers,
  CASE WHEN hi < {BINS} AND (lo = 1 OR coalesce(hist[hi + 1], 0) + coalesce(hist[hi + 2], 0) >= coalesce(hist[lo - 1], 0) + CASE WHEN lo > 2 THEN hist[lo - 2] ELSE 0 END) THEN lo ELSE greatest(1, lo - 2) END,
  CASE WHEN hi < {BINS} AND (lo = 1 OR coalesce(hist[hi + 1], 0) + coalesce(hist[hi + 2], 0) >= coalesce(hist[lo - 1], 0) + CASE WHEN lo > 2 THEN hist[lo - 2] ELSE 0 END) THEN least({BINS}, hi + 2) ELSE hi END,
  inside + CASE WHEN hi < {BINS} AND (lo = 1 OR coalesce(hist[hi + 1], 0) + coalesce(hist[hi + 2], 0) >= coalesce(hist[lo - 1], 0) + CASE WHEN lo > 2 THEN hist[lo - 2] ELSE 0 END) THEN coalesce(hist[hi + 1], 0) + coalesce(hist[hi + 2], 0) ELSE coalesce(hist[lo - 1], 0) + CASE WHEN lo > 2 THEN hist[lo - 2] ELSE 0 END END, target
  FROM va WHERE inside < target AND (lo > 1 OR hi < {BINS}))"""
_VALUE = "v AS (SELECT symbol, arg_max(centers[lo], hi - lo) AS val, arg_max(centers[hi], hi - lo) AS vah, max(inside) AS va_volume FROM va GROUP BY symbol)"
VALUE = f"WITH RECURSIVE {FLAG}, {_G}, {_hist()}, {_POC}, {_LISTS}, {_VA}, {_VALUE}"


@query("a6_value_area", f"{VALUE} SELECT symbol, round(val, 4) AS val, round(vah, 4) AS vah, round(va_volume, 3) AS va_volume FROM v")
def value_area(spark, sf_dir):
    _, _, d = base(spark, sf_dir, padded=False)
    return P.value_area(P.arrays(d)).select("symbol", r("val"), r("vah"), r("va_volume", 3))


@query("a6_value_area_udtf", f"{VALUE} SELECT symbol, round(val, 4) AS val, round(vah, 4) AS vah, round(va_volume, 3) AS va_volume FROM v")
def value_area_udtf(spark, sf_dir):
    """The value area called from SQL, a partition a symbol."""
    from volumetra.functions import tables

    tables.register(spark)
    _, _, d = base(spark, sf_dir, padded=False)
    d.select("symbol", "bin", "center", "volume").createOrReplaceTempView("volumetra_histogram")
    v = spark.sql("SELECT * FROM volumetra_value_area(TABLE(volumetra_histogram) PARTITION BY symbol ORDER BY bin)")
    return v.select("symbol", r("val"), r("vah"), r("va_volume", 3))


def with_levels(spark, sf_dir):
    b, g, d = base(spark, sf_dir, padded=False)
    return b, P.value_area(P.arrays(d)).join(P.point_of_control(d), "symbol")


_EPS = "1e-9"


@query("p7_location_in_value", f"{VALUE} SELECT symbol, CAST(ts AS VARCHAR) AS ts, CASE WHEN close > vah THEN 'above_value' WHEN close < val THEN 'below_value' ELSE 'in_value' END AS location, close BETWEEN val AND vah AS in_area FROM bars JOIN v USING (symbol)")
def location(spark, sf_dir):
    b, v = with_levels(spark, sf_dir)
    j = b.join(v, "symbol")
    where = F.when(F.col("close") > F.col("vah"), "above_value").when(F.col("close") < F.col("val"), "below_value").otherwise("in_value")
    return j.select("symbol", F.col("ts").cast("string").alias("ts"), where.alias("location"), F.col("close").between(F.col("val"), F.col("vah")).alias("in_area"))


@query(
    "j11_nearest_level",
    f"{VALUE}, d AS (SELECT symbol, ts, close, unnest([row('POC', 0, poc), row('VAH', 1, vah), row('VAL', 2, val)]) AS x FROM bars JOIN v USING (symbol) JOIN p USING (symbol)) SELECT symbol, CAST(ts AS VARCHAR) AS ts, arg_min(x[1], row(round(abs(close - x[3]), 6), x[2])) AS level, round(min(abs(close - x[3])), 4) AS distance FROM d WHERE abs(close - x[3]) < 5000 GROUP BY symbol, ts",
)
def nearest_level(spark, sf_dir):
    """The nearest level within a tolerance; of equals the more significant one. Inside the row: levels are an array."""
    b, v = with_levels(spark, sf_dir)
    j = b.join(v, "symbol")
    levels = F.array(*[F.struct(F.round(F.abs(F.col("close") - F.col(c)), 6).alias("d"), F.lit(i).alias("rank"), F.lit(n).alias("level"), F.abs(F.col("close") - F.col(c)).alias("raw")) for i, (n, c) in enumerate((("POC", "poc"), ("VAH", "vah"), ("VAL", "val")))])
    j = j.withColumn("best", F.array_min(F.filter(levels, lambda x: x["raw"] < 5000))).filter("best is not null")
    return j.select("symbol", F.col("ts").cast("string").alias("ts"), F.col("best.level").alias("level"), F.round("best.raw", 4).alias("distance"))


@query("w15_level_anchoring")
def level_anchoring(spark, sf_dir):
    """Closes next to a profile level, nodes included, within half an ATR."""
    s = walk.scores(walk.chunks(VIEWS["event"](spark, sf_dir), 120, 24))
    d = F.array(*[F.struct(F.abs(F.col("price") - F.col(c)).alias("d"), F.lit(n).alias("n")) for c, n in (("poc", "POC"), ("vah", "VAH"), ("val", "VAL"))])
    return s.withColumn("b", F.array_min(d)).select("symbol", F.col("ts").cast("string").alias("ts"), F.when(F.col("b.d") < 0.5 * F.col("atr"), F.concat_ws(" ", F.col("b.n"), F.format_string("%.2f", F.when(F.col("b.n") == "POC", F.col("poc")).when(F.col("b.n") == "VAH", F.col("vah")).otherwise(F.col("val"))))).alias("at_level"))


@query("a7_volume_nodes")
def volume_nodes(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    n = P.with_nodes(P.arrays(d)).select("symbol", F.explode("nodes").alias("n"))
    return n.select("symbol", "n.kind", F.round("n.price", 4).alias("price"), F.round("n.volume", 4).alias("volume"), F.round("n.volume_pct", 4).alias("volume_pct"))


@query("l2_top_bins", f"{BASE} SELECT symbol, bin, round(volume, 4) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY round(volume, 6) DESC, bin) AS place FROM h QUALIFY place <= 5")
def top_bins(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    d = d.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.round("volume", 6).desc(), "bin"))).filter("place <= 5")
    return d.select("symbol", F.col("bin").cast("long").alias("bin"), r("volume"), F.col("place").cast("long").alias("place"))


_MOMENTS = f"{BASE}, mu AS (SELECT symbol, sum(volume * center) / sum(volume) AS mean, sum(volume) AS t FROM h GROUP BY symbol), m AS (SELECT symbol, any_value(mean) AS mean, sum(volume * power(center - mean, 2)) / any_value(t) AS m2, sum(volume * power(center - mean, 3)) / any_value(t) AS m3, sum(volume * power(center - mean, 4)) / any_value(t) AS m4 FROM h JOIN mu USING (symbol) GROUP BY symbol)"


@query("a8_weighted_moments", f"{_MOMENTS} SELECT symbol, round(mean, 3) AS mean, round(sqrt(m2), 3) AS std, round(m3 / power(m2, 1.5), 5) AS skew, round(m4 / power(m2, 2), 5) AS kurtosis FROM m")
def weighted_moments(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    return P.moments(d).select("symbol", r("mean", 3), r("std", 3), r("skew", 5), r("kurtosis", 5))


@query("a9_synthetic_delta", f"WITH {FLAG}, {_G}, {_hist()}, {_hist('volume * ' + '(' + CLV_CLIPPED + ')', 'dl')}, j AS (SELECT h.symbol, h.bin, h.volume, dl.volume AS delta FROM h JOIN dl ON h.symbol = dl.symbol AND h.bin = dl.bin) SELECT symbol, round(sum(delta) / sum(volume), 6) AS delta_net, round(arg_max(delta / nullif(volume, 0), row(round(volume, 6), -bin)), 6) AS delta_poc FROM j GROUP BY symbol")
def synthetic_delta(spark, sf_dir):
    b, g, _ = base(spark, sf_dir)
    return P.delta(b, g).select("symbol", r("delta_net", 6), r("delta_poc", 6))


@query("a10_poc_location", f"{BASE}, {_POC} SELECT symbol, round(greatest(0.0, least(1.0, (poc - lo) / nullif(hi - lo, 0))), 6) AS poc_loc FROM p JOIN g USING (symbol)")
def poc_location(spark, sf_dir):
    _, g, d = base(spark, sf_dir)
    loc = (F.col("poc") - F.col("price_low")) / F.nullif(F.col("price_high") - F.col("price_low"), F.lit(0.0))
    return P.point_of_control(d).join(g, "symbol").select("symbol", F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), loc)), F.lit(0.5)), 6).alias("poc_loc"))


@query("a11_double_distribution")
def double_distribution(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    return P.with_double(P.arrays(d)).select("symbol", "is_double", r("valley_ratio", 6))


@query("a12_shape_class")
def shape_class(spark, sf_dir):
    _, g, d = base(spark, sf_dir)
    j = P.with_double(P.arrays(d)).join(P.moments(d), "symbol").join(P.point_of_control(d), "symbol").join(g, "symbol")
    loc = (F.col("poc") - F.col("price_low")) / F.nullif(F.col("price_high") - F.col("price_low"), F.lit(0.0))
    s = F.col("skew")
    shape = F.when(F.col("is_double"), "B").when((s < -0.5) & (loc > 0.7), "P").when((s > 0.5) & (loc < 0.3), "b").when(F.abs(s) < 0.5, "D").otherwise("unknown")
    return j.select("symbol", shape.alias("shape"), r("skew", 5))


@query("a13_ledges", f"{BASE}, s AS (SELECT symbol, bin, volume - lag(volume) OVER (PARTITION BY symbol ORDER BY bin) AS step FROM h), d AS (SELECT *, stddev_pop(step) OVER (PARTITION BY symbol) AS sd FROM s WHERE step IS NOT NULL) SELECT symbol, bin, round(step, 4) AS step FROM d WHERE abs(step) > 3 * sd AND sd > 1e-12")
def ledges(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    return P.ledges(d).select("symbol", F.col("bin").cast("long").alias("bin"), r("step"))


@query("a14_poor_ends", f"{BASE} SELECT symbol, avg(volume) FILTER (WHERE bin >= {BINS - 1}) > 0.5 * avg(volume) AS poor_high, avg(volume) FILTER (WHERE bin < 1) > 0.5 * avg(volume) AS poor_low FROM h GROUP BY symbol")
def poor_ends(spark, sf_dir):
    _, _, d = base(spark, sf_dir)
    return P.poor_ends(d).select("symbol", "poor_high", "poor_low")


@query("a15_decayed_poc", f"WITH {FLAG}, {_G}, w AS (SELECT symbol, ts, high, low, volume * power(0.5, (row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1) / 21.0) AS aged FROM bars), {_hist('aged', 'h', 'w')} SELECT symbol, round(arg_max(center, row(round(volume, 6), -bin)), 4) AS decayed_poc FROM h GROUP BY symbol")
def decayed_poc(spark, sf_dir):
    b, g, _ = base(spark, sf_dir, padded=False)
    h = P.dense(P.histogram(b.withColumn("volume", P.aged(b)), g), g)
    return P.point_of_control(h).select("symbol", F.round("poc", 4).alias("decayed_poc"))


@query("a16_value_compression", f"{VALUE}, last AS (SELECT symbol, arg_max(close, ts) AS ref FROM bars GROUP BY symbol) SELECT symbol, round((vah - val) / ref, 6) AS vacr FROM v JOIN last USING (symbol)")
def value_compression(spark, sf_dir):
    b, v = with_levels(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max_by("close", "ts").alias("ref"))
    return v.join(last, "symbol").select("symbol", F.round((F.col("vah") - F.col("val")) / F.col("ref"), 6).alias("vacr"))


_LOC = "(close - val) / greatest(vah - val, 1e-9)"


def value_area_component():
    loc = F.expr(_LOC)
    strength = F.when(loc < 0, F.least(F.lit(0.98), 0.9 - 0.25 * loc)).when(loc > 1, F.least(F.lit(0.98), 0.9 + 0.25 * (loc - 1))).otherwise(0.2 + 1.4 * F.abs(loc - 0.5))
    direction = F.when(loc <= 0.45, 1).when(loc >= 0.55, -1).otherwise(0)
    return strength, direction


@query("c1_value_area_component", f"{VALUE}, last AS (SELECT symbol, arg_max(close, ts) AS close FROM bars GROUP BY symbol), x AS (SELECT symbol, {_LOC} AS loc FROM v JOIN last USING (symbol)) SELECT symbol, round(CASE WHEN loc < 0 THEN least(0.98, 0.9 - 0.25 * loc) WHEN loc > 1 THEN least(0.98, 0.9 + 0.25 * (loc - 1)) ELSE 0.2 + 1.4 * abs(loc - 0.5) END, 6) AS strength, CASE WHEN loc <= 0.45 THEN 1 WHEN loc >= 0.55 THEN -1 ELSE 0 END AS direction FROM x")
def value_component(spark, sf_dir):
    b, v = with_levels(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    s, d = value_area_component()
    return v.join(last, "symbol").select("symbol", F.round(s, 6).alias("strength"), d.alias("direction"))


def latest_scores(spark, sf_dir, style="reversion", lookback=250):
    """Score and plan of each symbol's last bar."""
    return walk.scores(walk.latest(VIEWS["event"](spark, sf_dir), lookback), style=style)


def _component(part):
    def run(spark, sf_dir):
        return latest_scores(spark, sf_dir).select("symbol", F.round(f"{part}_strength", 6).alias("strength"), F.col(f"{part}_direction").alias("direction"), F.col(f"{part}_reason").alias("reason"))

    return run


query("c2_key_level_component")(_component("key_level"))
query("c3_quiet_component")(_component("quiet"))
query("c4_pattern_component")(_component("patterns"))


@query("c5_range_unit", staged("last250", ATR_STAGES, "symbol, round(arg_max(atr, ts), 6) AS atr", "GROUP BY symbol"))
def range_unit(spark, sf_dir):
    return latest_scores(spark, sf_dir).select("symbol", r("atr", 6))


@query("c6_confluence_score")
def confluence(spark, sf_dir):
    """Quality and bias, put together from the components by SQL."""
    s = latest_scores(spark, sf_dir)
    weight = {"value_area": 1.0, "key_level": 1.0, "quiet": 1.5, "patterns": 1.5}
    quality = sum(w * F.col(f"{p}_strength") for p, w in weight.items()) * 100 / sum(weight.values())
    lean = sum(w * F.col(f"{p}_strength") * F.col(f"{p}_direction") for p, w in weight.items()) * 100 / sum(weight.values())
    return s.select("symbol", F.bround(quality, 2).alias("setup_quality"), F.bround(lean, 2).alias("bias_score"), F.when(lean > 10, "bullish").when(lean < -10, "bearish").otherwise("neutral").alias("bias"))


@query("a25_quality_bias_sums", "SELECT doc_id, round(100 * (quality * 1.5 + toxic * 1.0) / 2.5, 4) AS weighted, round(100 * (quality * 1.5 - toxic * 1.0) / 2.5, 4) AS signed_sum FROM labels")
def weighted_sums(spark, sf_dir):
    """The weighted and signed sums on a plain table."""
    t = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return t.select("doc_id", F.round(100 * (F.col("quality") * 1.5 + F.col("toxic") * 1.0) / 2.5, 4).alias("weighted"), F.round(100 * (F.col("quality") * 1.5 - F.col("toxic") * 1.0) / 2.5, 4).alias("signed_sum"))


@query("c7_rationale")
def rationale(spark, sf_dir):
    return latest_scores(spark, sf_dir).select("symbol", "rationale")


@query("c8_signal_gate")
def signal_gate(spark, sf_dir):
    s = latest_scores(spark, sf_dir)
    reason = F.when(F.col("bias") == "neutral", "no directional bias").when(F.col("setup_quality") < 55, "setup quality").when(F.abs("bias_score") < 15, "directional conviction")
    return s.select("symbol", "bias", "setup_quality", "bias_score", reason.alias("gate"))


def _plan(style):
    def run(spark, sf_dir):
        return walk.scores(walk.chunks(VIEWS["event"](spark, sf_dir), 120, 12), style=style).select("symbol", F.col("ts").cast("string").alias("ts"), "action", "entry", "stop", "targets", "rr", "size", "reason")

    return run


query("c9_reversion_plan")(_plan("reversion"))
query("c10_breakout_plan")(_plan("breakout"))


@query("c11_risk_reward_size", f"WITH {EVENT}, x AS (SELECT symbol, ts, close AS entry, low - 0.25 * (high - low) AS stop, close + 3 * (high - low) AS target FROM bars WHERE high > low), y AS (SELECT *, abs(entry - stop) AS risk FROM x) SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(abs(target - entry) / risk, 3) AS rr, CAST(floor(100.0 / risk) AS BIGINT) AS size FROM y WHERE risk > 0 AND abs(target - entry) / risk >= 1.5 AND floor(100.0 / risk) > 0")
def risk_reward(spark, sf_dir):
    b = VIEWS["event"](spark, sf_dir).filter("high > low")
    b = b.selectExpr("symbol", "ts", "close AS entry", "low - 0.25 * (high - low) AS stop", "close + 3 * (high - low) AS target").withColumn("risk", F.abs(F.col("entry") - F.col("stop")))
    rr = F.abs(F.col("target") - F.col("entry")) / F.col("risk")
    b = b.filter("risk > 0").filter((rr >= 1.5) & (F.floor(100.0 / F.col("risk")) > 0))
    return b.select("symbol", F.col("ts").cast("string").alias("ts"), F.round(rr, 3).alias("rr"), F.floor(100.0 / F.col("risk")).cast("long").alias("size"))


@query("k4_watchlist_scanner")
def scanner(spark, sf_dir):
    """All symbols by quality, best first, those without a score last: the whole stack as one distributed query."""
    s = latest_scores(spark, sf_dir, lookback=120)
    every = VIEWS["event"](spark, sf_dir).select("symbol").distinct().join(s, "symbol", "left")
    return every.select("symbol", "price", "setup_quality", "bias", "quiet_score", "is_quiet", "action", "entry", "stop", "rr").orderBy(F.desc_nulls_last("setup_quality"), "symbol")


@query("l4_order_nulls_last", f"WITH {EVENT} SELECT symbol, CAST(rank() OVER (ORDER BY CASE WHEN symbol <> 'click' THEN max(close) END DESC NULLS LAST, symbol) AS BIGINT) AS place FROM bars GROUP BY symbol")
def nulls_last(spark, sf_dir):
    g = VIEWS["event"](spark, sf_dir).groupBy("symbol").agg(F.max("close").alias("m"))
    key = F.when(F.col("symbol") != "click", F.col("m"))
    return g.withColumn("place", F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(key), "symbol")).cast("long")).select("symbol", "place")
