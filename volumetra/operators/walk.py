"""Decision windows: the trailing bars of each sampled bar, and the kernels over them.

Bars are cut into chunks of consecutive decisions. A chunk holds its own bars and
the lookback - 1 before them, so a bar is shuffled once or twice, never once for
each window it is in; windows are slices that a kernel takes inside the chunk.
Chunks of one symbol go to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.functions import kernels
from volumetra.sources.bars import OHLCV, indexed

PARTS = ("value_area", "key_level", "quiet", "patterns")
SCORE = (
    "symbol string, us long, idx int, price double, atr double, poc double, vah double, val double, bin_size double, quiet_score double, is_quiet boolean, bars_in_state int, "
    + ", ".join(f"{p}_strength double, {p}_direction int, {p}_reason string" for p in PARTS)
    + ", setup_quality double, bias string, bias_score double, rationale string, n_patterns int, action string, entry double, stop double, targets array<double>, risk_per_unit double, rr double, size double, reason string"
)


CHUNK = 240


def windows(bars: DataFrame, lookback: int = 120, stride: int = 1, horizon: int = 0) -> DataFrame:
    """symbol, ts, idx and arrays o, h, l, c, v of the last `lookback` bars, for every stride-th bar with a whole window and `horizon` bars after it.

    For short windows that are to be seen as rows; kernels over long ones take `chunks`.
    """
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(-(lookback - 1), 0)
    b = indexed(bars)
    names = dict(zip(OHLCV, "ohlcv"))
    b = b.withColumns({n: F.collect_list(c).over(w) for c, n in names.items()})
    keep = (F.col("idx") >= lookback - 1) & ((F.col("idx") - (lookback - 1)) % stride == 0) & (F.col("idx") < F.col("n_bars") - horizon)
    return b.filter(keep).select("symbol", "ts", F.col("idx").cast("int").alias("idx"), *names.values())


def _arrays(b: DataFrame, key: list[str], extra: tuple[str, ...]) -> DataFrame:
    one = F.struct(F.col("idx").cast("long").alias("idx"), F.unix_micros("ts").alias("us"), *[F.col(c).cast("double").alias(n) for c, n in zip(OHLCV, "ohlcv")], *extra)
    g = b.groupBy(*key, "lookback", "stride").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(one)).alias("x"))
    return g.select("symbol", "lookback", "stride", "first", "last", *[F.col(f"x.{n}").alias(n) for n in ("idx", "us", *"ohlcv", *extra)])


def chunks(bars: DataFrame, lookback: int = 120, stride: int = 1, horizon: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk: symbol, lookback, stride, the first and last place of a decision, and arrays over bars.

    Decisions are every stride-th bar with a whole window and `horizon` bars after it. extra: more double columns of bars.
    """
    size = max(CHUNK, lookback)
    b = indexed(bars)
    at = F.sequence(F.floor(F.col("idx") / size), F.floor((F.col("idx") + lookback - 1) / size))
    b = b.withColumn("chunk", F.explode(at)).withColumns({"lookback": F.lit(lookback), "stride": F.lit(stride)})
    b = b.withColumn("first", F.greatest(F.col("chunk") * size, F.lit(lookback - 1))).withColumn("last", F.least((F.col("chunk") + 1) * size, F.col("n_bars") - horizon) - 1)
    return _arrays(b.filter("first <= last"), ["symbol", "chunk"], extra)


def latest(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """The chunk of each symbol's last bar alone: other bars go before any array is made."""
    b = indexed(bars).filter((F.col("n_bars") >= lookback) & (F.col("idx") >= F.col("n_bars") - lookback))
    last = F.col("n_bars") - 1
    return _arrays(b.withColumns({"lookback": F.lit(lookback), "stride": F.lit(1), "first": last, "last": last}), ["symbol"], ())


def _windows(pdf, extra: tuple[str, ...] = ()):
    """(symbol, microseconds, idx, extra values at the decision, o, h, l, c, v) of every decision."""
    import numpy as np

    for r in pdf.itertuples(index=False):
        idx, us = np.asarray(r.idx), np.asarray(r.us)
        series = [np.asarray(getattr(r, k), float) for k in "ohlcv"]
        more = [np.asarray(getattr(r, k), float) for k in extra]
        for i in np.flatnonzero((idx >= r.first) & (idx <= r.last) & ((idx - (r.lookback - 1)) % r.stride == 0)):
            own = slice(i - r.lookback + 1, i + 1)
            yield r.symbol, int(us[i]), int(idx[i]), [float(m[i]) for m in more], *(x[own] for x in series)


def _timed(df: DataFrame) -> DataFrame:
    return df.select("symbol", F.timestamp_micros("us").alias("ts"), *[c for c in df.columns if c not in ("symbol", "us")])


def scores(cut: DataFrame, mode: str = "auto", style: str = "reversion", equity: float = 10_000.0) -> DataFrame:
    """Profile levels, components, quality, bias and plan of each decision of `chunks`; a window without volume gives no row."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            out = []
            for symbol, us, idx, _, o, h, l, c, v in _windows(pdf):
                a = kernels.analyse(o, h, l, c, v, mode, style, equity)
                if a is None:
                    continue
                p, q, found, s, t = a
                row = [symbol, us, idx, s["price"], s["atr"], p["poc"], p["vah"], p["val"], p["bin_size"], q["score"], q["is_quiet"], q["bars"]]
                for k in PARTS:
                    row += list(s["parts"][k])
                row += [s["quality"], s["bias"], s["bias_score"], s["rationale"], len(found), t["action"], t["entry"], t["stop"], t["targets"], t["risk_per_unit"], t["rr"], t["size"], t["reason"]]
                out.append(row)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORE.split(", ")])

    return _timed(cut.mapInPandas(run, SCORE))


STRUCTURE = ("delta_net", "delta_poc", "skew", "kurtosis", "poc_loc", "vacr_z", "poc_slope", "cost_basis_migration", "n_ledges", "poor_high", "is_p_shape", "is_b_lower", "is_b_upper")
_RAW = ("delta_net", "delta_poc", "skew", "kurtosis", "poc_loc", "cost_basis_migration", "n_ledges", "poor_high", "poor_low", "is_p_shape", "is_b_lower", "is_b_upper", "vacr", "poc", "close")


def structural(cut: DataFrame, mode: str = "auto", halflife: float = 21.0) -> DataFrame:
    """Structural features of each decision of `chunks` (extra column atr optional), before those that look at earlier windows."""
    import pandas as pd

    extra = ("atr",) if "atr" in cut.columns else ()

    def run(frames):
        for pdf in frames:
            out = []
            for symbol, us, idx, more, o, h, l, c, v in _windows(pdf, extra):
                p = kernels.profile(h, l, c, v, mode)
                if p is None:
                    continue
                now = more[0] if more and more[0] == more[0] else float(kernels.atr(h, l, c)[-1])
                x = kernels.structure(h, l, c, v, p, now, halflife)
                out.append([symbol, us, idx, x["shape"], *(float(x[k]) for k in _RAW)])
            yield pd.DataFrame(out, columns=["symbol", "us", "idx", "shape", *_RAW])

    return _timed(cut.mapInPandas(run, "symbol string, us long, idx int, shape string, " + ", ".join(f"{k} double" for k in _RAW)))


def structural_walk(cut: DataFrame, vacr_window: int = 20, poc_window: int = 5, mode: str = "auto", halflife: float = 21.0) -> DataFrame:
    """The 13 structural features. Windows over the sampled rows: the compression's z-score against the `vacr_window`
    rows before (population deviation), and the slope of the last `poc_window` points of control per close."""
    s = structural(cut, mode, halflife)
    o = W.partitionBy("symbol").orderBy("idx")
    past, recent = o.rowsBetween(-vacr_window, -1), o.rowsBetween(-(poc_window - 1), 0)
    s = s.withColumn("_k", F.row_number().over(o) - 1)
    sd = F.stddev_pop("vacr").over(past)
    slope = F.regr_slope(F.col("poc"), F.col("_k").cast("double")).over(recent)
    s = s.withColumn("vacr_z", F.when(sd > 1e-12, (F.col("vacr") - F.avg("vacr").over(past)) / sd).otherwise(0.0))
    s = s.withColumn("poc_slope", F.when(F.col("close") > 1e-12, slope / F.col("close")).otherwise(0.0))
    return s.filter(F.col("_k") >= max(vacr_window, poc_window - 1)).select("symbol", "ts", "idx", "shape", "poc", "vacr", *STRUCTURE)
