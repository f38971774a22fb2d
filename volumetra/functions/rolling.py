"""Rolling features as staged SQL expressions over (symbol, ts).

A feature is a list of stages; a stage names columns by expressions that may use
bars and earlier stages. All windows share one partitioning and order, so Spark
sorts once for the whole list and keeps it in one stage.

`w(x, k)` aggregates the last k bars; `full` gives null until k values are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = dict[str, str]
ORDER = "PARTITION BY symbol ORDER BY ts"


def w(call: str, k: int) -> str:
    return f"{call} OVER ({ORDER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def prior(call: str, k: int) -> str:
    return f"{call} OVER ({ORDER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({ORDER})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({ORDER})"


def least_seen(x: str, k: int, n: int, value: str) -> str:
    """value once n of the last k x are there."""
    return f"CASE WHEN {w(f'count({x})', k)} >= {n} THEN {value} END"


def mean(x: str, k: int, n: int | None = None) -> str:
    return least_seen(x, k, k if n is None else n, w(f"avg({x})", k))


def std(x: str, k: int, n: int | None = None) -> str:
    return least_seen(x, k, k if n is None else n, w(f"stddev_samp({x})", k))


def zscore(x: str, k: int) -> str:
    return f"(({x}) - {mean(x, k)}) / ({std(x, k)} + 1e-12)"


TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
CLV = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
CLV_CLIPPED = f"greatest(-1.0, least(1.0, CASE WHEN high - low > 1e-12 THEN {CLV} ELSE 0 END))"
RET = f"close / {lag('close')} - 1"


def atr_sma(k: int = 14) -> list[Stage]:
    return [{"tr": TRUE_RANGE}, {"atr_sma": mean("tr", k, max(2, k // 2))}]


def slope(x: str, k: int, n: int | None = None) -> list[Stage]:
    """Least squares slope against the bar's place; null if a value in the window is missing or fewer than n bars are there."""
    n = max(2, k // 2) if n is None else n
    call = w(f"regr_slope({x}, _i)", k)
    return [{"_i": f"CAST(row_number() OVER ({ORDER}) AS DOUBLE)"}, {"slope": f"CASE WHEN {w(f'count({x})', k)} >= {n} AND {w(f'count({x})', k)} = {w('count(*)', k)} THEN {call} END"}]


def bandwidth(k: int = 20, n_std: float = 2.0) -> list[Stage]:
    sd, mu = w("stddev_pop(close)", k), w("avg(close)", k)
    return [{"bandwidth": least_seen("close", k, max(2, k // 2), f"2 * {n_std} * {sd} / nullif({mu}, 0)")}]


def absorption(k: int = 20) -> list[Stage]:
    return [{"_r": RET}, {"_a": "abs(_r)"}, {"absorption": f"coalesce({zscore('volume', k)} - ({zscore('_a', k)}), 0)"}]


def relative_volume(k: int = 20) -> list[Stage]:
    return [{"rvol": f"volume / ({mean('volume', k)} + 1e-12) - 1"}]


def clv_pressure(k: int = 20) -> list[Stage]:
    return [{"_clv": CLV}, {"clv_pressure": f"coalesce({mean('_clv', k)}, 0)"}]


def accumulation(k: int = 20, name: str = "accum_slope") -> list[Stage]:
    ad = f"sum({CLV} * volume) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [{"_ad": ad}, {name: f"coalesce((_ad - {lag('_ad', k)}) / ({mean('volume', k)} * {k} + 1e-12), 0)"}]


def liquidity_grab(k: int = 20) -> list[Stage]:
    low = f"CASE WHEN {prior('count(low)', k)} >= {k} THEN {prior('min(low)', k)} END"
    high = f"CASE WHEN {prior('count(high)', k)} >= {k} THEN {prior('max(high)', k)} END"
    grab = "coalesce(CASE WHEN low < _pl AND close > _pl THEN (_pl - low) / nullif(high - low, 0) ELSE 0 END, 0) - coalesce(CASE WHEN high > _ph AND close < _ph THEN (high - _ph) / nullif(high - low, 0) ELSE 0 END, 0)"
    return [{"_pl": low, "_ph": high}, {"liquidity_grab": grab}]


def wick_asymmetry(k: int = 20) -> list[Stage]:
    raw = "coalesce(((high - greatest(open, close)) - (least(open, close) - low)) / nullif(high - low, 0), 0)"
    return [{"_wick": raw}, {"wick_asym": f"coalesce({mean('_wick', k)}, 0)"}]


def price_extension(k: int = 20) -> list[Stage]:
    return [{"price_ext": f"coalesce({zscore('close', k)}, 0)"}]


def fomo_thrust(k: int = 20) -> list[Stage]:
    return [*price_extension(k), *relative_volume(k), {"fomo_thrust": "coalesce(price_ext * greatest(rvol, 0), 0) * CASE WHEN rvol IS NULL THEN 0 ELSE 1 END"}]


def volatility_expansion(short: int = 5, long: int = 20) -> list[Stage]:
    return [{"_r": RET}, {"vol_expansion": f"coalesce({std('_r', short)} / ({std('_r', long)} + 1e-12) - 1, 0)"}]


def trend_emergence(k: int = 20) -> list[Stage]:
    return [*volatility_expansion(max(2, k // 4), k), {"_mom": f"close / {lag('close', k)} - 1"}, {"trend_emergence": "coalesce(vol_expansion * sign(_mom), 0)"}]


def conviction_shift(k: int = 20) -> list[Stage]:
    return [*accumulation(k), {"conviction_shift": f"coalesce(accum_slope - {lag('accum_slope', k)}, 0)"}]


def apply(bars: DataFrame, stages: list[Stage]) -> DataFrame:
    for s in stages:
        bars = bars.withColumns({k: F.expr(v) for k, v in s.items()})
    return bars


def renamed(stages: list[Stage], tag: str, out: dict[str, str], source: tuple[str, ...] = ("open", "high", "low", "close", "volume", "symbol", "ts")) -> list[Stage]:
    """Stages with every column of their own suffixed by tag, and the results named by out: several features side by side."""
    import re

    own = {c for s in stages for c in s}
    new = {c: out.get(c, f"{c}_{tag}") for c in own}

    def sub(text: str) -> str:
        return re.sub(r"\b(" + "|".join(sorted(map(re.escape, own), key=len, reverse=True)) + r")\b", lambda m: new[m[1]], text)

    return [{new[k]: sub(v) for k, v in s.items()} for s in stages]


def behavioral(short: int = 5, med: int = 21, long: int = 63, grab: int = 20) -> tuple[list[Stage], list[str]]:
    """All stages of the behavioural frame, and its columns in order."""
    spec = [
        (f"rvol_{short}", relative_volume(short), "rvol"), (f"rvol_{med}", relative_volume(med), "rvol"), (f"absorption_{med}", absorption(med), "absorption"),
        (f"clv_pressure_{short}", clv_pressure(short), "clv_pressure"), (f"clv_pressure_{med}", clv_pressure(med), "clv_pressure"),
        (f"accum_slope_{med}", accumulation(med), "accum_slope"), (f"accum_slope_{long}", accumulation(long), "accum_slope"),
        (f"liquidity_grab_{grab}", liquidity_grab(grab), "liquidity_grab"), (f"wick_asym_{med}", wick_asymmetry(med), "wick_asym"),
        (f"price_ext_{med}", price_extension(med), "price_ext"), (f"price_ext_{long}", price_extension(long), "price_ext"),
        (f"vol_expansion_{short}_{med}", volatility_expansion(short, med), "vol_expansion"), (f"trend_emergence_{med}", trend_emergence(med), "trend_emergence"),
        (f"conviction_shift_{med}", conviction_shift(med), "conviction_shift"), (f"fomo_thrust_{med}", fomo_thrust(med), "fomo_thrust"),
    ]
    parts = [renamed(stages, f"b{i}", {result: name}) for i, (name, stages, result) in enumerate(spec)]
    merged: list[Stage] = []
    for depth in range(max(map(len, parts))):
        merged.append({k: v for p in parts if depth < len(p) for k, v in p[depth].items()})
    return merged, [name for name, _, _ in spec]
