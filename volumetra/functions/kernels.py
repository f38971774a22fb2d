"""Array kernels over one window of bars: profile, quiet phase, patterns, score, plan.

They work on NumPy arrays and return plain dicts, and are called from Arrow
batches (`operators.walk`), one row a window, so that windows of one symbol are
spread over all tasks.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-12


# --- smoothing and peaks ----------------------------------------------------


def gaussian(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, kernel cut at four sigma, edges mirrored with the edge sample repeated."""
    if sigma <= 0:
        return x.astype(float)
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x.astype(float), r, mode="symmetric"), k / k.sum(), mode="valid")


def peaks(x: np.ndarray, prominence: float, distance: int = 2) -> np.ndarray:
    """Interior local maxima (middle of a plateau), thinned by distance from the highest down, then by prominence."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(found, int)
    keep = np.ones(len(at), bool)
    for p in np.argsort(x[at], kind="stable")[::-1] if len(at) else ():
        if keep[p]:
            close = np.abs(at - at[p]) < distance
            close[p] = False
            keep &= ~close
    out = []
    for p in at[keep]:
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + higher[0] if len(higher) else n)].min()
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, int)


# --- rolling series ---------------------------------------------------------


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    tr = h - l
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    return tr


def ewm(x: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
    out, s = np.empty(len(x)), 0.0
    for i, v in enumerate(x.tolist()):
        s = v if i == 0 else s + alpha * (v - s)
        out[i] = s
    out[: least - 1] = np.nan
    return out


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, period: int = 14) -> np.ndarray:
    return ewm(true_range(h.copy(), l, c), 1.0 / period, period)


def trailing(x: np.ndarray, k: int) -> np.ndarray:
    """(n x k) trailing windows, NaN before the start."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(k - 1, np.nan), x]), k)


def rolling_mean(x: np.ndarray, k: int, least: int) -> np.ndarray:
    v = trailing(x, k)
    n = (~np.isnan(v)).sum(axis=1)
    s = np.nansum(v, axis=1)
    return np.where(n >= least, s / np.maximum(n, 1), np.nan)


def percentile_rank(x: np.ndarray, k: int) -> np.ndarray:
    """Share of the last k bars (those missing count as bars) at or below the current; null until max(3, k/4) values."""
    v = trailing(x, k)
    size = np.minimum(np.arange(len(x)) + 1, k)
    with np.errstate(invalid="ignore"):
        rank = (v <= x[:, None]).sum(axis=1) / size
    ok = ((~np.isnan(v)).sum(axis=1) >= max(3, k // 4)) & ~np.isnan(x)
    return np.where(ok, rank, np.nan)


def rolling_slope(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    for i in range(max(2, k // 2) - 1, min(k - 1, len(x))):
        v = x[: i + 1]
        t = np.arange(i + 1) - i / 2
        out[i] = (t * (v - v.mean())).sum() / (t * t).sum()  # NaN if a value is missing
    if len(x) >= k:
        t = np.arange(k) - (k - 1) / 2
        out[k - 1 :] = np.lib.stride_tricks.sliding_window_view(x, k) @ t / (t * t).sum()
    return out


def bandwidth(c: np.ndarray, k: int = 20, n_std: float = 2.0) -> np.ndarray:
    v = trailing(c, k)
    n = (~np.isnan(v)).sum(axis=1)
    mu = np.nansum(v, axis=1) / n
    sd = np.sqrt(np.nansum((v - mu[:, None]) ** 2, axis=1) / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * n_std * sd / np.where(mu == 0, np.nan, mu)
    return np.where(n >= max(2, k // 2), out, np.nan)


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    f = np.concatenate([[False], flag, [False]]).astype(int)
    d = np.diff(f)
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist()))


# --- profile ----------------------------------------------------------------


def spread(low: np.ndarray, high: np.ndarray, amount: np.ndarray, edges: np.ndarray, flat: float = 0.0) -> np.ndarray:
    """Each bar's amount over the bins it overlaps, in proportion; a bar no wider than `flat` goes to one bin."""
    n = len(edges) - 1
    size = (edges[-1] - edges[0]) / n
    wide = high - low > flat
    out = np.zeros(n)
    if wide.any():
        lo, hi, a = low[wide, None], high[wide, None], amount[wide]
        over = np.clip(np.minimum(hi, edges[1:]) - np.maximum(lo, edges[:-1]), 0, None)
        out += (a / (hi - lo)[:, 0]) @ over
    for p, a in zip(low[~wide], amount[~wide]):
        out[int(np.clip((p - edges[0]) / size, 0, n - 1))] += a
    return out


def half_even(x: float) -> int:
    return int(round(x))


def bins(h, l, c, mode: str = "fixed", num_bins: int = 100, width: float | None = None, period: int = 14, fraction: float = 0.25, least: int = 20, most: int = 500):
    lo, hi = float(l.min()), float(h.max())
    if hi <= lo:
        pad = abs(lo) * 1e-6 + 1e-9
        lo, hi = lo - pad, hi + pad
    if mode == "auto":
        target = float(true_range(h.copy(), l, c)[-min(period, len(h)) :].mean()) * fraction
        n = half_even((hi - lo) / target) if target > 0 and math.isfinite(target) else num_bins
        return np.linspace(lo, hi, min(most, max(least, n)) + 1)
    if width:
        edges = lo + width * np.arange(max(math.ceil((hi - lo) / width), 1) + 1)
        return np.append(edges, edges[-1] + width) if edges[-1] < hi else edges
    return np.linspace(lo, hi, num_bins + 1)


def value_area(hist: np.ndarray, at: int, share: float, total: float) -> tuple[int, int, float]:
    """Grow from bin `at`, two bins a side, the heavier pair first (a tie goes up), to the share of the total."""
    lo = hi = at
    inside, last = float(hist[at]), len(hist) - 1
    while inside < share * total and (lo > 0 or hi < last):
        above, below = hist[hi + 1 : hi + 3], hist[max(lo - 2, 0) : lo]
        if len(above) and (not len(below) or above.sum() >= below.sum()):
            inside, hi = inside + float(above.sum()), hi + len(above)
        else:
            inside, lo = inside + float(below.sum()), lo - len(below)
    return lo, hi, inside


def nodes(hist: np.ndarray, centers: np.ndarray, poc: int, total: float, prominence: float = 0.1, distance: int = 2, sigma: float = 1.0, most: int = 5):
    """High and low volume nodes as (price, volume, volume_pct)."""
    make = lambda i: (float(centers[i]), float(hist[i]), float(hist[i] / total * 100))
    if len(hist) < 3 or not most:
        return ([make(poc)] if most else []), []
    s = gaussian(hist, sigma)
    top = float(s.max())
    if top <= 0:
        return [], []
    high = sorted({*peaks(s, prominence * top, distance).tolist(), poc}, key=lambda i: (-hist[i], i))
    low = sorted(peaks(top - s, prominence * top, distance).tolist(), key=lambda i: (hist[i], i)) if len(hist) >= 5 else []
    return [make(i) for i in high[:most]], [make(i) for i in low[:most]]


def profile(h, l, c, v, mode: str = "fixed", num_bins: int = 100, width: float | None = None, share: float = 0.7, typical: bool = False, **more) -> dict | None:
    """The volume profile of valid bars, or None without volume."""
    ok = np.isfinite(h) & np.isfinite(l) & np.isfinite(c) & np.isfinite(v) & (v > 0) & (h >= l)
    h, l, c, v = h[ok], l[ok], c[ok], v[ok]
    if not len(v):
        return None
    edges = bins(h, l, c, mode, num_bins, width)
    if typical:
        hist = np.bincount(np.clip(np.digitize((h + l + c) / 3, edges) - 1, 0, len(edges) - 2), v, len(edges) - 1)
    else:
        hist = spread(l, h, v, edges)
    centers = (edges[:-1] + edges[1:]) / 2
    total, at = float(hist.sum()), int(hist.argmax())
    lo, hi, inside = value_area(hist, at, share, total)
    hvn, lvn = nodes(hist, centers, at, total, **more)
    return {
        "poc": float(centers[at]), "poc_volume": float(hist[at]), "val": float(centers[lo]), "vah": float(centers[hi]), "va_volume": inside, "total": total, "hvn": hvn, "lvn": lvn,
        "edges": edges, "centers": centers, "hist": hist, "bin_size": float(edges[1] - edges[0]), "low": float(l.min()), "high": float(h.max()), "n_bars": len(v),
    }


# --- structure --------------------------------------------------------------


def clv(h, l, c) -> np.ndarray:
    r = h - l
    return np.where(r > EPS, np.clip(((c - l) - (h - c)) / np.where(r > EPS, r, 1), -1, 1), 0.0)


def moments(x: np.ndarray, w: np.ndarray) -> tuple[float, float, float, float]:
    p = w / w.sum()
    mu = float(p @ x)
    var = float(p @ (x - mu) ** 2)
    if var <= EPS:
        return mu, 0.0, 0.0, 3.0
    z = (x - mu) / math.sqrt(var)
    return mu, math.sqrt(var), float(p @ z**3), float(p @ z**4)


def double_distribution(hist: np.ndarray, share: float = 0.15, valley: float = 0.2, sigma: float = 1.0) -> tuple[bool, float]:
    s = gaussian(hist, sigma)
    at = peaks(s, share * float(s.max()), 2) if len(hist) >= 3 and s.max() > EPS else np.array([], int)
    if len(at) < 2 or hist.mean() <= EPS:
        return False, 1.0
    a, b = sorted(at[np.argsort(hist[at])[::-1]][:2].tolist())
    ratio = float(hist[a : b + 1].min() / hist.mean())
    return len(at) == 2 and ratio < valley, ratio


SHAPES = ("unknown", "P", "b", "D", "B")


def shape(p: dict, skew: float) -> int:
    if double_distribution(p["hist"])[0]:
        return 4
    at = poc_location(p)
    if skew < -0.5 and at > 0.7:
        return 1
    if skew > 0.5 and at < 0.3:
        return 2
    return 3 if abs(skew) < 0.5 else 0


def poc_location(p: dict) -> float:
    r = p["high"] - p["low"]
    return min(1.0, max(0.0, (p["poc"] - p["low"]) / r)) if r > EPS else 0.5


def structure(h, l, c, v, p: dict, atr_now: float, halflife: float = 21.0) -> dict:
    """The structural features of one window, but for those over its predecessors."""
    hist, edges = p["hist"], p["edges"]
    delta = spread(l, h, v * clv(h, l, c), edges, EPS)
    volume = spread(l, h, v, edges, EPS)
    at = int(np.abs(p["centers"] - p["poc"]).argmin())
    _, _, skew, kurt = moments(p["centers"], hist)
    kind = shape(p, skew)
    step = np.diff(hist)
    ledges = int((np.abs(step) > 3 * step.std()).sum()) if len(hist) >= 4 and step.std() > EPS else 0
    k = max(1, half_even(0.02 * len(hist)))
    poor = lambda part: bool(len(hist) >= 5 and hist.mean() > EPS and part.mean() > 0.5 * hist.mean())
    aged = spread(l, h, v * 0.5 ** (np.arange(len(v) - 1, -1, -1) / max(halflife, EPS)), edges, EPS)
    recent = float(p["centers"][aged.argmax()]) if aged.sum() > EPS else p["poc"]
    unit = atr_now if math.isfinite(atr_now) and atr_now > 0 else max(p["bin_size"], EPS)
    ref = c[-1] if c[-1] > EPS else p["poc"]
    return {
        "delta_net": float(np.clip(delta.sum() / volume.sum(), -1, 1)) if volume.sum() > EPS else 0.0,
        "delta_poc": float(np.clip(delta[at] / volume[at], -1, 1)) if volume[at] > EPS else 0.0,
        "skew": skew, "kurtosis": kurt, "poc_loc": poc_location(p), "cost_basis_migration": (recent - p["poc"]) / unit,
        "n_ledges": float(ledges), "poor_high": float(poor(hist[-k:])), "poor_low": float(poor(hist[:k])),
        "is_p_shape": float(kind == 1), "is_b_lower": float(kind == 2), "is_b_upper": float(kind == 4), "shape": SHAPES[kind],
        "vacr": (p["vah"] - p["val"]) / ref if ref > EPS else 0.0, "poc": p["poc"], "close": float(c[-1]),
    }


# --- regime -----------------------------------------------------------------


def quiet(h, l, c, v, baseline: int = 100, threshold: float = 60.0) -> dict:
    """Percentiles and score of the last bar, and how long the state has lasted."""
    a, m, b = atr(h, l, c), rolling_mean(v, 20, 10), bandwidth(c)
    ranks = [percentile_rank(x, baseline) for x in (a, m, b)]
    score = 100 * sum(1 - r for r in ranks) / 3
    on = np.nan_to_num(score, nan=-1.0) >= threshold
    last = np.flatnonzero(~on)
    bars = len(on) - 1 - last[-1] if len(last) else len(on)
    slope = rolling_slope(m[-20:], 20)[-1] if len(m) else np.nan
    s = float(score[-1]) if np.isfinite(score[-1]) else 0.0
    return {"score": s, "is_quiet": bool(on[-1]), "bars": int(bars), "falling": bool(slope < 0), "ranks": [float(r[-1]) for r in ranks]}


def level_near(price: float, p: dict | None, tolerance: float) -> str | None:
    """The nearest level within the tolerance; the more significant one on a tie."""
    if p is None or not math.isfinite(tolerance) or tolerance <= 0:
        return None
    levels = [("POC", p["poc"]), ("VAH", p["vah"]), ("VAL", p["val"]), *(("HVN", n[0]) for n in p["hvn"]), *(("LVN", n[0]) for n in p["lvn"])]
    name, at = min(levels, key=lambda x: abs(price - x[1]))
    return f"{name} {at:.2f}" if abs(price - at) < tolerance else None


# What a pattern is called, and the sentences that tell of it. {near}: " near <level>" or nothing.
PATTERN_LEADS = {"dry_up": "Volume dry-up", "climax": "Volume climax", "divergence": "{side} volume divergence over {n} bars", "accumulation": "Possible accumulation"}
PATTERN_TEXTS = {
    "dry_up": "{lead}: {n} bars with volume ≤50% of its longer-term baseline (low {strength:.0%}) — supply thinning, watch for expansion{near}.",
    "climax": "{lead}: {strength:.1f}× average volume on a wide bar ({trade} climax){near} — potential exhaustion / reversal.",
    "bearish": "{lead}: price rising while volume fades — rally lacks participation.",
    "bullish": "{lead}: price falling on shrinking volume — selling pressure waning.",
    "accumulation": "{lead}: {n} bars coiling in a tight, flat range on below-average volume{near}.",
}


def patterns(o, h, l, c, v, p: dict | None = None) -> list[dict]:
    """All volume patterns of the window, by the place of their anchor."""
    n = len(c)
    with np.errstate(divide="ignore", invalid="ignore"):
        m20, m60 = rolling_mean(v, 20, 10), rolling_mean(v, 60, 30)
        ratio, dry = v / np.where(m20 == 0, np.nan, m20), m20 / np.where(m60 == 0, np.nan, m60)
        a = atr(h, l, c)
        wide = (h - l) / np.where(a == 0, np.nan, a)
        full20, full60 = rolling_mean(v, 20, 20), rolling_mean(v, 60, 60)
        ps, vs = rolling_slope(c, 20) / rolling_mean(c, 20, 20), rolling_slope(v, 20) / np.where(full20 == 0, np.nan, full20)
        move = np.full(n, np.nan)
        move[20:] = np.abs(c[20:] - c[:-20])
        span = (np.max(trailing(h, 20), axis=1) - np.min(trailing(l, 20), axis=1)) / c
        window = trailing(span, 60)
        norm = np.full(n, np.nan)
        whole = ~np.isnan(window).any(axis=1)
        norm[whole] = np.median(window[whole], axis=1)
        flat = (move < 2 * a) & (span < norm) & (m20 < full60)
        depth = np.clip(1 - m20 / np.where(full60 == 0, np.nan, full60), 0, 1)
    out = []

    def add(kind, direction, anchor, run, strength, figure=None):
        n_bars = run[1] - run[0] + 1
        near = level_near(float(c[anchor]), p, 0.5 * float(a[anchor])) if kind != "divergence" else None
        lead = PATTERN_LEADS[kind].format(side=direction.title(), n=n_bars)
        place = f" {'at' if kind == 'climax' else 'near'} {near}" if near else ""
        words = PATTERN_TEXTS[direction if kind == "divergence" else kind]
        text = words.format(lead=lead, n=n_bars, strength=strength if figure is None else figure, trade="buying" if direction == "bearish" else "selling", near=place)
        out.append({"type": kind, "direction": direction, "at": int(anchor), "price": float(c[anchor]), "volume": float(v[anchor]), "strength": float(strength), "start": run[0], "end": run[1], "n_bars": n_bars, "at_level": near, "lead": lead, "text": text})

    for s, e in runs(dry <= 0.5):
        if e - s >= 2:
            at = s + int(np.argmin(dry[s : e + 1]))
            add("dry_up", "neutral", at, (s, e), 1 - dry[at], dry[at])
    for s, e in runs((ratio >= 2.5) & (wide >= 1.5)):
        at = s + int(np.argmax(ratio[s : e + 1]))
        add("climax", "bearish" if c[at] >= o[at] else "bullish", at, (s, e), ratio[at])
    for direction, flag in (("bearish", (ps > 5e-4) & (vs < -5e-4)), ("bullish", (ps < -5e-4) & (vs < -5e-4))):
        for s, e in runs(flag):
            if e - s >= 2:
                add("divergence", direction, e, (s, e), abs(vs[e]) / 5e-4)
    for s, e in runs(flat):
        if e - s >= 4:
            add("accumulation", "bullish", e, (s, e), depth[e] if np.isfinite(depth[e]) else 0.5)
    return sorted(out, key=lambda x: x["at"])


# --- score and plan ---------------------------------------------------------

WEIGHTS = {"value_area": 1.0, "key_level": 1.0, "quiet": 1.5, "patterns": 1.5}


# The reasons that components give, and what a rationale is made of.
REASONS = {
    "below": "below value (under VAL {val:.2f}) — stretched, reversion pull up",
    "above": "above value (over VAH {vah:.2f}) — stretched, reversion pull down",
    "low": "near value-area low (VAL {val:.2f}) — bounce zone",
    "high": "near value-area high (VAH {vah:.2f}) — rejection zone",
    "balanced": "balanced inside the value area (POC {poc:.2f})",
    "no_node": "no major volume node nearby",
    "pocket": "inside LVN {at:.2f} (air pocket — fast moves)",
    "support": "holding above HVN {at:.2f} (support)",
    "resistance": "capped below HVN {at:.2f} (resistance)",
    "coil": "quiet coil (score {score:.0f}/100) — primed for a move",
    "active": "active market (quiet score {score:.0f}/100)",
    "no_pattern": "no recent volume patterns",
    "patterns": "{n} active; latest: {lead}",
    "weak": "little decisive evidence yet",
}
HEADS = {"bullish": "Bullish setup", "bearish": "Bearish setup", "neutral": "Neutral / balanced setup"}


def value_area_part(price: float, p: dict) -> tuple[float, int, str]:
    at = (price - p["val"]) / max(p["vah"] - p["val"], 1e-9)
    beyond = max(-at, at - 1)
    if beyond > 0:
        strength, side, why = min(0.98, 0.9 + 0.25 * beyond), (1 if at < 0 else -1), "below" if at < 0 else "above"
    else:
        side = (at <= 0.45) - (at >= 0.55)
        strength, why = 0.2 + 1.4 * abs(at - 0.5), {1: "low", -1: "high", 0: "balanced"}[side]
    return strength, side, REASONS[why].format(val=p["val"], vah=p["vah"], poc=p["poc"])


def key_level_part(price: float, p: dict, unit: float) -> tuple[float, int, str]:
    """The nearest node within half a range unit; a tie is the high-volume node's."""
    within = 0.5 * unit
    nodes_ = [(abs(n[0] - price), rank, n[0]) for rank, kind in enumerate(("hvn", "lvn")) for n in p[kind]]
    far, rank, at = min(nodes_, key=lambda x: x[:2], default=(math.inf, 0, 0.0))
    if far > within:
        return 0.1, 0, REASONS["no_node"]
    side = 0 if rank else 1 if price >= at else -1
    why = {0: "pocket", 1: "support", -1: "resistance"}[side]
    return 0.3 + (0.5 if rank else 0.6) * (1 - far / within), side, REASONS[why].format(at=at)


def quiet_part(q: dict) -> tuple[float, int, str]:
    return max(0.0, min(1.0, q["score"] / 100)), 0, REASONS["coil" if q["is_quiet"] else "active"].format(score=q["score"])


def pattern_force(x: dict) -> tuple[int, float]:
    s = x["strength"] if math.isfinite(x["strength"]) else 0.0
    side = 1 if x["direction"] == "bullish" else -1
    return {"accumulation": (1, min(1.0, max(0.4, s))), "dry_up": (0, min(1.0, max(0.3, s))), "divergence": (side, 0.6), "climax": (side, min(1.0, max(0.3, (s - 1) / 3)))}[x["type"]]


def patterns_part(found: list[dict], n: int, recency: int = 10) -> tuple[float, int, str]:
    active = [x for x in found if x["at"] >= n - 1 - recency]
    if not active:
        return 0.0, 0, REASONS["no_pattern"]
    forces = [pattern_force(x) for x in active]
    weights = [f * max(0.0, min(1.0, 1 - (n - 1 - x["at"]) / max(recency, 1))) for x, (_, f) in zip(active, forces)]
    total = sum(weights)
    lean = sum(d * w for (d, _), w in zip(forces, weights)) / total if total > 0 else 0.0
    lead = max(active, key=lambda x: x["at"])["lead"]
    reason = lead if len(active) == 1 else REASONS["patterns"].format(n=len(active), lead=lead)
    return max(0.0, min(1.0, max(weights))), (lean > 0.15) - (lean < -0.15), reason


def range_unit(h, l, c, p: dict, period: int = 14) -> float:
    """ATR of the last bar, else the mean range, else the bin size."""
    for x in (atr(h, l, c, period)[-1], (h - l)[-period:].mean(), p["bin_size"]):
        if math.isfinite(x) and x > 0:
            return float(x)
    return 1e-9


def score(h, l, c, p: dict, q: dict, found: list[dict]) -> dict:
    price, unit = float(c[-1]), range_unit(h, l, c, p)
    parts = {"value_area": value_area_part(price, p), "key_level": key_level_part(price, p, unit), "quiet": quiet_part(q), "patterns": patterns_part(found, len(c))}
    weight = sum(WEIGHTS.values())
    quality = 100 * sum(WEIGHTS[k] * s for k, (s, _, _) in parts.items()) / weight
    lean = 100 * sum(WEIGHTS[k] * s * d for k, (s, d, _) in parts.items()) / weight
    bias = "bullish" if lean > 10 else "bearish" if lean < -10 else "neutral"
    return {"price": price, "atr": unit, "parts": parts, "quality": round(quality, 2), "bias": bias, "bias_score": round(lean, 2), "rationale": rationale(bias, quality, parts), "quiet_score": q["score"], "is_quiet": q["is_quiet"]}


def rationale(bias: str, quality: float, parts: dict) -> str:
    """The two weightiest parts of some strength, and the first strong one that points the other way."""
    by_weight = sorted(parts, key=lambda k: WEIGHTS[k] * parts[k][0], reverse=True)
    told = [parts[k][2] for k in by_weight if parts[k][0] >= 0.25]
    opposite = {"bullish": -1, "bearish": 1}.get(bias)
    doubts = [parts[k][2] for k in by_weight if opposite and parts[k][1] == opposite and parts[k][0] >= 0.4]
    line = "; ".join(told[:2]) or REASONS["weak"]
    return f"{HEADS[bias]} (quality {quality:.0f}/100): {line}." + "".join(f" Caution: {d}." for d in doubts[:1])


def plan(s: dict, p: dict, style: str = "reversion", equity: float = 10_000.0, min_quality: float = 55.0, min_bias: float = 15.0, min_rr: float = 1.5, stop_atr: float = 1.5, stop_buffer: float = 0.25, breakout_buffer: float = 0.1, target_rr: float = 2.0, risk: float = 0.01, require_quiet: bool = False, min_quiet: float = 60.0) -> dict:
    """action, entry, stop, targets, rr, size; action is no_trade with a reason where a gate closes."""
    none = {"action": "no_trade", "entry": None, "stop": None, "targets": [], "risk_per_unit": None, "rr": None, "size": 0.0}
    side = {"bullish": 1, "bearish": -1}.get(s["bias"], 0)
    if not side:
        return none | {"reason": "no directional bias"}
    if s["quality"] < min_quality:
        return none | {"reason": f"setup quality {s['quality']:.0f} below minimum {min_quality:.0f}"}
    if abs(s["bias_score"]) < min_bias:
        return none | {"reason": f"directional conviction {abs(s['bias_score']):.0f} below minimum {min_bias:.0f}"}
    if require_quiet and s["quiet_score"] < min_quiet:
        return none | {"reason": f"not a quiet phase (quiet score {s['quiet_score']:.0f})"}
    price, unit = s["price"], s["atr"]
    eps = 0.05 * unit
    levels = sorted({p["poc"], p["vah"], p["val"], *(n[0] for n in p["hvn"])})
    # on an axis that points the way of the trade, ahead is above
    ahead = sorted((side * x for x in levels if side * (x - price) > eps))
    behind = sorted((side * x for x in levels if side * (x - price) < -eps))
    if style == "reversion":
        entry = price
        stop = side * (behind[-1] - stop_buffer * unit) if behind else entry - side * stop_atr * unit
        targets = [x for x in (p["poc"], p["vah"] if side > 0 else p["val"]) if side * (x - price) > eps]
    else:
        entry = side * ((ahead[0] if ahead else side * price) + breakout_buffer * unit)
        stop = entry - side * stop_atr * unit
        targets = [side * x for x in sorted(side * y for y in levels) if x > side * entry + eps][:1]
    if side * (entry - stop) <= 0:
        stop = entry - side * stop_atr * unit
    targets = [x for x in targets if side * (x - entry) > eps]
    at_risk = abs(entry - stop)
    targets = targets or [entry + side * at_risk * target_rr]
    targets = sorted(set(targets), key=lambda x: side * x)[:2]
    if at_risk <= 0:
        return none | {"reason": "degenerate stop (zero risk)"}
    rr = abs(targets[0] - entry) / at_risk
    if rr < min_rr:
        return none | {"reason": f"risk:reward {rr:.2f} below minimum {min_rr:.2f}"}
    size = math.floor(equity * risk / at_risk)
    if size <= 0:
        return none | {"reason": f"risk budget ({equity * risk:.2f}) too small to size one unit at {at_risk:.2f}/unit risk"}
    return {"action": "long" if side > 0 else "short", "entry": round(entry, 6), "stop": round(stop, 6), "targets": [round(x, 6) for x in targets], "risk_per_unit": round(at_risk, 6), "rr": round(rr, 3), "size": float(size), "reason": s["rationale"]}


def analyse(o, h, l, c, v, mode: str = "auto", style: str = "reversion", equity: float = 10_000.0) -> tuple[dict, dict, list, dict, dict] | None:
    """Profile, quiet state, patterns, score and plan of one window."""
    p = profile(h, l, c, v, mode)
    if p is None or len(c) < 30:
        return None
    q = quiet(h, l, c, v)
    found = patterns(o, h, l, c, v, p)
    s = score(h, l, c, p, q, found)
    return p, q, found, s, plan(s, p, style, equity)
