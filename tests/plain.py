"""Plain re-computation of the score stack, the backtest and the structural features: loops over bars, no engine code."""

import math

import numpy as np
import pandas as pd

NAN = float("nan")


def usable(w):
    ok = (w.volume > 0) & (w.high >= w.low)
    return w[ok]


def true_ranges(w):
    out, before = [], None
    for r in w.itertuples():
        out.append(r.high - r.low if before is None else max(r.high - r.low, abs(r.high - before), abs(r.low - before)))
        before = r.close
    return out


def wilder(values, period):
    """Exponential mean of weight 1 / period from the first value on, missing before `period` values."""
    return pd.Series(values).ewm(alpha=1 / period, adjust=False, min_periods=period).mean().to_numpy()


def edges_of(w, mode="auto", n=50):
    lo, hi = w.low.min(), w.high.max()
    if mode == "auto":
        tr = true_ranges(w)[-14:]
        n = min(500, max(20, round((hi - lo) / (sum(tr) / len(tr) * 0.25))))
    return [lo + (hi - lo) * i / n for i in range(n + 1)]


def histogram(w, edges, amounts):
    out = [0.0] * (len(edges) - 1)
    width = (edges[-1] - edges[0]) / len(out)
    for r, a in zip(w.itertuples(), amounts):
        if r.high - r.low <= 1e-12:
            out[min(len(out) - 1, max(0, int((r.low - edges[0]) / width)))] += a
            continue
        for i in range(len(out)):
            over = min(r.high, edges[i + 1]) - max(r.low, edges[i])
            if over > 0:
                out[i] += a * over / (r.high - r.low)
    return out


def grow(hist, at, share):
    lo = hi = at
    inside, total = hist[at], sum(hist)
    while inside < share * total and (lo > 0 or hi < len(hist) - 1):
        up, down = sum(hist[hi + 1 : hi + 3]), sum(hist[max(0, lo - 2) : lo])
        if hi < len(hist) - 1 and (lo == 0 or up >= down):
            inside, hi = inside + up, min(len(hist) - 1, hi + 2)
        else:
            inside, lo = inside + down, max(0, lo - 2)
    return lo, hi


def smooth(x):
    """Gaussian weights of deviation one out to four, the series mirrored at its ends."""
    k = [math.exp(-0.5 * i * i) for i in range(-4, 5)]
    n = len(x)

    def at(i):
        i %= 2 * n
        return x[i] if i < n else x[2 * n - 1 - i]

    return [sum(k[j + 4] * at(i + j) for j in range(-4, 5)) / sum(k) for i in range(n)]


def tops(x, prominence):
    """Interior maxima two apart at least (the higher stays), each that much above the higher of its two valleys."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    gone = set()
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p not in gone:
            gone |= {q for q in found if q != p and abs(q - p) < 2}
    out = []
    for p in found:
        if p in gone:
            continue
        left = right = x[p]
        for q in range(p - 1, -1, -1):
            if x[q] > x[p]:
                break
            left = min(left, x[q])
        for q in range(p + 1, len(x)):
            if x[q] > x[p]:
                break
            right = min(right, x[q])
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return out


def profile(w, mode="auto", n=50):
    w = usable(w)
    edges = edges_of(w, mode, n)
    hist = histogram(w, edges, list(w.volume))
    mids = [(a + b) / 2 for a, b in zip(edges, edges[1:])]
    poc = max(range(len(hist)), key=lambda i: (hist[i], -i))
    lo, hi = grow(hist, poc, 0.7)
    s = smooth(hist)
    top = max(s)
    high = sorted({*tops(s, 0.1 * top), poc}, key=lambda i: (-hist[i], i))[:5]
    low = sorted(tops([top - v for v in s], 0.1 * top), key=lambda i: (hist[i], i))[:5] if len(hist) >= 5 else []
    return {"edges": edges, "hist": hist, "mids": mids, "at": poc, "poc": mids[poc], "val": mids[lo], "vah": mids[hi], "hvn": [(mids[i], hist[i]) for i in high], "lvn": [(mids[i], hist[i]) for i in low], "bin": edges[1] - edges[0], "low": w.low.min(), "high": w.high.max()}


def double(hist):
    s = smooth(hist)
    at = tops(s, 0.15 * max(s))
    if len(at) < 2:
        return False, 1.0
    two = sorted(sorted(at, key=lambda i: hist[i])[-2:])
    ratio = min(hist[two[0] : two[1] + 1]) / (sum(hist) / len(hist))
    return len(at) == 2 and ratio < 0.2, ratio


def weighted_moments(p):
    t = sum(p["hist"])
    mu = sum(v * m for v, m in zip(p["hist"], p["mids"])) / t
    m2, m3, m4 = (sum(v * (m - mu) ** k for v, m in zip(p["hist"], p["mids"])) / t for k in (2, 3, 4))
    return m3 / m2**1.5, m4 / m2**2


def shape(p):
    skew, _ = weighted_moments(p)
    loc = min(1, max(0, (p["poc"] - p["low"]) / (p["high"] - p["low"])))
    return "B" if double(p["hist"])[0] else "P" if skew < -0.5 and loc > 0.7 else "b" if skew > 0.5 and loc < 0.3 else "D" if abs(skew) < 0.5 else "unknown"


def rank_in(x, k):
    out = []
    for i in range(len(x)):
        v = x[max(0, i - k + 1) : i + 1]
        have = [y for y in v if y == y]
        out.append(sum(y <= x[i] for y in have) / len(v) if len(have) >= max(3, k // 4) and x[i] == x[i] else NAN)
    return out


def quiet(w):
    atr = wilder(true_ranges(w), 14)
    vol = w.volume.rolling(20, min_periods=10).mean().to_numpy()
    c = w.close.rolling(20, min_periods=10)
    band = (4 * c.std(ddof=0) / c.mean()).to_numpy()
    ranks = [rank_in(list(x), 100) for x in (atr, vol, band)]
    score = [100 * sum(1 - r for r in rs) / 3 for rs in zip(*ranks)]
    bars = 0
    for s in score[::-1]:
        if not s >= 60:
            break
        bars += 1
    last = score[-1] if score[-1] == score[-1] else 0.0
    return {"score": last, "on": bool(score[-1] >= 60), "bars": bars}


def slope(x, k):
    out = []
    for i in range(len(x)):
        v = x[max(0, i - k + 1) : i + 1]
        out.append(float(np.polyfit(range(len(v)), v, 1)[0]) if len(v) >= max(2, k // 2) and all(y == y for y in v) else NAN)
    return out


def stretches(flags, least):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            if i - start >= least:
                out.append((start, i - 1))
            start = None
    return out


def patterns(w):
    """(kind, side, anchor, strength) in the order of anchors, kinds in the order they are looked for."""
    c, h, l, o, v = (w[x].to_numpy(float) for x in ("close", "high", "low", "open", "volume"))
    V, C = pd.Series(v), pd.Series(c)
    m20, m60 = V.rolling(20, min_periods=10).mean(), V.rolling(60, min_periods=30).mean()
    atr = pd.Series(wilder(true_ranges(w), 14))
    f20, f60 = V.rolling(20).mean(), V.rolling(60).mean()
    dry, ratio, wide = m20 / m60, V / m20, (h - l) / atr
    out = []
    for a, b in stretches(list(dry <= 0.5), 3):
        at = min(range(a, b + 1), key=lambda i: dry[i])
        out.append(("dry_up", 0, at, 1 - dry[at]))
    for a, b in stretches(list((ratio >= 2.5) & (wide >= 1.5)), 1):
        at = max(range(a, b + 1), key=lambda i: (ratio[i], -i))
        out.append(("climax", -1 if c[at] >= o[at] else 1, at, ratio[at]))
    ps, vs = pd.Series(slope(list(c), 20)) / C.rolling(20).mean(), pd.Series(slope(list(v), 20)) / f20
    for side, flag in ((-1, (ps > 5e-4) & (vs < -5e-4)), (1, (ps < -5e-4) & (vs < -5e-4))):
        for a, b in stretches(list(flag), 3):
            out.append(("divergence", side, b, abs(vs[b]) / 5e-4))
    span = (pd.Series(h).rolling(20).max() - pd.Series(l).rolling(20).min()) / C
    flat = (C.diff(20).abs() < 2 * atr) & (span < span.rolling(60).median()) & (m20 < f60)
    for a, b in stretches(list(flat), 5):
        depth = min(1, max(0, 1 - m20[b] / f60[b]))
        out.append(("accumulation", 1, b, depth if depth == depth else 0.5))
    return sorted(out, key=lambda x: x[2])


def parts_of(w, p):
    price = float(w.close.iloc[-1])
    atr = wilder(true_ranges(w), 14)[-1]
    unit = atr if atr == atr and atr > 0 else max(float((w.high - w.low).iloc[-14:].mean()), 0) or p["bin"]
    at = (price - p["val"]) / max(p["vah"] - p["val"], 1e-9)
    if at < 0 or at > 1:
        beyond = -at if at < 0 else at - 1
        value = (min(0.98, 0.9 + 0.25 * beyond), 1 if at < 0 else -1)
    else:
        value = (0.2 + 0.7 * (abs(at - 0.5) / 0.5), 1 if at <= 0.45 else -1 if at >= 0.55 else 0)
    near = lambda xs: min(((abs(x - price), x) for x, _ in xs), key=lambda t: t[0], default=(math.inf, NAN))
    (dh, hx), (dl, _), tol = near(p["hvn"]), near(p["lvn"]), 0.5 * unit
    if min(dh, dl) > tol:
        level = (0.1, 0)
    elif dh <= dl:
        level = (0.3 + 0.6 * (1 - dh / tol), 1 if price >= hx else -1)
    else:
        level = (0.3 + 0.5 * (1 - dl / tol), 0)
    q = quiet(w)
    found = patterns(w)
    active = [x for x in found if x[2] >= len(w) - 11]
    weigh = {"accumulation": lambda s: min(1, max(0.4, s)), "dry_up": lambda s: min(1, max(0.3, s)), "divergence": lambda s: 0.6, "climax": lambda s: min(1, max(0.3, (s - 1) / 3))}
    weights = [weigh[k](s) * max(0, 1 - (len(w) - 1 - a) / 10) for k, _, a, s in active]
    lean = sum(x[1] * y for x, y in zip(active, weights)) / sum(weights) if sum(weights) > 0 else 0
    pattern = (min(1, max(weights)), 1 if lean > 0.15 else -1 if lean < -0.15 else 0) if active else (0.0, 0)
    parts = {"value_area": value, "key_level": level, "quiet": (min(1, max(0, q["score"] / 100)), 0), "patterns": pattern}
    return price, unit, q, found, parts


def analysis(w):
    p = profile(w)
    price, unit, q, found, parts = parts_of(w, p)
    weight = {"value_area": 1, "key_level": 1, "quiet": 1.5, "patterns": 1.5}
    quality = 100 * sum(weight[k] * parts[k][0] for k in weight) / 5
    lean = 100 * sum(weight[k] * parts[k][0] * parts[k][1] for k in weight) / 5
    return {"p": p, "price": price, "unit": unit, "quiet": q, "found": found, "parts": parts, "quality": round(quality, 2), "bias": "bullish" if lean > 10 else "bearish" if lean < -10 else "neutral", "lean": round(lean, 2)}


def plan(a, style, equity=10_000.0):
    """None, or (side, entry, stop, targets, ratio, size); a second value says which gate closed."""
    side = {"bullish": 1, "bearish": -1}.get(a["bias"], 0)
    if not side:
        return None, "bias"
    if a["quality"] < 55:
        return None, "quality"
    if abs(a["lean"]) < 15:
        return None, "conviction"
    p, price, unit = a["p"], a["price"], a["unit"]
    eps = 0.05 * unit
    levels = {p["poc"], p["vah"], p["val"], *(x for x, _ in p["hvn"])}
    if side > 0:
        above, below = sorted(x for x in levels if x > price + eps), sorted((x for x in levels if x < price - eps), reverse=True)
    else:
        above, below = sorted((x for x in levels if x < price - eps), reverse=True), sorted(x for x in levels if x > price + eps)
    if style == "reversion":
        entry = price
        stop = below[0] - side * 0.25 * unit if below else entry - side * 1.5 * unit
        targets = [p["poc"], p["vah"] if side > 0 else p["val"]]
    else:
        entry = (above[0] if above else price) + side * 0.1 * unit
        stop = entry - side * 1.5 * unit
        targets = sorted((x for x in levels if side * (x - entry) > eps), key=lambda x: side * x)[:1]
    if side * (entry - stop) <= 0:
        stop = entry - side * 1.5 * unit
    targets = sorted({x for x in targets if side * (x - entry) > eps}, key=lambda x: side * x)[:2]
    if style == "reversion":
        targets = [x for x in targets if side * (x - price) > eps]
    risk = abs(entry - stop)
    targets = targets or [entry + side * 2 * risk]
    ratio = abs(targets[0] - entry) / risk
    if ratio < 1.5:
        return None, "ratio"
    size = math.floor(equity * 0.01 / risk)
    if size <= 0:
        return None, "size"
    return (side, entry, stop, targets, ratio, size), "trade"


def backtest(bars, lookback=120, style="reversion", analyses=None, cash=10_000.0, slip=5e-4):
    """(trades, equity by bar) of one symbol: each close decides with the cash it has, the next open fills."""
    rows = list(bars.itertuples())
    held = order = None
    trades, curve = [], {}

    def leave(i, price, why):
        nonlocal held, cash
        if why != "end":  # what is open at the end is marked at the close
            price *= 1 - held["side"] * slip
        pnl = held["side"] * (price - held["entry"]) * held["size"]
        cash += pnl
        trades.append({"side": "long" if held["side"] > 0 else "short", "entry_idx": held["at"], "exit_idx": i, "entry_price": held["entry"], "exit_price": price, "size": held["size"], "pnl": pnl, "exit_reason": why, "r": pnl / (abs(held["entry"] - held["stop"]) * held["size"])})
        held = None

    for i in range(lookback - 1, len(rows)):
        r = rows[i]
        if held is None and order is not None:
            side, stop, target = order
            entry = r.open * (1 + side * slip)
            if (entry > stop) if side > 0 else (entry < stop):
                size = min(math.floor(cash * 0.01 / abs(entry - stop)), math.floor(cash / entry))
                if size > 0:
                    held = {"side": side, "entry": entry, "stop": stop, "target": target, "size": size, "at": i}
            order = None
        if held is not None:
            up, stop, target = held["side"] > 0, held["stop"], held["target"]
            past_stop = (lambda x: x <= stop) if up else (lambda x: x >= stop)
            past_target = (lambda x: x >= target) if up else (lambda x: x <= target)
            if i > held["at"] and past_stop(r.open):
                leave(i, r.open, "stop")
            elif i > held["at"] and past_target(r.open):
                leave(i, r.open, "target")
            elif past_stop(r.low if up else r.high):
                leave(i, stop, "stop")
            elif past_target(r.high if up else r.low):
                leave(i, target, "target")
        if held is None and order is None:
            a = analyses[i] if analyses else analysis(bars.iloc[i - lookback + 1 : i + 1])
            got, _ = plan(a, style, cash)
            if got:
                order = got[0], round(got[2], 6), round(got[3][0], 6)
        curve[i] = cash + (held["side"] * (r.close - held["entry"]) * held["size"] if held else 0.0)
    if held is not None:
        leave(len(rows) - 1, rows[-1].close, "end")
        curve[len(rows) - 1] = cash
    return trades, curve


def structure(w, unit_now):
    p = profile(w)
    u = usable(w)
    e, hist = p["edges"], p["hist"]
    place = [0.0 if r.high - r.low <= 1e-12 else max(-1, min(1, ((r.close - r.low) - (r.high - r.close)) / (r.high - r.low))) for r in u.itertuples()]
    volume = histogram(u, e, list(u.volume))
    delta = histogram(u, e, [v * x for v, x in zip(u.volume, place)])
    aged = histogram(u, e, [v * 0.5 ** ((len(u) - 1 - i) / 21) for i, v in enumerate(u.volume)])
    recent = p["mids"][max(range(len(aged)), key=lambda i: (aged[i], -i))]
    skew, kurt = weighted_moments(p)
    step = np.diff(hist)
    mean, k = sum(hist) / len(hist), max(1, round(0.02 * len(hist)))
    kind = shape(p)
    close = float(w.close.iloc[-1])
    unit = unit_now if unit_now == unit_now and unit_now > 0 else max(p["bin"], 1e-12)
    return {
        "delta_net": sum(delta) / sum(volume), "delta_poc": delta[p["at"]] / volume[p["at"]], "skew": skew, "kurtosis": kurt, "poc_loc": min(1, max(0, (p["poc"] - p["low"]) / (p["high"] - p["low"]))),
        "cost_basis_migration": (recent - p["poc"]) / unit, "n_ledges": float((np.abs(step) > 3 * step.std()).sum()), "poor_high": float(np.mean(hist[-k:]) > 0.5 * mean),
        "is_p_shape": float(kind == "P"), "is_b_lower": float(kind == "b"), "is_b_upper": float(kind == "B"), "vacr": (p["vah"] - p["val"]) / close, "poc": p["poc"], "close": close,
    }


def structural_rows(bars, lookback=120, horizon=20, stride=3):
    """The thirteen features of every stride-th bar, from the 21st sampled row on: {idx: features}."""
    atr = wilder(true_ranges(bars), 14)
    raw = []
    for i in range(lookback - 1, len(bars) - horizon, stride):
        raw.append((i, structure(bars.iloc[i - lookback + 1 : i + 1], atr[i])))
    out = {}
    for k, (i, x) in enumerate(raw):
        if k < 20:
            continue
        past = [y["vacr"] for _, y in raw[k - 20 : k]]
        sd = float(np.std(past))
        points = [y["poc"] for _, y in raw[k - 4 : k + 1]]
        out[i] = {**x, "vacr_z": (x["vacr"] - sum(past) / 20) / sd if sd > 1e-12 else 0.0, "poc_slope": float(np.polyfit(range(5), points, 1)[0]) / x["close"]}
    return out


def barrier(bars, i, side, horizon=20, k=2.0):
    """(outcome, return) of a bet at the close of bar i."""
    atr = wilder(true_ranges(bars), 14)[i]
    entry = bars.close.iloc[i]
    v = atr / entry if atr == atr and atr > 0 else 0.01
    last = bars.iloc[i + 1 : i + 1 + horizon]
    for r in last.itertuples():
        worst, best = (r.low, r.high) if side > 0 else (r.high, r.low)
        if side * (worst - entry * (1 - side * k * v)) <= 0:
            return -1, side * (entry * (1 - side * k * v) - entry) / entry
        if side * (best - entry * (1 + side * k * v)) >= 0:
            return 1, side * (entry * (1 + side * k * v) - entry) / entry
    close = last.close.iloc[-1] if len(last) else entry
    return 0, side * (close - entry) / entry


def cross_validation(n, groups=6, purge=0, embargo=0.01):
    """(train, test) of every two of six parts; `purge` samples before a tested run and ceil(embargo n) after it are left out."""
    part = [g for g, xs in enumerate(np.array_split(np.arange(n), groups)) for _ in xs]
    after = math.ceil(embargo * n)
    for a in range(groups):
        for b in range(a + 1, groups):
            test = [i for i in range(n) if part[i] in (a, b)]
            held = set(test)
            starts, ends = [i for i in test if i - 1 not in held], [i for i in test if i + 1 not in held]
            out = held | {j for s in starts for j in range(s - purge, s)} | {j for e in ends for j in range(e + 1, e + 1 + after)}
            yield [i for i in range(n) if i not in out], test


def ridge(X, y, alpha=1.0):
    """Weights on standardised columns by least squares with a penalty row a column."""
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd = np.where(sd == 0, 1, sd)
    Z = (X - mu) / sd
    A = np.vstack([Z, math.sqrt(alpha) * np.eye(Z.shape[1])])
    w = np.linalg.lstsq(A, np.concatenate([y - y.mean(), np.zeros(Z.shape[1])]), rcond=None)[0]
    return lambda T: (T - mu) / sd @ w, w


def pearson(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return NAN
    return float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


def average_ranks(x):
    return pd.Series(x).rank().to_numpy()


def logistic(X, y, steps=800, rate=0.5, l2=1.0):
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd = np.where(sd == 0, 1, sd)
    Z, n = (X - mu) / sd, len(y)
    p = min(1 - 1e-6, max(1e-6, y.mean()))
    w, b = np.zeros(Z.shape[1]), math.log(p / (1 - p))
    for _ in range(steps if 0 < y.mean() < 1 else 0):
        e = 1 / (1 + np.exp(-np.clip(Z @ w + b, -30, 30))) - y
        w, b = w - rate * (Z.T @ e / n + l2 * w / n), b - rate * e.mean()
    return lambda T: 1 / (1 + np.exp(-np.clip((T - mu) / sd @ w + b, -30, 30)))


def pair_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return NAN
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
