"""Models, splits and resampling for one dataset in memory (a group of a Spark plan)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


def splits(n: int, groups: int = 6, test: int = 2, purge: int = 0, embargo: float = 0.0):
    """(train, test) places of every choice of test groups: contiguous groups; places before a test block (purge) and after it (embargo) leave the training set."""
    if n < groups:
        raise ValueError("fewer samples than groups")
    group = np.concatenate([np.full(len(g), i) for i, g in enumerate(np.array_split(np.arange(n), groups))])
    after = math.ceil(embargo * n)
    for chosen in combinations(range(groups), test):
        held = np.isin(group, chosen)
        edge = np.diff(np.concatenate([[0], held.astype(int), [0]]))
        out = held.copy()
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            out[max(0, a - purge) : a] = True
            out[b : b + after] = True
        yield np.flatnonzero(~out), np.flatnonzero(held)


class Ridge:
    """Closed form on features standardised by the training rows (population deviation, 1 for a constant)."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, X, y):
        self.mu, self.sd = X.mean(axis=0), X.std(axis=0)
        self.sd[self.sd == 0] = 1.0
        Z = (X - self.mu) / self.sd
        self.mean = float(y.mean())
        self.w = np.linalg.solve(Z.T @ Z + self.alpha * np.eye(Z.shape[1]), Z.T @ (y - self.mean))
        return self

    def signal(self, X):
        return (X - self.mu) / self.sd @ self.w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Full-batch gradient descent from the base rate, ridge penalty over n."""

    def __init__(self, l2: float = 1.0, rate: float = 0.5, steps: int = 800):
        self.l2, self.rate, self.steps = l2, rate, steps

    def fit(self, X, y):
        y = y.astype(float)
        self.mu, self.sd = X.mean(axis=0), X.std(axis=0)
        self.sd[self.sd == 0] = 1.0
        Z, n = (X - self.mu) / self.sd, len(y)
        p = min(1 - 1e-6, max(1e-6, y.mean()))
        self.w, self.b = np.zeros(Z.shape[1]), math.log(p / (1 - p))
        if y.std() > 0:
            for _ in range(self.steps):
                miss = sigmoid(Z @ self.w + self.b) - y
                self.w = self.w - self.rate * (Z.T @ miss + self.l2 * self.w) / n
                self.b -= self.rate * float(miss.mean())
        return self

    def chance(self, X):
        return sigmoid((X - self.mu) / self.sd @ self.w + self.b)


def chances(X, Y, T, l2: float = 1.0, rate: float = 0.5, steps: int = 800):
    """`Logistic` for every column of Y (n x r) at once: the chances of the rows of T, a column for each."""
    Y, n = Y.astype(float), len(Y)
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd[sd == 0] = 1.0
    Z = (X - mu) / sd
    p = np.clip(Y.mean(axis=0), 1e-6, 1 - 1e-6)
    W, b = np.zeros((Z.shape[1], Y.shape[1])), np.log(p / (1 - p))
    moving = Y.std(axis=0) > 0
    for _ in range(steps if moving.any() else 0):
        miss = (sigmoid(Z @ W + b) - Y) * moving
        W = W - rate * (Z.T @ miss + l2 * W) / n
        b = b - rate * miss.mean(axis=0)
    return sigmoid((T - mu) / sd @ W + b)


def column_corr(A, B):
    """Correlation of the columns of A and B; NaN for constant ones and for fewer than three rows."""
    if len(A) < 3:
        return np.full(A.shape[1], np.nan)
    a, b = A - A.mean(axis=0), B - B.mean(axis=0)
    sa, sb = np.sqrt((a * a).sum(axis=0)), np.sqrt((b * b).sum(axis=0))
    ok = (A.std(axis=0) > 0) & (B.std(axis=0) > 0)
    return np.where(ok, (a * b).sum(axis=0) / np.where(ok, sa * sb, 1), np.nan)


def fold_ics(X, Y, cv, alpha: float = 1.0, least: int = 10) -> np.ndarray:
    """(folds x columns of Y) ICs of ridge fits, all columns with one factorisation a fold."""
    out = []
    for tr, te in cv:
        if len(tr) >= max(least, X.shape[1] + 2) and len(te) >= 3:
            mu, sd = X[tr].mean(axis=0), X[tr].std(axis=0)
            sd[sd == 0] = 1.0
            Z = (X[tr] - mu) / sd
            W = np.linalg.solve(Z.T @ Z + alpha * np.eye(Z.shape[1]), Z.T @ (Y[tr] - Y[tr].mean(axis=0)))
            out.append(column_corr((X[te] - mu) / sd @ W, Y[te]))
    return np.array(out).reshape(-1, Y.shape[1])


def corr(a, b) -> float:
    return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and a.std() > 0 and b.std() > 0 else math.nan


def ranks(x):
    """Average ranks from 1."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def spearman(a, b) -> float:
    return corr(ranks(a), ranks(b)) if len(a) >= 3 else math.nan


def auc(y, s) -> float:
    p, q = int((y == 1).sum()), int((y == 0).sum())
    return float((ranks(s)[y == 1].sum() - p * (p + 1) / 2) / (p * q)) if p and q else math.nan


def folds(X, y, cv, alpha: float = 1.0, least: int = 10):
    """(train, test, fitted ridge, signal on test) of the folds that are large enough."""
    for tr, te in cv:
        if len(tr) >= max(least, X.shape[1] + 2) and len(te) >= 3:
            m = Ridge(alpha).fit(X[tr], y[tr])
            yield tr, te, m, m.signal(X[te])


def factor_eval(X, y, base, cv, alpha: float = 1.0) -> list[dict]:
    """Per fold: IC, direction accuracy, sign return, weights, and the baseline's IC."""
    out = []
    for _, te, m, s in folds(X, y, cv, alpha):
        ic = corr(s, y[te])
        if math.isfinite(ic):
            out.append({"ic": ic, "accuracy": float((np.sign(s) == np.sign(y[te])).mean()), "ls": float((np.sign(s) * y[te]).mean()), "weights": m.w, "baseline": corr(base[te], y[te])})
    return out


def buckets(X, y, cv, alpha: float = 1.0, n: int = 5, cost_bps: float = 10.0) -> dict | None:
    """Forward return by quantile of the fold-standardised signal, and the returns of the two tails net of cost."""
    sig, ret, on = [], [], []
    for _, te, _, s in folds(X, y, cv, alpha):
        on.append(np.sign(s) * y[te])
        sd = s.std()
        sig.append((s - s.mean()) / sd if sd > 0 else s - s.mean())
        ret.append(y[te])
    if not sig or len(sig := np.concatenate(sig)) < 3 * n or sig.std() == 0:
        return None
    ret, cost = np.concatenate(ret), cost_bps / 1e4
    place = np.clip(np.digitize(sig, np.quantile(sig, np.linspace(0, 1, n + 1))[1:-1]), 0, n - 1)
    mean = np.array([ret[place == b].mean() if (place == b).any() else np.nan for b in range(n)])
    spread = float(mean[-1] - mean[0])
    return {
        "curve": [round(float(x) * 100, 4) for x in mean], "top": mean[-1] * 100, "bottom": mean[0] * 100, "spread": spread * 100, "ls_net": (spread - 2 * cost) * 100, "long_net": (mean[-1] - cost) * 100,
        "rank_corr": corr(np.arange(n, dtype=float), np.argsort(np.argsort(mean)).astype(float)), "in_market": float(((place == 0) | (place == n - 1)).mean()), "always_on": float(np.concatenate(on).mean()) * 100,
        "stream": np.concatenate([ret[place == n - 1] - cost, -ret[place == 0] - cost]),
    }


def meta_fold(y, net, p, threshold: float = 0.5, top: float | None = None) -> dict:
    taken = p >= (np.quantile(p, 1 - top) if top is not None else threshold)
    return {"precision": float(y[taken].mean()) if taken.any() else math.nan, "auc": auc(y, p), "primary": float(net.mean()), "meta": float(net[taken].mean()) if taken.any() else 0.0, "fraction": float(taken.mean())}


def meta_folds(X, cv):
    return [(tr, te) for tr, te in cv if len(tr) >= max(20, X.shape[1] + 2) and len(te) >= 5]


def meta_eval(X, y, ret, cv, threshold: float = 0.5, l2: float = 1.0, cost_bps: float = 0.0, top: float | None = None) -> list[dict]:
    return [meta_fold(y[te], ret[te] - cost_bps / 1e4, Logistic(l2).fit(X[tr], y[tr]).chance(X[te]), threshold, top) for tr, te in meta_folds(X, cv)]


def meta_eval_many(X, Y, R, cv, threshold: float = 0.5, l2: float = 1.0) -> list[list[dict]]:
    """meta_eval for every column of Y and R (n x r), fitted together."""
    out = [[] for _ in range(Y.shape[1])]
    for tr, te in meta_folds(X, cv):
        P = chances(X[tr], Y[tr], X[te], l2)
        for k, rows in enumerate(out):
            rows.append(meta_fold(Y[te, k], R[te, k], P[:, k], threshold))
    return out


def mean_of(rows: list[dict], key: str) -> float:
    x = [r[key] for r in rows if math.isfinite(r[key])]
    return float(np.mean(x)) if x else math.nan


def block_size(horizon: int, stride: int) -> int:
    if horizon <= 0 or stride <= 0:
        raise ValueError("horizon and stride are above zero")
    return math.ceil(horizon / stride) + 1


def block_order(n: int, size: int, rng) -> np.ndarray:
    """A permutation of places that moves whole blocks."""
    size = max(1, min(size, n))
    starts = rng.permutation(np.arange(0, n, size))
    return np.concatenate([np.arange(s, min(s + size, n)) for s in starts])


def p_value(null, real: float, kind: str = "greater") -> float:
    x = np.asarray(null, float)
    x = x[np.isfinite(x)]
    beyond = {"greater": x >= real, "less": x <= real, "two-sided": np.abs(x) >= abs(real)}[kind]
    return float((beyond.sum() + 1) / (len(x) + 1))


def overfitting(M: np.ndarray, blocks: int = 16, metric: str = "sharpe") -> dict:
    """Combinatorially symmetric validation: where the best of one half of the blocks stands in the other."""
    T, N = M.shape
    if N < 2 or blocks < 4 or blocks % 2 or T < blocks:
        raise ValueError("at least two configurations, four blocks (even), and a period for each block")
    parts = np.array_split(np.arange(T), blocks)
    n = np.array([len(p) for p in parts], float)
    s, q = (np.stack([f(M[p]) for p in parts]) for f in (lambda x: x.sum(axis=0), lambda x: (x * x).sum(axis=0)))
    return overfitting_of(n, s, q, metric)


def overfitting_of(n: np.ndarray, s: np.ndarray, q: np.ndarray, metric: str = "sharpe") -> dict:
    """The same from n, sums and sums of squares (blocks x configurations): every choice of halves adds up block sums."""
    blocks, N = s.shape

    def stat(rows):
        k, a, b = n[rows].sum(), s[rows].sum(axis=0), q[rows].sum(axis=0)
        mu = a / k
        if metric == "mean":
            return mu
        var = np.maximum(b - k * mu * mu, 0) / max(k - 1, 1)
        return np.where(var > 1e-30, mu / np.sqrt(np.where(var > 1e-30, var, 1)), 0.0)

    logit, inside, outside = [], [], []
    every = set(range(blocks))
    for half in combinations(range(blocks), blocks // 2):
        a, b = stat(list(half)), stat(sorted(every - set(half)))
        best = int(a.argmax())
        w = (int(np.argsort(np.argsort(b))[best]) + 1) / (N + 1)
        logit.append(math.log(w / (1 - w)))
        inside.append(a[best])
        outside.append(b[best])
    x, y, z = np.array(inside), np.array(outside), np.array(logit)
    d = x - x.mean()
    return {"pbo": float((z <= 0).mean()), "n_combinations": len(z), "median_logit": float(np.median(z)), "prob_oos_loss": float((y < 0).mean()), "degradation_slope": float(d @ (y - y.mean()) / (d @ d)) if d @ d else 0.0, "logits": z}


def kmeans(X: np.ndarray, k: int = 3, seed: int = 0, starts: int = 6, steps: int = 100):
    """(centers, inertia, mean, deviation) on standardised rows; the best of several k-means++ starts."""
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd[sd == 0] = 1.0
    Z = (X - mu) / sd
    rng = np.random.default_rng(seed)
    near = lambda c: ((Z[:, None, :] - c[None]) ** 2).sum(axis=2)
    best = None
    for _ in range(starts):
        c = Z[[rng.integers(len(Z))]]
        while len(c) < k:
            d = near(c).min(axis=1)
            c = np.vstack([c, Z[rng.choice(len(Z), p=d / d.sum() if d.sum() > 0 else None)]])
        for _ in range(steps):
            at = near(c).argmin(axis=1)
            new = np.stack([Z[at == j].mean(axis=0) if (at == j).any() else Z[rng.integers(len(Z))] for j in range(k)])
            done = np.allclose(new, c)
            c = new
            if done:
                break
        loss = float(((Z - c[at]) ** 2).sum())
        if best is None or loss < best[1]:
            best = c, loss
    return *best, mu, sd


def assign(X, centers, mu, sd) -> np.ndarray:
    return ((((X - mu) / sd)[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)


def align(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Each new centre's old identity, the closest pairs first."""
    d = ((new[:, None, :] - old[None]) ** 2).sum(axis=2)
    out = np.full(len(new), -1)
    for i in np.argsort(d.min(axis=1)):
        out[i] = next(j for j in np.argsort(d[i]) if j not in out)
    return out


def walk_forward(X: np.ndarray, k: int = 3, first: int = 200, every: int = 60, seed: int = 0) -> np.ndarray:
    """Cluster labels that use rows before their own block only; -1 until `first` rows are there."""
    out, known = np.full(len(X), -1), None
    for t in range(first, len(X), every):
        c, _, mu, sd = kmeans(X[:t], k, seed)
        name = np.arange(k) if known is None else align(c, known)
        out[t : t + every] = name[assign(X[t : t + every], c, mu, sd)]
        known = c[np.argsort(name)]
    return out
