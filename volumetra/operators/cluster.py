"""k-means over a table of any size: a pass over the rows for each step, sums per partition, a few numbers to the driver.

Rows are standardised; several k-means++ starts run side by side in the same
passes, and the one with the least inertia wins. The draws of k-means++ are a
race: the row with the least -ln(u) / d^2 is a draw with weight d^2, and u is a
hash of the seed, the start, the step and the row's id, so that the result does
not depend on how rows are partitioned (but for the order of sums). A cluster
that loses all its rows keeps its centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(batch) -> np.ndarray:
    v = batch.column("v")
    return np.asarray(v.flatten(), float).reshape(len(v), -1)


def _sums(df: DataFrame, make) -> dict[int, float]:
    """make(batch) -> flat array, summed over all batches: its length bounds what comes back."""

    def run(frames):
        total = None
        for b in frames:
            if b.num_rows:
                x = make(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    rows = df.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["i"])])


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) + np.uint64(1)
    for s in salt:
        h = (h ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def distances(Z: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((Z * Z).sum(axis=1)[:, None] - 2 * Z @ c.T + (c * c).sum(axis=1), 0)


def kmeans(rows: DataFrame, k: int = 3, starts: int = 6, steps: int = 100, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(centres on standardised rows, inertia, mean, deviation) of rows (id long, v array<double>)."""
    m = _sums(rows, lambda b: (lambda X: np.concatenate([[len(X)], X.sum(axis=0), (X * X).sum(axis=0)]))(_matrix(b)))
    n, d = m[0], (len(m) - 1) // 2
    mu = m[1 : d + 1] / n
    sd = np.sqrt(np.maximum(m[d + 1 :] / n - mu * mu, 0))
    sd[sd <= 1e-12] = 1.0
    centres = [np.zeros((0, d)) for _ in range(starts)]
    for step in range(k):
        drawn = centres

        def race(frames):
            for b in frames:
                if not b.num_rows:
                    continue
                Z, ids = (_matrix(b) - mu) / sd, np.asarray(b.column("id"))
                out = []
                for s, c in enumerate(drawn):
                    weight = distances(Z, c).min(axis=1) if len(c) else np.ones(len(Z))
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, -np.log(_uniform(ids, seed, s, step)) / np.where(weight > 0, weight, 1), np.inf)
                    i = int(np.lexsort((ids, time))[0])
                    out.append((s, float(time[i]), int(ids[i]), Z[i]))
                s, t, i, z = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(t, pa.float64()), pa.array(i, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["s", "t", "id", "z"])

        best = rows.mapInArrow(race, "s int, t double, id long, z array<double>").groupBy("s").agg(F.min_by("z", F.struct("t", "id")).alias("z")).collect()
        centres = [np.vstack([centres[r["s"]], r["z"]]) for r in sorted(best, key=lambda r: r["s"])]
    open_, loss = set(range(starts)), np.full(starts, np.inf)
    for _ in range(steps):
        now = [centres[s] for s in sorted(open_)]

        def lloyd(b):
            Z, out = (_matrix(b) - mu) / sd, []
            for c in now:
                dist = distances(Z, c)
                at = dist.argmin(axis=1)
                one = np.zeros((len(c), len(Z)))
                one[at, np.arange(len(Z))] = 1
                out += [one.sum(axis=1), (one @ Z).ravel(), [dist.min(axis=1).sum()]]
            return np.concatenate(out)

        total = _sums(rows, lloyd).reshape(len(now), k + k * d + 1)
        for s, row in zip(sorted(open_), total):
            size, sums = row[:k, None], row[k:-1].reshape(k, d)
            new = np.where(size > 0, sums / np.maximum(size, 1), centres[s])
            loss[s] = row[-1]
            if np.allclose(new, centres[s]):
                open_ = open_ - {s}
            centres[s] = new
        if not open_:
            break
    s = int(loss.argmin())
    return centres[s], float(loss[s]), mu, sd


def assigned(rows: DataFrame, centres: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> DataFrame:
    """id, cluster: the nearest centre of every row."""

    def run(frames):
        for b in frames:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(distances((_matrix(b) - mu) / sd, centres).argmin(axis=1).astype(np.int32))], ["id", "cluster"])

    return rows.mapInArrow(run, "id long, cluster int")
