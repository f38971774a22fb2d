"""Python table functions: the sequential operators as they are called from SQL, with PARTITION BY symbol ORDER BY ...

`register` puts them into a session under the names volumetra_value_area and volumetra_fills.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class _ValueArea:
    """Rows (symbol, bin, center, volume) of one histogram in order of bin to its value area."""

    def __init__(self):
        self.symbol, self.centers, self.volumes = None, [], []

    def eval(self, row):
        self.symbol = row["symbol"]
        self.centers.append(float(row["center"]))
        self.volumes.append(float(row["volume"]))

    def terminate(self):
        import numpy as np

        from volumetra.functions.kernels import value_area

        hist = np.array(self.volumes)
        if len(hist) and hist.sum() > 0:
            lo, hi, inside = value_area(hist, int(hist.argmax()), 0.7, float(hist.cumsum()[-1]))  # added in the order of bins
            yield self.symbol, self.centers[lo], self.centers[hi], inside


class _Fills:
    """Rows (symbol, idx, ts, open, high, low, close, side, stop, target) of one symbol in order of idx to its trades: no
    costs, a millionth of a trillion at risk, three bars at most, what is open at the end closed at the last close."""

    def __init__(self):
        from volumetra.operators.trading import Fills

        self.machine, self.last = Fills(cash=1e12, slippage=0.0, risk=1e-6, max_hold=3), None

    def eval(self, row):
        signal = None if row["side"] is None else (int(row["side"]), float(row["stop"]), float(row["target"]))
        self.last = row
        trade = self.machine.step(int(row["idx"]), row["ts"], row["open"], row["high"], row["low"], row["close"], signal)
        if trade:
            yield (row["symbol"], trade[1], trade[2], trade[5], trade[6], trade[13])

    def terminate(self):
        if self.machine.pos is not None:
            r = self.last
            trade = self.machine.close(int(r["idx"]), r["ts"], float(r["close"]), "end")
            yield (r["symbol"], trade[1], trade[2], trade[5], trade[6], trade[13])


def register(spark: SparkSession) -> None:
    spark.udtf.register("volumetra_value_area", udtf(_ValueArea, returnType="symbol string, val double, vah double, va_volume double"))
    spark.udtf.register("volumetra_fills", udtf(_Fills, returnType="symbol string, entry_idx int, exit_idx int, entry_price double, exit_price double, exit_reason string"))
