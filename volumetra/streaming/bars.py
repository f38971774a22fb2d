"""Structured Streaming over ticks: bars, activity sessions, and the fill machine as keyed state.

The same functions serve a live source; here folders of Parquet files are read to
their end (`availableNow`), so that results can be compared with the batch. Sinks
are Parquet files in append mode: a window leaves the state, once and for good,
when the watermark has passed it. Windows that no watermark has passed when the
input ends are still open; the batch adds those. Checkpoints, inputs made here
and outputs lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.session import shared_folder

LATE = "10 minutes"


def batch_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(t: DataFrame) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: a bar leaves once the watermark has passed its hour."""
    tie = F.struct("ts", "event_id")
    g = t.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol"))
    return g.agg(F.min_by("value", tie).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", tie).alias("close"), F.count("*").cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(t: DataFrame, gap: str) -> DataFrame:
    g = t.groupBy(F.session_window("ts", gap).alias("w"), F.col("event_type").alias("symbol"))
    return g.agg(F.count("*").alias("ticks")).select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "ticks")


def finish(df: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that is there; returns the table that it wrote."""
    spark = df.sparkSession
    out = shared_folder(spark, name)
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def finished_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars: those that the stream closed, and those of hours that were open at its end."""
    done = finish(hourly(ticks(spark, sf_dir).withWatermark("ts", LATE)), "bars")
    rest = hourly(batch_ticks(spark, sf_dir)).join(done.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    return done.unionByName(rest).filter("low > 0")


def finished_sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    done = finish(sessions(ticks(spark, sf_dir).withWatermark("ts", LATE), gap), "sessions")
    closed = done.groupBy(F.col("symbol").alias("event_type")).agg(F.max("end_ts").alias("closed"))
    left = batch_ticks(spark, sf_dir).join(F.broadcast(closed), "event_type", "left").filter("closed is null or ts >= closed")
    return done.unionByName(sessions(left, gap)).drop("end_ts")


# --- the fill machine --------------------------------------------------------

STATE = "cash double, pos array<double>, since_ts timestamp, pending array<double>"


def fills(bars: DataFrame, **settings) -> DataFrame:
    """Closed trades of a stream of bars (symbol, idx, ts, open, high, low, close, side, stop, target; a null side is no signal).

    The state of a symbol is its cash, its position and its pending signal. Bars of a symbol come in order of idx.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from volumetra.operators.trading import TRADE, Fills

    names = [x.split()[0] for x in TRADE.split(", ")]

    class Keep(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("fills", STATE)

        def handleInputRows(self, key, rows, timerValues):
            m = Fills(**settings)
            if self.state.exists():
                m.cash, pos, since_ts, pending = self.state.get()
                if pos is not None:
                    m.pos = (int(pos[0]), *pos[1:5], int(pos[5]), since_ts)
                if pending is not None:
                    m.pending = (int(pending[0]), *pending[1:])
            out = []
            for r in pd.concat(list(rows)).sort_values("idx").itertuples():
                signal = None if pd.isna(r.side) else (int(r.side), float(r.stop), float(r.target))
                trade = m.step(int(r.idx), r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, signal)
                if trade:
                    out.append((key[0], *trade))
            pos = [float(x) for x in m.pos[:6]] if m.pos else None
            self.state.update((float(m.cash), pos, m.pos[6] if m.pos else None, [float(x) for x in m.pending] if m.pending else None))
            yield pd.DataFrame(out, columns=names)

        def close(self):
            pass

    return bars.groupBy("symbol").transformWithStateInPandas(Keep(), TRADE, "Append", "None")


def finished_fills(bars: DataFrame, parts: int = 3, **settings) -> DataFrame:
    """The trades of a table of bars and signals, cut by time into as many files, which the stream takes one by one."""
    spark = bars.sparkSession
    source = shared_folder(spark, "fill-source")
    cut = bars.withColumn("part", F.floor(F.col("idx") * parts / F.col("n_bars")))
    for k in range(parts):
        cut.filter(F.col("part") == k).drop("part", "n_bars").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(bars.drop("n_bars").schema).option("maxFilesPerTrigger", 1).parquet(source)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return finish(fills(stream, **settings), "fills")
    finally:
        spark.conf.set(key, before)
