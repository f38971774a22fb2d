"""Queries against DuckDB on the smallest tables, and the operators' guards."""

import math
import random
from fractions import Fraction

import duckdb
import pytest

from volumetra.plans import catalog, levels
from volumetra.sources.bars import VIEWS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "a1_volume_histogram", "a2_typical_price_histogram", "a5_point_of_control", "a6_value_area", "a8_weighted_moments", "a18_calendar_resample", "a19_coverage_fractions", "a26_equal_weight_curve",
    "w1_true_range", "w2_atr_wilder", "w4_percentile_rank", "w5_rolling_slope", "w7_quiet_score", "w9_quiet_segments", "w20_accumulation_slope", "w28_behavioral_frame", "w33_centered_rank",
    "j3_common_dates", "j4_asof_coarse_to_base", "j5_bounded_asof", "j10_membership_asof", "s2_bar_validation", "s3a_period_clamp", "s5_aggregates_payload", "s8_csv_german", "s9_lake_read_pruned",
    "m1_triple_barrier", "c12_fill_machine", "v1_purged_splits", "j15_auc_by_rank_sum", "t9_adjusted_p_values", "t3_annualised_sharpe_lo", "g5_harness_verdict", "g7_evidence_verdict", "g8_overclaim_scan", "st1_streaming_bars", "st2_streaming_sessions", "st3_streaming_fills",
    "s3d_freshness", "s5_delisted_pages", "s6_daily_payload", "s6_answers", "s11a_default_chain", "a6_value_area_udtf", "c12_fills_udtf", "g7_verdict_reasons", "g8_correction_banner",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, (bool, str, list)):
            return str(v)
        return f"{float(v):.5g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


#: Three bins of one profile of sf0.1 are equally large, but for the order in which Spark adds their rows.
TIED = ["a10_poc_location", "a15_decayed_poc", "a5_point_of_control", "a6_value_area", "c1_value_area_component", "a6_value_area_udtf", "j11_nearest_level", "p7_location_in_value"]


@pytest.mark.parametrize("name", TIED)
def test_equals_duckdb_on_equal_bins(spark, name):
    con, folder = duckdb.connect(), "/root/testdata/sf0.1"
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    test_equals_duckdb(spark, folder, con, name)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A: one bar, all bins alike. C: one price. D: a bin larger by 1e-7. E: bars without a range among others."""
    ticks = [("A", 0, 1000.1, 3), ("A", 0, 2000.7, 4), *[("C", d, 1234.5, 7) for d in range(5)]]
    ticks += [("D", 0, 1000.0, 1), ("D", 0, 1050.0, 1), ("D", 1, 1010.2, 1e-7), ("D", 1, 1010.8, 1e-7)]
    ticks += [("E", d, (900.0, 950.0, 1000.0, 1100.0, 1400.0)[d * (i + 3) * 7 % 5], 1 + d * (i + 5) % 50) for d in range(60) for i in range(3)]
    folder = tmp_path_factory.mktemp("odd")
    rows = ", ".join(f"('{s}', {k}, {d}, {p}::DOUBLE, {q}::DOUBLE)" for k, (s, d, p, q) in enumerate(ticks))
    columns = "k::BIGINT AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, q AS l_quantity, p * q AS l_extendedprice, s AS l_returnflag, TIMESTAMP '1996-01-01' + to_days(d) AS l_shipdate"
    duckdb.sql(f"COPY (SELECT {columns} FROM (VALUES {rows}) t(s, k, d, p, q)) TO '{folder}/lineitem.parquet'")
    return str(folder)


ODD = ["a5_point_of_control", "a15_decayed_poc", "j11_nearest_level", "c1_value_area_component", "p7_location_in_value"]


@pytest.mark.parametrize("name", ODD)
def test_equals_duckdb_on_odd_profiles(spark, odd, name):
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}/lineitem.parquet'")
    test_equals_duckdb(spark, odd, con, name)


@pytest.fixture(scope="module")
def near(tmp_path_factory):
    """40 bars a symbol, thirty bins of it alike but for the last digits: which is largest depends on how they are added."""
    folder, rows = tmp_path_factory.mktemp("near"), []
    for seed in (0, 29, 73, 86, 98):
        r = random.Random(seed)
        for d in range(40):
            low, high, q, w = round(r.uniform(900, 1100), 2), round(r.uniform(4000, 5000), 2), r.randint(1, 50), r.randint(1, 50)
            rows += [f"('{seed}', {2 * d}, {d}, {low}::DOUBLE, {q}::DOUBLE)", f"('{seed}', {2 * d + 1}, {d}, {high}::DOUBLE, {w}::DOUBLE)"]
    columns = "k::BIGINT AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, q AS l_quantity, p * q AS l_extendedprice, s AS l_returnflag, TIMESTAMP '1996-01-01' + to_days(d) AS l_shipdate"
    duckdb.sql(f"COPY (SELECT {columns} FROM (VALUES {', '.join(rows)}) t(s, k, d, p, q)) TO '{folder}/lineitem.parquet'")
    return str(folder)


def test_bins_are_exact_sums(spark, near):
    """Fractions tell what a bin holds; the order of bars doesn't matter."""
    _, g, d = levels.base(spark, near, padded=False)
    bars = VIEWS["flag"](spark, near).collect()
    grids = {r["symbol"]: r for r in g.collect()}
    found = {(r["symbol"], r["bin"]): r["volume"] for r in d.collect()}
    for (symbol, i), volume in found.items():
        e0, size = grids[symbol]["e0"], grids[symbol]["size"]
        over = lambda b: max(0.0, min(b["high"], e0 + (i + 1) * size) - max(b["low"], e0 + i * size)) / (b["high"] - b["low"])  # noqa: B023, E731
        assert volume == float(sum(Fraction(b["volume"] * over(b)) for b in bars if b["symbol"] == symbol))


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_duckdb(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    sql = catalog.oracle_sql()[name]
    assert plain(df.select(*columns).collect()) == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_every_row_of_the_inventory_has_a_query():
    names = catalog.queries()
    ids = {n.split("_")[0] for n in names}
    want = {f"w{i}" for i in range(1, 37)} | {f"a{i}" for i in range(1, 28)} | {f"c{i}" for i in range(1, 18)} | {f"j{i}" for i in range(1, 16)} | {f"m{i}" for i in range(1, 12)}
    want |= {f"v{i}" for i in range(1, 8)} | {f"x{i}" for i in range(1, 6)} | {f"t{i}" for i in range(1, 12)} | {f"g{i}" for i in range(1, 10)} | {f"p{i}" for i in range(1, 12)} | {f"l{i}" for i in range(1, 8)} | {"u1", "u2", "u3", "u4", "k1", "k2", "k3", "k4"}
    assert not want - ids


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_sources_guard(spark):
    from volumetra.sources import files

    lines = spark.createDataFrame([("x",)], "line string")
    with pytest.raises(ValueError):
        files.parse_lines(lines, "<html><body>not a table")
    with pytest.raises(ValueError):
        files.parse_lines(lines, "date,close")
    assert files.layout("Datum;Schluss") == (";", ",", ".") and files.layout("Date,Close") == (",", ".", "")
    with pytest.raises(ValueError):
        files.first_source([("a", lines)], require={"delisted"})


def test_streams_close_most_windows(spark, sf):
    """What the watermark has passed comes out of the stream, not from the batch that adds what is open."""
    from volumetra.streaming import bars as S

    done = S.finish(S.hourly(S.ticks(spark, sf).withWatermark("ts", S.LATE)), "bars")
    every = S.hourly(S.batch_ticks(spark, sf))
    assert done.count() >= 0.98 * every.count() and done.exceptAll(every).count() == 0


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from volumetra.session import shared_folder

    unset = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")), "x")


def test_pages_and_chain():
    from volumetra.sources import files

    assert files.next_page(None, "k") is None and files.next_page("u?cursor=1", "k") == "u?cursor=1&apiKey=k" and files.next_page("u", "k") == "u?apiKey=k"
    assert files.next_page("u?apiKey=z", "k") == "u?apiKey=z"
    assert files.default_chain({}, {"delisted"}) == [] and files.default_chain({"POLYGON_API_KEY": "k"}, {"delisted"}) == ["polygon"]


def test_bars_guard(spark):
    from volumetra.sources.bars import require, validate

    rows = [("A", "2020-01-01", 1.0, 2.0, 1.0, 1.5, 10.0), ("A", "2020-01-01", 1.0, 3.0, 1.0, 1.5, 10.0), ("A", "2020-01-02", float("nan"), 2.0, 1.0, 1.5, 1.0), ("A", "2020-01-03", 1.0, 1.0, 2.0, 1.5, 1.0), ("B", "2020-01-01", 1.0, 1.0, 1.0, 1.0, 0.0)]
    b = validate(spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double"))
    assert {(r["symbol"], r["high"]) for r in b.collect()} == {("A", 3.0), ("B", 1.0)}
    assert {r["symbol"] for r in require(b).collect()} == {"B"}


def test_no_look_ahead(spark, sf):
    """Behavioural columns of a bar are the same when later bars are cut off."""
    from pyspark.sql import functions as F

    from volumetra.functions import rolling as R
    from volumetra.sources.bars import event_hourly

    stages, names = R.behavioral()
    b = event_hourly(spark, sf).cache()
    cut = b.agg(F.expr("percentile(unix_timestamp(ts), 0.7)").alias("t")).first()["t"]
    early = F.unix_timestamp("ts") <= cut
    whole = R.apply(b, stages).filter(early).select("symbol", "ts", *names)
    part = R.apply(b.filter(early), stages).select("symbol", "ts", *names)
    assert whole.exceptAll(part).count() == 0


def test_registries_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
