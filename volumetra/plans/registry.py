"""Queries by name, each with the DuckDB statement that it must equal, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

EVENT = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2 HAVING min(value) > 0)"""
_TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_PX = "l_extendedprice / l_quantity"
FLAG = f"""bars AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, arg_min({_PX}, row({_TIE})) AS open, max({_PX}) AS high,
 min({_PX}) AS low, arg_max({_PX}, row({_TIE})) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2 HAVING min({_PX}) > 0)"""
NATION = f"""bars AS (SELECT CAST(s_nationkey AS VARCHAR) AS symbol, date_trunc('week', l_shipdate) AS ts, arg_min({_PX}, row(l_shipdate, {_TIE})) AS open, max({_PX}) AS high,
 min({_PX}) AS low, arg_max({_PX}, row(l_shipdate, {_TIE})) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING min({_PX}) > 0)"""
LAST250 = EVENT.replace("bars AS", "every AS", 1) + """, bars AS (SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM every) WHERE back <= 250 AND n >= 250)"""
DUCK = {"event": EVENT, "flag": FLAG, "nation": NATION, "last250": LAST250}


def unsigned_zero(sql: str) -> str:
    """`round(...) AS c` with 0.0 added: DuckDB rounds a small negative number to -0.0, Spark to 0.0."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        alone = sql[end : end + 4] == " AS " and not sql[max(0, start - 1)].isalnum()
        if alone:
            out.append(sql[at:end] + " + 0.0")
            at = end
        else:
            out.append(sql[at : start + 6])
            at = start + 6
    return "".join(out) + sql[at:]


def query(name: str, oracle: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"twice: {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = unsigned_zero(oracle)
        return f

    return add


def staged(view: str, stages: list[dict[str, str]], select: str, tail: str = "") -> str:
    """DuckDB: bars of a view, then each stage as a select over the one before."""
    text, before = [DUCK[view]], "bars"
    for i, s in enumerate(stages):
        text.append(f"s{i} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in s.items()) + f" FROM {before})")
        before = f"s{i}"
    return "WITH " + ",\n".join(text) + f"\nSELECT {select} FROM {before} {tail}"


TS = "CAST(ts AS VARCHAR) AS ts"
