"""Every query of the engine, with its DuckDB equivalent."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volumetra.plans.registry import ORACLES, QUERIES

MODULES = ("rolling", "levels", "bars", "trading", "research")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"volumetra.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["a5_point_of_control"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
