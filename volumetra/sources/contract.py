"""The source contract as a Python data source: what serves bars says what it can serve, and reads a partition a symbol.

    register(spark)
    spark.read.format("volumetra_synthetic").option("symbols", "AAA,BBB").option("period", "2y").load()

A source of one's own is a subclass of `BarSource` with a name, capabilities and `bars(symbol)`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from volumetra.sources.synthetic import BARS


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)


class BarSource(DataSource):
    """Options: symbols (comma-separated), require (capabilities, comma-separated), and what the source itself reads."""

    capabilities: frozenset[str] = frozenset()

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        missing = {x for x in self.options.get("require", "").split(",") if x} - self.capabilities
        if missing:
            raise ValueError(f"{self.name()} does not serve {sorted(missing)}")
        return _Reader(self)

    def bars(self, symbol: str) -> Iterator[tuple]:
        """(ts, open, high, low, close, volume) of a symbol, in any order."""
        raise NotImplementedError


class _Reader(DataSourceReader):
    def __init__(self, source: BarSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s.strip()) for s in self.source.options.get("symbols", "").split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for bar in self.source.bars(partition.value):
            yield (partition.value, *bar)


class SyntheticSource(BarSource):
    """Synthetic names; those in the option `gone` are delisted paths."""

    capabilities = frozenset({"delisted"})

    @classmethod
    def name(cls) -> str:
        return "volumetra_synthetic"

    def bars(self, symbol: str) -> Iterator[tuple]:
        from volumetra.sources import synthetic as S

        n = S.PERIOD_BARS.get(self.options.get("period", "2y").lower(), 504)
        make = S.dead if symbol in self.options.get("gone", "").split(",") else S.survivor
        f = make(n, S.seed_of(symbol))
        for r in f.itertuples(index=False):
            yield (r.ts.to_pydatetime(), float(r.open), float(r.high), float(r.low), float(r.close), float(r.volume))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyntheticSource)
