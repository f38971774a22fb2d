"""Exponentially weighted means: the one rolling feature that is a recursion.

The symbol's bars are sorted and folded by pandas, in Arrow batches, one group a
symbol: state is one number, so only the symbol's own columns are in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def ewm_columns(bars: DataFrame, columns: dict[str, tuple[str, float, int]]) -> DataFrame:
    """bars with name = EWM of (column, alpha, least number of values), `adjust=False`."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{c} double" for c in columns])

    def run(pdf):
        pdf = pdf.sort_values("ts")
        for name, (source, alpha, least) in columns.items():
            pdf[name] = pdf[source].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        return pdf

    out = bars.groupBy("symbol").applyInPandas(run, schema)
    from pyspark.sql import functions as F

    # pandas marks a missing value by NaN; here it is null
    return out.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in columns})
