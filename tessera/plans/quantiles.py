"""Exact quantiles (linear interpolation, as numpy / DuckDB ``quantile_cont``)
without holding a column or a group in one task.

``percentile`` inside an aggregate keeps every distinct value of a group in
one buffer, so a global quantile, or a quantile of a hot key, lands in one
task. Here the different values of a group are counted (partial aggregation),
ordered by the skew-safe positions engine with a running count, and only the
values around each requested rank are kept (at most ``2 x len(probs)`` per
group) and interpolated in a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.positions import value_ranks


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, id_col: str | None,
                    probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability. NULL values are
    ignored; a group with no value gets NULL."""
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100)):02d}_{value}" for p in probs])
    nn = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ranked = value_ranks(nn, keys, "_x")
    h = [F.lit(float(p)) * (F.col("_rows") - 1) for p in probs]

    def at(rank):  # does the value stand at this 0-based rank?
        return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_cnt"))

    near = None
    for e in h:
        c = at(F.floor(e)) | at(F.ceil(e))
        near = c if near is None else near | c
    picked = ranked.where(near)
    exprs = []
    for e, nm in zip(h, names):
        lo, hi = (F.max(F.when(at(r), F.col("_x"))) for r in (F.floor(e), F.ceil(e)))
        frac = F.max(e - F.floor(e))
        exprs.append((lo + (hi - lo) * frac).alias(nm))
    if not keys:
        return picked.agg(*exprs)
    return picked.groupBy(*keys).agg(*exprs)


def column_quantiles(df: DataFrame, value: str, id_col: str, probs: Sequence[float]) -> list[float]:
    """Global exact quantiles returned to the driver (a handful of numbers)."""
    row = group_quantiles(df, [], value, id_col, probs, names=[f"q{i}" for i in range(len(probs))]).first()
    return [row[f"q{i}"] for i in range(len(probs))]
