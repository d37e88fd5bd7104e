"""Exact distinct counts of many columns without a copy of the rows per column.

Several ``count(DISTINCT c)`` in one aggregate make Spark copy every row once
per column and group the copies by all columns together. Here one aggregate of
sketches (no copies) tells the columns with few values; those are counted
exactly by sets of bounded size, in the caller's own aggregate. Only columns
with many values are dealt as narrow (column, value) rows, pre-aggregated in
the tasks before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW = 4096  # values up to which a column is counted by a set
MARGIN = 1.5  # the sketch's error is 5 %: ten times that
_SETS = (T.StringType, T.BooleanType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def value_of(df: DataFrame, c: str) -> Column:
    """The column with -0.0 as 0.0, as grouping compares."""
    return F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, T.FractionalType) and not isinstance(
        df.schema[c].dataType, T.DecimalType) else F.col(c)


def set_count(df: DataFrame, c: str) -> Column:
    """Exact number of different values by a set; for columns with few."""
    x = value_of(df, c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):  # NaN is one value
        return (F.size(F.collect_set(F.when(~F.isnan(x), x)))
                + F.coalesce(F.max(F.isnan(x).cast("int")), F.lit(0))).cast("long")
    return F.size(F.collect_set(x)).cast("long")


def few_valued(df: DataFrame, cols_: Sequence[str], few: int = FEW) -> list[str]:
    """Columns with at most about ``few`` different values (one pass of
    sketches); types that sets do not compare as grouping does are left out."""
    able = [c for c in dict.fromkeys(cols_)
            if isinstance(df.schema[c].dataType, _SETS + (T.FloatType, T.DoubleType))]
    if not able:
        return []
    n = df.agg(*[F.approx_count_distinct(value_of(df, c)).alias(f"c{i}") for i, c in enumerate(able)]).first()
    return [c for i, c in enumerate(able) if n[i] <= few]


def many_valued_counts(df: DataFrame, cols_: Sequence[str], by: str | None = None) -> DataFrame:
    """Rows (``_part``, ``_all``, ``column``, ``nunique``): the exact count per
    value of ``by`` (``_all`` false) and over all rows (``_all`` true), both
    from the different (part, value) pairs of the column."""
    part = F.col(by).cast("string") if by else F.lit(None).cast("string")
    counts = None
    for c in dict.fromkeys(cols_):
        # one column is read per branch; the tasks pre-aggregate its values
        one = df.select(part.alias("_part"), value_of(df, c).alias("_v")).where(F.col("_v").isNotNull())
        if by:
            one = one.distinct()
        total = one.select("_v").distinct().agg(F.count(F.lit(1)).alias("nunique")).select(
            F.lit(None).cast("string").alias("_part"), F.lit(True).alias("_all"), F.lit(c).alias("column"), "nunique")
        out = total if not by else total.unionByName(one.groupBy("_part").agg(F.count(F.lit(1)).alias("nunique")).select(
            "_part", F.lit(False).alias("_all"), F.lit(c).alias("column"), "nunique"))
        counts = out if counts is None else counts.unionByName(out)
    return counts


def more_values_than(df: DataFrame, cols_: Sequence[str], threshold: int) -> list[str]:
    """Columns with more than ``threshold`` different values, decided exactly:
    by the sketch where it is far from the threshold, else by a set (or, for a
    large threshold, by grouping) of the few columns near it."""
    names = list(dict.fromkeys(cols_))
    if not names:
        return []
    n = df.agg(*[F.approx_count_distinct(value_of(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    near = [c for i, c in enumerate(names) if threshold / MARGIN <= n[i] <= threshold * MARGIN + 10]
    sure = {c for i, c in enumerate(names) if n[i] > threshold * MARGIN + 10}
    if near:
        if threshold * MARGIN + 10 <= FEW:
            able = [c for c in near if isinstance(df.schema[c].dataType, _SETS + (T.FloatType, T.DoubleType))]
            exact = df.agg(*[set_count(df, c).alias(f"c{i}") for i, c in enumerate(able)]).first() if able else []
            sure |= {c for i, c in enumerate(able) if exact[i] > threshold}
            near = [c for c in near if c not in able]
        for r in (many_valued_counts(df, near).collect() if near else []):
            if r["nunique"] > threshold:
                sure.add(r["column"])
    return [c for c in names if c in sure]
