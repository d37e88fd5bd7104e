"""Group-by aggregates joined back to every row.

Each function returns ``AggPart`` objects; ``apply_parts`` (plans.fuse) fuses
all parts that share a key set into one aggregate and one join. Nothing here
uses a whole-partition window: a window over a hot key would put that key in
one task, while ``groupBy`` combines map-side first.

pandas semantics kept: rows with a NULL key get a NULL feature (the left join
never matches NULL), ``count`` counts non-NULL values of the dummy column.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col, epoch_seconds, safe_div
from tessera.plans.fuse import AggPart, agg_alias, apply_parts
from tessera.plans.quantiles import group_quantiles
from tessera.spec import FeatureSpec, feature_name


def _cnt(dummy) -> Column:
    return F.count(col(dummy)) if dummy is not None else F.count(F.lit(1))


def count(cols: Sequence[str], dummy: str | None = None, name: str | None = None) -> AggPart:
    """rows per key combination (non-NULL ``dummy`` values)."""
    name = name or feature_name("count", cols)
    a = agg_alias(name, "n")
    return AggPart(name, tuple(cols), [_cnt(dummy).alias(a)], F.col(a))


def unique_count(cols: Sequence[str], name: str | None = None) -> AggPart:
    """distinct values of ``cols[-1]`` per ``cols[:-1]`` (exact)."""
    name = name or feature_name("unique_count", cols)
    a = agg_alias(name, "u")
    return AggPart(name, tuple(cols[:-1]), [F.count_distinct(col(cols[-1])).alias(a)], F.col(a))


def unique_count_ratio(cols: Sequence[str], dummy: str | None = None, name: str | None = None) -> AggPart:
    """F02(cols) / F01(cols[:-1])."""
    name = name or feature_name("unique_count_ratio", cols)
    u, n = agg_alias(name, "u"), agg_alias(name, "n")
    return AggPart(name, tuple(cols[:-1]),
                   [F.count_distinct(col(cols[-1])).alias(u), _cnt(dummy).alias(n)],
                   safe_div(F.col(u), F.col(n)))


def variance(cols: Sequence[str], name: str | None = None) -> AggPart:
    """sample variance of ``cols[-1]`` per ``cols[:-1]``; one row -> 0."""
    name = name or feature_name("variance", cols)
    a = agg_alias(name, "v")
    keys = tuple(cols[:-1])
    return AggPart(name, keys, [F.coalesce(F.var_samp(col(cols[-1])), F.lit(0.0)).alias(a)], F.col(a))


def count_std_over_mean(df: DataFrame, cols: Sequence[str], dummy: str | None = None,
                        coefficient=1, name: str | None = None) -> AggPart:
    """count by all ``cols``, then ``coef*std/mean`` of those counts per
    ``cols[:-1]``; undefined -> -1. ``coefficient`` is truncated to int."""
    name = name or feature_name("count_std_over_mean", cols, {"coefficient": coefficient})
    keys = tuple(cols[:-1])
    s, m = agg_alias(name, "s"), agg_alias(name, "m")
    per = df.groupBy(*cols).agg(_cnt(dummy).alias("_c"))
    frame = per.groupBy(*keys).agg(F.stddev_samp("_c").alias(s), F.avg("_c").alias(m))
    coef = int(float(coefficient))
    return AggPart(name, keys, [], F.coalesce(safe_div(F.lit(coef) * F.col(s), F.col(m)), F.lit(-1.0)),
                   frame=frame)


def count_ratio(cols_num: Sequence[str], cols_den: Sequence[str], dummy: str | None = None,
                name: str | None = None) -> list[AggPart]:
    """count(cols_num) / count(cols_den). F06 is the nested case
    ``cols_den = cols_num[:-1]``. Returns two parts (two key sets)."""
    name = name or feature_name("count_ratio", list(cols_num) + ["by"] + list(cols_den))
    a, b = agg_alias(name, "num"), agg_alias(name, "den")
    num = AggPart("_tmp_" + a, tuple(cols_num), [_cnt(dummy).alias(a)], F.col(a))
    den = AggPart(name, tuple(cols_den), [_cnt(dummy).alias(b)], safe_div(F.col(a), F.col(b)))
    return [num, den]


def history_count(history: DataFrame, keys: Sequence[str], name: str | None = None) -> AggPart:
    """occurrences of the key in a separate history table; missing -> 0."""
    name = name or feature_name("history_count", keys)
    a = agg_alias(name, "n")
    return AggPart(name, tuple(keys), [F.count(F.lit(1)).alias(a)],
                   F.coalesce(F.col(a), F.lit(0)).cast("bigint"), source=history)


def history_mean(history: DataFrame, keys: Sequence[str], target: str, missing: float = -0.01,
                 name: str | None = None) -> AggPart:
    """label mean per key from a history table; missing -> -0.01."""
    name = name or feature_name("history_mean", list(keys) + [target])
    a = agg_alias(name, "m")
    return AggPart(name, tuple(keys), [F.avg(col(target)).alias(a)],
                   F.coalesce(F.col(a), F.lit(missing)), source=history)


def history_regression(history: DataFrame, keys: Sequence[str], target: str, time_col: str,
                       shift: float = 0.0, missing: float = -0.5, time_expr=None,
                       name: str | None = None) -> AggPart:
    """per key, OLS of ``target`` on ``time - shift`` over the history,
    evaluated at each row's time. Fewer than two points or one distinct time
    -> ``missing``. ``time_expr(df_col)`` maps a time column to numbers
    (default: epoch seconds for timestamps)."""
    name = name or feature_name("history_regression", list(keys) + [target, time_col])
    conv = time_expr or (lambda c: epoch_seconds(c))
    sl, ic = agg_alias(name, "slope"), agg_alias(name, "icpt")
    ht = conv(time_col) - F.lit(shift)
    aggs = [F.regr_slope(col(target).cast("double"), ht).alias(sl),
            F.regr_intercept(col(target).cast("double"), ht).alias(ic)]
    pred = F.col(ic) + F.col(sl) * (conv(time_col) - F.lit(shift))
    return AggPart(name, tuple(keys), aggs, F.coalesce(pred, F.lit(missing)), source=history)


def first_last_diff(keys: Sequence[str], time_col: str, time_expr=None, name: str | None = None) -> list[AggPart]:
    """``t - min(t)`` and ``max(t) - t`` per key (seconds for timestamps)."""
    conv = time_expr or (lambda c: epoch_seconds(c))
    base = name or feature_name("first_last_diff", list(keys) + [time_col])
    lo, hi = agg_alias(base, "min"), agg_alias(base, "max")
    t = conv(time_col)
    return [AggPart(base + "_from_first", tuple(keys), [F.min(t).alias(lo), F.max(t).alias(hi)], t - F.col(lo)),
            AggPart(base + "_to_last", tuple(keys), [], F.col(hi) - t)]


def group_relative(keys: Sequence[str], value: str, agg: str = "mean", name: str | None = None,
                   df: DataFrame | None = None) -> list[AggPart]:
    """``x - agg(x by keys)`` and its absolute value. The median needs the
    rows (``df``): it comes from counted values, not from a buffer per group."""
    base = name or feature_name(f"diff_{agg}", list(keys) + [value])
    a = agg_alias(base, agg)
    d = col(value) - F.col(a)
    if agg == "median":
        if df is None:
            raise ValueError("the median of a group needs the rows (df)")
        frame = group_quantiles(df, keys, value, None, [0.5], names=[a])
        return [AggPart(base, tuple(keys), [], d, frame=frame), AggPart(base + "_abs", tuple(keys), [], F.abs(d), frame=frame)]
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[agg]
    return [AggPart(base, tuple(keys), [fn(col(value)).alias(a)], d),
            AggPart(base + "_abs", tuple(keys), [], F.abs(d))]


def common_keys(df: DataFrame, key: str, day_col: str, min_rows: int = 1000) -> DataFrame:
    """F13 helper: keys present on every day between the first and last day,
    where an edge day with fewer than ``min_rows`` rows is left out.
    Returns a one-column table of keys (distributed, one row per key).

    The day table has one row per calendar day, so the window over it and
    its broadcast are bounded by the span of the data, not its volume."""
    days = df.groupBy(day_col).agg(F.count(F.lit(1)).alias("_rows"))
    w0 = Window.partitionBy()
    d = days.select(day_col, "_rows",
                    F.min(day_col).over(w0).alias("_f"), F.max(day_col).over(w0).alias("_l"),
                    F.min_by("_rows", day_col).over(w0).alias("_rf"),
                    F.max_by("_rows", day_col).over(w0).alias("_rl"))
    lo = F.col("_f") + F.when(F.col("_rf") < min_rows, 1).otherwise(0)
    hi = F.col("_l") - F.when(F.col("_rl") < min_rows, 1).otherwise(0)
    days_in = (d.where((F.col(day_col) >= lo) & (F.col(day_col) <= hi))
               .select(day_col, F.count(F.lit(1)).over(w0).alias("_ndays")))
    inside = df.select(key, day_col).join(F.broadcast(days_in), day_col)
    per = inside.groupBy(key).agg(F.count_distinct(day_col).alias("_nd"), F.first("_ndays").alias("_ndays"))
    return per.where(F.col("_nd") == F.col("_ndays")).select(key)


def common_key_flag(df: DataFrame, key: str, day_col: str, min_rows: int = 1000,
                    name: str | None = None) -> AggPart:
    """``key + 1`` when the key is seen on every day, else 0."""
    name = name or feature_name("com", [key])
    frame = common_keys(df, key, day_col, min_rows).withColumn(agg_alias(name, "c"), F.lit(1))
    return AggPart(name, (key,), [], F.when(F.col(agg_alias(name, "c")) == 1, col(key) + 1).otherwise(F.lit(0)),
                   frame=frame)


def stable_key_flag(df: DataFrame, key: str, day_col: str, threshold: float, min_rows: int = 1000,
                    dummy: str | None = None, name: str | None = None) -> AggPart:
    """among common keys, ``100*std/mean`` of daily counts <= threshold ->
    ``key + 1`` else 0 (a single day has no std and compares false)."""
    name = name or feature_name("com", [key], {"t": threshold})
    common = common_keys(df, key, day_col, min_rows)
    rows = df.join(common, key, "left_semi")
    daily = rows.groupBy(key, day_col).agg(_cnt(dummy).alias("_c"))
    flag = agg_alias(name, "f")
    frame = (daily.groupBy(key).agg(F.stddev_samp("_c").alias("_s"), F.avg("_c").alias("_m"))
             .select(key, (F.lit(100.0) * F.col("_s") / F.col("_m") <= F.lit(float(threshold))).alias(flag)))
    return AggPart(name, (key,), [], F.when(F.col(flag), col(key) + 1).otherwise(F.lit(0)), frame=frame)


# ---------------------------------------------------------------- F15 specs
GROUP_FUNCTIONS = {
    "count": lambda df, s: [count(s.cols, s.p.get("dummy"), s.feature_name)],
    "unique_count": lambda df, s: [unique_count(s.cols, s.feature_name)],
    "unique_count_ratio": lambda df, s: [unique_count_ratio(s.cols, s.p.get("dummy"), s.feature_name)],
    "variance": lambda df, s: [variance(s.cols, s.feature_name)],
    "count_std_over_mean": lambda df, s: [count_std_over_mean(df, s.cols, s.p.get("dummy"),
                                                              s.p.get("coefficient", 1), s.feature_name)],
    "count_ratio": lambda df, s: count_ratio(s.cols, s.cols[:-1], s.p.get("dummy"), s.feature_name),
}


def combination_specs(columns: Sequence[str], sizes: Sequence[int], functions: Sequence[str],
                      value_col: str | None = None, params: dict | None = None) -> list[FeatureSpec]:
    """every n-column combination x every function. For functions that
    measure a column (unique_count, variance) ``value_col`` is appended."""
    out = []
    for n in sizes:
        for combo in itertools.combinations(columns, n):
            for fn in functions:
                cols = list(combo)
                if fn == "count_ratio" and len(cols) < 2:
                    continue  # the denominator needs a non-empty key set
                if fn in ("unique_count", "unique_count_ratio", "variance", "count_std_over_mean"):
                    if value_col is None or value_col in cols:
                        continue
                    cols = cols + [value_col]
                out.append(FeatureSpec.of(fn, cols, params))
    return out


def build_group_features(df: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """Fuse many group specs: one aggregate + one join per key set."""
    parts: list[AggPart] = []
    for s in specs:
        parts += GROUP_FUNCTIONS[s.function](df, s)
    out = apply_parts(df, parts)
    return out.drop(*[p.name for p in parts if p.name.startswith("_tmp_")])
