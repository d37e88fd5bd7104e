"""Projections, filters and scalar features.

Row-local features are plain ``Column`` expressions (whole-stage codegen).
Features that need a statistic of the whole column (z-score, deciles,
equal-width bins, mass divide) are fitted first with one aggregate that
returns one row; the fitted numbers enter the plan as literals, the way a
``pyspark.ml`` model carries its fitted state. Rank-based features use the
distributed rank (``plans.positions``), never a single-task window.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, inv_norm, safe_div
from tessera.plans.distinct import more_values_than
from tessera.plans.positions import average_rank, global_rank, value_ranks
from tessera.plans.quantiles import column_quantiles


# --------------------------------------------------------------------- P01
def calendar_parts(ts, zone: str | None = "Asia/Shanghai", prefix: str = "") -> list[Column]:
    """UTC timestamp -> local calendar parts: day, hour, minute,
    minute10 (minute // 10), hour*60 + minute, day*1440 + hour*60 + minute,
    10-minute bucket number and epoch seconds."""
    t = col(ts).cast("timestamp")
    local = F.from_utc_timestamp(t, zone) if zone else t
    day, hour, minute = F.dayofmonth(local), F.hour(local), F.minute(local)
    epoch = F.unix_seconds(t)
    return [day.alias(f"{prefix}day"), hour.alias(f"{prefix}hour"), minute.alias(f"{prefix}minute"),
            F.floor(minute / 10).cast("int").alias(f"{prefix}minute10"),
            (hour * 60 + minute).alias(f"{prefix}hour_minute"),
            (day * 1440 + hour * 60 + minute).alias(f"{prefix}day_hour_minute"),
            F.floor(epoch / 600).alias(f"{prefix}bucket10"),
            epoch.alias(f"{prefix}epoch")]


# --------------------------------------------------------------------- P02
def composite_key(cols_: Sequence[str], sep: str = "_") -> Column:
    """One string key for a column combination (works for strings too,
    unlike decimal digit shifting)."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in cols_])


def packed_key(hi, lo, factor: int = 1000) -> Column:
    """``factor * hi + lo`` (e.g. machine = 1000 * device + os)."""
    return col(hi) * F.lit(factor) + col(lo)


# --------------------------------------------------------------------- P03
def ratio(a, b) -> Column:
    """``a / b``; zero divisor -> NULL (pandas would give inf/NaN)."""
    return safe_div(a, b)


def ratio1(a, b) -> Column:
    """``a / (1 + b)``."""
    return safe_div(a, F.lit(1) + col(b))


# --------------------------------------------------------------------- P04
def row_stats(cols_: Sequence[str], weights: Sequence[float] | None = None, prefix: str = "row_") -> list[Column]:
    """Statistics across columns of one row, NULLs skipped (pandas
    ``skipna``): min, max, sum, mean, median, sample var and std; the
    weighted sum is NULL if any input is NULL."""
    xs = [col(c).cast("double") for c in cols_]
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    mean = F.when(n > 0, total / n)
    ss = sum((F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs), F.lit(0.0))
    var = F.when(n > 1, ss / (n - 1))
    # NULLs are sorted to the front
    srt, skip = F.sort_array(F.array(*xs)), F.lit(len(xs)) - n
    mid = skip + F.floor((n - 1) / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(srt, mid)).otherwise((F.get(srt, mid) + F.get(srt, mid + 1)) / 2)
    least, greatest = (F.least(*xs), F.greatest(*xs)) if len(xs) > 1 else (xs[0], xs[0])
    out = [least.alias(f"{prefix}min"), greatest.alias(f"{prefix}max"),
           total.alias(f"{prefix}sum"), mean.alias(f"{prefix}mean"),
           F.when(n > 0, median).alias(f"{prefix}median"), var.alias(f"{prefix}var"),
           F.sqrt(var).alias(f"{prefix}std")]
    if weights is not None:
        ws = sum((col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols_, weights)), F.lit(0.0))
        out.append(ws.alias(f"{prefix}weighted"))
    return out


# --------------------------------------------------------------- P05-P09
def sentinel_to_null(c, sentinels: Sequence = (), negative: bool = False) -> Column:
    """Sentinel values (365243, 'XNA', 0, ...) and optionally negative
    numbers become NULL."""
    x = col(c)
    cond = None
    for s in sentinels:
        e = x == F.lit(s)
        cond = e if cond is None else cond | e
    if negative:
        cond = (x < 0) if cond is None else cond | (x < 0)
    return x if cond is None else F.when(~cond | cond.isNull(), x)


def threshold_flag(c, op: str, value) -> Column:
    """``(x op value)`` as 0/1 with NULL -> 0."""
    x = col(c)
    cmp = {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value, "==": x == value}[op]
    return F.coalesce(cmp.cast("int"), F.lit(0))


def positive_part(c) -> Column:
    """``max(x, 0)`` with NULL -> 0 (``x > 0`` is false on NaN)."""
    return F.when(col(c) > 0, col(c)).otherwise(F.lit(0))


def square(c) -> Column:
    """P08."""
    return col(c) * col(c)


def squares_and_products(cols_: Sequence[str]) -> list[Column]:
    """Every ``x_i^2`` and every ``x_i * x_j`` (i < j)."""
    out = [square(c).alias(f"{c}_sq") for c in cols_]
    out += [(col(a) * col(b)).alias(f"{a}_x_{b}") for a, b in itertools.combinations(cols_, 2)]
    return out


# --------------------------------------------------------------------- P10
def mass_divide(df: DataFrame, cols_: Sequence[str], denominator: str, threshold: int,
                suffix: str = "_per") -> DataFrame:
    """P10: divide every column with more than ``threshold`` distinct values
    by ``denominator``. One pass of sketches decides the columns far from the
    threshold, one more the others (exactly); the division is a projection."""
    chosen = more_values_than(df, [c for c in cols_ if c != denominator], threshold)
    return df.select("*", *[safe_div(c, denominator).alias(f"{c}{suffix}_{denominator}") for c in chosen])


# --------------------------------------------------------------------- P11
def log_transform(c, twice: bool = False) -> Column:
    """``log2(x + 1)`` (applied twice for the log-log variant)."""
    y = F.log2(col(c) + 1)
    return F.log2(y + 1) if twice else y


def standardise(df: DataFrame, cols_: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Z-score with the population std, fitted by one aggregate."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols_], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols_]).first()
    return df.select("*", *[safe_div(col(c) - F.lit(st[f"m_{c}"]), F.lit(st[f"s_{c}"])).alias(f"{c}{suffix}")
                            for c in cols_])


# --------------------------------------------------------------------- P12
def decile_bins(df: DataFrame, c: str, id_col: str, name: str | None = None,
                probs: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """edges = exact percentiles (linear interpolation, as numpy), from
    the distributed rank (never one task holding the column); the bin is
    ``searchsorted(edges, x, 'left')`` = number of edges below x."""
    edges = column_quantiles(df, c, id_col, probs)
    x = F.col(c)
    b = sum((F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(name or f"{c}_decile", F.when(x.isNotNull(), b))


# --------------------------------------------------------------------- P13
def equal_width_bins(df: DataFrame, c: str, bins: int = 80, name: str | None = None) -> DataFrame:
    """``pd.cut(x, bins, right=False, labels=False)``: equal-width bins
    over [min, max]; the maximum falls into the last bin."""
    st = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    lo, hi = float(st["lo"]), float(st["hi"])
    w = (hi - lo) / bins
    x = F.col(c).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)) if w > 0 else F.lit(0)
    return df.withColumn(name or f"{c}_bin{bins}", F.when(x.isNotNull(), b.cast("int")))


# --------------------------------------------------------------------- P14
def equal_frequency_score(df: DataFrame, c: str, id_col: str, n: int, name: str | None = None) -> DataFrame:
    """Sort the non-NULL values (ties by id) and cut them into ``n``
    contiguous blocks numbered 1..n, larger blocks first (= SQL ``ntile``);
    NULL -> -1. Ranks come from the distributed rank, not one task."""
    name = name or f"{c}_score{n}"
    nn = df.where(F.col(c).isNotNull())
    ranked = global_rank(nn.select(id_col, c), [c, id_col], pos="_r", total="_N")
    q = F.floor(F.col("_N") / n)
    rem = F.col("_N") % n
    big = rem * (q + 1)
    tile = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(
        rem + F.floor((F.col("_r") - big) / q)) + 1
    scored = ranked.select(id_col, tile.cast("int").alias(name))
    return df.join(scored, id_col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def segment_label(cols_: Sequence[str], sep: str = "_") -> Column:
    """Join several scores (or low-cardinality values) into one label."""
    return F.concat_ws(sep, *[col(c).cast("string") for c in cols_])


# --------------------------------------------------------------------- P15
# Fixed patterns of the device-string cleanup (values that must match).
CLEAN_ENCODED = r"%2522|%(25){0,}2B|%20|%(25){0,}28|%(25){0,}29|%(25){0,}2C"
CLEAN_SEPARATORS = r"-{1,}|(?<=[a-zA-Z\d])\+{1,}\s{0,}(?=[a-zA-Z\d])|_{1,}"
CLEAN_SPACES = r"\s{2,}"
CLEAN_BRACKETS = r"\(|\)"


def clean_device_string(c) -> Column:
    """Encoded separators -> space, percent-decode, separators ->
    space, collapse spaces, drop brackets, upper-case; anything still holding
    ``%`` (or undecodable) -> NULL. '+' is escaped before decoding because
    Spark's decoder reads it as a space and the reference's does not."""
    s = F.regexp_replace(col(c), CLEAN_ENCODED, " ")
    s = F.try_url_decode(F.regexp_replace(s, r"\+", "%2B"))
    s = F.regexp_replace(s, CLEAN_SEPARATORS, " ")
    s = F.regexp_replace(s, CLEAN_SPACES, " ")
    s = F.upper(F.regexp_replace(s, CLEAN_BRACKETS, ""))
    return F.when(~F.contains(s, F.lit("%")), s)


# ----------------------------------------------------------------- P16-P17
def prefix_part(c, sep: str = "_") -> Column:
    """First segment of ``a_b_c``."""
    return F.split_part(col(c), F.lit(sep), F.lit(1))


def gap_band(c, low: float = 30, high: float = 1800) -> Column:
    """0 if gap < low, 1 if low < gap < high, else 2 (gap == low -> 2)."""
    g = col(c)
    return F.when(g < low, 0).when((g > low) & (g < high), 1).otherwise(2)


# --------------------------------------------------------------------- P18
RATE_GRID = 100_000  # rates k / RATE_GRID, k = 0 .. RATE_GRID - 1


def annuity_rate(pv: Column, payment: Column, n: Column) -> Column:
    """Grid rate whose annuity payment is nearest to ``payment``. The payment
    grows with the rate, so the bits of the largest rate that still costs at
    most ``payment`` are fixed from the highest down; its upper neighbour wins
    if it is as near. NULL where n payments do not cover ``pv``."""
    def cost(k: Column) -> Column:
        r = k / RATE_GRID
        return pv * r / (1 - F.pow(1 + r, -n))

    bits = F.array(*[F.lit(1 << b) for b in reversed(range((RATE_GRID - 1).bit_length()))])
    below = F.aggregate(bits, F.lit(0), lambda k, b: F.when(
        (k + b < RATE_GRID) & (cost(k + b) <= payment), k + b).otherwise(k))
    # the rate 0 has no payment in the formula, and the grid ends below 1
    nearest = F.transform(F.array(below), lambda k: F.when(
        (k > 0) & (k < RATE_GRID - 1) & (cost(k + 1) - payment <= payment - cost(k)), k + 1).otherwise(k))[0]
    return F.when(n * payment >= pv, nearest / RATE_GRID)


def loan_estimates(df: DataFrame, pv: str, payment: str, low_len: str, t_apr: float = 0.025,
                   max_len: int = 60, step: int = 6, prefix: str = "estimate_") -> DataFrame:
    """Rate and term estimate of each loan: of the terms that are
    multiples of ``step`` above ``low_len`` and at most ``max_len``, the one
    whose rate is nearest to ``t_apr`` (the longer of two as near). Columns
    only; NULL if there is no such term."""
    v, p, low = (col(c).cast("double") for c in (pv, payment, low_len))
    first = low + step - low % step
    terms = F.filter(F.array(*[F.lit(float(t)) for t in range(step, max_len + 1, step)]), lambda t: t >= first)
    rated = F.transform(terms, lambda t: F.struct(annuity_rate(v, p, t).alias("r"), t.alias("t")))
    best = F.array_min(F.transform(F.filter(rated, lambda x: x["r"].isNotNull()), lambda x: F.struct(
        F.abs(x["r"] - t_apr).alias("off"), (-x["t"]).alias("shorter"), x["r"].alias("r"))))
    return df.withColumn("_est", best).select(
        "*", F.col("_est.r").alias(f"{prefix}apr"), (-F.col("_est.shorter")).alias(f"{prefix}terms")).drop("_est")


# --------------------------------------------------------------------- P19
def rank_to_normal(df: DataFrame, c: str, id_col: str, name: str | None = None, clip: float = 1e-7) -> DataFrame:
    """Quantile position -> standard normal. p = average 0-based rank of
    the value (ties share it) / (n - 1), clipped to [clip, 1 - clip], then the
    inverse normal CDF. Only the different values are
    ranked, with their counts (a hot value combines map-side)."""
    name = name or f"{c}_normal"
    ties = value_ranks(df.where(F.col(c).isNotNull()).select(c), [], c)
    p = F.when(F.col("_rows") > 1, (average_rank() - 1) / (F.col("_rows") - 1)).otherwise(F.lit(0.5))
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    z = ties.select(c, inv_norm(p).alias(name))
    return df.join(z, c, "left")


# --------------------------------------------------------------- P20-P21
def normalise_tags(c, sep: str = ",", missing: str = "notFound") -> Column:
    """P20: tags -> distinct, sorted, empties removed, re-joined; NULL -> ``notFound``."""
    parts = F.filter(F.split(col(c), sep), lambda s: s != "")
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(parts)), sep), F.lit(missing))


def band_values(c, mapping: Mapping | None = None, bands: Sequence[tuple] | None = None, default=None) -> Column:
    """Many values -> few. ``mapping`` maps values to labels; ``bands``
    is an ordered list of (predicate builder, label), first match wins."""
    x = col(c)
    out = None
    if mapping:
        for k, v in mapping.items():
            out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    if bands:
        for pred, label in bands:
            cond = pred(x)
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return x
    return out.otherwise(F.lit(default) if default is not None else x)
