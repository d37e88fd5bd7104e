"""Column-level helpers. Everything here returns a JVM-side ``Column``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cols(cs) -> list[Column]:
    return [col(c) for c in cs]


def safe_div(a, b) -> Column:
    """a / b with NULL instead of an error (ANSI) or inf/NaN (pandas)."""
    return F.try_divide(col(a), col(b))


def rnd(c, digits: int = 10) -> Column:
    """Round a double to ``digits`` significant digits the same way in every
    engine, so results can be compared across engines and partitionings.

    The mantissa is scaled by an exact power of ten, snapped to 12 decimals
    as a DECIMAL(18, 12) (absorbs last-bit noise of summation order; 18
    digits keep Spark on its compact long decimals), rounded half-up to
    ``digits - 1`` decimals and scaled back with the same exact power. Plain ``round(double, n)`` breaks exact ties differently in
    different engines and cannot keep 6 decimals of 1e10. NULL stays NULL;
    callers keep NaN and infinities out."""
    x = col(c).cast("double")
    e = F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), F.abs(e))
    m = F.when(e >= 0, x / p).otherwise(x * p)
    m = F.round(m.cast("decimal(18,12)"), digits - 1).cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(F.when(e >= 0, m * p).otherwise(m / p))


def sql_rnd(expr: str, digits: int = 10) -> str:
    """The DuckDB/ANSI spelling of ``rnd``."""
    x = f"CAST(({expr}) AS DOUBLE)"
    e = f"floor(log10(abs({x})))"
    p = f"power(10.0, abs({e}))"
    m = (f"CAST(round(CAST(CASE WHEN {e} >= 0 THEN {x} / {p} ELSE {x} * {p} END AS DECIMAL(18,12)), "
         f"{digits - 1}) AS DOUBLE)")
    return f"(CASE WHEN {x} = 0 THEN 0.0 WHEN {e} >= 0 THEN {m} * {p} ELSE {m} / {p} END)"


def epoch_seconds(c) -> Column:
    """Timestamp (with or without zone) -> fractional epoch seconds (double)."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(1e6)


def epoch_micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def all_not_null(cs) -> Column:
    cs = cols(cs)
    if not cs:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cs])


def null_unless_keys(value, keys) -> Column:
    """pandas drops NULL group keys: the feature of such a row stays NULL."""
    if not keys:
        return col(value)
    return F.when(all_not_null(keys), col(value))


def hash_unit(*parts) -> Column:
    """Deterministic pseudo-random number in [0, 1) from md5 of the parts.

    Same value in DuckDB: ('0x' || substr(md5(s), 1, 15))::BIGINT / 16^15.
    Used instead of ``rand()`` so results do not depend on partitioning.
    """
    s = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint") / F.lit(float(16 ** 15))


def hash_key(*parts) -> Column:
    """md5 hex of the parts joined by '|' (order key for reproducible draws)."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def row_md5(df_columns) -> Column:
    """Row id for tables without a unique key: md5 over every column."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                         for c in df_columns]))


def pandas_skew(g1: Column, n: Column) -> Column:
    """Population skewness (Spark, scipy) -> pandas' bias-corrected form."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def inv_norm(p) -> Column:
    """Inverse standard normal CDF, Acklam's rational approximation
    (relative error about 1e-9), written as Column arithmetic."""
    p = col(p)
    # Fixed coefficients of the published approximation.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    plow = 0.02425

    def poly(coef, x):
        return reduce(lambda acc, k: acc * x + F.lit(k), coef[1:], F.lit(coef[0]))

    q_lo = F.sqrt(-2 * F.log(p))
    lo = poly(c, q_lo) / (poly(d, q_lo) * q_lo + 1)
    q_hi = F.sqrt(-2 * F.log(1 - p))
    hi = -poly(c, q_hi) / (poly(d, q_hi) * q_hi + 1)
    q = p - 0.5
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + 1)
    return F.when(p < plow, lo).when(p > 1 - plow, hi).otherwise(mid)
