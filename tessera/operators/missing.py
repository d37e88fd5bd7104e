"""Missing values, cleaning and profiling.

Profiles are one aggregate over all columns (one row per group of the
grouping), reshaped with ``stack`` into a long (column, statistic) table;
columns with many values are counted apart (``plans/distinct.py``). Fills are fitted by one statistics pass and applied as literals.
Model-based imputation (N06) trains ``pyspark.ml`` regressors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir
from tessera.plans.distinct import few_valued, many_valued_counts, more_values_than, set_count
from tessera.plans.quantiles import group_quantiles


def _stack(pairs: Sequence[tuple[str, Column]], names: tuple[str, str]) -> Column:
    args = ", ".join(f"'{n}', `{n}`" for n, _ in pairs)
    return F.expr(f"stack({len(pairs)}, {args}) as ({names[0]}, {names[1]})")


def null_share(df: DataFrame, cols_: Sequence[str] | None = None) -> DataFrame:
    """Share of NULL per column, highest first (one aggregate)."""
    cols_ = list(cols_ or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols_])
    args = ", ".join(f"'{c}', `{c}`" for c in cols_)
    return row.select(F.expr(f"stack({len(cols_)}, {args}) as (column, null_share)")).orderBy(
        F.desc("null_share"), "column")


def column_profile(df: DataFrame, cols_: Sequence[str], split: str | None = None) -> DataFrame:
    """Max, min, distinct count, rows per distinct value and NULL rate of
    each numeric column, per split value (NULL is a part named NULL) and for
    all rows (part ``all``; grouping sets). Columns with few values are counted
    by sets in the same pass, the others by ``plans/distinct.py``: no copy of
    the rows per column."""
    x = df.select(*([F.col(split)] if split else []), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols_)])
    xs = [f"_x{i}" for i in range(len(cols_))]
    few = set(few_valued(x, xs))
    many = [c for c in xs if c not in few]
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for c in xs:
        exprs += [F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"),
                  F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null"),
                  (set_count(x, c) if c in few else F.lit(None).cast("long")).alias(f"{c}_n")]
    if split:
        # the total is told by grouping(), so a NULL split value stays a part of its own
        g = x.cube(split).agg(*exprs, (F.grouping(split) == 1).alias("_all")).withColumn(
            "_part", F.when(~F.col("_all"), F.col(split).cast("string")))
    else:
        g = x.agg(*exprs).select("*", F.lit(True).alias("_all"), F.lit(None).cast("string").alias("_part"))
    per = ", ".join(f"'{c}', `{c}_max`, `{c}_min`, `{c}_n`, `{c}_null`" for c in xs)
    long = g.select("_part", "_all", "_rows", F.expr(f"stack({len(xs)}, {per}) as (_x, max, min, _n, null_rate)"))
    if many:
        counted = many_valued_counts(x, many, split).withColumnRenamed("column", "_x")
        long = long.alias("l").join(counted.alias("c"), (F.col("l._x") == F.col("c._x")) & (F.col("l._all") == F.col("c._all"))
                                    & F.col("l._part").eqNullSafe(F.col("c._part")), "left").select("l.*", "c.nunique")
        # a part without values has no cells
        long = long.withColumn("nunique", F.when(F.col("_x").isin(many), F.coalesce("nunique", F.lit(0))).otherwise(F.col("_n")))
    else:
        long = long.withColumn("nunique", F.col("_n"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols_]), F.substring("_x", 3, 9).cast("int") + 1)
    return long.select(F.when(F.col("_all"), F.lit("all")).otherwise(F.col("_part")).alias("part"), name.alias("column"),
                       "max", "min", "nunique", F.try_divide("_rows", "nunique").alias("rows_per_unique"), "null_rate")


def fill_values(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """Per column rule: a constant, ``'mean'`` or ``'int_mean'`` (the
    mean truncated toward zero, as ``int()``). One statistics pass."""
    stats_cols = [c for c, r in rules.items() if r in ("mean", "int_mean")]
    st = df.agg(*[F.avg(c).alias(c) for c in stats_cols]).first() if stats_cols else {}
    fills = {}
    for c, r in rules.items():
        if r == "mean":
            fills[c] = st[c]
        elif r == "int_mean":
            fills[c] = int(st[c]) if st[c] is not None else None
        else:
            fills[c] = r
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills and fills[c] is not None
                       else F.col(c) for c in df.columns])


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clamp_infinite(df: DataFrame, cols_: Sequence[str]) -> DataFrame:
    """+inf -> max of the finite values, -inf -> their min, then NULL
    (and NaN) -> mean of the finite values."""
    st = df.agg(*[F.max(_finite(F.col(c))).alias(f"hi_{c}") for c in cols_],
                *[F.min(_finite(F.col(c))).alias(f"lo_{c}") for c in cols_],
                *[F.avg(_finite(F.col(c))).alias(f"m_{c}") for c in cols_]).first()
    out = []
    for c in df.columns:
        if c not in cols_:
            out.append(F.col(c))
            continue
        x = F.col(c)
        v = (F.when(x == F.lit(float("inf")), F.lit(st[f"hi_{c}"]))
             .when(x == F.lit(float("-inf")), F.lit(st[f"lo_{c}"]))
             .when(x.isNull() | F.isnan(x), F.lit(st[f"m_{c}"])).otherwise(x))
        out.append(v.alias(c))
    return df.select(*out)


def extreme_fill(df: DataFrame, cols_: Sequence[str], parts: int = 63) -> DataFrame:
    """Infinities -> NULL; NULL -> ``min - (max - min) / 63`` (a value
    below everything seen, so trees can split missing off)."""
    st = df.agg(*[F.max(_finite(F.col(c))).alias(f"hi_{c}") for c in cols_],
                *[F.min(_finite(F.col(c))).alias(f"lo_{c}") for c in cols_]).first()
    out = []
    for c in df.columns:
        if c not in cols_:
            out.append(F.col(c))
            continue
        lo, hi = st[f"lo_{c}"], st[f"hi_{c}"]
        fill = None if lo is None else lo - (hi - lo) / parts
        out.append(F.coalesce(_finite(F.col(c)), F.lit(fill)).alias(c))
    return df.select(*out)


def model_impute(df: DataFrame, cols_: Sequence[str], features: Sequence[str], min_distinct: int = 200,
                 max_iter: int = 20, seed: int = 0) -> DataFrame:
    """For each numeric column with NULLs and at least ``min_distinct``
    distinct values (least-missing first), fit a GBT regressor on the rows
    where it is present and predict it where it is missing. Spark trees
    reject NULL inputs, so ``features`` must already be filled (N03/N05)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    prof = df.agg(*[F.count(c).alias(f"n_{c}") for c in cols_], F.count(F.lit(1)).alias("rows")).first()
    holes = [c for c in cols_ if prof[f"n_{c}"] < prof["rows"]]
    todo = more_values_than(df, holes, min_distinct - 1)
    todo.sort(key=lambda c: -prof[f"n_{c}"])
    # each column's model reads the columns filled before it: written once, so
    # neither the plan nor the work grows with the number of columns
    ensure_checkpoint_dir(df.sparkSession)
    out = df
    for c in todo:
        out = out.checkpoint(eager=True)
        feats = [f for f in features if f != c]
        va = VectorAssembler(inputCols=feats, outputCol="_fv", handleInvalid="keep")
        train = va.transform(out.where(F.col(c).isNotNull()))
        model = GBTRegressor(featuresCol="_fv", labelCol=c, maxIter=max_iter, seed=seed).fit(train)
        pred = model.transform(va.transform(out)).drop("_fv")
        out = pred.withColumn(c, F.coalesce(F.col(c), F.col("prediction"))).drop("prediction")
    return out


def imputation_report(df: DataFrame, truth: str, mean_fill: str, model_fill: str, max_ratio: float = 1.0) -> DataFrame:
    """On rows whose true value was hidden, RMSE of mean fill and of the
    model, their ratio, correlation of model and truth, and the std of the
    prediction vs the truth (one aggregate). ``use_model``: the ratio is under
    ``max_ratio``, so the model is worth its place."""
    e1 = F.pow(F.col(mean_fill) - F.col(truth), 2)
    e2 = F.pow(F.col(model_fill) - F.col(truth), 2)
    return df.agg(F.sqrt(F.avg(e1)).alias("rmse_mean"), F.sqrt(F.avg(e2)).alias("rmse_model"),
                   (F.sqrt(F.avg(e2)) / F.sqrt(F.avg(e1))).alias("ratio"),
                   (F.sqrt(F.avg(e2)) < max_ratio * F.sqrt(F.avg(e1))).alias("use_model"),
                   F.corr(model_fill, truth).alias("corr"),
                   F.stddev_samp(model_fill).alias("pred_std"), F.stddev_samp(truth).alias("true_std"))


def drop_report(df: DataFrame, cols_: Sequence[str], null_limit: float = 0.9) -> DataFrame:
    """Which columns are constant (one distinct value) or mostly NULL
    (share above ``null_limit``). One row per column; distinct counts as in
    ``column_profile``."""
    few = set(few_valued(df, cols_))
    row = df.agg(*[(set_count(df, c) if c in few else F.lit(None).cast("long")).alias(f"d_{c}") for c in cols_],
                 *[F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}") for c in cols_])
    per = ", ".join(f"'{c}', `d_{c}`, `n_{c}`" for c in cols_)
    long = row.select(F.expr(f"stack({len(cols_)}, {per}) as (column, _n, null_share)"))
    many = [c for c in cols_ if c not in few]
    if many:
        long = long.join(many_valued_counts(df, many).select("column", "nunique"), "column", "left").withColumn(
            "nunique", F.coalesce("_n", "nunique"))
    else:
        long = long.withColumnRenamed("_n", "nunique")
    return long.select("column", "nunique", "null_share",
                       ((F.col("nunique") <= 1) | (F.col("null_share") > null_limit)).alias("drop"))


def crosstab_normalised(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Counts of a x b, and each count divided by its row total (all
    non-NULL values of b, also those without a column)."""
    n = [F.count_if(F.col(b) == F.lit(v)).alias(f"n_{v}") for v in values]
    rows = df.groupBy(a).agg(*n, F.count(b).alias("_total"))
    return rows.select(a, *[f"n_{v}" for v in values],
                       *[F.try_divide(F.col(f"n_{v}"), F.col("_total")).alias(f"share_{v}") for v in values])


def describe(df: DataFrame, cols_: Sequence[str], id_col: str) -> DataFrame:
    """Count, mean, std, min, exact quartiles (rank-based, distributed)
    and max of each column, as long (column, stat, value) rows."""
    basic = df.agg(*[F.struct(F.count(c).cast("double").alias("count"), F.avg(c).alias("mean"),
                              F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
                              F.max(F.col(c).cast("double")).alias("max")).alias(f"_s{i}") for i, c in enumerate(cols_)])
    args = ", ".join(f"{i}, '{s}', _s{i}.`{s}`" for i in range(len(cols_)) for s in ("count", "mean", "std", "min", "max"))
    out = basic.select(F.expr(f"stack({5 * len(cols_)}, {args}) as (_c, stat, value)"))
    for i, c in enumerate(cols_):
        q = group_quantiles(df, [], c, id_col, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"])
        out = out.unionByName(q.select(F.lit(i).alias("_c"), F.expr("stack(3, '25%', q25, '50%', q50, '75%', q75) as (stat, value)")))
    name = F.element_at(F.array(*[F.lit(c) for c in cols_]), F.col("_c") + 1)
    return out.select(name.alias("column"), "stat", "value")


def group_means(df: DataFrame, key: str, cols_: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per key."""
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols_])
