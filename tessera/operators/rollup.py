"""Parent/child roll-ups.

A child table is aggregated per parent key with ONE ``groupBy(keys).agg``
per key set (partial aggregation first, so a parent with a huge history costs
one combined row per task), then left-joined to the parent. Conditional
roll-ups go in the same pass as ``agg(f(when(cond, x)))``. Aggregate names
follow pandas semantics: ``var``/``std`` are sample forms, ``count`` counts
non-NULL values, ``size`` counts rows, ``skew``/``kurt`` are pandas'
bias-corrected forms (``skew_pop``/``kurt_pop`` are scipy's).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, pandas_skew
from tessera.plans.quantiles import group_quantiles

QUANTILES = ("median", "iqr")


def pandas_kurt(g2: Column, n: Column) -> Column:
    """Population excess kurtosis (Spark, scipy) -> pandas' unbiased form."""
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def agg_expr(agg: str, x: Column) -> Column:
    """One pandas-named aggregate as a Spark aggregate expression."""
    xd = x.cast("double") if agg not in ("count", "size", "nunique", "first", "last", "min", "max") else x
    n = F.count(x)
    if agg == "mean":
        return F.avg(xd)
    if agg == "sum":
        return F.coalesce(F.sum(xd), F.lit(0.0))  # pandas: sum of nothing is 0
    if agg == "min":
        return F.min(x)
    if agg == "max":
        return F.max(x)
    if agg == "var":
        return F.var_samp(xd)
    if agg == "std":
        return F.stddev_samp(xd)
    if agg == "count":
        return F.count(x)
    if agg == "size":
        return F.count(F.lit(1))
    if agg == "nunique":
        return F.count_distinct(x)
    if agg == "skew":
        return F.when(F.var_pop(xd) == 0, F.lit(0.0)).otherwise(pandas_skew(F.skewness(xd), n))
    if agg == "skew_pop":
        return F.skewness(xd)
    if agg == "kurt":
        return F.when(F.var_pop(xd) == 0, F.lit(0.0)).otherwise(pandas_kurt(F.kurtosis(xd), n))
    if agg == "kurt_pop":
        return F.kurtosis(xd)
    if agg == "span":
        return F.max(xd) - F.min(xd)
    if agg == "n_pos":
        return F.count_if(xd > 0)
    if agg in QUANTILES:
        raise ValueError(f"{agg} is no aggregate of bounded memory: use grouped()")
    raise ValueError(f"unknown aggregate {agg}")


def grouped(child: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str, Column, Column | None]],
            extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key with an aggregate per (name, agg, x, where): x over the
    rows that satisfy ``where`` (None: all; NULL if a key has none). All plain
    aggregates share one pass. Medians and interquartile ranges come from
    ``group_quantiles``, one counting pass per column: no group, however
    large, is held in a buffer."""
    keys = list(keys)
    plain, ranked = list(extra), {}
    for name, agg, x, where in specs:
        if agg in QUANTILES:
            ranked.setdefault((str(x), str(where)), (x, where, []))[2].append((name, agg))
        else:
            e = agg_expr(agg, x if where is None else F.when(where, x))
            plain.append((e if where is None else F.when(F.count_if(where) > 0, e)).alias(name))
    out = child.groupBy(*keys).agg(*plain) if plain else child.select(*keys).distinct()
    for x, where, wanted in ranked.values():
        rows = child if where is None else child.where(where)
        q = group_quantiles(rows.select(*keys, x.cast("double").alias("_q")), keys, "_q", None, [0.25, 0.5, 0.75],
                            names=["_q25", "_q50", "_q75"])
        cols_ = [F.col("_q50").alias(n) if a == "median" else (F.col("_q75") - F.col("_q25")).alias(n) for n, a in wanted]
        q = q.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *cols_)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(q, same, "left").drop(*[f"_k_{k}" for k in keys])
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def recipe_aggregate(child: DataFrame, recipe: Sequence[tuple[Sequence[str], Sequence[tuple[str, str]]]],
                     prefix: str = "") -> dict[tuple[str, ...], DataFrame]:
    """``[(keys, [(column, agg), ...]), ...]`` -> one aggregated table per
    key set, columns named ``{prefix}{keys}_{agg}_{column}``. Entries that
    share a key set are fused into one aggregate."""
    fused: dict[tuple[str, ...], list[tuple]] = {}
    for keys, pairs in recipe:
        k = tuple(keys)
        fused.setdefault(k, []).extend((f"{prefix}{'_'.join(k)}_{a}_{c}", a, col(c), None) for c, a in pairs)
    return {k: grouped(child, k, specs) for k, specs in fused.items()}


def dict_aggregate(child: DataFrame, key: str, spec: Mapping[str, Sequence[str]], prefix: str,
                   where: Column | None = None, count_name: str | None = "COUNT") -> DataFrame:
    """G02 (and G03 with ``where``): ``{column: [aggs]}`` per ``key``, names
    ``PREFIX_COLUMN_AGG`` plus a row count ``PREFIX_COUNT``. With ``where``
    the same aggregates run over the rows that satisfy it."""
    wanted = [(c, a) for c, aggs in spec.items() for a in aggs]
    specs = [(f"{prefix}{c}_{a.upper()}", a, col(c) if where is None or a in QUANTILES else F.when(where, col(c)),
              where if a in QUANTILES else None) for c, a in wanted]
    cnt = F.count(F.lit(1)) if where is None else F.count_if(where)
    return grouped(child, [key], specs, [cnt.alias(f"{prefix}{count_name}")] if count_name else [])


def conditional_aggregates(child: DataFrame, key: str, spec: Mapping[str, Sequence[str]],
                           subsets: Mapping[str, Column]) -> DataFrame:
    """The G02 aggregates once per named subset, all in ONE pass. A key
    with no row in a subset gets NULL for that subset (as when the subset is
    aggregated on its own and left-joined)."""
    specs = [(f"{prefix}{c}_{a.upper()}", a, col(c), cond) for prefix, cond in subsets.items()
             for c, aggs in spec.items() for a in aggs]
    return grouped(child, [key], specs)


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a categorical column, for generating one
    output column per value: the list is as long as the schema it becomes.
    Pass a value list of your own, or use the long encoders, where that is
    too wide."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def attach(parent: DataFrame, tables: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Left-join keyed tables to the parent: ``(table, {table_key: parent_key})``."""
    out = parent
    for t, kmap in tables:
        renamed = t
        for tk, pk in kmap.items():
            if tk != pk:
                renamed = renamed.withColumnRenamed(tk, pk)
        out = out.join(renamed, list(kmap.values()), "left")
    return out


def two_level(grandchild: DataFrame, child_key: str, child: DataFrame, child_id: str, parent_key: str,
              first: Mapping[str, Sequence[str]], second: Sequence[str], prefix: str = "") -> DataFrame:
    """Aggregate grandchild rows per child, attach to the child, then
    aggregate those per-child values per parent with each of ``second``."""
    per_child = dict_aggregate(grandchild, child_key, first, prefix="", count_name="COUNT")
    c = child.select(child_id, parent_key).join(per_child.withColumnRenamed(child_key, child_id), child_id, "left")
    value_cols = [x for x in per_child.columns if x != child_key]
    exprs = [agg_expr(a, F.col(v)).alias(f"{prefix}{v}_{a.upper()}") for v in value_cols for a in second]
    return c.groupBy(parent_key).agg(*exprs)


def category_shares(child: DataFrame, key: str, column: str, values: Sequence[str],
                    prefix: str | None = None, how: str = "mean", dummy_na: bool = False) -> DataFrame:
    """One-hot ``column`` over the known ``values`` (a NULL category too
    with ``dummy_na``), then mean (share) or sum (count) per ``key``."""
    p = prefix or f"{column}_"
    fn = F.avg if how == "mean" else F.sum
    exprs = [fn(F.coalesce((col(column) == F.lit(v)).cast("int"), F.lit(0))).alias(f"{p}{v}_{how.upper()}")
             for v in values]
    if dummy_na:
        exprs.append(fn(col(column).isNull().cast("int")).alias(f"{p}nan_{how.upper()}"))
    return child.groupBy(key).agg(*exprs)


def distinct_set_string(child: DataFrame, key: str, column: str, name: str | None = None) -> DataFrame:
    """Sorted distinct values joined by ``_`` (NULL spelled ``nan``).
    The set per key is bounded by the column's cardinality, not the group."""
    name = name or f"{column}_set"
    v = F.coalesce(col(column).cast("string"), F.lit("nan"))
    return child.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(v)), "_").alias(name))


def status_score(grandchild: DataFrame, child_key: str, child: DataFrame, child_id: str, parent_key: str,
                 status: str, points: Mapping[str, float], name: str = "status_score") -> DataFrame:
    """Status codes -> points, summed per child, then max and mean per
    parent. Unknown codes score 0."""
    m = F.create_map(*[x for k, v in points.items() for x in (F.lit(k), F.lit(float(v)))])
    per_child = grandchild.groupBy(child_key).agg(
        F.sum(F.coalesce(F.element_at(m, col(status)), F.lit(0.0))).alias("_score"))
    c = child.select(child_id, parent_key).join(per_child.withColumnRenamed(child_key, child_id), child_id)
    return c.groupBy(parent_key).agg(F.max("_score").alias(f"{name}_max"), F.avg("_score").alias(f"{name}_mean"))


def status_flags(child: DataFrame, key: str, status: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per status value seen in the group, plus its length."""
    p = prefix or f"{status}_"
    exprs = [F.max((col(status) == F.lit(v)).cast("int")).alias(f"{p}{v}") for v in values]
    return child.groupBy(key).agg(*exprs, F.count(F.lit(1)).alias(f"{p}len"))


def map_to_parent(child: DataFrame, child_key: str, mapping: DataFrame, map_child: str, map_parent: str,
                  validate: bool = False) -> DataFrame:
    """Attach the parent id through a distinct (child id, parent id)
    map. With ``validate`` one small aggregate asserts the map is
    one-to-one (each child id maps to one parent id)."""
    m = mapping.select(map_child, map_parent).dropDuplicates()
    if validate:
        dup = m.groupBy(map_child).count().where("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"{map_child} -> {map_parent} is not one-to-one")
    return child.join(m.withColumnRenamed(map_child, child_key), child_key, "left")


def coverage_report(parent: DataFrame, parent_key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """For every child table the number and share of parents that have
    at least one child row, plus the parents found in none. Semi/anti joins;
    the result has one row per child table."""
    total = parent.select(parent_key).distinct()
    rows = [total.agg(F.count(F.lit(1)).alias("found")).withColumn("table", F.lit("_total"))]
    none = total
    for name, (df, key) in children.items():
        ids = df.select(F.col(key).alias(parent_key))
        found = total.join(ids, parent_key, "left_semi")
        rows.append(found.agg(F.count(F.lit(1)).alias("found")).withColumn("table", F.lit(name)))
        none = none.join(ids, parent_key, "left_anti")
    rows.append(none.agg(F.count(F.lit(1)).alias("found")).withColumn("table", F.lit("none")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    # a window over the few report rows (one per child table) carries the total
    from pyspark.sql import Window
    n = F.max(F.when(F.col("table") == "_total", F.col("found"))).over(Window.partitionBy())
    return (out.select("table", F.col("found").cast("bigint").alias("found"), (F.col("found") / n).alias("share"))
            .where(F.col("table") != "_total"))
