"""Ordered and event-time features.

Row order is explicit: every function takes ``order`` (ending in a unique id)
instead of relying on the position of rows in a file. All positions come from
``plans.positions.with_positions``, which never sends a whole key group to
one task. On top of positions:

* lead/lag (T04-T07) look inside a slice of the key's order, and into the
  first or last rows of the slices beside it;
* time-horizon counts (T08-T10) are range frames inside a slice; only where a
  horizon ends in another slice a *probe* row is sent there;
* last-K roll-ups (T12-T15) number child rows by recency and aggregate with
  ``agg(f(when(pos < K, x)))`` for every K in one pass (partial aggregation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col, null_unless_keys
from tessera.plans.positions import chunk_rows, with_positions, with_slices
from tessera.plans.quantiles import group_quantiles


def _on(l: str, r: str, keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}"))
    return cond


# ------------------------------------------------------------------ T01-T03
def cumulative_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      prefix: str | None = None) -> DataFrame:
    """T01 ``cumulative_count`` (0-based position), T02
    ``reverse_cumulative_count`` and T03 ratio ``round(pos/(n-1), 4)`` with
    0/0 -> 1.1, all from one positions pass."""
    p = prefix or "_".join(keys)
    out = with_positions(df, keys, order)
    cum = F.col("_pos")
    rev = F.col("_n") - 1 - F.col("_pos")
    ratio = F.coalesce(F.round(F.try_divide(F.col("_pos").cast("double"), (F.col("_n") - 1).cast("double")), 4),
                       F.lit(1.1))
    return out.select(*df.columns,
                      null_unless_keys(cum, keys).cast("bigint").alias(f"cum_count__{p}"),
                      null_unless_keys(rev, keys).cast("bigint").alias(f"rev_cum_count__{p}"),
                      null_unless_keys(ratio, keys).alias(f"cum_count_ratio__{p}"))


def ordered_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: Column | None = None,
                     cumulative: bool = True, reverse: bool = False, nexts: Sequence[tuple[int, object]] = (),
                     prefix: str | None = None) -> DataFrame:
    """Fusion of ordered features that share one key set and one order
    (T01, T02, T04/T05): ONE positions pass, one window, one exchange.
    ``nexts`` lists (n, fill) pairs for ``time_to_n_next`` on ``time``."""
    p = prefix or "_".join(keys)
    base = df.withColumn("_t", time) if time is not None else df
    leads = {f"_tn{i}": ("_t", n) for i, (n, _) in enumerate(nexts)}
    pos = with_positions(base, keys, order, total="_n" if reverse else None, leads=leads)
    out = [F.col(c) for c in df.columns]
    if cumulative:
        out.append(null_unless_keys(F.col("_pos"), keys).cast("bigint").alias(f"cum_count__{p}"))
    if reverse:
        out.append(null_unless_keys(F.col("_n") - 1 - F.col("_pos"), keys).cast("bigint").alias(f"rev_cum_count__{p}"))
    for i, (n, fill) in enumerate(nexts):
        v = F.col(f"_tn{i}") - F.col("_t")
        if fill is not None:
            v = F.coalesce(v, F.lit(fill))
        out.append(null_unless_keys(v, keys).alias(f"time_to_{n}_next__{p}"))
    return pos.select(*out)


# ------------------------------------------------------------------ T04-T07
def time_to_n_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: Column,
                   n: int = 1, fill=None, plus: float = 0.0, name: str | None = None) -> DataFrame:
    """``time`` of the n-th next row of the same key minus this
    row's ``time`` (+ ``plus``), missing -> ``fill``. n < 0 looks back and
    keeps the sign (T05). ``time`` is a numeric Column."""
    name = name or f"time_to_{n}_next__{'_'.join(keys)}"
    base = df.withColumn("_t", time)
    pos = with_positions(base, keys, order, total=None, leads={"_tn": ("_t", n)})
    val = F.col("_tn") - F.col("_t") + F.lit(plus) if plus else F.col("_tn") - F.col("_t")
    if fill is not None:
        val = F.coalesce(val, F.lit(fill))
    return pos.select(*df.columns, null_unless_keys(val, keys).alias(name))


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: Column,
         missing: float = -1.0, prefix: str | None = None) -> DataFrame:
    """Gap to the next and to the previous row (both positive), missing -> -1."""
    p = prefix or "_".join(keys)
    base = df.withColumn("_t", time)
    pos = with_positions(base, keys, order, total=None, leads={"_nt": ("_t", 1), "_pt": ("_t", -1)})
    return pos.select(*df.columns,
                      null_unless_keys(F.coalesce(F.col("_nt") - F.col("_t"), F.lit(missing)), keys)
                      .alias(f"gap_next__{p}"),
                      null_unless_keys(F.coalesce(F.col("_t") - F.col("_pt"), F.lit(missing)), keys)
                      .alias(f"gap_prev__{p}"))


# ------------------------------------------------------------------ T08-T10
def horizon_counts(df: DataFrame, keys: Sequence[str], time: Column, id_col: str,
                   n: float | None = None, which: Sequence[str] = ("prev", "next", "window"),
                   prefix: str | None = None, ns: Sequence[float] | None = None) -> DataFrame:
    """Counts of same-key rows within a time horizon ``n`` (same units as
    ``time``), rows ordered by ``(time, id)``:

    * ``prev`` (T08): rows earlier in order with ``t' >= t - n``;
    * ``next`` (T09): rows later in order with ``t' <= t + n``;
    * ``window`` (T10): rows with ``t <= t' <= t + n``, self included.

    Rows are cut into slices of their key's time order and dealt once. Inside a
    slice, growing range frames count the rows below ``t - n`` and up to
    ``t + n`` for all horizons (``ns``) in one window. A probe row is sent only
    where a horizon ends in another slice, to that slice; it comes back with
    the slice's count by the row's id. Keys without cuts send none, so rows
    are not copied per horizon. NULL times count as equal to each other.
    """
    keys = list(keys)
    p = prefix or "_".join(keys)
    horizons = list(ns) if ns is not None else [n]
    spark = df.sparkSession
    base = df.withColumn("_v", time).withColumn("_id", F.col(id_col))
    whole = base.schema["_v"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    at: dict[str, tuple[Column, bool]] = {}
    for i, h in enumerate(horizons):
        if "prev" in which:
            at[f"lo{i}"] = (F.col("_b._v") - F.lit(h), False)   # rows with t' <  t - h
        if "next" in which or "window" in which:
            at[f"hi{i}"] = (F.col("_b._v") + F.lit(h), True)    # rows with t' <= t + h
    if "window" in which:
        at["now"] = (F.col("_b._v"), False)                      # rows with t' <  t
    sliced = with_slices(base, keys, ["_v", "_id"], chunk_rows(spark), at={f"_at_{t}": v for t, v in at.items()})

    # the row itself, and a probe for every count that ends in another slice
    def entry(tag, chunk, value, own):
        return F.struct(F.lit(tag).alias("tag"), chunk.alias("chunk"), value.cast(base.schema["_v"].dataType).alias("v"),
                        own.alias("own"))

    shift = {t: (F.lit(0) if t == "now" else F.lit(-horizons[int(t[2:])]) if t[:2] == "lo" else F.lit(horizons[int(t[2:])]))
             for t in at}
    everything = F.struct(*[F.col(c) for c in df.columns])
    nothing = F.lit(None).cast(sliced.select(everything).schema[0].dataType)
    entries = [entry("", F.col("_chunk"), F.col("_v"), everything)]
    entries += [F.when(F.col(f"_at_{t}") != F.col("_chunk"), entry(t, F.col(f"_at_{t}"), F.col("_v") + shift[t], nothing))
                for t in at]
    away = [(F.col(f"_at_{t}") != F.col("_chunk")).alias(f"_away_{t}") for t in at]
    stream = sliced.select(*keys, "_id", "_hot", *away, F.explode(F.array_compact(F.array(*entries))).alias("e")) \
        .select(*keys, "_id", "_hot", *[f"_away_{t}" for t in at], "e.*").withColumnRenamed("chunk", "_chunk") \
        .withColumn("flag", (F.col("tag") == "").cast("long"))
    dealt = stream.repartition(*[F.col(k) for k in keys], F.col("_chunk"))

    part = Window.partitionBy(*[F.col(k) for k in keys], F.col("_chunk"))
    by_time = part.orderBy("v")

    def upto(offset) -> Column:
        """Rows of the slice with t' <= v + offset."""
        return F.coalesce(F.sum("flag").over(by_time.rangeBetween(Window.unboundedPreceding, offset)), F.lit(0))

    def below(h) -> Column:
        """Rows of the slice with t' < v - h."""
        if whole:
            return F.when(F.col("v").isNull(), 0).otherwise(upto(-int(h) - 1))  # nothing is below NULL
        down = f"sum(flag) over (partition by {', '.join(f'`{k}`' for k in keys + ['_chunk'])} order by v desc " \
               f"range between unbounded preceding and {float(h)}D following)"
        return F.sum("flag").over(part) - F.coalesce(F.expr(down), F.lit(0))

    def up(h) -> Column:
        if whole:
            return upto(int(h))
        return F.coalesce(F.expr(f"sum(flag) over (partition by {', '.join(f'`{k}`' for k in keys + ['_chunk'])} order by v "
                                 f"range between unbounded preceding and {float(h)}D following)"), F.lit(0))

    here = F.sum("flag").over(part.orderBy("v", F.col("flag").desc(), "_id").rowsBetween(Window.unboundedPreceding, 0))
    equal = F.sum("flag").over(by_time.rangeBetween(0, 0))
    local = [upto(0).alias("_upto"), equal.alias("_equal")]
    for i, h in enumerate(horizons):
        local += [below(h).alias(f"_lo{i}")] if f"lo{i}" in at else []
        local += [up(h).alias(f"_hi{i}")] if f"hi{i}" in at else []
    same = F.xxhash64(*dealt.columns).bitwiseAND(F.lit(0))
    # the finest order first: it serves the windows by time alone, too
    counted = dealt.select("*", same.alias("_same"), here.alias("_here")).select("*", *local)
    # rows of the slices before, for rows and probes that meet across slices
    sizes = dealt.groupBy(*keys, "_chunk").agg(F.sum("flag").alias("_n"), F.max("_hot").alias("_cut"), F.max(same).alias("_same")) \
        .where("_cut")
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select(*keys, "_chunk", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_same")).alias("_off"))
    j = counted.alias("_r").join(F.broadcast(off).alias("_o"), _on("_r", "_o", [*keys, "_chunk"]), "left")
    offset = F.coalesce(F.col("_o._off"), F.lit(0))
    # in the order of the whole key: the row's own place, and what a probe counts
    answer = offset + F.when(F.col("tag").startswith("hi"), F.col("_upto")).otherwise(F.col("_upto") - F.col("_equal"))
    real = F.col("tag") == ""
    keep = F.struct("own", (offset + F.col("_here") - 1 + F.col("_same")).alias("place"), (offset + F.col("_upto") - F.col("_equal")).alias("now"),
                    *[(offset + F.col(f"_{t}")).alias(t) for t in at if t != "now"], *[F.col(f"_away_{t}") for t in at])
    per = j.select(F.col("_r._id").alias("_id"), "tag", F.when(real, keep).alias("k"), answer.alias("a")).groupBy("_id").agg(
        F.first("k", ignorenulls=True).alias("k"), *[F.max(F.when(F.col("tag") == t, F.col("a"))).alias(f"far_{t}") for t in at])

    def count(t) -> Column:
        return F.when(F.col(f"k._away_{t}"), F.col(f"far_{t}")).otherwise(F.col(f"k.{t}"))

    place, feats = F.col("k.place"), []
    for i, h in enumerate(horizons):
        if "prev" in which:
            feats.append((place - count(f"lo{i}")).alias(f"count_prev_{_fmt(h)}__{p}"))
        if "next" in which:
            feats.append((count(f"hi{i}") - place - 1).alias(f"count_next_{_fmt(h)}__{p}"))
        if "window" in which:
            feats.append((count(f"hi{i}") - count("now")).alias(f"count_window_{_fmt(h)}__{p}"))
    out = per.select(*[F.col(f"k.own.{c}").alias(c) for c in df.columns], *feats)
    return out.select(*df.columns, *[null_unless_keys(F.col(c).cast("bigint"), keys).alias(c)
                                     for c in out.columns if c not in df.columns])


def _fmt(n) -> str:
    return str(int(n)) if float(n).is_integer() else str(n).replace(".", "p")


# ------------------------------------------------------------------------ T11
def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: str,
                 name: str | None = None, strict_name: str | None = None) -> DataFrame:
    """Mean of ``target`` over rows up to and including this one (the
    reference leaks the label this way); ``strict_name`` also adds the mean
    over earlier rows only. One positions pass serves both."""
    name = name or f"running_mean_{target}__{'_'.join(keys)}"
    base = df.withColumn("_y", col(target).cast("double"))
    pos = with_positions(base, keys, order, sums=["_y"], total=None)
    out = [null_unless_keys(F.col("_cum__y") / (F.col("_pos") + 1), keys).alias(name)]
    if strict_name:
        strict = F.try_divide(F.col("_cum__y") - F.col("_y"), F.col("_pos").cast("double"))
        out.append(null_unless_keys(strict, keys).alias(strict_name))
    return pos.select(*df.columns, *out)


# ------------------------------------------------------------------ T12-T15
LASTK_AGGS = ("sum", "mean", "max", "min", "std", "median", "skew", "kurt", "iqr", "count")


def _lastk_agg(agg: str, x: Column) -> Column:
    return {
        "sum": lambda: F.sum(x),
        "mean": lambda: F.avg(x),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "std": lambda: F.stddev_samp(x),
        "median": lambda: F.percentile(x, 0.5),
        "skew": lambda: F.skewness(x),        # population form (= scipy)
        "kurt": lambda: F.kurtosis(x),        # excess, population form (= scipy)
        "iqr": lambda: F.percentile(x, 0.75) - F.percentile(x, 0.25),
        "count": lambda: F.count(x),
    }[agg]()


def last_k_aggregates(child: DataFrame, parent_key: str, order: Sequence[str], values: Sequence[str],
                      ks: Sequence[int | None], aggs: Sequence[str] = LASTK_AGGS,
                      prefix: str = "") -> DataFrame:
    """Per parent, aggregates of the latest K child rows for every K
    (None = all rows) in one grouped pass. ``order`` sorts oldest -> newest
    and ends with a unique id; position 0 is the most recent row.

    Quantiles (median, iqr) of a finite K use ``percentile`` over at most K
    values; over the whole history (K = None) they come from the rank-based
    ``group_quantiles``, so a parent with a huge history is never one buffer."""
    need = child.select(*dict.fromkeys([parent_key, *order, *values]))  # positions deal every column they get
    pos = with_positions(need, [parent_key], order, total=None, descending=True, pos="_rec")
    exprs, names, deferred = [], [], []
    for k in ks:
        keep = F.lit(True) if k is None else F.col("_rec") < k
        tag = "all" if k is None else f"last{k}"
        for v in values:
            x = F.when(keep, col(v).cast("double"))
            for a in aggs:
                name = f"{prefix}{tag}_{a}_{v}"
                names.append(name)
                if k is None and a in ("median", "iqr"):
                    deferred.append((name, a, v))
                else:
                    exprs.append(_lastk_agg(a, x).alias(name))
    out = pos.groupBy(parent_key).agg(*exprs) if exprs else pos.select(parent_key).distinct()
    for v in sorted({d[2] for d in deferred}):
        q = group_quantiles(child, [parent_key], v, order[-1], [0.25, 0.5, 0.75], names=["_q25", "_q50", "_q75"])
        cols_ = [F.col(parent_key)]
        for name, a, vv in deferred:
            if vv == v:
                cols_.append((F.col("_q50") if a == "median" else F.col("_q75") - F.col("_q25")).alias(name))
        out = out.join(q.select(*cols_), parent_key, "left")
    return out.select(parent_key, *names)


def last_k_fractions(table: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``a / b`` for (name, a, b); a zero divisor gives 0.0, NULL stays NULL."""
    return table.select("*", *[F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b)).alias(nm)
                               for nm, a, b in pairs])


def last_k_trend(child: DataFrame, parent_key: str, order: Sequence[str], value: str,
                 ks: Sequence[int], prefix: str = "") -> DataFrame:
    """OLS slope of ``value`` on recency position (0 = most recent) over
    the latest K rows. One row -> 0.0; any NULL value among the K -> NULL."""
    need = child.select(*dict.fromkeys([parent_key, *order, value]))
    pos = with_positions(need, [parent_key], order, total=None, descending=True, pos="_rec")
    exprs = []
    for k in ks:
        keep = F.col("_rec") < k
        y = F.when(keep, col(value).cast("double"))
        x = F.when(keep, F.col("_rec").cast("double"))
        nrows = F.count(F.when(keep, F.lit(1)))
        nnull = F.count(F.when(keep & col(value).isNull(), F.lit(1)))
        slope = F.regr_slope(y, x)
        exprs.append(F.when(nnull > 0, F.lit(None).cast("double"))
                     .when(nrows == 1, F.lit(0.0))
                     .otherwise(slope).alias(f"{prefix}trend_last{k}_{value}"))
    return pos.groupBy(parent_key).agg(*exprs)


# ------------------------------------------------------------------ T16-T17
def last_group_aggregates(child: DataFrame, parent_key: str, group_key: str, order: Sequence[str],
                          values: Sequence[str], aggs: Sequence[str] = ("mean", "max", "min", "sum", "count"),
                          prefix: str = "lastgrp_") -> DataFrame:
    """Rows of the same ``group_key`` (e.g. loan) as the latest row of
    each parent, then aggregates. ``max_by`` picks the latest group without a
    window; the pick is joined back (one row per parent)."""
    o = F.struct(*[col(c) for c in order])
    latest = child.groupBy(parent_key).agg(F.max_by(col(group_key), o).alias("_lg"))
    rows = child.join(latest, parent_key).where(col(group_key).eqNullSafe(F.col("_lg")))
    exprs = [_lastk_agg(a, col(v).cast("double")).alias(f"{prefix}{a}_{v}") for v in values for a in aggs]
    return rows.groupBy(parent_key).agg(*exprs)


def first_last_value(child: DataFrame, parent_key: str, order: Sequence[str], values: Sequence[str],
                     skip_nulls: bool = False, prefix: str = "") -> DataFrame:
    """Value in the first and the last row of each group by time.
    ``skip_nulls`` mimics pandas ``.first()/.last()`` (skip NULL values);
    otherwise the value of the first/last row itself (``.iloc``)."""
    o = F.struct(*[col(c) for c in order])
    exprs = []
    for v in values:
        if skip_nulls:
            exprs += [F.min_by(col(v), F.when(col(v).isNotNull(), o)).alias(f"{prefix}first_{v}"),
                      F.max_by(col(v), F.when(col(v).isNotNull(), o)).alias(f"{prefix}last_{v}")]
        else:
            exprs += [F.min_by(col(v), o).alias(f"{prefix}first_{v}"),
                      F.max_by(col(v), o).alias(f"{prefix}last_{v}")]
    return child.groupBy(parent_key).agg(*exprs)
