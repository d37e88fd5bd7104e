"""Target encoders (E01-E08), leakage-safe by construction.

Out-of-fold statistics use the subtraction trick: one aggregate by
``(key, fold)`` and key totals over that small table; the statistics of
"every fold but f" are ``total - fold f``. One shuffle of combined rows, no
loop over folds, and the cost does not grow with K. Fold totals are a table
(one row per fold) joined to it.

The encoded value is computed on the small per-(key, fold) table and joined
to the rows once: AQE broadcasts it when it is small and splits a skewed key
of the row side otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, hash_unit
from tessera.session import written


def _woe(s, n, P, N, smooth=0.5):
    return F.log(F.try_divide(F.try_divide(s + smooth, P), F.try_divide(n - s + smooth, N)))


def _chi2(s, n, P, T):
    """Chi-square of a 2x2 table in closed form from its margins: T (sT - nP)^2
    over the product of the four margins. NULL if a margin is empty."""
    lean = s * T - n * P
    return F.try_divide(T * lean * lean, n * (T - n) * (P * (T - P)))


STATS = {
    "woe": lambda s, n, P, N: _woe(s, n, P, N),
    "chi_square": lambda s, n, P, N: _chi2(s, n, P, P + N),
    "mean": lambda s, n, P, N: F.try_divide(s, n),
    "click_woe": lambda s, n, P, N: F.log(F.try_divide(F.try_divide(s, P), F.try_divide(n - s + 1e-8, N)) + 1),
}


def leave_fold_out(df: DataFrame, keys: Sequence[str], label: str, fold: str, is_train: Column,
                   stat: str = "woe", name: str | None = None, missing: float = -1.0,
                   stats_filter: Column | None = None) -> DataFrame:
    """E01 ``woe`` / E02 ``chi_square`` / E03 ``mean`` / E04 click WOE.

    Train rows of fold ``f`` are encoded with statistics of the train rows
    of all other folds; test rows (``~is_train``) with all train rows.
    ``stats_filter`` restricts the rows the statistics come from (E04:
    hours 12-22). Unseen keys and undefined values get ``missing``.
    """
    keys = list(keys)
    name = name or f"{stat}__{'_'.join(keys)}"
    fn = STATS[stat]
    src = df.where(is_train if stats_filter is None else is_train & stats_filter)
    # one scan for all statistics: key and fold totals follow from this table
    kf = written(src.groupBy(*keys, fold).agg(F.count(col(label)).alias("_n"), F.sum(col(label)).alias("_s")), "key-folds")
    folds = [r for r in kf.groupBy(fold).agg(F.sum("_n").cast("double").alias("n"), F.sum("_s").cast("double").alias("s")).collect()]
    n_all, s_all = float(sum(r["n"] or 0 for r in folds)), float(sum(r["s"] or 0 for r in folds))
    # one row per key: totals and a map of its folds, so train and test rows share one join
    entry = F.when(F.col(fold).isNotNull(), F.struct(F.col(fold).alias("f"), F.struct("_n", F.coalesce("_s", F.lit(0)).alias("_s"))))
    stats = kf.groupBy(*keys).agg(F.sum("_n").alias("_nk"), F.sum("_s").alias("_sk"),
                                  F.map_from_entries(F.collect_list(entry)).alias("_by"))
    j = df.join(stats, keys, "left")
    known = [r for r in folds if r[fold] is not None]

    def of_fold(what: str) -> Column:
        """The row's fold in all keys: a literal per fold."""
        if not known:
            return F.lit(0.0)
        table = F.map_from_arrays(F.array(*[F.lit(r[fold]) for r in known]), F.array(*[F.lit(float(r[what] or 0)) for r in known]))
        return F.coalesce(F.element_at(table, F.col(fold)), F.lit(0.0))

    own = F.element_at("_by", F.col(fold))
    nk, sk = F.coalesce("_nk", F.lit(0)), F.coalesce("_sk", F.lit(0))
    n_ex, s_ex = nk - F.coalesce(own["_n"], F.lit(0)), sk - F.coalesce(own["_s"], F.lit(0))
    p_ex = F.lit(s_all) - of_fold("s")
    t_ex = F.lit(n_all) - of_fold("n")
    train = F.when(n_ex > 0, fn(s_ex, n_ex, p_ex, t_ex - p_ex))
    test = F.when(nk > 0, fn(sk, nk, F.lit(s_all), F.lit(n_all - s_all)))
    return j.where(is_train | ~is_train).select(
        *df.columns, F.coalesce(F.when(is_train, train).otherwise(test), F.lit(missing)).alias(name))


def in_sample_chi_square(df: DataFrame, keys: Sequence[str], label: str, is_train: Column,
                         name: str | None = None, missing: float = 0.0) -> DataFrame:
    """Chi-square of key vs label from all train rows (in sample),
    the same value for train and test rows of a key; undefined or unseen -> 0."""
    keys = list(keys)
    name = name or f"chi__{'_'.join(keys)}"
    train = df.where(is_train)
    tot = train.agg(F.count(col(label)).alias("n"), F.sum(col(label)).alias("s")).first()
    T, P = float(tot["n"]), float(tot["s"] or 0)
    k = train.groupBy(*keys).agg(F.count(col(label)).alias("_n"), F.sum(col(label)).alias("_s"))
    enc = k.select(*keys, F.coalesce(_chi2(F.col("_s"), F.col("_n"), F.lit(P), F.lit(T)), F.lit(missing)).alias(name))
    return df.join(enc, keys, "left").fillna({name: missing})


def kfold_target_mean(df: DataFrame, keys: Sequence[str], label: str, fold: str, role: str,
                      k: int, name: str | None = None) -> DataFrame:
    """Out-of-fold label mean. ``role`` is 'train', 'holdout' or 'test'
    per row; ``fold`` (0..k-1) is set on train rows (H01). Train rows get the
    mean over the other folds (NULL if the key is nowhere else); holdout and
    test rows get the average of the K fold mappings, NULL if any mapping
    lacks the key. Holdout rows never feed any statistic."""
    keys = list(keys)
    name = name or f"target_mean__{'_'.join(keys)}"
    train = df.where(F.col(role) == "train")
    # one row per key: its totals and a map of its (at most k) folds, so rows
    # of every role are served by one join
    stats = (train.groupBy(*keys, fold).agg(F.count(col(label)).alias("_n"), F.sum(col(label)).alias("_s"))
             .groupBy(*keys).agg(F.sum("_n").alias("_nk"), F.sum("_s").alias("_sk"),
                                 F.map_from_entries(F.collect_list(F.struct(
                                     F.col(fold).alias("f"), F.struct("_n", "_s")))).alias("_by")))
    n, total = F.col("_nk"), F.col("_sk")

    def without(f: Column) -> Column:
        return F.when(n - f["_n"] > 0, (total - f["_s"]) / (n - f["_n"]))

    means = F.transform(F.map_values("_by"), without)
    summed = F.aggregate(means, F.lit(0.0), lambda acc, m: acc + m)
    # a fold without the key maps it to the mean of all folds
    average = F.when(F.forall(means, lambda m: m.isNotNull()),
                     (summed + (F.lit(k) - F.size("_by")) * total / n) / F.lit(k))
    own = without(F.element_at("_by", F.col(fold)))
    value = F.when(F.col(role) == "train", own).otherwise(average)
    return df.join(stats, keys, "left").select(*df.columns, value.alias(name))


def count_and_rate_encoding(df: DataFrame, column: str, label: str, is_train: Column, seed=0,
                            jitter: float = 0.001, prefix: str | None = None) -> DataFrame:
    """Category -> train count, and -> train label mean (unseen: the
    overall mean), each plus a deterministic jitter in [0, jitter) drawn from
    a hash of the category value, so equal counts stay distinguishable."""
    p = prefix or column
    train = df.where(is_train)
    overall = train.agg(F.avg(col(label)).alias("m")).first()["m"]
    enc = train.groupBy(column).agg(F.count(F.lit(1)).alias("_c"), F.avg(col(label)).alias("_r"))
    j = hash_unit(F.col(column), F.lit(str(seed))) * F.lit(jitter)
    out = df.join(enc, column, "left")
    return out.select(*df.columns,
                      (F.coalesce(F.col("_c"), F.lit(0)) + j).alias(f"{p}_count_enc"),
                      (F.coalesce(F.col("_r"), F.lit(overall)) + j).alias(f"{p}_rate_enc"))
