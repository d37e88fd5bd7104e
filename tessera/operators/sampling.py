"""Sampling and splitting.

Every random draw is a hash of the row id and a seed (md5), never ``rand()``:
the same row gets the same fold or sample however the data is partitioned,
and DuckDB computes the same md5. Ordered picks ("first n", "last 10 %")
use the distributed rank of ``plans.positions``; nothing ranks rows in one
task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, hash_key, hash_unit
from tessera.plans.positions import global_rank, with_positions


def _hash_cols(id_col: str, seed, extra=()):
    key = hash_key(id_col, F.lit(str(seed)), *[F.lit(str(e)) for e in extra])
    unit = hash_unit(id_col, F.lit(str(seed)), *[F.lit(str(e)) for e in extra])
    return key, unit


def kfold(df: DataFrame, id_col: str, k: int, seed=42, label: str | None = None, name: str = "fold") -> DataFrame:
    """K folds by shuffled order. Rows are ordered by ``md5(id|seed)``
    (inside each label for the stratified form) and dealt round-robin:
    ``fold = rank mod K``, so every fold gets the same label share."""
    key, unit = _hash_cols(id_col, seed)
    base = df.withColumn("_hk", key).withColumn("_hu", unit)
    keys = [label] if label else []
    ranked = with_positions(base, keys, ["_hk", id_col], pos="_fr", total=None)
    return ranked.withColumn(name, (F.col("_fr") % k).cast("int")).drop("_hk", "_hu", "_fr")


def tail_split(df: DataFrame, order: Sequence[str], ratio: float, name: str = "is_valid") -> DataFrame:
    """The last ``ratio`` of the rows by ``order`` are validation rows."""
    r = global_rank(df, order, pos="_tr", total="_tn")
    return r.withColumn(name, (F.col("_tr") >= F.col("_tn") - F.floor(F.col("_tn") * F.lit(ratio))).cast("int")) \
            .drop("_tr", "_tn")


def listed_split(df: DataFrame, id_col: str, valid_ids: DataFrame, name: str = "is_valid") -> DataFrame:
    """The rows whose id is in ``valid_ids`` are validation rows."""
    ids = valid_ids.select(id_col).distinct().withColumn("_listed", F.lit(1))
    return df.join(ids, id_col, "left").withColumn(name, F.coalesce("_listed", F.lit(0))).drop("_listed")


def window_holdout(train: DataFrame, test: DataFrame, time_col: str, id_col: str, days: int, n: int,
                   seed=42) -> DataFrame:
    """Up to ``n`` train rows drawn (hash order) from the time window of
    the test rows shifted back ``days`` days. The test window is one small
    aggregate; the cap ``n`` is the sample size asked for."""
    w = test.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    lo = w["lo"] - timedelta(days=days)
    hi = w["hi"] - timedelta(days=days)
    key, _ = _hash_cols(id_col, seed)
    cand = train.where((F.col(time_col) >= F.lit(lo)) & (F.col(time_col) <= F.lit(hi)))
    return cand.withColumn("_hk", key).orderBy("_hk", id_col).limit(n).drop("_hk")


def negative_downsample(df: DataFrame, label: str, id_col: str, ratio: float | None = None,
                        draws: int = 1, seed=42) -> DataFrame:
    """Every positive plus ``floor(ratio * negatives)`` negatives drawn
    without replacement (equal counts when ``ratio`` is None), for ``draws``
    independent draws tagged by ``draw``. Negatives are ranked by
    ``md5(id|seed|draw)`` with the distributed rank and the first ones kept."""
    counts = df.groupBy(label).count().collect()  # two rows: label values
    cnt = {r[label]: r["count"] for r in counts}
    n_pos, n_neg = cnt.get(1, 0), cnt.get(0, 0)
    keep = n_pos if ratio is None else int(ratio * n_neg)
    out = None
    for d in range(draws):
        key, unit = _hash_cols(id_col, seed, [d])
        neg = df.where(F.col(label) == 0).withColumn("_hk", key).withColumn("_hu", unit)
        ranked = global_rank(neg, ["_hk", id_col], pos="_dr", total=None)
        picked = ranked.where(F.col("_dr") < keep).drop("_hk", "_hu", "_dr")
        part = df.where(F.col(label) == 1).unionByName(picked).withColumn("draw", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def rate_downsample(df: DataFrame, label: str, id_col: str, rate: float, seed=42,
                    by: str | None = None) -> DataFrame:
    """Keep every positive and each negative with probability ``rate``
    (hash threshold: reproducible, without replacement); ``by`` only tags the
    stratum (e.g. day), the rate is the same in each."""
    _, unit = _hash_cols(id_col, seed, [by or ""])
    return df.where((F.col(label) == 1) | (unit < F.lit(rate)))


def poisson_thresholds(rate: float) -> list[float]:
    """Cumulative Poisson probabilities until they reach 1 in a double."""
    out, p, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += p
        if total >= 1.0 or (out and total == out[-1]):
            return out
        out.append(total)
        k += 1
        p *= rate / k


def poisson_weight(id_col: str, seed, bag=0, rate: float = 1.0) -> Column:
    """How often a row is drawn in one bootstrap sample: Poisson(``rate``) by
    inversion of the row's hash. Sampling n of n rows with replacement gives
    each row Binomial(n, 1/n) draws, which this is for large n, without a
    shuffle and with the same draws whatever the partitions."""
    _, unit = _hash_cols(id_col, seed, [bag])
    draws = F.lit(0)
    for t in poisson_thresholds(rate):
        draws = draws + (unit >= F.lit(t)).cast("int")
    return draws


def bootstrap_weights(df: DataFrame, id_col: str, bags: int, seed=42, rate: float = 1.0, prefix: str = "w") -> DataFrame:
    """``df`` with a weight column per bag: the samples with replacement, as
    columns a learner takes as weights instead of copies of the rows."""
    return df.select("*", *[poisson_weight(id_col, seed, b, rate).alias(f"{prefix}{b}") for b in range(bags)])


def _entry(bag: Column, copy: Column) -> Column:
    return F.struct(bag, copy.alias("copy"))


def sample_with_replacement(df: DataFrame, id_col: str, rate: float, bags: int = 1, seed=42,
                            where: Column | None = None) -> DataFrame:
    """H05/H06 with replacement: rows that satisfy ``where`` (None: all) occur
    as often as they are drawn, the others once, in every bag; ``bag`` and
    ``copy`` (from 1) tell the rows apart."""
    entries = []
    for b in range(bags):
        n = poisson_weight(id_col, seed, b, rate)
        n = n if where is None else F.when(where, n).otherwise(F.lit(1))
        copies = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        bag = F.lit(b).alias("bag")
        entries.append(F.transform(copies, functools.partial(_entry, bag)))
    return df.select("*", F.explode(F.concat(*entries)).alias("_e")).select("*", "_e.bag", "_e.copy").drop("_e")


def debug_subset(df: DataFrame, order: Sequence[str], n: int | None = None, fraction: float | None = None) -> DataFrame:
    """The first ``n`` rows (or the first ``fraction``) by ``order``."""
    if n is not None:
        return df.orderBy(*order).limit(n)
    r = global_rank(df, order, pos="_dr", total="_dn")
    return r.where(F.col("_dr") < F.floor(F.col("_dn") * F.lit(fraction))).drop("_dr", "_dn")


def balanced_one_vs_one(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """All positives plus the first equally many negatives (by order)."""
    n_pos = df.where(F.col(label) == 1).count()
    neg = global_rank(df.where(F.col(label) == 0), order, pos="_dr", total=None)
    return df.where(F.col(label) == 1).unionByName(neg.where(F.col("_dr") < n_pos).drop("_dr"))


def random_holdout(df: DataFrame, id_col: str, k: int = 7, seed=42, label: str | None = None,
                   name: str = "is_holdout") -> DataFrame:
    """H01 with K folds, fold 0 is the holdout (share 1/K)."""
    out = kfold(df, id_col, k, seed, label, name="_hf")
    return out.withColumn(name, (F.col("_hf") == 0).cast("int")).drop("_hf")


def supplied_folds(df: DataFrame, fold: Column, name: str = "fold") -> DataFrame:
    """Folds given by the data (e.g. the day) or by a joined fold table."""
    return df.withColumn(name, fold)


def fold_table(df: DataFrame, id_col: str, k: int, fold_col: str = "fold") -> DataFrame:
    """(fold, id, role) rows: for every fold 0..k-1 its validation ids
    and its training ids, as a long table that drives train/predict loops.
    Each row is repeated once per fold (``explode``), which is what K
    training sets are."""
    rows = df.select(id_col, fold_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f"))
    return rows.select(F.col("_f").alias("fold"), col(id_col),
                       F.when(F.col(fold_col) == F.col("_f"), "valid").otherwise("train").alias("role"))
