"""Registered target-encoder queries (E01-E08) over ``events``.

Train rows are the first 24 days (test: the rest); E01-E04 leave one day
out (the split column is the day); E06/E07 use hashed stratified 5-fold on
days 1-21, days 22-24 as holdout. Label: ``event_type = 'purchase'``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.catalog.events import EV, events_df
from tessera.catalog.registry import register
from tessera.functions.columns import rnd
from tessera.operators import sampling as H
from tessera.operators import target as E

IS_TRAIN = "day <= 24"

_SQL_STAT = {
    "woe": "ln(((S + 0.5) / P) / ((N_ - S + 0.5) / (T - P)))",
    "mean": "S / N_",
    "click_woe": "ln((S / P) / ((N_ - S + 1e-8) / (T - P)) + 1)",
    "chi_square": None,
}


def _chi_sql(S, N_, P, T):
    """Squared z statistic of the difference of two proportions."""
    n, rest = f"CAST({N_} AS DOUBLE)", f"(({T}) - ({N_}))"
    gap = f"(({S}) / nullif({n}, 0) - (({P}) - ({S})) / nullif({rest}, 0))"
    rate = f"(({P}) / ({T}))"
    return f"{gap} * {gap} / nullif({rate} * (1 - {rate}) * (1 / nullif({n}, 0) + 1 / nullif({rest}, 0)), 0)"


def _stat_sql(stat, S, N_, P, T):
    if stat == "chi_square":
        return _chi_sql(S, N_, P, T)
    return _SQL_STAT[stat].replace("S", f"({S})").replace("N_", f"({N_})").replace("P", f"({P})").replace("T", f"({T})")


def _lfo_sql(stat, keys, name, filt="TRUE"):
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = e.{c}" for c in keys)
    tr_v = _stat_sql(stat, "kt.s - kf.s", "kt.n - kf.n", "tot.s - ft.s", "tot.n - ft.n")
    te_v = _stat_sql(stat, "kt.s", "kt.n", "tot.s", "tot.n")
    return f"""
WITH e AS (SELECT *, {IS_TRAIN} AS is_train FROM {EV} z),
src AS (SELECT * FROM e WHERE is_train AND ({filt})),
ft AS (SELECT day, CAST(count(y) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM src GROUP BY day),
tot AS (SELECT sum(n) AS n, sum(s) AS s FROM ft),
kf AS (SELECT {k}, day, count(y) AS n, sum(y) AS s FROM src GROUP BY ALL),
kt AS (SELECT {k}, sum(n) AS n, sum(s) AS s FROM kf GROUP BY ALL),
rk AS (SELECT DISTINCT {k}, day FROM e WHERE is_train),
trv AS (SELECT rk.*, CASE WHEN coalesce(kt.n, 0) - coalesce(kf.n, 0) > 0 THEN
          {tr_v.replace('kt.s', 'coalesce(kt.s, 0)').replace('kf.s', 'coalesce(kf.s, 0)').replace('kt.n', 'coalesce(kt.n, 0)').replace('kf.n', 'coalesce(kf.n, 0)').replace('ft.s', 'coalesce(ft.s, 0)').replace('ft.n', 'coalesce(ft.n, 0)')} END AS v
        FROM rk LEFT JOIN kf USING ({k}, day) LEFT JOIN kt USING ({k}) LEFT JOIN ft USING (day), tot),
tev AS (SELECT {k}, CASE WHEN kt.n > 0 THEN {te_v} END AS v FROM kt, tot)
SELECT e.event_id, RND(coalesce(CASE WHEN e.is_train THEN
    (SELECT x.v FROM trv x WHERE {on} AND x.day = e.day) ELSE (SELECT x.v FROM tev x WHERE {on}) END, -1)) AS {name}
FROM e"""


def _lfo(spark, sf, stat, keys, name, filt=None):
    ev = events_df(spark, sf)
    out = E.leave_fold_out(ev, keys, "y", "day", F.expr(IS_TRAIN), stat=stat, name=name,
                           stats_filter=F.expr(filt) if filt else None)
    return out.select("event_id", rnd(name).alias(name))


@register("E01_woe", sql=_lfo_sql("woe", ["user_id"], "woe__user_id"), headline=True)
def e01(spark, sf):
    return _lfo(spark, sf, "woe", ["user_id"], "woe__user_id")


@register("E02_chi_square", sql=_lfo_sql("chi_square", ["k"], "chi_square__k"))
def e02(spark, sf):
    return _lfo(spark, sf, "chi_square", ["k"], "chi_square__k")


@register("E03_mean", sql=_lfo_sql("mean", ["hr", "event_type"], "mean__hr_event_type"))
def e03(spark, sf):
    return _lfo(spark, sf, "mean", ["hr", "event_type"], "mean__hr_event_type")


@register("E04_click_woe", sql=_lfo_sql("click_woe", ["user_id"], "click_woe__user_id", "hr BETWEEN 12 AND 22"))
def e04(spark, sf):
    return _lfo(spark, sf, "click_woe", ["user_id"], "click_woe__user_id", "hr BETWEEN 12 AND 22")


@register("E05_in_sample_chi_square", sql=f"""
WITH e AS (SELECT *, {IS_TRAIN} AS is_train FROM {EV} z),
tot AS (SELECT CAST(count(y) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM e WHERE is_train),
k AS (SELECT k, hr, count(y) AS n, sum(y) AS s FROM e WHERE is_train GROUP BY ALL),
v AS (SELECT k, hr, coalesce({_chi_sql('k.s', 'k.n', 'tot.s', 'tot.n')}, 0) AS v FROM k, tot)
SELECT e.event_id, RND(coalesce(v.v, 0)) AS chi__k_hr FROM e LEFT JOIN v USING (k, hr)""")
def e05(spark, sf):
    ev = events_df(spark, sf)
    out = E.in_sample_chi_square(ev, ["k", "hr"], "y", F.expr(IS_TRAIN))
    return out.select("event_id", rnd("chi__k_hr").alias("chi__k_hr"))


# ------------------------------------------------------------------ E06/E07
K = 5
ROLE = "CASE WHEN day <= 21 THEN 'train' WHEN day <= 24 THEN 'holdout' ELSE 'test' END"
FOLD_SQL = (f"(row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(event_id AS VARCHAR), '|', '42')), "
            f"event_id) - 1) % {K}")


def _roles(spark, sf):
    ev = events_df(spark, sf).withColumn("role", F.expr(ROLE))
    tr = H.kfold(ev.where("role = 'train'"), "event_id", K, seed=42, label="y")
    return tr.unionByName(ev.where("role != 'train'").withColumn("fold", F.lit(None).cast("int")))


def _tm_sql(keys, name):
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = r.{c}" for c in keys)
    return f"""
WITH e AS (SELECT *, {ROLE} AS role FROM {EV} z),
tr AS (SELECT *, {FOLD_SQL} AS fold FROM e WHERE role = 'train'),
kf AS (SELECT {k}, fold, count(y) AS n, sum(y) AS s FROM tr GROUP BY ALL),
kt AS (SELECT {k}, sum(n) AS n, sum(s) AS s FROM kf GROUP BY ALL),
folds AS (SELECT DISTINCT fold FROM tr),
allf AS (SELECT kt.*, folds.fold FROM kt, folds),
m AS (SELECT allf.*, CASE WHEN allf.n - coalesce(kf.n, 0) > 0
        THEN (allf.s - coalesce(kf.s, 0)) / (allf.n - coalesce(kf.n, 0)) END AS mf
      FROM allf LEFT JOIN kf USING ({k}, fold)),
te AS (SELECT {k}, CASE WHEN count(*) FILTER (WHERE mf IS NULL) = 0 THEN avg(mf) END AS v FROM m GROUP BY ALL),
rows AS (SELECT event_id, {k}, fold, role FROM tr UNION ALL SELECT event_id, {k}, NULL, role FROM e WHERE role <> 'train')
SELECT r.event_id, r.role, RND(CASE WHEN r.role = 'train' THEN (SELECT a.mf FROM m a WHERE {on} AND a.fold = r.fold)
                                ELSE (SELECT a.v FROM te a WHERE {on}) END) AS {name}
FROM rows r"""


@register("E06_kfold_target_mean", sql=_tm_sql(["user_id"], "target_mean__user_id"), headline=True)
def e06(spark, sf):
    out = E.kfold_target_mean(_roles(spark, sf), ["user_id"], "y", "fold", "role", K)
    return out.select("event_id", "role", rnd("target_mean__user_id").alias("target_mean__user_id"))


E07_COLS = ["user_id", "k", "hr"]


def _e07_sql():
    parts = []
    for a, b in itertools.combinations(E07_COLS, 2):
        nm = f"target_mean__{a}_{b}"
        parts.append(f"(SELECT event_id, {nm} FROM ({_tm_sql(['pair'], nm).replace(f'FROM {EV} z', f'FROM (SELECT *, concat_ws(chr(95), CAST({a} AS VARCHAR), CAST({b} AS VARCHAR)) AS pair FROM {EV} q) z')}))")
    sel = ", ".join(f"t{i}.target_mean__{a}_{b}" for i, (a, b) in enumerate(itertools.combinations(E07_COLS, 2)))
    joins = " ".join(f"JOIN {p} t{i} USING (event_id)" if i else f"FROM {p} t0"
                     for i, p in enumerate(parts))
    return f"SELECT t0.event_id, {sel} {joins}"


@register("E07_pairwise_target_mean", sql=_e07_sql())
def e07(spark, sf):
    # the fold assignment feeds three encoders: written once to the shared
    # checkpoint folder instead of being recomputed by each branch
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    base = _roles(spark, sf).checkpoint(eager=True)
    out = base
    names = []
    for a, b in itertools.combinations(E07_COLS, 2):
        pair = f"pair_{a}_{b}"
        nm = f"target_mean__{a}_{b}"
        out = out.withColumn(pair, F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string")))
        out = E.kfold_target_mean(out, [pair], "y", "fold", "role", K, name=nm)
        names.append(nm)
    return out.select("event_id", *[rnd(n).alias(n) for n in names])


@register("E08_count_and_rate_encoding", sql=f"""
WITH e AS (SELECT *, {IS_TRAIN} AS is_train FROM {EV} z),
c AS (SELECT k, count(*) AS c, avg(y) AS r FROM e WHERE is_train GROUP BY k),
o AS (SELECT avg(y) AS m FROM e WHERE is_train)
SELECT e.event_id,
  RND(coalesce(c.c, 0) + ('0x' || substr(md5(concat(CAST(e.k AS VARCHAR), '|', '0')), 1, 15))::BIGINT / 1152921504606846976.0 * 0.001)
    AS k_count_enc,
  RND(coalesce(c.r, o.m) + ('0x' || substr(md5(concat(CAST(e.k AS VARCHAR), '|', '0')), 1, 15))::BIGINT / 1152921504606846976.0 * 0.001)
    AS k_rate_enc
FROM e LEFT JOIN c USING (k), o""")
def e08(spark, sf):
    ev = events_df(spark, sf)
    out = E.count_and_rate_encoding(ev, "k", "y", F.expr(IS_TRAIN), seed=0)
    return out.select("event_id", rnd("k_count_enc").alias("k_count_enc"), rnd("k_rate_enc").alias("k_rate_enc"))
