"""Registered sampling / splitting queries (H01-H10) over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.events import EV, events_df
from tessera.catalog.registry import register
from tessera.operators import sampling as H
from tessera.plans.positions import global_rank

MD5 = "md5(concat(CAST(event_id AS VARCHAR), '|', '42'{extra}))"


def _md5(extra=""):
    return MD5.format(extra=extra)


@register("H01_kfold", sql=f"""
SELECT event_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {_md5()}, event_id) - 1) % 5 AS INTEGER) AS fold
FROM {EV} e""", headline=True)
def h01(spark, sf):
    return H.kfold(events_df(spark, sf).select("event_id", "y"), "event_id", 5, seed=42, label="y").select("event_id", "fold")


@register("H02_global_rank", sql="""
SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rank_value FROM events""")
def h02(spark, sf):
    ev = events_df(spark, sf).select("event_id", "value")
    return global_rank(ev, ["value", "event_id"], pos="rank_value", total=None).select("event_id", "rank_value")


@register("H03_tail_split", sql="""
SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 >= count(*) OVER () - floor(count(*) OVER () * 0.1)
  AS INTEGER) AS is_valid FROM events""")
def h03(spark, sf):
    ev = events_df(spark, sf).select("event_id", "ts")
    return H.tail_split(ev, ["ts", "event_id"], 0.1).select("event_id", "is_valid")


@register("H04_window_holdout", sql=f"""
WITH w AS (SELECT min(ts) - INTERVAL 7 DAY AS lo, max(ts) - INTERVAL 7 DAY AS hi FROM {EV} t WHERE day > 24)
SELECT event_id FROM {EV} e, w WHERE e.day <= 24 AND e.ts BETWEEN w.lo AND w.hi
ORDER BY {_md5()}, event_id LIMIT 200""")
def h04(spark, sf):
    ev = events_df(spark, sf)
    out = H.window_holdout(ev.where("day <= 24"), ev.where("day > 24"), "ts", "event_id", days=7, n=200)
    return out.select("event_id")


def _h05_sql(ratio, draws):
    parts = []
    for d in range(draws):
        parts.append(f"""SELECT event_id, {d} AS draw FROM {EV} p WHERE y = 1
UNION ALL SELECT event_id, {d} FROM (SELECT event_id, row_number() OVER (ORDER BY {_md5(f", '|', '{d}'")}, event_id) - 1 AS r
  FROM {EV} n WHERE y = 0) WHERE r < (SELECT floor({ratio} * count(*)) FROM {EV} c WHERE y = 0)""")
    return "\nUNION ALL ".join(parts)


@register("H05_negative_downsample", sql=_h05_sql(0.1, 2))
def h05(spark, sf):
    ev = events_df(spark, sf)
    out = H.negative_downsample(ev, "y", "event_id", ratio=0.1, draws=2, seed=42)
    return out.select("event_id", F.col("draw").cast("int").alias("draw"))


def _h05_bootstrap_sql(rate, bags):
    parts = []
    for b in range(bags):
        u = f"('0x' || substr({_md5(f", '|', '{b}'")}, 1, 15))::BIGINT / 1152921504606846976.0"
        n = " + ".join(f"CASE WHEN u >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in H.poisson_thresholds(rate))
        parts.append(f"SELECT event_id, {b} AS bag, unnest(range(1, 1 + n))::INTEGER AS copy FROM (SELECT event_id, "
                     f"CASE WHEN y = 0 THEN {n} ELSE 1 END AS n FROM (SELECT event_id, y, ({u})::DOUBLE AS u FROM {EV} e))")
    return " UNION ALL ".join(parts)


@register("H05_negative_bootstrap", sql=_h05_bootstrap_sql(0.5, 2))
def h05_bootstrap(spark, sf):
    ev = events_df(spark, sf)
    out = H.sample_with_replacement(ev, "event_id", 0.5, bags=2, seed=42, where=F.col("y") == 0)
    return out.select("event_id", "bag", "copy")


@register("H06_rate_downsample", sql=f"""
SELECT event_id FROM {EV} e WHERE y = 1
  OR ('0x' || substr({_md5(", '|', ''")}, 1, 15))::BIGINT / 1152921504606846976.0 < 0.25""")
def h06(spark, sf):
    ev = events_df(spark, sf)
    return H.rate_downsample(ev, "y", "event_id", 0.25, seed=42).select("event_id")


@register("H07_debug_subset", sql="SELECT event_id FROM events ORDER BY ts, event_id LIMIT 500")
def h07(spark, sf):
    return H.debug_subset(events_df(spark, sf), ["ts", "event_id"], n=500).select("event_id")


@register("H08_balanced_one_vs_one", sql=f"""
SELECT event_id FROM {EV} e WHERE y = 1
UNION ALL SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM {EV} n WHERE y = 0)
WHERE r <= (SELECT count(*) FROM {EV} c WHERE y = 1)""")
def h08(spark, sf):
    return H.balanced_one_vs_one(events_df(spark, sf), "y", ["ts", "event_id"]).select("event_id")


@register("H09_random_holdout", sql=f"""
SELECT event_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {_md5()}, event_id) - 1) % 7 = 0 AS INTEGER) AS is_holdout
FROM {EV} e""")
def h09(spark, sf):
    return H.random_holdout(events_df(spark, sf), "event_id", 7, seed=42, label="y").select("event_id", "is_holdout")


@register("H10_supplied_folds", sql=f"""
SELECT f AS fold, event_id, CASE WHEN (day - 1) // 6 = f THEN 'valid' ELSE 'train' END AS role
FROM {EV} e, range(5) r(f)""")
def h10(spark, sf):
    ev = H.supplied_folds(events_df(spark, sf), F.floor((F.col("day") - 1) / 6).cast("int"))
    out = H.fold_table(ev, "event_id", 5)
    return out.select(F.col("fold").cast("bigint").alias("fold"), "event_id", "role")
