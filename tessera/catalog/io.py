"""Registered scan / sink queries (S01-S06). Round trips write under the
session's shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog.events import EV, ORDER, events_df
from tessera.catalog.modeling import EVX, evx
from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import group as G
from tessera.operators import model as M
from tessera.operators import ordered as O
from tessera.plans.fuse import apply_parts
from tessera.sources import io as S


@register("S01_train_test_union", sql="""
SELECT event_id, user_id, event_type, value, CASE WHEN dayofmonth(ts) <= 24 THEN 'train' ELSE 'test' END AS split,
  CASE WHEN dayofmonth(ts) <= 24 THEN CAST(event_type = 'purchase' AS INTEGER) END AS y
FROM events""")
def s01(spark, sf):
    ev = table(spark, sf, "events")
    tr = ev.where(F.dayofmonth("ts") <= 24).select("event_id", "user_id", "event_type", "value",
                                                    (F.col("event_type") == "purchase").cast("int").alias("y"))
    te = ev.where(F.dayofmonth("ts") > 24).select("event_id", "user_id", "event_type", "value")
    return S.train_test(tr, te)


CSV_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
                           T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@register("S02_typed_csv_scan", sql="SELECT event_id, user_id, event_type, value FROM events")
def s02(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))
    path = S.write_csv(ev, S.shared_path(spark, "csv", uuid.uuid4().hex), quote='"', escape='"')
    return S.read_csv_typed(spark, path, CSV_SCHEMA, usecols=["event_id", "user_id", "event_type", "value"],
                            quote='"', escape='"')


@register("S03_feature_store_write", sql=f"""
SELECT event_id, count(*) OVER (PARTITION BY user_id) AS count__user_id,
  CASE WHEN day <= 24 THEN 'train' ELSE 'test' END AS split FROM {EV} e""")
def s03(spark, sf):
    ev = events_df(spark, sf).withColumn("split", F.when(F.col("day") <= 24, "train").otherwise("test"))
    feats = apply_parts(ev, [G.count(["user_id"])]).select("event_id", "count__user_id", "split")
    store = S.FeatureStore(spark)
    store.write("count_user", feats)
    return store.read("count_user").select("event_id", "count__user_id", "split")


@register("S04_feature_store_assemble", sql=f"""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS count__user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cum_count__user_id FROM {EV} e""")
def s04(spark, sf):
    ev = events_df(spark, sf)
    store = S.FeatureStore(spark)
    store.write("count_user", apply_parts(ev, [G.count(["user_id"])]).select("event_id", "count__user_id"))
    store.write("cum_user", O.cumulative_counts(ev, ["user_id"], ORDER).select("event_id", "cum_count__user_id"))
    base = ev.select("event_id", "user_id")
    return store.assemble(base, ["count_user", "cum_user"], "event_id")


@register("S05_external_feature_append", sql=f"""
SELECT e.event_id, e.value, RND(x.m) AS user_mean_value
FROM {EV} e JOIN (SELECT user_id, avg(value) AS m FROM {EV} a GROUP BY user_id) x USING (user_id)""")
def s05(spark, sf):
    ev = events_df(spark, sf)
    ext = ev.groupBy("user_id").agg(F.avg("value").alias("user_mean_value"))
    ext_rows = ev.select("event_id", "user_id").join(ext, "user_id").select("event_id", "user_mean_value")
    out = S.append_by_id(ev.select("event_id", "value"), ext_rows, "event_id")
    return out.select("event_id", "value", rnd("user_mean_value").alias("user_mean_value"))


@register("S06_metrics_append", sql=f"""
WITH r AS (SELECT y, p_a, p_b, rank() OVER (ORDER BY p_a) + (count(*) OVER (PARTITION BY p_a) - 1) / 2.0 AS ra,
                  rank() OVER (ORDER BY p_b) + (count(*) OVER (PARTITION BY p_b) - 1) / 2.0 AS rb FROM {EVX})
SELECT 'run_a' AS run, '{{"model": "p_a"}}' AS params, 'auc' AS metric,
  RND((sum(ra) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))) AS value FROM r
UNION ALL
SELECT 'run_b', '{{"model": "p_b"}}', 'auc',
  RND((sum(rb) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))) FROM r""")
def s06(spark, sf):
    d = evx(spark, sf)
    rows = [{"run": f"run_{m[-1]}", "params": {"model": m}, "metric": "auc",
             "value": M.auc(d, "y", m, "event_id")} for m in ("p_a", "p_b")]
    path = S.shared_path(spark, "reports", uuid.uuid4().hex)
    out = S.append_metrics(spark, path, rows)
    return out.select("run", "params", "metric", rnd("value").alias("value"))
