"""The modelling frame shared by the selection and model-job queries: one
row per event with numeric features and the purchase label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.events import EV, events_df
from tessera.operators import group as G
from tessera.plans.fuse import apply_parts

FEATS = ["value", "hr", "k", "day", "user_n", "k_n", "value_sq"]

EVX = f"""(SELECT event_id, y, user_id, day AS day_i, CAST(value AS DOUBLE) AS value, CAST(hr AS DOUBLE) AS hr,
  CAST(k AS DOUBLE) AS k, CAST(day AS DOUBLE) AS day,
  CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS user_n, CAST(count(*) OVER (PARTITION BY k) AS DOUBLE) AS k_n,
  value * value AS value_sq, 1.0 AS one,
  1 / (1 + exp(-(value - 25) / 10)) AS p_a,
  1 / (1 + exp(-(count(*) OVER (PARTITION BY user_id) - 65) / 20)) AS p_b,
  1 / (1 + exp(-(hr - 12) / 6)) AS p_c
 FROM {EV} z)"""


def evx(spark, sf):
    ev = events_df(spark, sf)
    ev = apply_parts(ev, [G.count(["user_id"], name="_un"), G.count(["k"], name="_kn")])
    return ev.select(
        "event_id", "y", "user_id", F.col("day").alias("day_i"),
        F.col("value").cast("double").alias("value"), F.col("hr").cast("double").alias("hr"),
        F.col("k").cast("double").alias("k"), F.col("day").cast("double").alias("day"),
        F.col("_un").cast("double").alias("user_n"), F.col("_kn").cast("double").alias("k_n"),
        (F.col("value") * F.col("value")).alias("value_sq"), F.lit(1.0).alias("one"),
        (1 / (1 + F.exp(-(F.col("value") - 25) / 10))).alias("p_a"),
        (1 / (1 + F.exp(-(F.col("_un") - 65) / 20))).alias("p_b"),
        (1 / (1 + F.exp(-(F.col("hr") - 12) / 6))).alias("p_c"))
