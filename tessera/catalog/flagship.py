"""Flagship query: counts by key set, position in
the user's history, time to the second next event and events in the previous
hour, over ``events`` keyed by ``user_id`` / (``user_id``, ``event_type``),
ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.events import EV, HOUR_US, ORDER, events_df
from tessera.catalog.registry import register
from tessera.functions.columns import rnd
from tessera.operators import group as G
from tessera.operators import ordered as O
from tessera.plans.feature_run import Run, build_features
from tessera.plans.fuse import apply_parts
from tessera.spec import FeatureSpec


def flagship(spark, sf):
    ev = events_df(spark, sf)
    base = apply_parts(ev, [G.count(["user_id"], "event_id"), G.count(["user_id", "event_type"], "event_id")])
    # T01 and T04 share the (user_id; ts, event_id) order: one positions pass
    ordf = O.ordered_features(base.select("event_id", "user_id", "event_type", "ts", "t_us", "count__user_id",
                                          "count__user_id_event_type"),
                              ["user_id"], ORDER, time=F.col("t_us"), nexts=[(2, -1_000_000)])
    hz = O.horizon_counts(ev.select("event_id", "user_id", "t_us"), ["user_id"], F.col("t_us"), "event_id",
                          HOUR_US, which=["prev"])
    return (ordf.select("event_id", "user_id", "event_type", "count__user_id", "count__user_id_event_type",
                        "cum_count__user_id",
                        rnd(F.col("time_to_2_next__user_id") / 1e6).alias("time_to_2_next__user_id"))
            .join(hz.select("event_id", f"count_prev_{HOUR_US}__user_id"), "event_id"))


register("FLAGSHIP_event_features", sql=f"""
SELECT e.event_id, e.user_id, e.event_type,
  count(e.event_id) OVER (PARTITION BY e.user_id) AS count__user_id,
  count(e.event_id) OVER (PARTITION BY e.user_id, e.event_type) AS count__user_id_event_type,
  row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) - 1 AS cum_count__user_id,
  RND(coalesce(lead(e.t_us, 2) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) - e.t_us, -1000000) / 1e6, 6)
    AS time_to_2_next__user_id,
  (SELECT count(*) FROM {EV} b WHERE b.user_id = e.user_id
     AND (b.ts < e.ts OR (b.ts = e.ts AND b.event_id < e.event_id)) AND b.t_us >= e.t_us - {HOUR_US})
    AS count_prev_{HOUR_US}__user_id
FROM {EV} e""", headline=True)(flagship)


def _mixed_specs():
    S = FeatureSpec.of
    return [S("count", ["user_id"]), S("count", ["user_id", "event_type"]), S("variance", ["event_type", "value"]),
            S("unique_count", ["user_id", "k"]), S("cumulative_count", ["user_id"]), S("reverse_cumulative_count", ["user_id"]),
            S("time_to_n_next", ["user_id"], {"n": 1, "fill": -1}), S("time_to_n_next", ["user_id"], {"n": -2}),
            S("running_mean", ["user_id", "y"]), S("count_in_previous", ["user_id"], {"n": HOUR_US}),
            S("count_in_next", ["user_id"], {"n": HOUR_US}), S("target_mean", ["k"]), S("woe", ["k"]), S("log_value", ["value"])]


_MIXED_SQL = f"""
WITH e AS (SELECT *, event_id % 3 AS fold FROM {EV}), u AS (SELECT user_id, count(DISTINCT k) AS u FROM e GROUP BY 1),
s AS (SELECT a.event_id, count(b.event_id) AS n, sum(b.y) AS y FROM e a JOIN e b ON a.k = b.k AND a.fold <> b.fold GROUP BY 1),
f AS (SELECT a.fold, count(*) AS n, sum(b.y) AS y FROM (SELECT DISTINCT fold FROM e) a JOIN e b ON a.fold <> b.fold GROUP BY 1),
h AS (SELECT a.event_id, count(*) FILTER (WHERE (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND b.t_us >= a.t_us - {HOUR_US}) AS p,
       count(*) FILTER (WHERE (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.t_us <= a.t_us + {HOUR_US}) AS q
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.t_us BETWEEN a.t_us - {HOUR_US} AND a.t_us + {HOUR_US} GROUP BY 1)
SELECT e.event_id, count(*) OVER (PARTITION BY e.user_id) AS count__user_id,
  count(*) OVER (PARTITION BY e.user_id, event_type) AS count__user_id_event_type,
  RND(coalesce(var_samp(value) OVER (PARTITION BY event_type), 0)) AS variance__event_type_value, u.u AS unique_count__user_id_k,
  row_number() OVER w - 1 AS cumulative_count__user_id,
  count(*) OVER (PARTITION BY e.user_id) - row_number() OVER w AS reverse_cumulative_count__user_id,
  coalesce(lead(t_us, 1) OVER w - t_us, -1) AS time_to_n_next__user_id__fill_m1_n_1,
  lag(t_us, 2) OVER w - t_us AS time_to_n_next__user_id__n_m2,
  RND((sum(e.y) OVER w - e.y) / nullif(row_number() OVER w - 1, 0)) AS running_mean__user_id_y,
  h.p AS count_in_previous__user_id__n_{HOUR_US}, h.q AS count_in_next__user_id__n_{HOUR_US},
  RND(s.y / s.n) AS target_mean__k, RND(ln(((s.y + 0.5) / (f.y + 0.5)) / ((s.n - s.y + 0.5) / (f.n - f.y + 0.5)))) AS woe__k,
  RND(ln(1 + value)) AS log_value__value
FROM e LEFT JOIN u USING (user_id) LEFT JOIN s USING (event_id) LEFT JOIN f USING (fold) LEFT JOIN h USING (event_id)
WINDOW w AS (PARTITION BY e.user_id ORDER BY ts, e.event_id)"""


@register("F15_mixed_feature_run", sql=_MIXED_SQL)
def mixed_run(spark, sf):
    """One list of group, ordered, horizon, target and user functions."""
    ev = events_df(spark, sf).withColumn("fold", (F.col("event_id") % 3).cast("int"))
    specs = _mixed_specs()
    own = {"log_value": ("row", lambda s, run: F.log1p(F.col(s.cols[0])))}
    out = build_features(ev, specs, Run("event_id", ("ts", "event_id"), "t_us", "y", "fold"), own)
    doubles = ("variance", "running_mean", "target_mean", "woe", "log_value")
    return out.select("event_id", *[rnd(s.feature_name).alias(s.feature_name) if s.function in doubles else F.col(s.feature_name)
                                    for s in specs])
