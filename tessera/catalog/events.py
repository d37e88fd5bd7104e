"""Registered queries over the ``events`` click log: group features (F*) and
ordered / event-time features (T01-T11).

Roles: row id ``event_id``; keys ``user_id``, ``event_type``, ``k`` (from the
JSON ``props``), ``day``; time ``ts`` with order ``(ts, event_id)``; label
``event_type = 'purchase'``. Time differences are in seconds, computed from
integer microseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import group as G
from tessera.operators import ordered as O
from tessera.plans.fuse import apply_parts
from tessera.plans.lattice import lattice_features
from tessera.spec import FeatureSpec

ORDER = ["ts", "event_id"]
HOUR_US = 3600 * 1_000_000
SHIFT_S = 1704067200.0  # 2024-01-01T00:00:00Z, subtracted before OLS for conditioning

# DuckDB view with the same derived columns as ``events_df``.
EV = """(SELECT *, CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INTEGER) AS k,
       CAST(dayofmonth(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hr,
       epoch_us(ts) AS t_us, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y
   FROM events)"""


def events_df(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "*",
        F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).cast("int").alias("k"),
        F.dayofmonth("ts").cast("int").alias("day"),
        F.hour("ts").cast("int").alias("hr"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.col("event_type") == "purchase").cast("int").alias("y"))


def _r(c):
    return rnd(c).alias(c)


def _cols(spark, sf, *cols):
    """The order columns and ``cols``: positions deal every column they get."""
    return events_df(spark, sf).select("event_id", "ts", *cols)


# ----------------------------------------------------------------- F01-F07
@register("F01_count", sql=f"""
SELECT event_id,
  count(event_id) OVER (PARTITION BY user_id) AS count__user_id,
  count(event_id) OVER (PARTITION BY user_id, event_type) AS count__user_id_event_type
FROM {EV} e""", headline=True)
def f01(spark, sf):
    ev = events_df(spark, sf)
    out = apply_parts(ev, [G.count(["user_id"], "event_id"), G.count(["user_id", "event_type"], "event_id")])
    return out.select("event_id", "count__user_id", "count__user_id_event_type")


@register("F02_unique_count", sql=f"""
WITH a AS (SELECT user_id, count(DISTINCT event_type) AS u1, count(DISTINCT k) AS u2 FROM {EV} x GROUP BY user_id)
SELECT e.event_id, a.u1 AS unique_count__user_id_event_type, a.u2 AS unique_count__user_id_k
FROM {EV} e JOIN a USING (user_id)""")
def f02(spark, sf):
    ev = events_df(spark, sf)
    out = apply_parts(ev, [G.unique_count(["user_id", "event_type"]), G.unique_count(["user_id", "k"])])
    return out.select("event_id", "unique_count__user_id_event_type", "unique_count__user_id_k")


@register("F03_unique_count_ratio", sql=f"""
WITH a AS (SELECT user_id, count(DISTINCT k) AS u, count(event_id) AS n FROM {EV} x GROUP BY user_id)
SELECT e.event_id, RND(a.u / a.n, 6) AS unique_count_ratio__user_id_k
FROM {EV} e JOIN a USING (user_id)""")
def f03(spark, sf):
    ev = events_df(spark, sf)
    out = apply_parts(ev, [G.unique_count_ratio(["user_id", "k"], "event_id")])
    return out.select("event_id", _r("unique_count_ratio__user_id_k"))


@register("F04_variance", sql=f"""
SELECT event_id,
  RND(coalesce(var_samp(value) OVER (PARTITION BY user_id), 0), 6) AS variance__user_id_value,
  RND(coalesce(var_samp(value) OVER (PARTITION BY user_id, event_type), 0), 6) AS variance__user_id_event_type_value
FROM {EV} e""", headline=True)
def f04(spark, sf):
    ev = events_df(spark, sf)
    out = apply_parts(ev, [G.variance(["user_id", "value"]), G.variance(["user_id", "event_type", "value"])])
    return out.select("event_id", _r("variance__user_id_value"), _r("variance__user_id_event_type_value"))


@register("F05_count_std_over_mean", sql=f"""
WITH c AS (SELECT user_id, event_type, count(event_id) AS c FROM {EV} x GROUP BY 1, 2),
     s AS (SELECT user_id, stddev_samp(c) AS s, avg(c) AS m FROM c GROUP BY 1)
SELECT e.event_id, RND(coalesce(100 * s.s / s.m, -1), 6) AS count_std_over_mean__user_id_event_type__coefficient_100
FROM {EV} e JOIN s USING (user_id)""")
def f05(spark, sf):
    ev = events_df(spark, sf)
    p = G.count_std_over_mean(ev, ["user_id", "event_type"], "event_id", coefficient="100")
    return apply_parts(ev, [p]).select("event_id", _r(p.name))


@register("F06_count_ratio_nested", sql=f"""
SELECT event_id, RND(count(*) OVER (PARTITION BY user_id, event_type) / count(*) OVER (PARTITION BY user_id), 6)
  AS count_ratio__user_id_event_type_by_user_id
FROM {EV} e""")
def f06(spark, sf):
    ev = events_df(spark, sf)
    parts = G.count_ratio(["user_id", "event_type"], ["user_id"])
    return apply_parts(ev, parts).select("event_id", _r(parts[-1].name))


@register("F07_count_ratio_pair", sql=f"""
SELECT event_id, RND(count(*) OVER (PARTITION BY k, hr) / count(*) OVER (PARTITION BY event_type, hr), 6)
  AS count_ratio__k_hr_by_event_type_hr
FROM {EV} e""")
def f07(spark, sf):
    ev = events_df(spark, sf)
    parts = G.count_ratio(["k", "hr"], ["event_type", "hr"])
    return apply_parts(ev, parts).select("event_id", _r(parts[-1].name))


# ----------------------------------------------------------------- F08-F10
# history = the first 15 days, scored rows = the rest
_HIST = f"(SELECT * FROM {EV} h WHERE day <= 15)"
_CUR = f"(SELECT * FROM {EV} c WHERE day > 15)"


def _split(spark, sf):
    ev = events_df(spark, sf)
    return ev.where("day <= 15"), ev.where("day > 15")


@register("F08_history_count", sql=f"""
WITH h AS (SELECT user_id, event_type, count(*) AS n FROM {_HIST} x GROUP BY 1, 2)
SELECT c.event_id, coalesce(h.n, 0) AS history_count__user_id_event_type
FROM {_CUR} c LEFT JOIN h USING (user_id, event_type)""")
def f08(spark, sf):
    hist, cur = _split(spark, sf)
    p = G.history_count(hist, ["user_id", "event_type"])
    return apply_parts(cur, [p]).select("event_id", p.name)


@register("F09_history_mean", sql=f"""
WITH h AS (SELECT user_id, avg(y) AS m FROM {_HIST} x GROUP BY 1)
SELECT c.event_id, RND(coalesce(h.m, -0.01), 6) AS history_mean__user_id_y
FROM {_CUR} c LEFT JOIN h USING (user_id)""")
def f09(spark, sf):
    hist, cur = _split(spark, sf)
    p = G.history_mean(hist, ["user_id"], "y")
    return apply_parts(cur, [p]).select("event_id", _r(p.name))


@register("F10_history_regression", sql=f"""
WITH h AS (SELECT user_id, regr_slope(y, t_us / 1e6 - {SHIFT_S}) AS b, regr_intercept(y, t_us / 1e6 - {SHIFT_S}) AS a
           FROM {_HIST} x GROUP BY 1)
SELECT c.event_id, RND(coalesce(h.a + h.b * (c.t_us / 1e6 - {SHIFT_S}), -0.5), 4) AS history_regression__user_id_y_ts
FROM {_CUR} c LEFT JOIN h USING (user_id)""")
def f10(spark, sf):
    hist, cur = _split(spark, sf)
    p = G.history_regression(hist, ["user_id"], "y", "ts", shift=SHIFT_S)
    # 4 places: OLS on epoch seconds loses a few digits in either engine
    return apply_parts(cur, [p]).select("event_id", rnd(p.name).alias(p.name))


# ----------------------------------------------------------------- F11-F14
@register("F11_first_last_diff", sql=f"""
SELECT event_id,
  RND((t_us - min(t_us) OVER (PARTITION BY user_id)) / 1e6, 6) AS first_last_diff__user_id_ts_from_first,
  RND((max(t_us) OVER (PARTITION BY user_id) - t_us) / 1e6, 6) AS first_last_diff__user_id_ts_to_last
FROM {EV} e""")
def f11(spark, sf):
    ev = events_df(spark, sf)
    parts = G.first_last_diff(["user_id"], "t_us", time_expr=lambda c: F.col(c))
    out = apply_parts(ev, parts)
    return out.select("event_id", *[rnd(F.col(p.name) / 1e6).alias(p.name.replace("t_us", "ts"))
                                    for p in parts])


@register("F12_group_relative", sql=f"""
SELECT event_id,
  RND(value - avg(value) OVER (PARTITION BY event_type), 6) AS diff_mean__event_type_value,
  RND(abs(value - avg(value) OVER (PARTITION BY event_type)), 6) AS diff_mean__event_type_value_abs
FROM {EV} e""")
def f12(spark, sf):
    ev = events_df(spark, sf)
    parts = G.group_relative(["event_type"], "value", "mean")
    return apply_parts(ev, parts).select("event_id", *[_r(p.name) for p in parts])


@register("F12_group_median", sql=f"""
SELECT event_id,
  RND(value - quantile_cont(value, 0.5) OVER (PARTITION BY event_type, hr), 6) AS diff_median__event_type_hr_value,
  RND(abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY event_type, hr)), 6) AS diff_median__event_type_hr_value_abs
FROM {EV} e""")
def f12_median(spark, sf):
    ev = events_df(spark, sf)
    parts = G.group_relative(["event_type", "hr"], "value", "median", df=ev)
    return apply_parts(ev, parts).select("event_id", *[_r(p.name) for p in parts])


_COMMON_SQL = f"""
days AS (SELECT day, count(*) AS n FROM {EV} x GROUP BY day),
b AS (SELECT min(day) + CASE WHEN arg_min(n, day) < 300 THEN 1 ELSE 0 END AS lo,
             max(day) - CASE WHEN arg_max(n, day) < 300 THEN 1 ELSE 0 END AS hi FROM days),
common AS (SELECT e.k FROM {EV} e, b WHERE e.day BETWEEN b.lo AND b.hi
           GROUP BY e.k, b.lo, b.hi HAVING count(DISTINCT e.day) = b.hi - b.lo + 1)"""


@register("F13_common_key", sql=f"""
WITH {_COMMON_SQL}
SELECT e.event_id, CASE WHEN c.k IS NOT NULL THEN e.k + 1 ELSE 0 END AS com__k
FROM {EV} e LEFT JOIN common c USING (k)""")
def f13(spark, sf):
    ev = events_df(spark, sf)
    p = G.common_key_flag(ev, "k", "day", min_rows=300)
    return apply_parts(ev, [p]).select("event_id", F.col(p.name).cast("bigint").alias(p.name))


@register("F14_stable_key", sql=f"""
WITH {_COMMON_SQL},
daily AS (SELECT e.k, e.day, count(e.event_id) AS c FROM {EV} e JOIN common USING (k) GROUP BY 1, 2),
st AS (SELECT k, 100 * stddev_samp(c) / avg(c) <= 60 AS f FROM daily GROUP BY k)
SELECT e.event_id, CASE WHEN st.f THEN e.k + 1 ELSE 0 END AS com__k__t_60
FROM {EV} e LEFT JOIN st USING (k)""")
def f14(spark, sf):
    ev = events_df(spark, sf)
    p = G.stable_key_flag(ev, "k", "day", threshold=60, min_rows=300, dummy="event_id")
    return apply_parts(ev, [p]).select("event_id", F.col(p.name).cast("bigint").alias(p.name))


# ---------------------------------------------------------------------- F15
_F15_COLS = ["user_id", "event_type", "k", "hr"]


def _f15_specs():
    return G.combination_specs(_F15_COLS, [1, 2], ["count", "variance"], value_col="value",
                               params=None)


def _f15_sql():
    sel = []
    for s in _f15_specs():
        if s.function == "count":
            keys = ", ".join(s.cols)
            sel.append(f"count(*) OVER (PARTITION BY {keys}) AS {s.feature_name}")
        else:
            keys = ", ".join(s.cols[:-1])
            sel.append(f"RND(coalesce(var_samp({s.cols[-1]}) OVER (PARTITION BY {keys}), 0), 6) AS {s.feature_name}")
    return f"SELECT event_id, {', '.join(sel)} FROM {EV} e"


@register("F15_key_combinations", sql=_f15_sql(), headline=True)
def f15(spark, sf):
    ev = events_df(spark, sf)
    specs = _f15_specs()
    out = G.build_group_features(ev, specs)
    return out.select("event_id", *[F.col(s.feature_name) if s.function == "count" else _r(s.feature_name)
                                    for s in specs])


def _f15_lattice_specs():
    return (G.combination_specs(_F15_COLS, [1, 2, 3], ["count", "variance"], value_col="value")
            + [FeatureSpec.of("unique_count", ["user_id", "k"]), FeatureSpec.of("count_ratio", ["user_id", "k"])])


def _f15_lattice_sql():
    sel = []
    for s in _f15_lattice_specs():
        keys, v = ", ".join(s.cols[:-1]), s.cols[-1]
        sel.append({
            "count": lambda: f"count(*) OVER (PARTITION BY {', '.join(s.cols)})",
            "variance": lambda: f"RND(coalesce(var_samp({v}) OVER (PARTITION BY {keys}), 0), 6)",
            "unique_count": lambda: f"(SELECT count(DISTINCT {v}) FROM {EV} u WHERE u.{keys} = e.{keys})",
            "count_ratio": lambda: f"RND(count(*) OVER (PARTITION BY {keys}, {v}) / count(*) OVER (PARTITION BY {keys}))",
        }[s.function]() + f" AS {s.feature_name}")
    return f"SELECT event_id, {', '.join(sel)} FROM {EV} e"


@register("F15_aggregate_lattice", sql=_f15_lattice_sql())
def f15_lattice(spark, sf):
    """All combinations up to three columns: only the triples are aggregated
    from the rows, the rest is derived."""
    ev = events_df(spark, sf)
    specs = _f15_lattice_specs()
    out = lattice_features(ev, specs)
    return out.select("event_id", *[_r(s.feature_name) if s.function in ("variance", "count_ratio") else F.col(s.feature_name)
                                    for s in specs])


# ----------------------------------------------------------------- T01-T03
@register("T01_cumulative_count", sql=f"""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cum_count__user_id
FROM {EV} e""", headline=True)
def t01(spark, sf):
    out = O.cumulative_counts(_cols(spark, sf, "user_id"), ["user_id"], ORDER)
    return out.select("event_id", "cum_count__user_id")


@register("T02_reverse_cumulative_count", sql=f"""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) - 1
  AS rev_cum_count__user_id_event_type
FROM {EV} e""")
def t02(spark, sf):
    out = O.cumulative_counts(_cols(spark, sf, "user_id", "event_type"), ["user_id", "event_type"], ORDER)
    return out.select("event_id", "rev_cum_count__user_id_event_type")


@register("T03_cum_count_ratio", sql=f"""
SELECT event_id, CASE WHEN count(*) OVER p = 1 THEN 1.1
  ELSE round((row_number() OVER w - 1) / (count(*) OVER p - 1), 4) END AS cum_count_ratio__user_id_k
FROM {EV} e
WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id), p AS (PARTITION BY user_id, k)""")
def t03(spark, sf):
    out = O.cumulative_counts(_cols(spark, sf, "user_id", "k"), ["user_id", "k"], ORDER)
    return out.select("event_id", "cum_count_ratio__user_id_k")


# ----------------------------------------------------------------- T04-T07
def _sec(c):
    return rnd(F.col(c) / 1e6).alias(c)


@register("T04_time_to_n_next", sql=f"""
SELECT event_id, RND(coalesce(lead(t_us, 2) OVER w - t_us, -1000000) / 1e6, 6) AS time_to_2_next__user_id
FROM {EV} e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", headline=True)
def t04(spark, sf):
    out = O.time_to_n_next(_cols(spark, sf, "user_id", "t_us"), ["user_id"], ORDER, F.col("t_us"), n=2, fill=-1_000_000)
    return out.select("event_id", _sec("time_to_2_next__user_id"))


@register("T05_time_to_n_previous", sql=f"""
SELECT event_id, RND((lag(t_us, 1) OVER w - t_us) / 1e6, 6) AS time_to_1_previous__user_id_event_type
FROM {EV} e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def t05(spark, sf):
    out = O.time_to_n_next(_cols(spark, sf, "user_id", "event_type", "t_us"), ["user_id", "event_type"], ORDER, F.col("t_us"), n=-1,
                           name="time_to_1_previous__user_id_event_type")
    return out.select("event_id", _sec("time_to_1_previous__user_id_event_type"))


@register("T06_click_next", sql=f"""
SELECT event_id, coalesce(RND((lead(t_us, 1) OVER w - t_us + 1000000) / 1e6), 999999) AS next_click__user_id_day
FROM {EV} e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)""")
def t06(spark, sf):
    # lead(t) - t + 1 second, in integer microseconds until the last step
    out = O.time_to_n_next(_cols(spark, sf, "user_id", "day", "t_us"), ["user_id", "day"], ORDER, F.col("t_us"), n=1, plus=1_000_000,
                           name="next_click__user_id_day")
    return out.select("event_id", F.coalesce(rnd(F.col("next_click__user_id_day") / 1e6), F.lit(999999.0))
                      .alias("next_click__user_id_day"))


@register("T07_gaps", sql=f"""
SELECT event_id,
  RND(coalesce(lead(t_us) OVER w - t_us, -1000000) / 1e6, 6) AS gap_next__user_id_event_type,
  RND(coalesce(t_us - lag(t_us) OVER w, -1000000) / 1e6, 6) AS gap_prev__user_id_event_type
FROM {EV} e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def t07(spark, sf):
    out = O.gaps(_cols(spark, sf, "user_id", "event_type", "t_us"), ["user_id", "event_type"], ORDER, F.col("t_us"), missing=-1_000_000)
    return out.select("event_id", _sec("gap_next__user_id_event_type"), _sec("gap_prev__user_id_event_type"))


# ----------------------------------------------------------------- T08-T10
@register("T08_count_in_previous_n_time_unit", sql=f"""
SELECT a.event_id, count(b.event_id) AS count_prev_{HOUR_US}__user_id
FROM {EV} a LEFT JOIN {EV} b
  ON a.user_id = b.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))
 AND b.t_us >= a.t_us - {HOUR_US}
GROUP BY a.event_id""", headline=True)
def t08(spark, sf):
    out = O.horizon_counts(_cols(spark, sf, "user_id", "t_us"), ["user_id"], F.col("t_us"), "event_id", HOUR_US, which=["prev"])
    return out.select("event_id", f"count_prev_{HOUR_US}__user_id")


@register("T09_count_in_next_n_time_unit", sql=f"""
SELECT a.event_id, count(b.event_id) AS count_next_{HOUR_US}__user_id
FROM {EV} a LEFT JOIN {EV} b
  ON a.user_id = b.user_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id))
 AND b.t_us <= a.t_us + {HOUR_US}
GROUP BY a.event_id""")
def t09(spark, sf):
    out = O.horizon_counts(_cols(spark, sf, "user_id", "t_us"), ["user_id"], F.col("t_us"), "event_id", HOUR_US, which=["next"])
    return out.select("event_id", f"count_next_{HOUR_US}__user_id")


@register("T10_count_in_next_hours_self", sql=f"""
SELECT a.event_id, count(b.event_id) AS count_window_{6 * HOUR_US}__user_id
FROM {EV} a LEFT JOIN {EV} b
  ON a.user_id = b.user_id AND b.t_us >= a.t_us AND b.t_us <= a.t_us + {6 * HOUR_US}
GROUP BY a.event_id""")
def t10(spark, sf):
    out = O.horizon_counts(_cols(spark, sf, "user_id", "t_us"), ["user_id"], F.col("t_us"), "event_id", 6 * HOUR_US,
                           which=["window"])
    return out.select("event_id", f"count_window_{6 * HOUR_US}__user_id")


# ---------------------------------------------------------------------- T11
@register("T11_running_label_mean", sql=f"""
SELECT event_id,
  RND(avg(y) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
    AS running_mean_y__user_id,
  RND(avg(y) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6)
    AS running_mean_strict_y__user_id
FROM {EV} e""")
def t11(spark, sf):
    ev = _cols(spark, sf, "user_id", "y")
    out = O.running_mean(ev, ["user_id"], ORDER, "y", strict_name="running_mean_strict_y__user_id")
    return out.select("event_id", _r("running_mean_y__user_id"), _r("running_mean_strict_y__user_id"))


# ------------------------------------------------------- F15 time horizons
F15_HORIZONS_US = [300 * 1_000_000, 1800 * 1_000_000, 3600 * 1_000_000]   # 5 min, 30 min, 1 h
F15_TIME_KEYS = [["user_id"], ["user_id", "event_type"]]


def _f15_time_sql():
    ctes, sel = [], []
    for i, keys in enumerate(F15_TIME_KEYS):
        on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
        name = "_".join(keys)
        hmax = max(F15_HORIZONS_US)
        cnt = ", ".join(f"count(b.event_id) FILTER (WHERE b.t_us >= a.t_us - {h}) AS count_prev_{h}__{name}"
                        for h in F15_HORIZONS_US)
        ctes.append(f"""c{i} AS (SELECT a.event_id, {cnt} FROM {EV} a LEFT JOIN {EV} b
  ON {on} AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND b.t_us >= a.t_us - {hmax}
  GROUP BY a.event_id)""")
        sel += [f"c{i}.count_prev_{h}__{name}" for h in F15_HORIZONS_US]
    joins = " ".join(f"JOIN c{i} USING (event_id)" for i in range(1, len(F15_TIME_KEYS)))
    return f"WITH {', '.join(ctes)} SELECT c0.event_id, {', '.join(sel)} FROM c0 {joins}"


@register("F15_time_horizon_combinations", sql=_f15_time_sql())
def f15t(spark, sf):
    """F15 time functions: previous-window counts for every key set and
    every horizon; all horizons of a key set share one positions pass."""
    ev = events_df(spark, sf).select("event_id", "user_id", "event_type", "t_us")
    out = ev.select("event_id")
    for keys in F15_TIME_KEYS:
        h = O.horizon_counts(ev, keys, F.col("t_us"), "event_id", which=["prev"], ns=F15_HORIZONS_US)
        cols = [f"count_prev_{x}__{'_'.join(keys)}" for x in F15_HORIZONS_US]
        out = out.join(h.select("event_id", *cols), "event_id")
    return out
