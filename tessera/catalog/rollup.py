"""Registered roll-up queries over customer <- orders <- lineitem:
G01-G14 and the history features T12-T17 (latest orders of a customer).

Recency order of a customer's orders is ``(o_orderdate, o_orderkey)``;
position 0 is the latest order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import ordered as O
from tessera.operators import rollup as R
from tessera.plans.quantiles import group_quantiles

OORDER = ["o_orderdate", "o_orderkey"]


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def _round_doubles(df, keep=()):
    """r6 on every double column (same rounding as the oracle SQL)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in keep:
            out.append(rnd(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --------------------------------------------------------------------- G01
G01_PAIRS = [("o_totalprice", "mean"), ("o_totalprice", "max"), ("o_totalprice", "min"),
             ("o_totalprice", "sum"), ("o_totalprice", "var"), ("o_orderkey", "count"),
             ("o_orderkey", "size"), ("o_orderpriority", "nunique")]
_G01_SQLAGG = {"mean": "avg({c})", "max": "max({c})", "min": "min({c})", "sum": "coalesce(sum({c}), 0)",
               "var": "var_samp({c})", "count": "count({c})", "size": "count(*)", "nunique": "count(DISTINCT {c})"}


def _g01_sql():
    o = ", ".join(f"{_G01_SQLAGG[a].format(c=c)} AS o_custkey_{a}_{c}" for c, a in G01_PAIRS)
    dbl = {"mean", "max", "min", "sum", "var"}
    sel = ", ".join(f"RND(o.o_custkey_{a}_{c}, 6) AS o_custkey_{a}_{c}" if a in dbl else f"o.o_custkey_{a}_{c}"
                    for c, a in G01_PAIRS)
    return f"""
WITH o AS (SELECT o_custkey, {o} FROM orders GROUP BY o_custkey),
s AS (SELECT c_mktsegment, avg(c_acctbal) AS c_mktsegment_mean_c_acctbal FROM customer GROUP BY 1),
s2 AS (SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS c_mktsegment_c_nationkey_max_c_acctbal
       FROM customer GROUP BY 1, 2)
SELECT c.c_custkey, {sel}, RND(s.c_mktsegment_mean_c_acctbal, 6) AS c_mktsegment_mean_c_acctbal,
  RND(s2.c_mktsegment_c_nationkey_max_c_acctbal, 6) AS c_mktsegment_c_nationkey_max_c_acctbal
FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey
LEFT JOIN s USING (c_mktsegment) LEFT JOIN s2 USING (c_mktsegment, c_nationkey)"""


@register("G01_recipe_aggregation", sql=_g01_sql(), headline=True)
def g01(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    child = R.recipe_aggregate(orders, [(["o_custkey"], G01_PAIRS)])
    own = R.recipe_aggregate(customer, [(["c_mktsegment"], [("c_acctbal", "mean")]),
                                        (["c_mktsegment", "c_nationkey"], [("c_acctbal", "max")])])
    out = R.attach(customer, [(child[("o_custkey",)], {"o_custkey": "c_custkey"}),
                              (own[("c_mktsegment",)], {"c_mktsegment": "c_mktsegment"}),
                              (own[("c_mktsegment", "c_nationkey")],
                               {"c_mktsegment": "c_mktsegment", "c_nationkey": "c_nationkey"})])
    cols = ["c_custkey"] + [f"o_custkey_{a}_{c}" for c, a in G01_PAIRS] + [
        "c_mktsegment_mean_c_acctbal", "c_mktsegment_c_nationkey_max_c_acctbal"]
    return _round_doubles(out.select(*cols))


# --------------------------------------------------------------------- G02
G02_SPEC = {"l_quantity": ["mean", "max", "sum"], "l_extendedprice": ["mean", "var"], "l_discount": ["min", "max"]}
_SQLAGG = {"mean": "avg({c})", "max": "max({c})", "min": "min({c})", "sum": "coalesce(sum({c}), 0)",
           "var": "var_samp({c})", "std": "stddev_samp({c})", "count": "count({c})"}


@register("G02_dict_aggregation", sql="""
WITH a AS (SELECT l_orderkey, """ + ", ".join(
    f"RND({_SQLAGG[a].format(c=c)}, 6) AS LI_{c}_{a.upper()}" for c, aa in G02_SPEC.items() for a in aa) + """,
  count(*) AS LI_COUNT FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, a.* EXCLUDE (l_orderkey) FROM orders o LEFT JOIN a ON a.l_orderkey = o.o_orderkey""")
def g02(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    agg = R.dict_aggregate(lineitem, "l_orderkey", G02_SPEC, prefix="LI_")
    out = R.attach(orders.select("o_orderkey"), [(agg, {"l_orderkey": "o_orderkey"})])
    return _round_doubles(out)


# --------------------------------------------------------------------- G03
G03_SPEC = {"l_extendedprice": ["mean", "sum"], "l_quantity": ["max"]}
G03_SUBSETS = {"RET_": "l_returnflag = 'R'", "OPEN_": "l_linestatus = 'O'"}


def _g03_sql():
    sel = []
    for p, cond in G03_SUBSETS.items():
        for c, aa in G03_SPEC.items():
            for a in aa:
                e = _SQLAGG[a].format(c=c)
                sel.append(f"RND(CASE WHEN count(*) FILTER (WHERE {cond}) > 0 THEN "
                           f"{e.replace('(' + c + ')', '(' + c + ') FILTER (WHERE ' + cond + ')')} END, 6) "
                           f"AS {p}{c}_{a.upper()}")
    return f"SELECT l_orderkey, {', '.join(sel)} FROM lineitem GROUP BY l_orderkey"


@register("G03_conditional_rollup", sql=_g03_sql())
def g03(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    subsets = {p: F.expr(c) for p, c in G03_SUBSETS.items()}
    return _round_doubles(R.conditional_aggregates(lineitem, "l_orderkey", G03_SPEC, subsets))


# --------------------------------------------------------------------- G04
@register("G04_two_level_rollup", sql="""
WITH l AS (SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS l_quantity_SUM, avg(l_extendedprice) AS l_extendedprice_MEAN,
                  count(*) AS COUNT FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o.o_custkey, l.* FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey)
SELECT o_custkey,
  RND(avg(l_quantity_SUM), 6) AS L2_l_quantity_SUM_MEAN, RND(max(l_quantity_SUM), 6) AS L2_l_quantity_SUM_MAX,
  RND(avg(l_extendedprice_MEAN), 6) AS L2_l_extendedprice_MEAN_MEAN,
  RND(max(l_extendedprice_MEAN), 6) AS L2_l_extendedprice_MEAN_MAX,
  RND(avg(COUNT), 6) AS L2_COUNT_MEAN, max(COUNT) AS L2_COUNT_MAX
FROM o GROUP BY o_custkey""")
def g04(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    out = R.two_level(lineitem, "l_orderkey", orders, "o_orderkey", "o_custkey",
                      {"l_quantity": ["sum"], "l_extendedprice": ["mean"]}, ["mean", "max"], prefix="L2_")
    return _round_doubles(out)


# --------------------------------------------------------------------- G05
@register("G05_category_share", sql="""
SELECT o_custkey,
  RND(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END), 6) AS "o_orderpriority_1-URGENT_MEAN",
  RND(avg(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END), 6) AS "o_orderpriority_2-HIGH_MEAN",
  RND(avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END), 6) AS "o_orderpriority_3-MEDIUM_MEAN",
  RND(avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END), 6) AS "o_orderpriority_4-NOT SPECIFIED_MEAN",
  RND(avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END), 6) AS "o_orderpriority_5-LOW_MEAN",
  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS o_orderstatus_F_SUM,
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o_orderstatus_O_SUM,
  sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS o_orderstatus_P_SUM
FROM orders GROUP BY o_custkey""")
def g05(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    pri = R.distinct_values(orders, "o_orderpriority")
    st = R.distinct_values(orders, "o_orderstatus")
    a = R.category_shares(orders, "o_custkey", "o_orderpriority", pri, how="mean")
    b = R.category_shares(orders, "o_custkey", "o_orderstatus", st, how="sum")
    out = a.join(b, "o_custkey")
    return _round_doubles(out.select("o_custkey", *[F.col(f"`{c}`").cast("bigint").alias(c) if c.endswith("_SUM")
                                                    else F.col(f"`{c}`") for c in out.columns[1:]]))


# --------------------------------------------------------------------- G06
@register("G06_span_and_positive_counts", sql="""
SELECT l_orderkey,
  CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS BIGINT) AS ship_span_days,
  count(*) FILTER (WHERE l_tax > 0) AS n_pos_l_tax,
  RND(coalesce(sum(l_quantity), 0), 6) AS sum_l_quantity,
  RND(max(l_discount) - min(l_discount), 6) AS span_l_discount
FROM lineitem GROUP BY l_orderkey""")
def g06(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    out = lineitem.groupBy("l_orderkey").agg(
        F.date_diff(F.max("l_shipdate"), F.min("l_shipdate")).cast("bigint").alias("ship_span_days"),
        R.agg_expr("n_pos", F.col("l_tax")).alias("n_pos_l_tax"),
        R.agg_expr("sum", F.col("l_quantity")).alias("sum_l_quantity"),
        R.agg_expr("span", F.col("l_discount")).alias("span_l_discount"))
    return _round_doubles(out)


# --------------------------------------------------------------------- G07
@register("G07_distinct_set_string", sql="""
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(coalesce(CAST(o_orderstatus AS VARCHAR), 'nan')))), '_')
  AS o_orderstatus_set
FROM orders GROUP BY o_custkey""")
def g07(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    return R.distinct_set_string(orders, "o_custkey", "o_orderstatus")


# --------------------------------------------------------------------- G08
# Fixed points per return flag (our stand-in for a bureau status scale).
G08_POINTS = {"R": 2.0, "A": 1.0, "N": 0.0}


@register("G08_status_risk_score", sql="""
WITH l AS (SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 1.0 ELSE 0.0 END) AS s
           FROM lineitem GROUP BY l_orderkey)
SELECT o.o_custkey, RND(max(l.s), 6) AS status_score_max, RND(avg(l.s), 6) AS status_score_mean
FROM orders o JOIN l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""")
def g08(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    out = R.status_score(lineitem, "l_orderkey", orders, "o_orderkey", "o_custkey", "l_returnflag", G08_POINTS)
    return _round_doubles(out)


# --------------------------------------------------------------------- G09
@register("G09_status_presence_flags", sql="""
SELECT o_custkey,
  max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS o_orderstatus_F,
  max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o_orderstatus_O,
  max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS o_orderstatus_P,
  count(*) AS o_orderstatus_len
FROM orders GROUP BY o_custkey""")
def g09(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    return R.status_flags(orders, "o_custkey", "o_orderstatus", R.distinct_values(orders, "o_orderstatus"))


# --------------------------------------------------------------------- G10
G10_STATS = ["mean", "max", "min", "std"]
G10_VALUES = ["n_late", "late_rate", "n_short", "short_rate", "owed", "remaining", "n_remaining"]


def g10_per_order(orders, lineitem):
    """Per order: late lines (shipped > 90 days after the order), short lines
    (discount > 6 %), their rates, amount owed, open amount and open lines."""
    li = lineitem.join(orders.select("o_orderkey", "o_orderdate"), lineitem.l_orderkey == orders.o_orderkey)
    late = (F.date_diff("l_shipdate", "o_orderdate") > 90).cast("int")
    short = (F.col("l_discount") > 0.06).cast("int")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    is_open = F.col("l_linestatus") == "O"
    return li.groupBy("l_orderkey").agg(
        F.sum(late).cast("double").alias("n_late"), F.avg(late).alias("late_rate"),
        F.sum(short).cast("double").alias("n_short"), F.avg(short).alias("short_rate"),
        F.sum(net).alias("owed"), F.coalesce(F.sum(F.when(is_open, net)), F.lit(0.0)).alias("remaining"),
        F.count_if(is_open).cast("double").alias("n_remaining"))


def _g10_sql():
    stats = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}
    sel = [f"RND({fn}({v}), 6) AS {v}_{s.upper()}" for v in G10_VALUES for s, fn in stats.items()]
    sel += [f"RND(arg_max({v}, (o_orderdate, o_orderkey)), 6) AS {v}_LAST" for v in G10_VALUES]
    return f"""
WITH li AS (SELECT l.*, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
po AS (SELECT l_orderkey,
  CAST(sum(CASE WHEN date_diff('day', o_orderdate, l_shipdate) > 90 THEN 1 ELSE 0 END) AS DOUBLE) AS n_late,
  avg(CASE WHEN date_diff('day', o_orderdate, l_shipdate) > 90 THEN 1 ELSE 0 END) AS late_rate,
  CAST(sum(CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END) AS DOUBLE) AS n_short,
  avg(CASE WHEN l_discount > 0.06 THEN 1 ELSE 0 END) AS short_rate,
  sum(l_extendedprice * (1 - l_discount)) AS owed,
  coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE l_linestatus = 'O'), 0) AS remaining,
  CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS n_remaining
  FROM li GROUP BY l_orderkey),
x AS (SELECT o.o_custkey, o.o_orderdate, o.o_orderkey, po.* EXCLUDE (l_orderkey)
      FROM orders o JOIN po ON po.l_orderkey = o.o_orderkey)
SELECT o_custkey, {', '.join(sel)} FROM x GROUP BY o_custkey"""


@register("G10_payment_behaviour", sql=_g10_sql())
def g10(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    po = g10_per_order(orders, lineitem)
    x = orders.select("o_custkey", "o_orderdate", "o_orderkey").join(
        po.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    recency = F.struct("o_orderdate", "o_orderkey")
    exprs = [R.agg_expr(s, F.col(v)).alias(f"{v}_{s.upper()}") for v in G10_VALUES for s in G10_STATS]
    exprs += [F.max_by(v, recency).alias(f"{v}_LAST") for v in G10_VALUES]
    return _round_doubles(x.groupBy("o_custkey").agg(*exprs))


# --------------------------------------------------------------------- G11
@register("G11_portfolio_ratios", sql="""
WITH a AS (SELECT o_custkey, count(*) AS n_orders, count(DISTINCT o_orderpriority) AS n_types,
  sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open_total, sum(o_totalprice) AS total,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open
  FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, a.n_orders, a.n_types, RND(a.n_orders / a.n_types, 6) AS orders_per_type,
  RND(coalesce(a.open_total, 0) / a.total, 6) AS open_share_amount,
  RND(a.n_open / a.n_orders, 6) AS open_share_count,
  RND(CASE WHEN c.c_acctbal = 0 THEN NULL ELSE a.total / c.c_acctbal END, 6) AS total_over_balance
FROM customer c LEFT JOIN a ON a.o_custkey = c.c_custkey""")
def g11(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    a = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_orderpriority").alias("n_types"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), F.lit(0.0)).alias("open_total"),
        F.sum("o_totalprice").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    j = customer.join(a, customer.c_custkey == a.o_custkey, "left")
    out = j.select("c_custkey", "n_orders", "n_types",
                   F.try_divide("n_orders", "n_types").alias("orders_per_type"),
                   F.try_divide("open_total", "total").alias("open_share_amount"),
                   F.try_divide("n_open", "n_orders").alias("open_share_count"),
                   F.try_divide("total", "c_acctbal").alias("total_over_balance"))
    return _round_doubles(out)


# --------------------------------------------------------------------- G12
@register("G12_moment_set", sql="""
WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mu, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT o.o_custkey, avg(power(o.o_totalprice - m.mu, 2)) AS m2, avg(power(o.o_totalprice - m.mu, 3)) AS m3,
             avg(power(o.o_totalprice - m.mu, 4)) AS m4, any_value(m.n) AS n,
             quantile_cont(o.o_totalprice, 0.5) AS med,
             quantile_cont(o.o_totalprice, 0.75) - quantile_cont(o.o_totalprice, 0.25) AS iqr
      FROM orders o JOIN m USING (o_custkey) GROUP BY 1)
SELECT o_custkey,
  RND(CASE WHEN m2 = 0 THEN 0 WHEN n >= 3 THEN m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) END, 4)
    AS o_totalprice_skew,
  RND(CASE WHEN m2 = 0 THEN NULL ELSE m4 / (m2 * m2) - 3 END, 4) AS o_totalprice_kurt_pop,
  RND(iqr, 6) AS o_totalprice_iqr, RND(med, 6) AS o_totalprice_median
FROM c""")
def g12(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    x = F.col("o_totalprice")
    moments = orders.groupBy("o_custkey").agg(
        R.agg_expr("skew", x).alias("o_totalprice_skew"), R.agg_expr("kurt_pop", x).alias("o_totalprice_kurt_pop"))
    # exact quantiles by rank: a customer with a huge history never sits in one buffer
    q = group_quantiles(orders, ["o_custkey"], "o_totalprice", "o_orderkey", [0.25, 0.5, 0.75],
                        names=["_q25", "_q50", "_q75"])
    out = moments.join(q, "o_custkey", "left").select(
        "o_custkey", "o_totalprice_skew", "o_totalprice_kurt_pop",
        (F.col("_q75") - F.col("_q25")).alias("o_totalprice_iqr"), F.col("_q50").alias("o_totalprice_median"))
    # shape statistics: 4 places (ratios of large central moments)
    return out.select("o_custkey", rnd("o_totalprice_skew").alias("o_totalprice_skew"),
                      rnd("o_totalprice_kurt_pop").alias("o_totalprice_kurt_pop"),
                      rnd("o_totalprice_iqr").alias("o_totalprice_iqr"),
                      rnd("o_totalprice_median").alias("o_totalprice_median"))


# --------------------------------------------------------------------- G13
@register("G13_child_to_parent_map", sql="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, m.o_custkey
FROM lineitem l LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) m ON m.o_orderkey = l.l_orderkey""")
def g13(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    out = R.map_to_parent(lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey",
                          orders, "o_orderkey", "o_custkey", validate=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


# --------------------------------------------------------------------- G14
@register("G14_history_coverage", sql="""
WITH t AS (SELECT DISTINCT c_custkey FROM customer),
o AS (SELECT DISTINCT o_custkey AS k FROM orders),
u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT DISTINCT o.o_custkey AS k FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
      WHERE li.l_returnflag = 'R'),
r AS (SELECT 'orders' AS "table", count(*) AS found FROM t WHERE c_custkey IN (SELECT k FROM o)
      UNION ALL SELECT 'urgent_orders', count(*) FROM t WHERE c_custkey IN (SELECT k FROM u)
      UNION ALL SELECT 'returned_lines', count(*) FROM t WHERE c_custkey IN (SELECT k FROM l)
      UNION ALL SELECT 'none', count(*) FROM t WHERE c_custkey NOT IN (SELECT k FROM o)
        AND c_custkey NOT IN (SELECT k FROM u) AND c_custkey NOT IN (SELECT k FROM l))
SELECT "table", CAST(found AS BIGINT) AS found, RND(found / (SELECT count(*) FROM t), 6) AS share FROM r""")
def g14(spark, sf):
    customer, orders, lineitem = _t(spark, sf, "customer", "orders", "lineitem")
    ret = lineitem.where("l_returnflag = 'R'").join(orders, lineitem.l_orderkey == orders.o_orderkey)
    out = R.coverage_report(customer, "c_custkey", {
        "orders": (orders, "o_custkey"),
        "urgent_orders": (orders.where("o_orderpriority = '1-URGENT'"), "o_custkey"),
        "returned_lines": (ret, "o_custkey")})
    return _round_doubles(out)


# ------------------------------------------------------------ T12-T15
T12_KS = [1, 5, None]
T12_AGGS = ["sum", "mean", "max", "min", "std", "median", "skew", "kurt", "iqr", "count"]


def _lastk_sql(ks, aggs, value="o_totalprice", prefix=""):
    """Oracle: latest-K aggregates with FILTER, central moments for skew /
    kurtosis (population forms, as scipy)."""
    filt = {k: ("TRUE" if k is None else f"rn <= {k}") for k in ks}
    tag = {k: ("all" if k is None else f"last{k}") for k in ks}
    mus = ", ".join(f"avg({value}) FILTER (WHERE {filt[k]}) AS mu_{tag[k]}" for k in ks)
    sel = []
    for k in ks:
        f, t = filt[k], tag[k]
        dev = f"({value} - mu_{t})"
        m2 = f"avg(power({dev}, 2)) FILTER (WHERE {f})"
        m3 = f"avg(power({dev}, 3)) FILTER (WHERE {f})"
        m4 = f"avg(power({dev}, 4)) FILTER (WHERE {f})"
        e = {
            "sum": f"sum({value}) FILTER (WHERE {f})",
            "mean": f"avg({value}) FILTER (WHERE {f})",
            "max": f"max({value}) FILTER (WHERE {f})",
            "min": f"min({value}) FILTER (WHERE {f})",
            "std": f"stddev_samp({value}) FILTER (WHERE {f})",
            "median": f"quantile_cont({value}, 0.5) FILTER (WHERE {f})",
            "skew": f"CASE WHEN {m2} = 0 THEN NULL ELSE {m3} / power({m2}, 1.5) END",
            "kurt": f"CASE WHEN {m2} = 0 THEN NULL ELSE {m4} / power({m2}, 2) - 3 END",
            "iqr": f"quantile_cont({value}, 0.75) FILTER (WHERE {f}) - quantile_cont({value}, 0.25) FILTER (WHERE {f})",
            "count": f"count({value}) FILTER (WHERE {f})",
        }
        for a in aggs:
            name = f"{prefix}{t}_{a}_{value}"
            if a == "count":
                sel.append(f"{e[a]} AS {name}")
            else:
                places = 4 if a in ("skew", "kurt") else 6
                sel.append(f"RND({e[a]}, {places}) AS {name}")
    return f"""
WITH r AS (SELECT o_custkey, {value},
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
m AS (SELECT o_custkey, {mus} FROM r GROUP BY o_custkey),
x AS (SELECT r.*, m.* EXCLUDE (o_custkey) FROM r JOIN m USING (o_custkey))
SELECT o_custkey, {', '.join(sel)} FROM x GROUP BY o_custkey"""


def _lastk_round(df):
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            places = 4 if ("_skew_" in f.name or "_kurt_" in f.name) else 6
            out.append(rnd(F.col(f.name)).alias(f.name))
        elif f.dataType.typeName() in ("long", "integer"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


@register("T12_last_k_aggregates", sql=_lastk_sql(T12_KS, T12_AGGS), headline=True)
def t12(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    out = O.last_k_aggregates(orders, "o_custkey", OORDER, ["o_totalprice"], T12_KS, T12_AGGS)
    return _lastk_round(out)


@register("T13_tail_n_means", sql=_lastk_sql([1, 3, 5], ["mean"], value="o_totalprice", prefix="tail_"))
def t13(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    out = O.last_k_aggregates(orders, "o_custkey", OORDER, ["o_totalprice"], [1, 3, 5], ["mean"], prefix="tail_")
    return _lastk_round(out)


@register("T14_last_k_fractions", sql="""
WITH r AS (SELECT o_custkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
a AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE rn <= 1) AS m1, avg(o_totalprice) FILTER (WHERE rn <= 5) AS m5,
             sum(o_totalprice) FILTER (WHERE rn <= 5) AS s5, sum(o_totalprice) AS sa FROM r GROUP BY 1)
SELECT o_custkey, RND(CASE WHEN m5 = 0 THEN 0.0 ELSE m1 / m5 END, 6) AS frac_mean_1_5,
  RND(CASE WHEN sa = 0 THEN 0.0 ELSE s5 / sa END, 6) AS frac_sum_5_all FROM a""")
def t14(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    t = O.last_k_aggregates(orders, "o_custkey", OORDER, ["o_totalprice"], [1, 5, None], ["mean", "sum"])
    out = O.last_k_fractions(t, [("frac_mean_1_5", "last1_mean_o_totalprice", "last5_mean_o_totalprice"),
                                 ("frac_sum_5_all", "last5_sum_o_totalprice", "all_sum_o_totalprice")])
    return _round_doubles(out.select("o_custkey", "frac_mean_1_5", "frac_sum_5_all"))


T15_KS = [3, 5, 10]


@register("T15_last_k_trend", sql="""
WITH r AS (SELECT o_custkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS p FROM orders)
SELECT o_custkey, """ + ", ".join(
    f"RND(CASE WHEN count(*) FILTER (WHERE p < {k}) = 1 THEN 0.0 "
    f"ELSE regr_slope(o_totalprice, p) FILTER (WHERE p < {k}) END, 4) AS trend_last{k}_o_totalprice"
    for k in T15_KS) + " FROM r GROUP BY o_custkey")
def t15(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    out = O.last_k_trend(orders, "o_custkey", OORDER, "o_totalprice", T15_KS)
    return out.select("o_custkey", *[rnd(c).alias(c) for c in out.columns[1:]])


# ------------------------------------------------------------ T16-T17
@register("T16_last_group_aggregates", sql="""
WITH li AS (SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
lg AS (SELECT o_custkey, arg_max(l_orderkey, (o_orderdate, l_orderkey)) AS lk FROM li GROUP BY 1)
SELECT li.o_custkey, RND(avg(l_extendedprice), 6) AS lastgrp_mean_l_extendedprice,
  RND(max(l_extendedprice), 6) AS lastgrp_max_l_extendedprice, RND(min(l_extendedprice), 6) AS lastgrp_min_l_extendedprice,
  RND(sum(l_extendedprice), 6) AS lastgrp_sum_l_extendedprice, count(l_extendedprice) AS lastgrp_count_l_extendedprice,
  RND(avg(l_quantity), 6) AS lastgrp_mean_l_quantity, RND(max(l_quantity), 6) AS lastgrp_max_l_quantity,
  RND(min(l_quantity), 6) AS lastgrp_min_l_quantity, RND(sum(l_quantity), 6) AS lastgrp_sum_l_quantity,
  count(l_quantity) AS lastgrp_count_l_quantity
FROM li JOIN lg ON li.o_custkey = lg.o_custkey AND li.l_orderkey = lg.lk GROUP BY li.o_custkey""")
def t16(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    li = lineitem.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                       lineitem.l_orderkey == orders.o_orderkey)
    out = O.last_group_aggregates(li, "o_custkey", "l_orderkey", ["o_orderdate", "l_orderkey"],
                                  ["l_extendedprice", "l_quantity"])
    return _lastk_round(out)


@register("T17_first_last_value", sql="""
SELECT o_custkey,
  arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus,
  arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_o_orderpriority,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_o_orderpriority
FROM orders GROUP BY o_custkey""")
def t17(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    return O.first_last_value(orders, "o_custkey", OORDER, ["o_orderstatus", "o_orderpriority"])
