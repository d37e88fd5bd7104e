"""Registered missing-value / profiling queries.

Inputs with NULLs and infinities are made inside the queries from real
columns: negative balances and one market segment become NULL, a price over
a zero tax becomes +inf.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import missing as N

CUST_SQL = """(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg,
  CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS nat, c_nationkey, 1 AS one FROM customer)"""


def cust(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"),
                    F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("nat"),
                    "c_nationkey", F.lit(1).alias("one"))


INF_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax = 0 AND l_discount > 0 THEN 'inf'::DOUBLE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS r,
  CASE WHEN l_tax = 0 AND l_discount > 0 THEN '-inf'::DOUBLE ELSE -l_quantity END AS q FROM lineitem)"""


def inf_df(spark, sf):
    li = table(spark, sf, "lineitem")
    r = (F.when((F.col("l_tax") == 0) & (F.col("l_discount") > 0), F.lit(float("inf")))
         .when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(F.col("l_discount") / F.col("l_tax")))
    q = F.when((F.col("l_tax") == 0) & (F.col("l_discount") > 0), F.lit(float("-inf"))).otherwise(-F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r"), q.alias("q"))


@register("N01_null_share", sql=f"""
SELECT * FROM (
  SELECT 'c_custkey' AS column, RND(avg(CASE WHEN c_custkey IS NULL THEN 1.0 ELSE 0.0 END)) AS null_share FROM {CUST_SQL}
  UNION ALL SELECT 'bal', RND(avg(CASE WHEN bal IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL}
  UNION ALL SELECT 'seg', RND(avg(CASE WHEN seg IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL}
  UNION ALL SELECT 'nat', RND(avg(CASE WHEN nat IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL})""")
def n01(spark, sf):
    out = N.null_share(cust(spark, sf), ["c_custkey", "bal", "seg", "nat"])
    return out.select("column", rnd("null_share").alias("null_share"))


def _n02_sql():
    parts = []
    for part, cond in (("all", "TRUE"), ("0", "one_split = 0"), ("1", "one_split = 1")):
        for c in ("bal", "nat"):
            parts.append(f"""SELECT '{part}' AS part, '{c}' AS column, RND(max(CAST({c} AS DOUBLE))) AS max,
  RND(min(CAST({c} AS DOUBLE))) AS min, count(DISTINCT {c}) AS nunique,
  RND(CASE WHEN count(DISTINCT {c}) > 0 THEN count(*) / count(DISTINCT {c}) END) AS rows_per_unique,
  RND(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)) AS null_rate
FROM (SELECT *, CAST(c_nationkey < 12 AS INTEGER) AS one_split FROM {CUST_SQL}) WHERE {cond} HAVING count(*) > 0""")
    return "\nUNION ALL ".join(parts)


@register("N02_column_profile", sql=_n02_sql())
def n02(spark, sf):
    c = cust(spark, sf).withColumn("one_split", (F.col("c_nationkey") < 12).cast("int"))
    out = N.column_profile(c, ["bal", "nat"], split="one_split")
    return out.select("part", "column", rnd("max").alias("max"), rnd("min").alias("min"), "nunique",
                      rnd("rows_per_unique").alias("rows_per_unique"), rnd("null_rate").alias("null_rate"))


@register("N03_fill_values", sql=f"""
SELECT c_custkey, RND(coalesce(bal, (SELECT avg(bal) FROM {CUST_SQL}))) AS bal,
  coalesce(seg, 'UNKNOWN') AS seg, coalesce(nat, (SELECT CAST(trunc(avg(nat)) AS INTEGER) FROM {CUST_SQL})) AS nat
FROM {CUST_SQL}""")
def n03(spark, sf):
    c = cust(spark, sf).select("c_custkey", "bal", "seg", "nat")
    out = N.fill_values(c, {"bal": "mean", "seg": "UNKNOWN", "nat": "int_mean"})
    return out.select("c_custkey", rnd("bal").alias("bal"), "seg", F.col("nat").cast("int"))


@register("N04_infinity_clamp_mean_fill", sql=f"""
WITH s AS (SELECT max(r) FILTER (WHERE isfinite(r)) AS hr, min(r) FILTER (WHERE isfinite(r)) AS lr,
                  avg(r) FILTER (WHERE isfinite(r)) AS mr, max(q) FILTER (WHERE isfinite(q)) AS hq,
                  min(q) FILTER (WHERE isfinite(q)) AS lq, avg(q) FILTER (WHERE isfinite(q)) AS mq FROM {INF_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  RND(CASE WHEN r = 'inf'::DOUBLE THEN hr WHEN r = '-inf'::DOUBLE THEN lr WHEN r IS NULL OR isnan(r) THEN mr ELSE r END) AS r,
  RND(CASE WHEN q = 'inf'::DOUBLE THEN hq WHEN q = '-inf'::DOUBLE THEN lq WHEN q IS NULL OR isnan(q) THEN mq ELSE q END) AS q
FROM {INF_SQL}, s""")
def n04(spark, sf):
    out = N.clamp_infinite(inf_df(spark, sf), ["r", "q"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("r").alias("r"), rnd("q").alias("q"))


@register("N05_extreme_fill", sql=f"""
WITH s AS (SELECT max(r) FILTER (WHERE isfinite(r)) AS hr, min(r) FILTER (WHERE isfinite(r)) AS lr,
                  max(q) FILTER (WHERE isfinite(q)) AS hq, min(q) FILTER (WHERE isfinite(q)) AS lq FROM {INF_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  RND(CASE WHEN r IS NULL OR NOT isfinite(r) THEN lr - (hr - lr) / 63 ELSE r END) AS r,
  RND(CASE WHEN q IS NULL OR NOT isfinite(q) THEN lq - (hq - lq) / 63 ELSE q END) AS q
FROM {INF_SQL}, s""")
def n05(spark, sf):
    out = N.extreme_fill(inf_df(spark, sf), ["r", "q"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("r").alias("r"), rnd("q").alias("q"))


def _n06_base(spark, sf):
    """Orders with the total price hidden where the customer's market segment
    is BUILDING (a real column decides, not a row subset)."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("o_totalprice").alias("truth"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("o_totalprice")).alias("price"),
                    F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nat"),
                    F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("age"),
                    F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("is_f"))


@register("N06_model_imputation")
def n06(spark, sf):
    base = _n06_base(spark, sf)
    out = N.model_impute(base, ["price"], ["bal", "nat", "age", "is_f"], min_distinct=200, max_iter=10)
    return out.select("o_orderkey", "price")


@register("N07_imputation_report")
def n07(spark, sf):
    base = _n06_base(spark, sf)
    filled = N.model_impute(base, ["price"], ["bal", "nat", "age", "is_f"], min_distinct=200, max_iter=10)
    hidden = base.where(F.col("price").isNull()).select("o_orderkey", "truth")
    mean = base.agg(F.avg("price")).first()[0]
    j = hidden.join(filled.select("o_orderkey", F.col("price").alias("model")), "o_orderkey") \
              .withColumn("mean_fill", F.lit(mean))
    return N.imputation_report(j, "truth", "mean_fill", "model")


@register("N08_drop_report", sql=f"""
SELECT * FROM (
  SELECT 'bal' AS column, count(DISTINCT bal) AS nunique, RND(avg(CASE WHEN bal IS NULL THEN 1.0 ELSE 0.0 END)) AS null_share FROM {CUST_SQL}
  UNION ALL SELECT 'seg', count(DISTINCT seg), RND(avg(CASE WHEN seg IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL}
  UNION ALL SELECT 'one', count(DISTINCT one), RND(avg(CASE WHEN one IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL}
  UNION ALL SELECT 'nat', count(DISTINCT nat), RND(avg(CASE WHEN nat IS NULL THEN 1.0 ELSE 0.0 END)) FROM {CUST_SQL})
  , LATERAL (SELECT nunique <= 1 OR null_share > 0.15 AS "drop")""")
def n08(spark, sf):
    out = N.drop_report(cust(spark, sf), ["bal", "seg", "one", "nat"], null_limit=0.15)
    return out.select("column", "nunique", rnd("null_share").alias("null_share"), "drop")


@register("N09_crosstab_normalised", sql="""
WITH j AS (SELECT c.c_mktsegment AS seg, o.o_orderstatus AS st FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT seg AS c_mktsegment, count(*) FILTER (WHERE st = 'F') AS n_F, count(*) FILTER (WHERE st = 'O') AS n_O,
  count(*) FILTER (WHERE st = 'P') AS n_P,
  RND(count(*) FILTER (WHERE st = 'F') / count(*)) AS share_F, RND(count(*) FILTER (WHERE st = 'O') / count(*)) AS share_O,
  RND(count(*) FILTER (WHERE st = 'P') / count(*)) AS share_P
FROM j GROUP BY seg""")
def n09(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderstatus")
    out = N.crosstab_normalised(j, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])
    return out.select("c_mktsegment", "n_F", "n_O", "n_P",
                      *[rnd(f"share_{v}").alias(f"share_{v}") for v in ("F", "O", "P")])


@register("N10_group_means", sql="""
SELECT o_orderpriority, RND(avg(o_totalprice)) AS mean_o_totalprice, RND(avg(o_custkey)) AS mean_o_custkey
FROM orders GROUP BY o_orderpriority""")
def n10_means(spark, sf):
    out = N.group_means(table(spark, sf, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"])
    return out.select("o_orderpriority", *[rnd(c).alias(c) for c in ("mean_o_totalprice", "mean_o_custkey")])


@register("N10_describe", sql="""
SELECT * FROM (
  SELECT 'o_totalprice' AS column, s.stat, RND(s.value) AS value FROM (
    SELECT unnest([{'stat': 'count', 'value': CAST(count(o_totalprice) AS DOUBLE)}, {'stat': 'mean', 'value': avg(o_totalprice)},
                   {'stat': 'std', 'value': stddev_samp(o_totalprice)}, {'stat': 'min', 'value': min(o_totalprice)},
                   {'stat': 'max', 'value': max(o_totalprice)},
                   {'stat': '25%', 'value': quantile_cont(o_totalprice, 0.25)},
                   {'stat': '50%', 'value': quantile_cont(o_totalprice, 0.5)},
                   {'stat': '75%', 'value': quantile_cont(o_totalprice, 0.75)}]) AS s FROM orders))""")
def n10(spark, sf):
    o = table(spark, sf, "orders")
    out = N.describe(o, ["o_totalprice"], "o_orderkey")
    return out.select("column", "stat", rnd("value").alias("value"))
