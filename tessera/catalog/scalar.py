"""Registered scalar-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.events import EV, ORDER, events_df
from tessera.catalog.registry import register, table
from tessera.functions.columns import rnd
from tessera.operators import ordered as O
from tessera.operators import scalar as S

LI_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _dbl(df, skip=()):
    return df.select(*[rnd(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


@register("P01_calendar_split", sql=f"""
SELECT event_id, CAST(day(lt) AS BIGINT) AS day, CAST(hour(lt) AS BIGINT) AS hour, CAST(minute(lt) AS BIGINT) AS minute,
  CAST(minute(lt) // 10 AS BIGINT) AS minute10, CAST(hour(lt) * 60 + minute(lt) AS BIGINT) AS hour_minute,
  CAST(day(lt) * 1440 + hour(lt) * 60 + minute(lt) AS BIGINT) AS day_hour_minute,
  CAST(floor(epoch(ts) // 600) AS BIGINT) AS bucket10, CAST(floor(epoch(ts)) AS BIGINT) AS epoch
FROM (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS lt FROM events)""")
def p01(spark, sf):
    ev = table(spark, sf, "events")
    out = ev.select("event_id", *S.calendar_parts("ts", "Asia/Shanghai"))
    return out.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


@register("P02_composite_key", sql="""
SELECT event_id, concat_ws('_', CAST(user_id AS VARCHAR), event_type) AS user_id_event_type,
  CAST(1000 * user_id + CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INTEGER) AS BIGINT) AS user_k
FROM events""")
def p02(spark, sf):
    ev = events_df(spark, sf)
    return ev.select("event_id", S.composite_key(["user_id", "event_type"]).alias("user_id_event_type"),
                     S.packed_key("user_id", "k").cast("bigint").alias("user_k"))


@register("P03_ratio_features", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  RND(l_extendedprice / l_quantity) AS price_per_unit,
  RND(l_discount / (1 + l_tax)) AS discount_over_1p_tax,
  RND(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END) AS discount_over_tax,
  RND(l_extendedprice * (1 - l_discount) - l_extendedprice) AS discount_amount
FROM lineitem""")
def p03(spark, sf):
    li = table(spark, sf, "lineitem")
    out = li.select(*LI_ID, S.ratio("l_extendedprice", "l_quantity").alias("price_per_unit"),
                    S.ratio1("l_discount", "l_tax").alias("discount_over_1p_tax"),
                    S.ratio("l_discount", "l_tax").alias("discount_over_tax"),
                    (F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice"))
                    .alias("discount_amount"))
    return _dbl(out)


_P04_VALS = ("[l_quantity, l_discount * 100, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax * 100 END, "
             "l_extendedprice / 1000]")


@register("P04_row_stats", sql=f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice,
                  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax * 100 END AS tax100,
                  list_filter({_P04_VALS}, lambda v: v IS NOT NULL) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  RND(list_min(a)) AS row_min, RND(list_max(a)) AS row_max, RND(list_sum(a)) AS row_sum,
  RND(list_avg(a)) AS row_mean, RND(list_median(a)) AS row_median,
  RND(list_var_samp(a)) AS row_var, RND(list_stddev_samp(a)) AS row_std,
  RND(0.5 * l_quantity + 2.0 * l_discount * 100 + 1.0 * tax100 + 0.25 * l_extendedprice / 1000) AS row_weighted
FROM x""")
def p04(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.select(*LI_ID, F.col("l_quantity"), (F.col("l_discount") * 100).alias("d100"),
                  F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 100).alias("tax100"),
                  (F.col("l_extendedprice") / 1000).alias("p1000"))
    out = x.select(*LI_ID, *S.row_stats(["l_quantity", "d100", "tax100", "p1000"], weights=[0.5, 2.0, 1.0, 0.25]))
    return _dbl(out)


@register("P05_sentinel_to_null", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal_clean,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment_clean,
  CASE WHEN c_nationkey IN (0, 24) THEN NULL ELSE c_nationkey END AS c_nationkey_clean
FROM customer""")
def p05(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.sentinel_to_null("c_acctbal", negative=True).alias("c_acctbal_clean"),
                    S.sentinel_to_null("c_mktsegment", ["BUILDING"]).alias("c_mktsegment_clean"),
                    S.sentinel_to_null("c_nationkey", [0, 24]).alias("c_nationkey_clean"))


@register("P06_threshold_flag", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END AS low_discount,
  coalesce(CAST(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END > 0 AS INTEGER), 0) AS taxed
FROM lineitem""")
def p06(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tax_n", F.when(F.col("l_returnflag") != "N", F.col("l_tax")))
    return li.select(*LI_ID, S.threshold_flag("l_discount", "<", 0.05).alias("low_discount"),
                     S.threshold_flag("tax_n", ">", 0).alias("taxed"))


@register("P07_positive_part", sql="""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS acctbal_pos FROM customer""")
def p07(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.positive_part("c_acctbal").cast("double").alias("acctbal_pos"))


@register("P08_square", sql="SELECT p_partkey, RND(p_retailprice * p_retailprice) AS p_retailprice_sq FROM part")
def p08(spark, sf):
    p = table(spark, sf, "part")
    return _dbl(p.select("p_partkey", S.square("p_retailprice").alias("p_retailprice_sq")))


@register("P09_squares_and_products", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  RND(l_quantity * l_quantity) AS l_quantity_sq, RND(l_discount * l_discount) AS l_discount_sq,
  RND(l_tax * l_tax) AS l_tax_sq, RND(l_quantity * l_discount) AS l_quantity_x_l_discount,
  RND(l_quantity * l_tax) AS l_quantity_x_l_tax, RND(l_discount * l_tax) AS l_discount_x_l_tax
FROM lineitem""")
def p09(spark, sf):
    li = table(spark, sf, "lineitem")
    return _dbl(li.select(*LI_ID, *S.squares_and_products(["l_quantity", "l_discount", "l_tax"])))


@register("P10_mass_divide", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice,
  RND(l_extendedprice / l_quantity) AS l_extendedprice_per_l_quantity
FROM lineitem""")
def p10(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_ID, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = S.mass_divide(li, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_quantity", threshold=20)
    return _dbl(out, skip=("l_quantity", "l_discount", "l_tax", "l_extendedprice"))


@register("P11_log_and_standardise", sql="""
SELECT p_partkey, RND(log2(p_retailprice + 1)) AS log2_price, RND(log2(log2(p_retailprice + 1) + 1)) AS loglog_price,
  RND((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()) AS p_retailprice_z,
  RND((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()) AS p_size_z
FROM part""")
def p11(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = S.standardise(p, ["p_retailprice", "p_size"])
    out = out.select("p_partkey", S.log_transform("p_retailprice").alias("log2_price"),
                     S.log_transform("p_retailprice", twice=True).alias("loglog_price"), "p_retailprice_z", "p_size_z")
    return _dbl(out)


@register("P12_decile_bins", sql="""
WITH e AS (SELECT quantile_cont(p_retailprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM part)
SELECT p_partkey, CAST(len(list_filter(e.q, lambda v: v < p_retailprice)) AS INTEGER) AS p_retailprice_decile
FROM part, e""")
def p12(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return S.decile_bins(p, "p_retailprice", "p_partkey").select("p_partkey", F.col("p_retailprice_decile").cast("int"))


@register("P13_equal_width_bins", sql="""
WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 80)), 79) AS INTEGER) AS p_retailprice_bin80
FROM part, m""")
def p13(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return S.equal_width_bins(p, "p_retailprice", 80).select("p_partkey", "p_retailprice_bin80")


@register("P14_equal_frequency_score", sql="""
SELECT p_partkey, CAST(ntile(10) OVER (ORDER BY p_retailprice, p_partkey) AS INTEGER) AS p_retailprice_score10,
  concat_ws('_', CAST(ntile(10) OVER (ORDER BY p_retailprice, p_partkey) AS VARCHAR), p_type) AS segment
FROM part""")
def p14(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_type")
    out = S.equal_frequency_score(p, "p_retailprice", "p_partkey", 10)
    return out.select("p_partkey", "p_retailprice_score10",
                      S.segment_label(["p_retailprice_score10", "p_type"]).alias("segment"))


# messy device-like strings built from part names (no '%' occurs in the data)
_P15_IN = ("concat(replace(p_name, ' ', '%2520'), '+', p_brand, '--', replace(p_type, 'A', '%2528'), "
           "'_(', CAST(p_size AS STRING), ')', '%2C ', p_name)")


@register("P15_device_string_cleanup", sql=f"""
WITH x AS (SELECT p_partkey, {_P15_IN} AS raw FROM part),
a AS (SELECT p_partkey, raw, regexp_replace(raw, '%2522|%(25)*2B|%20|%(25)*28|%(25)*29|%(25)*2C', ' ', 'g') AS s1 FROM x),
b AS (SELECT p_partkey, raw, url_decode(s1) AS s2 FROM a),
c AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(regexp_replace(s2, '-+|_+', ' ', 'g'),
        '([a-zA-Z0-9])\\++\\s*([a-zA-Z0-9])', '\\1 \\2', 'g'), '\\s{{2,}}', ' ', 'g') AS s3 FROM b)
SELECT p_partkey, raw, CASE WHEN contains(upper(regexp_replace(s3, '\\(|\\)', '', 'g')), '%') THEN NULL
  ELSE upper(regexp_replace(s3, '\\(|\\)', '', 'g')) END AS cleaned
FROM c""")
def p15(spark, sf):
    p = table(spark, sf, "part")
    raw = F.expr(_P15_IN.replace("concat(", "concat(", 1))
    x = p.select("p_partkey", raw.alias("raw"))
    return x.select("p_partkey", "raw", S.clean_device_string("raw").alias("cleaned"))


@register("P16_prefix_split", sql="""
SELECT p_partkey, split_part(concat(p_type, '_', p_brand, '_', p_name), '_', 1) AS type_prefix FROM part""")
def p16(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.prefix_part(F.concat_ws("_", "p_type", "p_brand", "p_name")).alias("type_prefix"))


@register("P17_inter_event_band", sql=f"""
SELECT event_id, CASE WHEN g < 30 THEN 0 WHEN g > 30 AND g < 1800 THEN 1 ELSE 2 END AS gap_band
FROM (SELECT event_id, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM {EV} e)""")
def p17(spark, sf):
    ev = events_df(spark, sf).select("event_id", "user_id", "ts", "t_us")
    g = O.time_to_n_next(ev, ["user_id"], ORDER, F.col("t_us"), n=-1, name="_lag")
    return g.select("event_id", S.gap_band(-F.col("_lag") / 1e6).alias("gap_band"))


def _rate_sql(pv, p, n):
    """Index of the grid rate, digit by digit in base 10 from the left."""
    def cost(k):
        return f"({pv} * (({k}) / 100000.0) / (1 - pow(1 + ({k}) / 100000.0, -{n})))"
    digits = ", ".join(str(10 ** e) for e in range(4, -1, -1) for _ in range(9))
    k = (f"list_reduce([{digits}], lambda k, d: CASE WHEN {cost('k + d')} <= {p} THEN k + d ELSE k END, 0)")
    return k, cost


_K, _COST = _rate_sql("l_extendedprice", "payment", "t")


@register("P18_loan_estimate", sql=f"""
WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax,
                   l_extendedprice * (0.09 + l_discount + l_tax) AS payment, 12 AS low_len,
                   row_number() OVER () AS rid FROM lineitem),
o AS (SELECT *, unnest([18.0, 24.0, 30.0, 36.0, 42.0, 48.0, 54.0, 60.0]::DOUBLE[]) AS t FROM li),
k AS (SELECT *, {_K} AS k FROM o WHERE t * payment >= l_extendedprice),
r AS (SELECT *, (CASE WHEN k > 0 AND k < 99999 AND {_COST('k + 1')} - payment <= payment - {_COST('k')}
                      THEN k + 1 ELSE k END) / 100000.0 AS rate FROM k),
b AS (SELECT rid, arg_min(struct_pack(rate := rate, t := t), (abs(rate - 0.025), -t)) AS x FROM r GROUP BY rid)
SELECT li.* EXCLUDE (rid), RND(x.rate) AS estimate_apr, x.t AS estimate_terms FROM li LEFT JOIN b USING (rid)""")
def p18(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_ID, "l_extendedprice", "l_discount", "l_tax")
    # monthly payment between 9 % and 27 % of the amount; at least 12 months
    li = li.withColumn("payment", F.col("l_extendedprice") * (0.09 + F.col("l_discount") + F.col("l_tax")))
    li = li.withColumn("low_len", F.lit(12))
    out = S.loan_estimates(li, "l_extendedprice", "payment", "low_len", t_apr=0.025)
    return out.withColumn("estimate_apr", rnd("estimate_apr"))


def _inv_norm_sql(p: str) -> str:
    """The same rational approximation as ``functions.columns.inv_norm``."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]

    def poly(coef, x):
        e = repr(coef[0])
        for k in coef[1:]:
            e = f"(({e}) * ({x}) + {k!r})"
        return e
    qlo = f"sqrt(-2 * ln({p}))"
    qhi = f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    lo = f"{poly(c, qlo)} / ({poly(d, qlo)} * {qlo} + 1)"
    hi = f"-{poly(c, qhi)} / ({poly(d, qhi)} * {qhi} + 1)"
    mid = f"{poly(a, r)} * {q} / ({poly(b, r)} * {r} + 1)"
    return f"CASE WHEN ({p}) < 0.02425 THEN {lo} WHEN ({p}) > 1 - 0.02425 THEN {hi} ELSE {mid} END"


_P = "least(greatest(CASE WHEN n > 1 THEN ar / (n - 1) ELSE 0.5 END, 1e-7), 1 - 1e-7)"


@register("P19_rank_to_normal", sql=f"""
WITH r AS (SELECT p_partkey, p_size, (rank() OVER (ORDER BY p_size) - 1) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ar,
                  count(*) OVER () AS n FROM part)
SELECT p_partkey, RND({_inv_norm_sql(_P)}) AS p_size_normal FROM r""")
def p19(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return _dbl(S.rank_to_normal(p, "p_size", "p_partkey").select("p_partkey", "p_size_normal"))


_TAGS = "concat(replace(p_name, ' ', ','), ',,', p_type, ',', p_name, ',', lower(p_type))"


@register("P20_tag_set_normalise", sql=f"""
SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split({_TAGS}, ','), lambda s: s <> ''))), ','),
  'notFound') AS tags
FROM part""")
def p20(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.normalise_tags(F.expr(_TAGS)).alias("tags"))


@register("P21_value_banding", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax = 0 THEN 'null' WHEN l_discount / l_tax > 1 THEN 'gt1' WHEN l_discount / l_tax = 1 THEN 'eq1'
       WHEN l_discount / l_tax > 0.5 THEN 'half_1' WHEN l_discount / l_tax > 0 THEN 'zero_half'
       WHEN l_discount / l_tax = 0 THEN 'zero' ELSE 'null' END AS discount_tax_band,
  CASE WHEN l_quantity >= 15 THEN '15+' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity_band,
  CASE l_shipmode_stub WHEN 'A' THEN 'returned_or_accepted' WHEN 'R' THEN 'returned_or_accepted' ELSE l_shipmode_stub END
    AS flag_band
FROM (SELECT *, l_returnflag AS l_shipmode_stub FROM lineitem)""")
def p21(spark, sf):
    li = table(spark, sf, "lineitem")
    r = F.try_divide(F.col("l_discount"), F.col("l_tax"))
    band = S.band_values(r, bands=[(lambda x: x.isNull(), "null"), (lambda x: x > 1, "gt1"),
                                   (lambda x: x == 1, "eq1"), (lambda x: x > 0.5, "half_1"),
                                   (lambda x: x > 0, "zero_half"), (lambda x: x == 0, "zero")], default="null")
    qty = F.when(F.col("l_quantity") >= 15, F.lit("15+")).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    flag = S.band_values("l_returnflag", mapping={"A": "returned_or_accepted", "R": "returned_or_accepted"})
    return li.select(*LI_ID, band.alias("discount_tax_band"), qty.alias("quantity_band"), flag.alias("flag_band"))
