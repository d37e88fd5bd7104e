"""SURVEY §7 step 8: many specs, few shuffles. 117 generated specs over 41
key sets compile to exactly one aggregate per key set (or one grouping-sets
pass), checked on the physical plan."""

import re

from pyspark.sql import functions as F

from tessera.operators import group as G
from tessera.plans.fuse import apply_parts

from .conftest import SF001


def _specs():
    cols = ["user_id", "event_type", "k", "hr", "dow", "day"]
    specs = G.combination_specs(cols, [1, 2, 3], ["count", "variance"], value_col="value")
    specs += G.combination_specs(cols, [1, 2, 3], ["count_ratio"], value_col="value")
    return specs


def _frame(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    return ev.select("event_id", "user_id", "event_type", "value",
                     F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("k"),
                     F.hour("ts").alias("hr"), F.dayofweek("ts").alias("dow"), F.dayofmonth("ts").alias("day"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_aggregate_per_key_set(spark):
    ev = _frame(spark)
    specs = _specs()
    assert len(specs) >= 100
    parts = [p for s in specs for p in G.GROUP_FUNCTIONS[s.function](ev, s)]
    key_sets = {p.keys for p in parts}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(apply_parts(ev, parts, grouping_sets=False))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    partial = [ln for ln in plan.splitlines() if "HashAggregate" in ln and "partial_" in ln]
    assert len(partial) == len(key_sets), (len(partial), len(key_sets))


def test_grouping_sets_scan_once(spark):
    ev = _frame(spark)
    parts = [p for s in _specs() for p in G.GROUP_FUNCTIONS[s.function](ev, s)]
    out = apply_parts(ev, parts, grouping_sets=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Expand", plan)) >= 1
    assert out.count() == ev.count()


def test_lattice_equals_one_aggregate_per_key_set(spark):
    """The same 117 specs and more, with NULL keys and NULL values: equal
    features from one scan for the aggregates and one for the rows."""
    from tessera.plans.lattice import Lattice
    from tessera.spec import FeatureSpec
    ev = _frame(spark).withColumn("k", F.when(F.col("event_id") % 7 != 0, F.col("k"))) \
        .withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value") + 1e6))
    specs = _specs()
    assert len(specs) == 117
    specs += [FeatureSpec.of("unique_count", ["user_id", "k"]), FeatureSpec.of("unique_count_ratio", ["k", "event_type"]),
              FeatureSpec.of("count_std_over_mean", ["event_type", "k", "hr"]), FeatureSpec.of("count", ["k"], {"dummy": "value"})]
    lat = Lattice(ev, specs)
    assert len(lat.maximal) == 20 and len(lat.sets) == 41
    got = lat.rows()
    want = G.build_group_features(ev, specs)
    names = [s.feature_name for s in specs]
    assert got.columns == [*ev.columns, *names]
    a = {r["event_id"]: r for r in got.collect()}
    b = {r["event_id"]: r for r in want.select("event_id", *names).collect()}
    assert a.keys() == b.keys()
    for i, r in b.items():
        for n in names:
            x, y = a[i][n], r[n]
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-6 * max(1, abs(y))), (i, n, x, y)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 1  # the aggregates are written: the rows are read for the joins only
