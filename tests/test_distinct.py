import math

import pytest
from pyspark.sql import functions as F

from tessera.operators.missing import column_profile, describe, drop_report
from tessera.plans import distinct as D


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(30_000).select(
        (F.col("id") % 3).cast("string").alias("part_raw"), F.col("id").cast("double").alias("many"),
        (F.col("id") % 20).cast("int").alias("twenty"), (F.col("id") % 21).cast("string").alias("twentyone"),
        F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(-0.0))
        .when(F.col("id") % 4 == 2, F.lit(0.0)).alias("odd"),
        F.lit(None).cast("double").alias("none"), F.lit(7).alias("one"),
        F.array((F.col("id") % 25).cast("int")).alias("arr")).withColumn(
        "part", F.when(F.col("part_raw") != "2", F.col("part_raw"))).drop("part_raw")


def truth(df, cols):
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first().asDict()


@pytest.mark.parametrize("threshold", [0, 1, 2, 19, 20, 21, 24, 5_000, 29_999, 30_000])
def test_threshold_is_exact(spark, rows, threshold):
    cols = ["many", "twenty", "twentyone", "odd", "none", "one", "arr"]
    want = truth(rows, cols)
    assert D.more_values_than(rows, cols, threshold) == [c for c in cols if want[c] > threshold]


@pytest.mark.parametrize("few", [D.FEW, 0])
def test_profiles_agree_with_count_distinct(spark, rows, few, monkeypatch):
    # few = 0: every column with a value takes the grouping path
    real = D.few_valued
    monkeypatch.setattr("tessera.operators.missing.few_valued", lambda df, cols_: real(df, cols_, few))
    cols = ["many", "twenty", "odd", "none", "one"]
    got = {(r["part"], r["column"]): r for r in column_profile(rows, cols, "part").collect()}
    assert len(got) == 4 * len(cols)  # parts 0, 1, NULL and all
    for part, sub in (("all", rows), ("0", rows.where("part = '0'")), ("1", rows.where("part = '1'")),
                      (None, rows.where("part is null"))):
        want, n = truth(sub, cols), sub.count()
        for c in cols:
            r = got[(part, c)]
            assert r.nunique == want[c], (part, c)
            assert r.rows_per_unique == (n / want[c] if want[c] else None)
            assert r.null_rate == pytest.approx(sub.where(F.col(c).isNull()).count() / n)
    for r in drop_report(rows, cols).collect():
        assert r["nunique"] == truth(rows, cols)[r["column"]] and r["drop"] == (r["column"] in ("none", "one"))
    assert column_profile(rows.limit(0), cols).count() == len(cols)


def test_no_copy_of_the_rows_per_column(spark, rows):
    for df in (drop_report(rows, ["many", "twenty", "twentyone", "one"]), column_profile(rows, ["twenty", "many"])):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_describe(spark, rows):
    got = {(r["column"], r["stat"]): r["value"] for r in describe(rows.withColumn("id", F.col("many")), ["many", "none"], "id").collect()}
    assert got["many", "count"] == 30_000 and got["many", "50%"] == 14_999.5 and got["none", "count"] == 0
    assert got["many", "max"] == 29_999 and math.isclose(got["many", "mean"], 14_999.5)
