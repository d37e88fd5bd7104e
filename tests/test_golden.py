"""Golden examples from the reference docstrings (FIXTURES.md §1), run
through the Spark operators. Row order is made explicit with a row id."""

from pyspark.sql import functions as F

from tessera.operators import group as G
from tessera.operators import ordered as O
from tessera.plans.fuse import apply_parts

AB = [(0, 0, 1), (0, 1, 1), (0, 0, 1), (0, 1, 0), (1, 1, 1), (1, 1, 0), (1, 1, 1), (1, 0, 0)]
AB_UNIQ = [(0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 0), (1, 1, 1), (1, 1, 0), (1, 1, 1), (1, 1, 0)]
AB_CUM = [(0, 0, 1), (0, 1, 1), (1, 2, 1), (0, 3, 0), (1, 1, 1), (2, 1, 0), (0, 1, 1), (1, 1, 0)]
ALT = [(0, 1, 0), (1, 1, 1), (1, 1, 2), (1, 0, 3), (2, 1, 4), (0, 0, 5), (1, 1, 6), (0, 0, 7)]
ALT2 = [(0, 1, 0), (1, 1, 1), (1, 1, 2), (1, 0, 3), (1, 1, 4), (0, 0, 5), (1, 1, 6), (0, 0, 7)]


def frame(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["rid", *names])


def ordered_values(df, col):
    return [r[col] for r in df.orderBy("rid").collect()]


def test_count(spark):
    df = frame(spark, AB, ["a", "b", "label"])
    out = apply_parts(df, [G.count(["a", "b"], "label", name="count_a_b")])
    assert ordered_values(out, "count_a_b") == [2, 2, 2, 2, 3, 3, 3, 1]


def test_unique_count(spark):
    df = frame(spark, AB_UNIQ, ["a", "b", "label"])
    out = apply_parts(df, [G.unique_count(["a", "b"], name="u")])
    assert ordered_values(out, "u") == [4, 4, 4, 4, 1, 1, 1, 1]


def test_cumulative_count(spark):
    df = frame(spark, AB_CUM, ["a", "b", "label"])
    out = O.cumulative_counts(df, ["a"], ["rid"])
    assert ordered_values(out, "cum_count__a") == [0, 1, 0, 2, 1, 0, 3, 2]
    assert ordered_values(out, "rev_cum_count__a") == [3, 2, 2, 1, 1, 0, 0, 0]


def test_time_to_n_next(spark):
    df = frame(spark, ALT, ["a", "label", "t"])
    out = O.time_to_n_next(df, ["a"], ["t", "rid"], F.col("t"), n=1, fill=222, name="x")
    assert ordered_values(out, "x") == [5, 1, 1, 3, 222, 2, 222, 222]


def test_count_in_previous_n_time_unit(spark):
    df = frame(spark, ALT2, ["a", "label", "t"])
    out = O.horizon_counts(df, ["a"], F.col("t"), "rid", 3, which=["prev"])
    assert ordered_values(out, "count_prev_3__a") == [0, 0, 1, 2, 3, 0, 2, 1]


def test_count_in_next_n_time_unit(spark):
    df = frame(spark, ALT2, ["a", "label", "t"])
    out = O.horizon_counts(df, ["a"], F.col("t"), "rid", 3, which=["next"])
    assert ordered_values(out, "count_next_3__a") == [0, 3, 2, 2, 1, 1, 0, 0]


def test_null_keys_stay_null(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 2), (2, 5, 3)], "rid long, a long, t long")
    out = apply_parts(df, [G.count(["a"], name="c")])
    assert ordered_values(out, "c") == [None, None, 1]
    cum = O.cumulative_counts(df, ["a"], ["t", "rid"])
    assert ordered_values(cum, "cum_count__a") == [None, None, 0]
