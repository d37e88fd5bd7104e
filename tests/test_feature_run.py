"""Mixed specs in one run: equal to each built alone, one pass per key and order."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import group as G
from tessera.operators import ordered as O
from tessera.plans import feature_run as R
from tessera.plans.fuse import AggPart, agg_alias
from tessera.spec import FeatureSpec as S

from .conftest import SF001

RUN = R.Run("event_id", ("ts", "event_id"), "t_us", "y", "fold")
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def ev(spark):
    from tessera.catalog.events import events_df
    return events_df(spark, SF001).withColumn("k", F.when(F.col("event_id") % 9 != 0, F.col("k"))) \
        .withColumn("fold", (F.col("event_id") % 3).cast("int"))


def specs():
    return [S.of("count", ["user_id"]), S.of("count", ["user_id", "event_type"]), S.of("variance", ["user_id", "value"]),
            S.of("unique_count", ["user_id", "k"]), S.of("count_ratio", ["user_id", "k"]),
            S.of("cumulative_count", ["user_id"]), S.of("reverse_cumulative_count", ["user_id"]),
            S.of("time_to_n_next", ["user_id"], {"n": 1}), S.of("time_to_n_next", ["user_id"], {"n": 2, "fill": -1}),
            S.of("time_to_n_next", ["user_id"], {"n": -1}), S.of("running_mean", ["user_id", "y"]),
            S.of("cumulative_count", ["k"]), S.of("count_in_previous", ["user_id"], {"n": HOUR}),
            S.of("count_in_previous", ["user_id"], {"n": 6 * HOUR}), S.of("count_in_next", ["user_id"], {"n": HOUR}),
            S.of("target_mean", ["k"]), S.of("target_mean", ["k"], {"smooth": 10}), S.of("woe", ["k"]),
            S.of("log_value", ["value"]), S.of("range_share", ["event_type", "value"]), S.of("by_table", ["hr"])]


USER = {
    "log_value": ("row", lambda s, run: F.log1p(F.col(s.cols[0]))),
    "range_share": ("group", lambda df, s, run: [AggPart(
        s.feature_name, (s.cols[0],), [F.min(s.cols[1]).alias(agg_alias(s.feature_name, "a")), F.max(s.cols[1]).alias(agg_alias(s.feature_name, "b"))],
        (F.col(s.cols[1]) - F.col(agg_alias(s.feature_name, "a"))) / (F.col(agg_alias(s.feature_name, "b")) - F.col(agg_alias(s.feature_name, "a"))))]),
    "by_table": ("table", lambda df, s, run: df.where("hr > 3").select("event_id", (F.col(s.cols[0]) * 2).alias("x"))),
}


def test_twenty_one_mixed_specs_equal_each_alone(ev, monkeypatch):
    passes = []
    real_positions, real_horizons = R.with_positions, R.horizon_counts
    monkeypatch.setattr(R, "with_positions", lambda df, keys, *a, **k: passes.append(("order", *keys)) or real_positions(df, keys, *a, **k))
    monkeypatch.setattr(R, "horizon_counts", lambda df, keys, *a, **k: passes.append(("time", *keys)) or real_horizons(df, keys, *a, **k))
    every = specs()
    got = R.build_features(ev, every, RUN, USER)
    assert passes == [("order", "user_id"), ("order", "k"), ("time", "user_id")]
    names = [s.feature_name for s in every]
    assert got.columns == [*ev.columns, *names]
    rows = {r["event_id"]: r for r in got.collect()}
    assert len(rows) == ev.count()
    for s in every:
        alone = R.build_features(ev, [s], RUN, USER).select("event_id", s.feature_name).collect()
        for r in alone:
            a, b = rows[r["event_id"]][s.feature_name], r[s.feature_name]
            assert a == b or abs(a - b) < 1e-9, (s, r)


def test_values_against_the_single_functions(ev):
    got = R.build_features(ev, specs(), RUN, USER)
    t = O.time_to_n_next(ev, ["user_id"], ["ts", "event_id"], F.col("t_us"), n=2, fill=-1, name="v").select("event_id", "v")
    c = G.build_group_features(ev, [S.of("count", ["user_id"], name="c")]).select("event_id", "c")
    h = O.horizon_counts(ev, ["user_id"], F.col("t_us"), "event_id", HOUR, which=["prev"]).select("event_id", F.col(f"count_prev_{HOUR}__user_id").alias("h"))
    j = got.join(t, "event_id").join(c, "event_id").join(h, "event_id")
    assert j.where((F.col("time_to_n_next__user_id__fill_m1_n_2") != F.col("v")) | (F.col("count__user_id") != F.col("c"))
                   | (F.col(f"count_in_previous__user_id__n_{HOUR}") != F.col("h"))).count() == 0
    # out of fold: the label of a row never enters its own encoding
    d = got.select("event_id", "k", "y", "fold", "target_mean__k").toPandas()
    for f in range(3):
        rest = d[(d.fold != f) & d.k.notna()].groupby("k").y.mean()
        mine = d[(d.fold == f) & d.k.notna()]
        want = mine.k.map(rest)
        assert ((mine.target_mean__k - want).abs().fillna(0) < 1e-9).all() and (mine.target_mean__k.isna() == want.isna()).all()


def test_registering_and_errors(ev):
    @R.feature("twice", "row")
    def twice(s, run):
        return F.col(s.cols[0]) * 2

    assert R.build_features(ev, [S.of("twice", ["value"])], RUN).where("twice__value <> value * 2").count() == 0
    with pytest.raises(ValueError):
        R.build_features(ev, [S.of("nothing", ["k"])], RUN)
    with pytest.raises(ValueError):
        R.build_features(ev, [S.of("twice", ["value"]), S.of("twice", ["value"])], RUN)
    with pytest.raises(ValueError):
        R.feature("x", "unknown")
    del R.REGISTRY["twice"]
