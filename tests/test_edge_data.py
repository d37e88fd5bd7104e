"""Operators on data with NULLs, missing rows, rare letters and many values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import category as C
from tessera.operators import missing as N
from tessera.operators import model as M
from tessera.operators import rollup as R
from tessera.operators import select as L
from tessera.operators import target as E
from tessera.plans.fuse import AggPart, apply_parts
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io as S


def test_selection_scores_do_not_need_the_zeros(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    a, b = rng.integers(0, 3, 200) * y, rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(200)], "id long, y int, a double, b double")
    dense = L.long_format(df, "id", ["a", "b"], "y")
    sparse = dense.where("value <> 0")
    for fn, name in ((L.chi2_scores, "chi2"), (L.anova_f, "f")):
        one, two = ({r.feature: r[name] for r in fn(x, "y", df).collect()} for x in (dense, sparse))
        assert one.keys() == two.keys() == {"a", "b"}
        assert all(one[k] == pytest.approx(two[k]) for k in one)
    groups = [a[y == 0], a[y == 1]]
    between = sum(len(g) * (g.mean() - a.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert {r.feature: r.f for r in L.anova_f(sparse, "y", df).collect()}["a"] == pytest.approx(between / (within / 198))


def test_correlation_of_many_columns_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 60)) + 1e6
    x[:, 7] = x[:, 3] * 2 + 1
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    got = L.correlation_matrix(df, names)
    for i, j in ((0, 1), (3, 7), (10, 59)):
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_profile_keeps_the_null_part(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, None)], "v double, s string")
    got = {r.part: (r.max, r.null_rate) for r in N.column_profile(df, ["v"], split="s").collect()}
    assert got == {"a": (1.0, 0.0), None: (2.0, 0.5), "all": (2.0, pytest.approx(1 / 3))}


def test_crosstab_shares_count_every_value(spark):
    df = spark.createDataFrame([("x", "F"), ("x", "Z"), ("x", None), ("y", "Z")], "a string, b string")
    got = {r.a: (r.n_F, r.share_F) for r in N.crosstab_normalised(df, "a", "b", ["F"]).collect()}
    assert got == {"x": (1, 0.5), "y": (0, 0.0)}


def test_append_by_id_sees_a_lost_and_a_doubled_row(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ok = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "d"), (9, "e")], "id long, v string")
    assert S.append_by_id(base, ok, "id").count() == 3
    for bad in ([(1, "a"), (1, "b"), (2, "c")], [(1, "a"), (2, "b")]):
        with pytest.raises(ValueError):
            S.append_by_id(base, spark.createDataFrame(bad, "id long, v string"), "id")


def test_repository_scores_and_remove(spark):
    import uuid
    repo = M.PredictionRepository(spark, f"{ensure_checkpoint_dir(spark)}/repo-{uuid.uuid4().hex}")
    p = spark.createDataFrame([(1, 0.5)], "id long, pred double")
    for m, s in (("a=1", 0.1), ("b", 0.3), ("a=1", 0.9)):
        repo.save(m, p, p, s)
    assert {r.model_id: r.score for r in repo.scores().collect()} == {"a=1": 0.9, "b": 0.3}
    repo.remove("b")
    assert {r.model_id for r in repo.select("oof").collect()} == {"a=1"} == {r.model_id for r in repo.scores().collect()}
    repo.remove("a=1")
    assert repo.scores().count() == 0
    repo.save("c", p, None, 0.2)
    assert {r.model_id for r in repo.select("oof").collect()} == {"c"}


def test_feature_names_must_differ(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    part = AggPart("f", ("a",), [F.count("b").alias("_n")], F.col("_n"))
    with pytest.raises(ValueError):
        apply_parts(df, [part, AggPart("f", ("b",), [F.count("a").alias("_m")], F.col("_m"))])


def test_letters_of_every_script_are_words(spark):
    df = spark.createDataFrame([(1, "Café naïve 数据 привет мир, été")], "d long, t string")
    terms = {r.term for r in C.word_terms(df, "d", "t").collect()}
    assert {"café", "naïve", "数据", "привет", "мир"} <= terms


def test_many_values_lose_none(spark):
    n = 300_000
    df = spark.range(n).select("id", F.concat(F.lit("t"), "id", F.lit(",t"), (F.col("id") + 1) % n).alias("tags"))
    got = C.tag_counts(df, "id", "tags", min_df=2)
    assert got.select("tag").distinct().count() == n and got.count() == 2 * n
    wide = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("c"))
    assert len(R.distinct_values(wide, "c")) == 1500
    folds = spark.range(24_000).select((F.col("id") % 12_000).alias("f"), (F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("y"))
    out = E.leave_fold_out(folds, ["k"], "y", "f", F.lit(True), stat="mean")
    assert out.count() == 24_000 and out.where("mean__k = -1").count() == 0


def _labelled(spark, n=1200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(n)],
                                 "id long, y int, fold int, a double, b double, c double")


def test_calibration_scores_new_rows_and_is_held_out(spark):
    df = _labelled(spark)
    new = df.where("id % 4 = 0").withColumn("id", F.col("id") + 10_000)
    got = M.calibrated_svm(df, ["a", "b", "c"], "y", "fold", "id", 3, test=new)
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == {"train": 1200, "test": 300}
    j = got.where("part = 'train'").join(df, "id")
    assert M.auc(j.withColumn("pred", F.col("calibrated")), "y", "pred", "id") > 0.75
    assert abs(j.agg(F.avg("calibrated") - F.avg("y")).first()[0]) < 0.05
    # the label of a fold does not move its own calibration
    flipped = df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    again = M.calibrated_svm(flipped, ["a", "b", "c"], "y", "fold", "id", 3).join(df.where("fold = 1"), "id")
    both = {r.id: r.svm_score for r in j.where("fold = 1").collect()}
    assert all(abs(r.svm_score - both[r.id]) < 1e-6 for r in again.collect())


def test_blend_search_of_many_candidates(spark):
    df = _labelled(spark).select("id", "y", *[F.expr(f"1 / (1 + exp(-{c}))").alias(c) for c in "abc"])
    got = {r.weights: r.logloss for r in M.blend_weight_search(df, ["a", "b", "c"], "y", n_weight=9, n_search=3000).collect()}
    pdf = df.toPandas()
    for w in list(got)[:20]:
        v = np.array([float(x) for x in w.split(",")])
        p = pdf[["a", "b", "c"]].to_numpy() @ v / v.sum()
        assert got[w] == pytest.approx(-np.mean(pdf.y * np.log(p) + (1 - pdf.y) * np.log(1 - p)))


def test_search_over_families_and_a_validation_split(spark):
    df = _labelled(spark, 600)
    spaces = {"logistic": {"regParam": [0.0]}, "naive_bayes": {}}
    for valid in (None, F.col("id") % 5 == 0):
        got = M.random_search(df, ["a", "b", "c"], "y", "fold", "id", 3, spaces, n_iter=1, valid=valid).collect()
        assert {r.family for r in got} == set(spaces) and all(r.auc > 0.7 for r in got)


def test_selection_in_rounds_and_by_importance(spark):
    df = _labelled(spark, 600).withColumn("noise", F.rand(1))
    rounds = L.forward_rounds(df, ["noise", "b", "a"], "y", "fold", "id", 3).collect()
    assert [r.added for r in rounds][:2] == ["a", "b"] and rounds[1].cv_auc > rounds[0].cv_auc
    found = L.importance_search(df, ["a", "b", "noise"], "y", "fold", "id", 3, top=[1, 2]).collect()
    assert found[0].features == "a" and "a" in found[1].features
    assert [r.best for r in found] == [r.cv_auc == max(x.cv_auc for x in found) for r in found] or found[0].best


def test_stacking_per_label_and_depth(spark):
    df = _labelled(spark, 300).withColumn("y2", 1 - F.col("y"))
    long = df.select("id", F.expr("stack(2, 'a', a, 'b', b) as (model, pred)"))
    out = M.stack_labels(long, df, "id", ["y", "y2"], "fold", 3, depth=2, test_long=long.where("id < 50"))
    n = {(r.label, r.layer, r.part): r["count"] for r in out.groupBy("label", "layer", "part").count().collect()}
    assert n == {(y, d, p): c for y in ("y", "y2") for d in (1, 2) for p, c in (("oof", 300), ("test", 50))}
    j = out.where("part = 'oof' and layer = 2 and label = 'y'").join(df.select("id", "y"), "id")
    assert M.auc(j, "y", "pred", "id") > 0.7


def test_nmf_counts_the_zeros(spark):
    rng = np.random.default_rng(2)
    v = (rng.random((12, 2)) * 4).round() @ (rng.random((2, 9)) * 3).round()
    df = spark.createDataFrame([(int(i), int(j)) for i in range(12) for j in range(9) for _ in range(int(v[i, j]))], "r long, c long")
    w = C.nmf_embedding(df, "r", "c", k=2, max_iter=15).toPandas().sort_values("r")
    e = w.drop(columns="r").to_numpy()
    full = v[w.r.to_numpy()]
    h = np.linalg.lstsq(e, full, rcond=None)[0]
    assert (e >= 0).all() and np.linalg.norm(full - e @ h) < 0.15 * np.linalg.norm(full)


def test_bucketed_feature_sets_join_without_an_exchange(spark):
    import uuid
    store = S.FeatureStore(spark)
    names = [f"fs_{x}_{uuid.uuid4().hex}" for x in "ab"]
    for n in names:
        store.write_bucketed(n, spark.range(500).select("id", F.rand(1).alias(n)), "id", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = store.assemble_bucketed(names[0], names[1:], "id")
        assert out.count() == 500 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names:
            spark.sql(f"DROP TABLE {n}")


def test_listed_split_and_accents(spark):
    from tessera.operators import sampling as H
    df = spark.range(5)
    got = {r.id: r.is_valid for r in H.listed_split(df, "id", spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    out = spark.range(1).select(C.strip_accents(F.lit("Éàçñüß ő ž 数")).alias("x")).first().x
    assert out == "Eacnuß o z 数"
