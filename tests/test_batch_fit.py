"""Batched logistic fits against single fits, and selection with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batch_fit as B
from tessera.operators import model as M
from tessera.operators import select as L


@pytest.fixture(scope="module")
def frame(spark):
    """``a`` and ``b`` carry the signal, the others none; rows in 3 folds."""
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.standard_normal((n, 6)) * [1, 5, 0.1, 1, 100, 1] + [0, 3, 0, -7, 1000, 0]
    z = 1.5 * x[:, 0] - 0.3 * (x[:, 1] - 3) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, int(y[i]), i % 3, *map(float, x[i]), 4.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double, d double, e double, f double, flat double")
    return df.repartition(5).cache()


def test_coefficients_equal_those_of_single_fits(frame):
    from pyspark.ml.classification import LogisticRegression
    models = [B.Model(("a", "b", "c", "e"), 1, 0.01), B.Model(("a", "flat", "d"), None, 0.1), B.Model(("b", "f"), 2, 0.0)]
    got = B.fit_logistic(frame, "y", models, "fold")
    for i, m in enumerate(models):
        rows = frame if m.fold is None else frame.where(F.col("fold") != m.fold)
        lr = LogisticRegression(labelCol="y", regParam=m.l2, maxIter=500, tol=1e-12).fit(M.assemble(rows, list(m.columns)))
        want = dict(zip(m.columns, lr.coefficients.toArray()))
        assert np.allclose(got.coefficients[i], [want.get(c, 0.0) for c in got.columns], rtol=1e-4, atol=1e-6)
        assert abs(got.intercepts[i] - lr.intercept) < 1e-3


def test_many_models_take_the_passes_of_one(frame):
    cols = ["a", "b", "c", "d", "e", "f"]
    one = B.fit_logistic(frame, "y", [B.Model(tuple(cols), 0)], "fold")
    many = B.fit_logistic(frame, "y", [B.Model(tuple(x for x in cols if x != c), f) for c in cols for f in range(3)], "fold")
    assert many.passes <= one.passes + 1


def test_known_answers_of_the_selection_loops(frame):
    cols = ["a", "b", "c", "d", "e", "f"]
    report = {r["dropped"]: r["gain"] for r in L.drop_one_report(frame, cols, "y", "fold", "id", 3).collect()}
    assert report["a"] < -0.1 and report["b"] < -0.1 and all(abs(report[c]) < 0.01 for c in "cdef")
    rounds = L.backward_elimination(frame, cols, "y", "fold", "id", 3, min_features=2).collect()
    assert {"a", "b"} <= set(rounds[-1]["features"].split(","))
    assert [r["added"] for r in L.forward_rounds(frame, cols, "y", "fold", "id", 3, max_rounds=2).collect()] == ["a", "b"]
    hold = frame.where("fold = 2")
    picked = {r["candidate"]: r for r in L.forward_selection(
        frame.where("fold < 2"), ["c", "a", "b"], "y", "fold", "id", 2, holdout=hold).collect()}
    assert picked["a"]["added"] and picked["b"]["added"] and list(picked) == ["c", "a", "b"]
    kept = [r["feature"] for r in L.recursive_elimination(frame, cols, "y", 2).collect() if r["dropped_round"] is None]
    assert sorted(kept) == ["a", "b"]


def test_out_of_fold_auc_equals_single_models(frame):
    from pyspark.ml.classification import LogisticRegression
    oof, _ = M.oof_predict(frame, ["a", "c"], "y", "fold", "id", 3,
                           estimator=lambda: LogisticRegression(labelCol="y", regParam=0.01, maxIter=300, tol=1e-12))
    want = M.auc(oof.join(frame.select("id", "y"), "id"), "y", "pred", "id")
    assert abs(B.cv_aucs(frame, [["a", "c"]], "y", "fold", 3)[0][0] - want) < 1e-5


def test_awkward_rows_and_sets(spark, frame):
    nan = float("nan")
    rows = [(1, 0, 1.0, None), (0, 0, 2.0, 1.0), (1, 1, nan, 2.0), (0, 1, 3.0, 0.5), (1, 1, 4.0, 0.1), (None, 0, 1.0, 1.0), (1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y int, fold int, a double, b double")
    assert B.cv_aucs(df, [[], ["a"]], "y", "fold", 2)[0][0] == 0.5
    empty = B.fit_logistic(df.limit(0), "y", [B.Model(("a",))])
    assert (empty.coefficients == 0).all() and empty.passes == 1
    separated = spark.createDataFrame([(int(i > 50), i % 2, float(i)) for i in range(100)], "y int, fold int, a double")
    fit = B.fit_logistic(separated, "y", [B.Model(("a",), None, 0.0)])
    assert np.isfinite(fit.coefficients).all() and fit.coefficients[0, 0] > 0


def test_ridge_draws_of_a_search_share_a_fit(frame):
    got = M.random_search(frame, ["a", "c"], "y", "fold", "id", 3, {"logistic": {"regParam": [0.0, 0.1, 10.0]}}, n_iter=4).collect()
    assert [r["run"] for r in got] == [0, 1, 2, 3] and all(0.7 < r["auc"] < 0.9 for r in got)
