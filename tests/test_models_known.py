"""Model jobs on data with a planted answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import model as M


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1800, 3))
    y = (rng.random(1800) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(int)
    rows = [(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(1800)]
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double").repartition(4).cache()


def _auc(pred, frame, name="pred"):
    return M.auc(pred.join(frame.select("id", "y"), "id"), "y", name, "id")


def test_out_of_fold_and_test_predictions_find_the_signal(frame):
    tr, te = frame.where("id < 1200"), frame.where("id >= 1200")
    oof, test = M.oof_predict(tr, ["a", "b", "c"], "y", "fold", "id", 3, test=te)
    assert oof.count() == 1200 and test.count() == 600
    assert _auc(oof, frame) > 0.85 and _auc(test, frame) > 0.85
    noise, _ = M.oof_predict(tr, ["c"], "y", "fold", "id", 3)
    assert 0.4 < _auc(noise, frame) < 0.6
    # stacking the two single signals beats either
    long = None
    for name, f in (("a", ["a"]), ("b", ["b"])):
        p, _ = M.oof_predict(tr, f, "y", "fold", "id", 3)
        p = p.select("id", F.lit(name).alias("model"), "pred")
        long = p if long is None else long.unionByName(p)
    single = max(_auc(long.where(F.col("model") == m).select("id", "pred"), frame) for m in "ab")
    stack, _ = M.stack_layer(long, tr, "id", "y", "fold", 3)
    assert _auc(stack, frame, [c for c in stack.columns if c.endswith("pred")][0]) > single + 0.01


def test_pseudo_labels_are_those_of_confident_rows(frame):
    tr, te = frame.where("id < 1200").drop("fold"), frame.where("id >= 1200").drop("fold")
    pred = te.select("id", (1 / (1 + F.exp(-2 * F.col("a") + F.col("b")))).alias("pred"))
    out = M.pseudo_label(tr, pred, te, "y", "id", hi=0.9, lo=0.1)
    added = out.join(tr.select("id"), "id", "left_anti").join(pred, "id")
    assert added.count() == pred.where("pred > 0.9 or pred < 0.1").count() > 50
    assert added.where("(y = 1) <> (pred > 0.9)").count() == 0


def test_adversarial_selection_keeps_the_rows_like_the_test_rows(spark):
    rng = np.random.default_rng(2)
    old = rng.normal(0, 1, 600)
    new = rng.normal(4, 1, 300)
    train = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate([*old, *new])], "id long, a double, b double")
    test = spark.createDataFrame([(10_000 + i, float(v), 0.0) for i, v in enumerate(rng.normal(4, 1, 400))], "id long, a double, b double")
    kept = {r["id"] for r in M.adversarial_selection(train, test, ["a"], "id", keep_n=300).collect()}
    assert len(kept) == 300 and len([i for i in kept if i >= 600]) > 280


def test_calibrated_scores_are_probabilities_of_the_signal(frame):
    out = M.calibrated_svm(frame.where("id < 1200"), ["a", "b"], "y", "fold", "id", 3, test=frame.where("id >= 1200"))
    d = out.join(frame.select("id", "y"), "id").toPandas()
    assert set(d.part) == {"oof", "test"} or len(set(d.part)) == 2
    for _, g in d.groupby("part"):
        assert abs(g.calibrated.mean() - g.y.mean()) < 0.05
        assert g[g.calibrated > 0.8].y.mean() > 0.7 > 0.3 > g[g.calibrated < 0.2].y.mean()


def test_kept_rows_are_computed_once(spark):
    from tessera.operators.model import _materialise
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kept = _materialise(spark.range(100).mapInArrow(count, "id long"))
    assert kept.count() == 100 and seen.value == 100


def test_folds_of_the_factorisation_read_kept_rows(spark, monkeypatch):
    """The coded rows are written once, not coded again in every fold."""
    from tessera.operators import category as C
    kept, once = [], C._once
    monkeypatch.setattr(C, "_once", lambda df: kept.append(df.columns) or once(df))
    rows = spark.createDataFrame([(i, i % 5, i % 3, i % 2, i % 2) for i in range(60)], "id long, u long, k long, y int, fold int")
    out = C.mf_oof_feature(rows, "u", "k", "y", "fold", 2)
    assert out.count() == 60 and sum("_y" in c for c in kept) == 1
