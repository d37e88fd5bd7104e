"""Distributed factorisations against numpy and planted structure."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import category as C
from tessera.plans.factor import hashed_factor, non_negative, pair_cells, randomised_svd, topics


def _cells(spark, matrices):
    rows = [(g, f"r{i}", f"c{j}", float(m[i, j])) for g, m in matrices.items() for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "_g string, _r string, _c string, _v double")


def test_singular_values_and_rows_match_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((120, 8)) @ np.diag([30, 20, 12, 8, 5, 1, .5, .2]) @ rng.standard_normal((8, 60))
    a += 0.3 * rng.standard_normal(a.shape) * (rng.random(a.shape) < 0.3)
    a[:, 0] += 50  # one column in a third of the weight
    low = np.outer(np.arange(1.0, 21), np.ones(7))  # rank one
    rows, sigma = randomised_svd(_cells(spark, {"a": a, "low": low}), 4)
    for g, m in (("a", a), ("low", low)):
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        assert np.abs(sigma[g] - np.where(np.arange(4) < np.linalg.matrix_rank(m), s[:4], 0)).max() < 1e-6 * s[0]
        got = {r["_r"]: [r[f"_{i}"] for i in range(4)] for r in rows.where(F.col("_g") == g).collect()}
        e = np.array([got[f"r{i}"] for i in range(len(m))])
        want = u[:, :4] * s[:4]
        for i in range(4 if g == "a" else 1):
            assert min(np.abs(e[:, i] - want[:, i]).max(), np.abs(e[:, i] + want[:, i]).max()) < 1e-5 * s[0]
    assert randomised_svd(_cells(spark, {}).limit(0), 2)[0].collect() == []


def test_all_ordered_pairs_in_as_many_jobs_as_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), int(rng.integers(12)), int(rng.integers(9)), int(rng.integers(7))) for i in range(600)],
                               "id long, a int, b int, c int").cache()
    pairs = [(x, y) for x in "abc" for y in "abc" if x != y]
    tracker = spark.sparkContext.statusTracker()

    def jobs(run):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "")
        out = {tuple(r) for r in run().collect()}
        spark.sparkContext.setJobGroup("", "")
        return out, len(tracker.getJobIdsForGroup(group))

    for f in (C.topic_pairs, C.nmf_pairs):
        every, many = jobs(lambda: f(df, pairs, k=2, max_iter=3))
        first, one = jobs(lambda: f(df, pairs[:1], k=2, max_iter=3))
        assert many <= one * 1.2 + 2
        assert {r[0] for r in every} == {f"{x}|{y}" for x, y in pairs}
        mine = {(r[0], r[1]): r[2:] for r in every if r[0] == "a|b"}
        assert all(np.allclose(mine[r[0], r[1]], r[2:], atol=1e-9) for r in first) and len(mine) == len(first)


def test_topics_find_planted_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i}", f"w{int(rng.integers(6)) + 6 * (i % 2)}") for i in range(40) for _ in range(30)]
    df = spark.createDataFrame(rows, "doc string, word string")
    got = {r["doc"]: np.array(r[1:]) for r in C.lda_topics(df, "doc", "word", k=2).collect()}
    assert all(abs(v.sum() - 1) < 1e-9 and v.max() > 0.9 for v in got.values())
    assert len({got[f"d{i}"].argmax() for i in range(0, 40, 2)}) == 1
    assert got["d0"].argmax() != got["d1"].argmax()


def test_non_negative_updates_match_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.random((15, 3)) @ rng.random((3, 10))
    cells = _cells(spark, {"x": m})
    w, h = (np.array([r[2:] for r in sorted(hashed_factor(cells, side, 3, 0, 0.1, 1.1).collect(), key=lambda r: int(r[1][1:]))])
            for side in ("_r", "_c"))
    for _ in range(4):
        w = w * (m @ h) / (w @ (h.T @ h) + 1e-12)
        h = h * (m.T @ w) / (h @ (w.T @ w) + 1e-12)
    got_w, got_h = non_negative(cells, 3, max_iter=4)
    for got, want in ((got_w, w), (got_h, h)):
        rows = sorted(got.collect(), key=lambda r: int(r[1][1:]))
        assert np.allclose([r[2:] for r in rows], want, rtol=1e-9)


def test_nulls_and_hot_values_in_pair_cells(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, None), (2, "y")], "a int, b string")
    assert {tuple(r) for r in pair_cells(df, [("a", "b"), ("b", "a")]).collect()} == {
        ("a|b", "1", "x", 2.0), ("a|b", "2", "y", 1.0), ("b|a", "x", "1", 2.0), ("b|a", "y", "2", 1.0)}


def test_category_vectors_repeat_and_group_alike_tokens(spark):
    """Tokens that meet the same partners point the same way; an unseen token
    is zero; a second run over other partitions agrees."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        side = int(rng.integers(2))
        rows.append((i, f"u{side}{int(rng.integers(3))}", f"i{side}{int(rng.integers(3))}", None if i % 50 == 0 else f"o{side}"))
    df = spark.createDataFrame(rows, "id long, u string, i string, o string")
    one = {r["token"]: np.array(r["vector"]) for r in C.category_vectors(df, ["u", "i", "o"], size=4).collect()}
    two = {r["token"]: np.array(r["vector"]) for r in C.category_vectors(df.repartition(7), ["u", "i", "o"], size=4).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[t], two[t], atol=1e-9) for t in one)

    def cos(a, b):
        return one[a] @ one[b] / np.sqrt((one[a] @ one[a]) * (one[b] @ one[b]))

    assert cos("u=u00", "u=u01") > 0.8 > 0.3 > cos("u=u00", "u=u10")
    new = spark.createDataFrame([(1, "u00", "never", "o0")], "id long, u string, i string, o string")
    v = C.category2vec(new, "id", ["u", "i", "o"], size=4, fit_on=df).first()["cat2vec"]
    assert len(v) == 12 and v[4:8] == [0.0] * 4 and any(v[:4])


@pytest.mark.parametrize("k", [1, 3])
def test_more_dimensions_than_columns(spark, k):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x")], "a int, b string")
    got = C.svd_embedding(df, "a", "b", k=k).orderBy("a").collect()
    assert [abs(round(r[1], 6)) for r in got] == [1.0, 2.0] and all(abs(x) < 1e-6 for r in got for x in r[2:])


def test_factorisation_machine_beats_plain_factorisation(spark):
    """The label follows a taste of the user's group for the item's group, and
    the groups are side columns; users and items alone are met too rarely."""
    from tessera.operators import model as M
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4000):
        u, t = int(rng.integers(1500)), int(rng.integers(800))
        x = float(rng.standard_normal())
        like = 1.5 if (u % 2) == (t % 2) else -1.5
        rows.append((i, u, t, f"g{u % 2}" if i % 97 else None, f"h{t % 2}", x if i % 89 else None, int(rng.random() < 1 / (1 + np.exp(-like - x))), i % 3))
    df = spark.createDataFrame(rows, "id long, u long, t long, gu string, gt string, x double, y int, fold int")
    fm = C.fm_oof_feature(df, "id", "u", "t", "y", "fold", 3, side=["gu", "gt"], numeric=["x"], buckets=1 << 13, max_iter=80)
    als = C.mf_oof_feature(df, "u", "t", "y", "fold", 3).select("id", F.coalesce(F.nanvl("mf_score", F.lit(0.5)), F.lit(0.5)).alias("s"))
    fm_rows = fm.collect()
    assert len(fm_rows) == 4000 and all(0 <= r["fm_score"] <= 1 for r in fm_rows)
    a = M.auc(fm.join(df.select("id", "y"), "id"), "y", "fm_score", "id")
    b = M.auc(als.join(df.select("id", "y"), "id"), "y", "s", "id")
    assert a > 0.65 and a > b + 0.1, (a, b)


def test_a_short_side_takes_one_pass_whatever_the_rounds(spark, monkeypatch):
    """Rounds of a matrix with a short side write nothing; the singular values
    and rows are those of the dense matrix, on either side."""
    from tessera.plans import factor
    rng = np.random.RandomState(3)
    a = rng.rand(40, 25)
    for m in (a, a.T):
        cells = spark.createDataFrame([("g", f"r{i:02d}", f"c{j:02d}", float(v)) for (i, j), v in np.ndenumerate(m)],
                                      "_g string, _r string, _c string, _v double")
        calls, write = [], factor.written
        with monkeypatch.context() as p:
            p.setattr(factor, "written", lambda df, name: calls.append(name) or write(df, name))
            rows, sigma = factor.randomised_svd(cells, 3, max_iter=200, tol=1e-12)
        assert len(calls) <= 4
        u, s, _ = np.linalg.svd(m)
        assert np.allclose(sigma["g"], s[:3])
        got = np.array([[r["_0"], r["_1"], r["_2"]] for r in rows.orderBy("_r").collect()])
        assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-5)


def test_machines_of_all_folds_learn_together_as_one_by_one(spark):
    """The scores are FMClassifier's, fold by fold; the passes do not grow with the folds."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(5)
    rows = [(i, f"u{rng.integers(30)}" if i % 31 else None, f"t{rng.integers(9)}", float(rng.standard_normal()) if i % 17 else 0.0,
             int(rng.random() < .4) if i % 13 else None, i % 3 if i % 50 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, u string, t string, x double, y int, fold int")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "")
    got = {r["id"]: r["fm_score"] for r in C.fm_oof_feature(df, "id", "u", "t", "y", "fold", 3, numeric=["x"], buckets=64, max_iter=12).collect()}
    spark.sparkContext.setJobGroup("rest", "")
    assert len(jobs.getJobIdsForGroup("folds")) < 3 * 12 + 20
    m, s = df.agg(F.avg("x"), F.stddev("x")).first()
    plain = df.select("id", "fold", F.col("y").cast("double").alias("_y"), F.coalesce("u", F.lit("\0")).alias("_c0"), F.col("t").alias("_c1"),
                      F.nullif((F.col("x") - m) / s, F.lit(0.0)).alias("_n0"))
    plain = FeatureHasher(inputCols=["_c0", "_c1", "_n0"], outputCol="features", numFeatures=64).transform(plain).cache()
    want = {}
    for f in range(3):
        fm = FMClassifier(labelCol="_y", factorSize=4, maxIter=12, stepSize=0.1, regParam=1e-4, seed=0, solver="adamW")
        model = fm.fit(plain.where((F.col("fold") != f) & F.col("_y").isNotNull()))
        want |= {r[0]: r[1] for r in model.transform(plain.where(F.col("fold") == f)).select("id", vector_to_array("probability")[1]).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
