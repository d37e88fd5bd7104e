"""Seeded bootstrap with replacement."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import model as M
from tessera.operators import sampling as H


def test_weights_have_poisson_moments_and_repeat(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    for rate in (1.0, 0.3):
        a = H.bootstrap_weights(df, "k", 3, seed=5, rate=rate)
        row = a.agg(*[f(f"w{b}") for b in range(3) for f in (F.avg, F.var_samp)], F.corr("w0", "w1")).first()
        assert all(abs(x - rate) < 0.05 for x in row[:6]) and abs(row[6]) < 0.03
        b = H.bootstrap_weights(df.repartition(7), "k", 3, seed=5, rate=rate)
        assert a.exceptAll(b).count() == 0
    other = H.bootstrap_weights(df, "k", 1, seed=6)
    assert other.join(H.bootstrap_weights(df, "k", 1, seed=5).withColumnRenamed("w0", "v"), "k").where("w0 <> v").count() > 5000


def test_copies_equal_the_weights(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    got = H.sample_with_replacement(df, "id", 0.8, bags=2, seed=1, where=F.col("y") == 0)
    w = H.bootstrap_weights(df, "id", 2, seed=1, rate=0.8)
    for bag in (0, 1):
        n = got.where(F.col("bag") == bag).groupBy("id").agg(F.count("*").alias("n"), F.max("copy").alias("m"))
        j = w.join(n, "id", "left")
        want = F.when(F.col("y") == 1, 1).otherwise(F.col(f"w{bag}"))
        assert j.where((F.coalesce("n", F.lit(0)) != want) | (F.col("n") != F.col("m"))).count() == 0


def test_bagging_with_replacement_finds_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(1500)], "id long, y int, a double, b double")
    tr, te = df.where("id < 1000"), df.where("id >= 1000")
    p = M.bagging(tr, te, ["a", "b"], "y", "id", n_bags=3, fraction=1.0, replace=True)
    assert M.auc(p.join(te, "id"), "y", "bag_pred", "id") > 0.8


def test_thresholds():
    t = H.poisson_thresholds(1.0)
    assert abs(t[0] - np.exp(-1)) < 1e-15 and t == sorted(t) and 1 - t[-1] < 1e-14 and len(t) < 25
    assert H.poisson_thresholds(0.0) == []
