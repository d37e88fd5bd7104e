"""Registered model-job queries (M01-M15) on the modelling frame.

Train rows are days 1-24, test rows days 25-30; K = 3 hashed stratified
folds. The "model outputs" blended by M05-M10 and M15 are fixed functions of
the frame's columns (``p_a``, ``p_b``, ``p_c``), so those queries are
checked against SQL.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.catalog.modeling import EVX, FEATS, evx
from tessera.catalog.registry import register
from tessera.catalog.select import _long_sql
from tessera.functions.columns import rnd
from tessera.operators import model as M
from tessera.operators import sampling as H
from tessera.operators import select as L
from tessera.session import ensure_checkpoint_dir, written

K = 3
SMALL = ["value", "hr", "user_n", "k_n"]
FOLD5 = "(row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(event_id AS VARCHAR), '|', '42')), event_id) - 1) % 5"


def _train_test(spark, sf):
    """Written once: every fit and score of a job reads them again."""
    d = written(evx(spark, sf), "model-frame")
    tr = H.kfold(d.where("day_i <= 24"), "event_id", K, seed=42, label="y")
    return written(tr, "model-folds"), d.where("day_i > 24")


@register("M01_oof_prediction")
def m01(spark, sf):
    tr, te = _train_test(spark, sf)
    oof, tp = M.oof_predict(tr, SMALL, "y", "fold", "event_id", K, test=te)
    return (oof.withColumn("part", F.lit("oof")).unionByName(tp.withColumn("part", F.lit("test"))))


@register("M02_stacking_layer")
def m02(spark, sf):
    tr, te = _train_test(spark, sf)
    longs, tests = None, None
    for name, feats in (("lr_value", ["value", "hr"]), ("lr_counts", ["user_n", "k_n"])):
        oof, tp = M.oof_predict(tr, feats, "y", "fold", "event_id", K, test=te)
        o = oof.select("event_id", F.lit(name).alias("model"), "pred")
        t = tp.select("event_id", F.lit(name).alias("model"), "pred")
        longs = o if longs is None else longs.unionByName(o)
        tests = t if tests is None else tests.unionByName(t)
    oof2, test2 = M.stack_layer(longs, tr, "event_id", "y", "fold", K, test_long=tests)
    return oof2.withColumn("part", F.lit("oof")).unionByName(test2.withColumn("part", F.lit("test")))


@register("M03_result_repository")
def m03(spark, sf):
    tr, te = _train_test(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prediction_repository-{uuid.uuid4().hex}"
    repo = M.PredictionRepository(spark, root)
    for name, feats in (("lr_a", ["value"]), ("lr_b", SMALL)):
        oof, tp = M.oof_predict(tr, feats, "y", "fold", "event_id", K, test=te)
        score = M.auc(oof.join(tr.select("event_id", "y"), "event_id"), "y", "pred", "event_id")
        repo.save(name, oof, tp, score)
    best = repo.scores().orderBy(F.desc("score"), "model_id").limit(1).select("model_id")
    return repo.select("test").join(best, "model_id", "left_semi")


@register("M04_random_parameter_search")
def m04(spark, sf):
    tr, _ = _train_test(spark, sf)
    spaces = {"logistic": {"regParam": [0.0, 0.01, 0.1], "maxIter": [10, 25], "elasticNetParam": [0.0, 0.5]},
              "random_forest": {"maxDepth": [3, 5], "numTrees": [5, 10], "seed": [1]}}
    return M.random_search(tr, SMALL, "y", "fold", "event_id", K, spaces, n_iter=4, seed=0)


@register("M05_top_n_configurations", sql=f"""
WITH l AS ({_long_sql()}),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value)
        + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM l),
s AS (SELECT feature, sum(rk) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS n1,
        count(*) FILTER (WHERE y = 0) AS n0 FROM r GROUP BY feature),
a AS (SELECT feature, (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM s)
SELECT feature, RND(auc) AS auc FROM a ORDER BY auc DESC, feature LIMIT 3""")
def m05(spark, sf):
    """Runs = single-feature models scored by AUC; the best three."""
    long = L.long_format(evx(spark, sf), "event_id", FEATS, "y")
    runs = L.feature_auc(long, "y", "event_id")
    return M.top_n(runs, "auc", 3, tie="feature").select("feature", rnd("auc").alias("auc"))


@register("M06_metrics", sql=f"""
WITH d AS (SELECT event_id, y, p_a, {FOLD5} AS fold FROM {EVX}),
r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p_a) + (count(*) OVER (PARTITION BY fold, p_a) - 1) / 2.0 AS rk
      FROM d),
a AS (SELECT fold, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY fold),
m AS (SELECT fold, avg(-(y * ln(least(greatest(p_a, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p_a, 1e-15), 1 - 1e-15))))
        AS logloss, sqrt(avg((p_a - y) * (p_a - y))) AS rmse FROM d GROUP BY fold),
p AS (SELECT * FROM a JOIN m USING (fold))
SELECT RND(avg(auc)) AS auc_mean, RND(stddev_samp(auc)) AS auc_std, RND(avg(logloss)) AS logloss_mean,
  RND(stddev_samp(logloss)) AS logloss_std, RND(avg(rmse)) AS rmse_mean, RND(stddev_samp(rmse)) AS rmse_std FROM p""",
          headline=True)
def m06(spark, sf):
    d = H.kfold(evx(spark, sf), "event_id", 5, seed=42, label="y")
    out = M.fold_metrics(d, "y", "p_a", "fold", "event_id")
    return out.select(*[rnd(c).alias(c) for c in out.columns])


PART = "CASE WHEN day_i <= 20 THEN 'train' WHEN day_i <= 24 THEN 'valid' ELSE 'holdout' END"


@register("M06_metric_gaps", sql=f"""
WITH e AS (SELECT {PART} AS part, y, p_a FROM {EVX}), d AS (SELECT * FROM e UNION ALL SELECT 'all', y, p_a FROM e),
r AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY p_a) + (count(*) OVER (PARTITION BY part, p_a) - 1) / 2.0 AS rk FROM d),
a AS (SELECT part, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY part),
m AS (SELECT part, count(*) AS n, avg(-(y * ln(least(greatest(p_a, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p_a, 1e-15), 1 - 1e-15))))
        AS logloss, sqrt(avg((p_a - y) * (p_a - y))) AS rmse, corr(p_a, y) AS corr FROM d GROUP BY part),
p AS (SELECT * FROM a JOIN m USING (part)), t AS (SELECT * FROM p WHERE part = 'train')
SELECT p.part, p.n AS "rows", RND(p.auc) AS auc, RND(p.logloss) AS logloss, RND(p.rmse) AS rmse, round(p.corr, 6) AS corr,
  round(p.auc - t.auc, 6) AS auc_gap, round(p.logloss - t.logloss, 6) AS logloss_gap, round(p.rmse - t.rmse, 6) AS rmse_gap,
  round(p.corr - t.corr, 6) AS corr_gap FROM p, t""")
def m06_gaps(spark, sf):
    d = evx(spark, sf).withColumn("part", F.expr(PART))
    out = M.metric_gaps(d, "part", "y", "p_a")
    return out.select("part", "rows", *[rnd(c).alias(c) for c in ("auc", "logloss", "rmse")],
                      *[F.round(c, 6).alias(c) for c in ("corr", "auc_gap", "logloss_gap", "rmse_gap", "corr_gap")])


@register("M07_rank_weighted_blend", sql=f"""
WITH d AS (SELECT event_id, p_a, p_b, count(*) OVER () AS n,
             rank() OVER (ORDER BY p_a) + (count(*) OVER (PARTITION BY p_a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY p_b) + (count(*) OVER (PARTITION BY p_b) - 1) / 2.0 AS rb FROM {EVX}),
b AS (SELECT event_id, p_a * (ra + 1) / n AS p_a_rank, p_b * (rb + 1) / n AS p_b_rank,
        (p_a * (ra + 1) / n * 2 + p_b * (rb + 1) / n * 8) / 10 AS blend FROM d)
SELECT event_id, RND(p_a_rank) AS p_a_rank, RND(p_b_rank) AS p_b_rank, RND(blend) AS blend,
  RND(rank() OVER (ORDER BY blend) + (count(*) OVER (PARTITION BY blend) - 1) / 2.0) AS blend_RANK FROM b""")
def m07(spark, sf):
    d = evx(spark, sf).select("event_id", "p_a", "p_b")
    out = M.rank_weighted_blend(d, ["p_a", "p_b"], [2, 8], "event_id")
    return out.select("event_id", *[rnd(c).alias(c) for c in ("p_a_rank", "p_b_rank", "blend", "blend_RANK")])


@register("M08_fixed_weight_blend", sql=f"SELECT event_id, RND(0.3 * p_a + 0.7 * p_b) AS blend FROM {EVX}")
def m08(spark, sf):
    d = evx(spark, sf)
    return d.select("event_id", rnd(M.weighted_blend(["p_a", "p_b"], [0.3, 0.7])).alias("blend"))


M09_PREDS = ["p_a", "p_b", "p_c"]


def _m09_cands(n_weight=5, n_search=30, seed=0):
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n_search):
        w = rng.randint(n_weight, size=len(M09_PREDS))
        if w.sum():
            out.append([int(x) for x in w])
    return out


def _m09_sql():
    sel = []
    for i, w in enumerate(_m09_cands()):
        p = f"(({' + '.join(f'{x}.0 * {c}' for c, x in zip(M09_PREDS, w))}) / {sum(w)}.0)"
        q = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
        sel.append(f"SELECT {i} AS candidate, '{','.join(map(str, w))}' AS weights, "
                   f"RND(avg(-(y * ln({q}) + (1 - y) * ln(1 - {q})))) AS logloss FROM {EVX}")
    return " UNION ALL ".join(sel)


@register("M09_blend_weight_search", sql=_m09_sql())
def m09(spark, sf):
    d = evx(spark, sf)
    out = M.blend_weight_search(d, M09_PREDS, "y", n_weight=5, n_search=30, seed=0)
    return out.select(F.col("candidate").cast("int").alias("candidate"), "weights", rnd("logloss").alias("logloss"))


@register("M10_prediction_combine", sql=f"""
WITH l AS (SELECT event_id, y, 'p_a' AS model, p_a AS pred FROM {EVX} UNION ALL SELECT event_id, y, 'p_b', p_b FROM {EVX}
           UNION ALL SELECT event_id, y, 'p_c', p_c FROM {EVX}),
r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0 AS rk
      FROM l),
s AS (SELECT model, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS score FROM r GROUP BY model),
k AS (SELECT l.* FROM l JOIN s USING (model) WHERE s.score >= 0.49)
SELECT event_id, RND(max(pred) FILTER (WHERE model = 'p_a')) AS p_a, RND(max(pred) FILTER (WHERE model = 'p_b')) AS p_b,
  RND(max(pred) FILTER (WHERE model = 'p_c')) AS p_c FROM k GROUP BY event_id""")
def m10(spark, sf):
    d = evx(spark, sf)
    long = None
    for m in ("p_a", "p_b", "p_c"):
        part = d.select("event_id", "y", F.lit(m).alias("model"), F.col(m).alias("pred"))
        long = part if long is None else long.unionByName(part)
    scores = M.auc_by_group(long, "model", "y", "pred", "event_id").withColumnRenamed("auc", "score")
    wide = M.combine_predictions(long, "event_id", scores, 0.49)
    cols = [c for c in ("p_a", "p_b", "p_c")]
    for c in cols:
        if c not in wide.columns:
            wide = wide.withColumn(c, F.lit(None).cast("double"))
    return wide.select("event_id", *[rnd(c).alias(c) for c in cols])


@register("M11_pseudo_labelling")
def m11(spark, sf):
    tr, te = _train_test(spark, sf)
    _, tp = M.oof_predict(tr, SMALL, "y", "fold", "event_id", K, test=te)
    aug = M.pseudo_label(tr, tp, te, "y", "event_id", hi=0.3, lo=0.1)
    aug = H.kfold(aug.drop("fold"), "event_id", K, seed=43, label="y")
    oof, tp2 = M.oof_predict(aug, SMALL, "y", "fold", "event_id", K, test=te)
    return tp2


@register("M12_adversarial_holdout")
def m12(spark, sf):
    tr, te = _train_test(spark, sf)
    n = tr.count()
    return M.adversarial_selection(tr.drop("fold"), te, SMALL, "event_id", keep_n=int(n * 0.8), k=K)


@register("M13_probability_calibration")
def m13(spark, sf):
    tr, te = _train_test(spark, sf)
    return M.calibrated_svm(tr, SMALL, "y", "fold", "event_id", K, test=te)


@register("M14_bagging")
def m14(spark, sf):
    tr, te = _train_test(spark, sf)
    return M.bagging(tr, te, SMALL, "y", "event_id", n_bags=3, fraction=0.7, column_fraction=0.7)


@register("M14_bootstrap_bagging")
def m14_bootstrap(spark, sf):
    tr, te = _train_test(spark, sf)
    return M.bagging(tr, te, SMALL, "y", "event_id", n_bags=3, fraction=1.0, column_fraction=0.7, replace=True)


def _m15_sql():
    """Runs = single-feature scorers; CV = mean AUC over 5 hashed folds of
    days 1-24, public = AUC on days 25-27, private = AUC on days 28-30."""
    rows = " UNION ALL ".join(
        f"SELECT event_id, y, day_i, fold, '{f}' AS feature, {f} AS value FROM d" for f in FEATS)
    return f"""
WITH d AS (SELECT *, {FOLD5} AS fold FROM {EVX} x WHERE day_i <= 24
           UNION ALL SELECT *, NULL AS fold FROM {EVX} x WHERE day_i > 24),
l AS ({rows}),
g AS (SELECT *, CASE WHEN day_i <= 24 THEN 'cv' || CAST(fold AS VARCHAR) WHEN day_i <= 27 THEN 'public' ELSE 'private' END AS grp
      FROM l),
r AS (SELECT feature, grp, y, rank() OVER (PARTITION BY feature, grp ORDER BY value)
        + (count(*) OVER (PARTITION BY feature, grp, value) - 1) / 2.0 AS rk FROM g),
a AS (SELECT feature, grp, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY ALL),
runs AS (SELECT feature, avg(auc) FILTER (WHERE grp LIKE 'cv%') AS cv, max(auc) FILTER (WHERE grp = 'public') AS public,
           max(auc) FILTER (WHERE grp = 'private') AS private FROM a GROUP BY feature)
SELECT RND(corr(cv, public)) AS corr_cv_public, RND(corr(cv, private)) AS corr_cv_private,
  RND(corr(public, private)) AS corr_public_private FROM runs"""


@register("M15_score_agreement", sql=_m15_sql())
def m15(spark, sf):
    d = evx(spark, sf)
    tr = H.kfold(d.where("day_i <= 24"), "event_id", 5, seed=42, label="y")
    rest = d.where("day_i > 24").withColumn("fold", F.lit(None).cast("int"))
    d = tr.unionByName(rest)
    grp = (F.when(F.col("day_i") <= 24, F.concat(F.lit("cv"), F.col("fold").cast("string")))
           .when(F.col("day_i") <= 27, F.lit("public")).otherwise(F.lit("private")))
    long = L.long_format(d.withColumn("grp", grp), "event_id", FEATS, "y")
    long = long.join(d.select("event_id", grp.alias("grp")), "event_id")
    long = long.withColumn("fg", F.concat_ws("#", "feature", "grp"))
    a = M.auc_by_group(long, "fg", "y", "value", "event_id")
    a = a.select(F.split("fg", "#")[0].alias("feature"), F.split("fg", "#")[1].alias("grp"), "auc")
    runs = a.groupBy("feature").agg(F.avg(F.when(F.col("grp").startswith("cv"), F.col("auc"))).alias("cv"),
                                    F.max(F.when(F.col("grp") == "public", F.col("auc"))).alias("public"),
                                    F.max(F.when(F.col("grp") == "private", F.col("auc"))).alias("private"))
    out = M.score_agreement(runs, ["cv", "public", "private"])
    return out.select(*[rnd(c).alias(c) for c in out.columns])
