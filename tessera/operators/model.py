"""Model jobs around ``pyspark.ml`` estimators.

Metrics are SQL aggregates (rank-sum AUC with average ranks from the
distributed rank; log-loss clipped at 1e-15), so they scale with the data
and agree with DuckDB. Out-of-fold training loops over K folds on the
driver, each fit is a distributed ``pyspark.ml`` job; the assembled feature
vectors are persisted once for the loop and released after it. Predictions
are kept long (id, model, pred) and pivoted only when stacked.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.plans.positions import average_rank as mean_rank
from tessera.plans.positions import global_rank, value_ranks
from tessera.session import written

EPS = 1e-15


# ------------------------------------------------------------------- ranks
def average_rank(df: DataFrame, value: str, id_col: str, name: str = "rank") -> DataFrame:
    """pandas ``rank()`` (1-based, ties share the mean rank): the different
    values are ranked with their counts, then joined back."""
    return average_ranks(df, [value], {value: name})


def average_ranks(df: DataFrame, values: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """``average_rank`` of several columns: all are ranked in one pass over a
    long table of their different values. NULL has no rank."""
    pairs = F.array(*[F.struct(F.lit(v).alias("_what"), F.col(v).cast("double").alias("_x")) for v in values])
    long = df.select(F.explode(pairs).alias("p")).select("p._what", "p._x").where("_x is not null")
    ranked = written(value_ranks(long, ["_what"], "_x").select("_what", "_x", mean_rank().alias("_rank")), "ranks")
    out = df
    for v in values:
        mine = ranked.where(F.col("_what") == v).select(F.col("_x").alias(f"_x_{v}"), F.col("_rank").alias(names[v]))
        out = out.join(mine, F.col(v).cast("double") == F.col(f"_x_{v}"), "left").drop(f"_x_{v}")
    return out


# ----------------------------------------------------------------- metrics
def auc(df: DataFrame, label: str, score: str, id_col: str) -> float | None:
    """ROC-AUC by the rank-sum formula with average ranks for ties."""
    row = auc_by_group(df.withColumn("_one", F.lit(1)), "_one", label, score, id_col).first()
    return row["auc"] if row else None


def auc_by_group(df: DataFrame, group: str, label: str, score: str, id_col: str) -> DataFrame:
    """ROC-AUC per group (e.g. per candidate feature or per fold), all groups
    in one distributed pass: the different scores of a group with their
    counts and positives are ranked, then summed. NULL for a group of one
    class."""
    v = value_ranks(df.where(F.col(score).isNotNull()), [group], score,
                    _pos=F.count_if(F.col(label) == 1), _neg=F.count_if(F.col(label) == 0))
    n1, n0 = F.sum("_pos"), F.sum("_neg")
    return v.groupBy(group).agg(F.try_divide(F.sum(mean_rank() * F.col("_pos")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def logloss_expr(label, p) -> Column:
    q = F.least(F.greatest(col(p), F.lit(EPS)), F.lit(1 - EPS))
    return -(col(label) * F.log(q) + (1 - col(label)) * F.log(1 - q))


def metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """M06 (non-rank part): log-loss (clipped), RMSE, correlation, one row."""
    return df.agg(F.avg(logloss_expr(label, score)).alias("logloss"),
                  F.sqrt(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("rmse"),
                  F.corr(score, label).alias("corr"))


def part_metrics(df: DataFrame, part: str, label: str, score: str) -> DataFrame:
    """M06 per part (a fold, or train / valid / holdout): ``rows``, ``auc``,
    ``logloss`` (clipped), ``rmse`` and ``corr`` of score and 0/1 label, all from
    one table of the different scores with their positives and negatives.
    Rows without score or label count nowhere."""
    v = value_ranks(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), [part], score,
                    _pos=F.count_if(F.col(label) == 1), _neg=F.count_if(F.col(label) == 0))
    s, n1, n0 = F.col(score).cast("double"), F.sum("_pos"), F.sum("_neg")
    n = n1 + n0
    loss = F.col("_pos") * logloss_expr(F.lit(1), score) + F.col("_neg") * logloss_expr(F.lit(0), score)
    square = F.col("_pos") * F.pow(s - 1, 2) + F.col("_neg") * F.pow(s, 2)
    both = F.col("_pos") + F.col("_neg")
    sx, sxx, sxy = F.sum(s * both), F.sum(s * s * both), F.sum(s * F.col("_pos"))
    corr = F.try_divide(n * sxy - sx * n1, F.sqrt((n * sxx - sx * sx) * (n * n1 - n1 * n1)))
    return v.groupBy(part).agg(
        n.alias("rows"), F.try_divide(F.sum(mean_rank() * F.col("_pos")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
        F.try_divide(F.sum(loss), n).alias("logloss"), F.sqrt(F.try_divide(F.sum(square), n)).alias("rmse"), corr.alias("corr"))


def fold_metrics(df: DataFrame, label: str, score: str, fold: str, id_col: str) -> DataFrame:
    """AUC, log-loss and RMSE per fold, then their mean and std over
    folds (one row per statistic)."""
    per = part_metrics(df, fold, label, score)
    return per.agg(*[f(c).alias(f"{c}_{n}") for c in ("auc", "logloss", "rmse")
                     for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def metric_gaps(df: DataFrame, part: str, label: str, score: str, base: str = "train") -> DataFrame:
    """``part_metrics`` with each part's gap to ``base`` (e.g. validation
    and holdout against train) and a row ``all`` over every part."""
    rows = df.select(F.explode(F.array(F.col(part).cast("string"), F.lit("all"))).alias(part), label, score)
    per = written(part_metrics(rows, part, label, score), "part-metrics")
    at = per.where(F.col(part) == base).select(*[F.col(c).alias(f"_{c}") for c in ("auc", "logloss", "rmse", "corr")])
    return per.join(at, F.lit(True), "left").select(  # one row: the base
        *per.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_gap") for c in ("auc", "logloss", "rmse", "corr")])


# ---------------------------------------------------------------- M01-M02
def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def default_estimator(label: str):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=25, regParam=0.01)


def oof_predict(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int,
                test: DataFrame | None = None, estimator: Callable | None = None,
                name: str = "pred", materialise: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """For each fold, fit on the other folds and predict it; the test
    prediction is the mean of the K models. Returns (oof rows, test rows),
    each ``(id, pred)``. With ``materialise`` the predictions are written
    to the checkpoint folder before the cached inputs are released (the
    lineage of K fits is long); inner selection loops score right away."""
    from pyspark.ml.functions import vector_to_array
    make = estimator or (lambda: default_estimator(label))
    tr = assemble(train.select(id_col, label, fold, *features), features).persist()
    te = assemble(test.select(id_col, *features), features).persist() if test is not None else None
    oof, tpred = None, None
    try:
        for f in range(k):
            model = make().fit(tr.where(F.col(fold) != f))
            p = model.transform(tr.where(F.col(fold) == f))
            p = p.select(id_col, vector_to_array("probability")[1].alias(name))
            oof = p if oof is None else oof.unionByName(p)
            if te is not None:
                q = model.transform(te).select(id_col, vector_to_array("probability")[1].alias(name))
                tpred = q if tpred is None else tpred.unionByName(q)
        if tpred is not None:
            tpred = tpred.groupBy(id_col).agg(F.avg(name).alias(name))
        if materialise:
            # materialise while the inputs are cached, then release them
            oof = _materialise(oof)
            tpred = _materialise(tpred) if tpred is not None else None
    finally:
        tr.unpersist()
        if te is not None:
            te.unpersist()
    return oof, tpred


def _materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (survives a lost
    executor). Parquet: the rows are computed once, where ``checkpoint``
    computes its last stage twice."""
    return written(df, "model-rows")


def _model_names(d: DataFrame, model_col: str) -> list[str]:
    """Distinct model names: one column per model follows."""
    return sorted(r[0] for r in d.select(model_col).distinct().collect())


def stack_layer(preds_long: DataFrame, labels: DataFrame, id_col: str, label: str, fold: str, k: int,
                model_col: str = "model", pred_col: str = "pred", test_long: DataFrame | None = None):
    """Layer-1 OOF predictions (long: id, model, pred) become the
    layer-2 inputs: pivot to one column per model, then M01 again."""
    models = _model_names(preds_long, model_col)
    wide = preds_long.groupBy(id_col).pivot(model_col, models).agg(F.first(pred_col))
    tr = wide.join(labels.select(id_col, label, fold), id_col)
    te = test_long.groupBy(id_col).pivot(model_col, models).agg(F.first(pred_col)) if test_long is not None else None
    return oof_predict(tr, models, label, fold, id_col, k, test=te, name="stack_pred")


def stack_labels(preds_long: DataFrame, labels: DataFrame, id_col: str, label_cols: Sequence[str], fold: str, k: int,
                 depth: int = 1, model_col: str = "model", pred_col: str = "pred",
                 test_long: DataFrame | None = None) -> DataFrame:
    """M02 for several labels and layers in one call: for every label, layer
    1 sees the given predictions, and each further layer those and the
    stacked predictions of the layers before. (id, label, layer, part, pred)."""
    out = []
    for label in label_cols:
        preds, tests = preds_long, test_long
        for layer in range(1, depth + 1):
            oof, test = stack_layer(preds, labels, id_col, label, fold, k, model_col, pred_col, tests)
            for part, d in (("oof", oof), ("test", test)):
                if d is not None:
                    out.append(d.select(id_col, F.lit(label).alias("label"), F.lit(layer).alias("layer"),
                                        F.lit(part).alias("part"), F.col("stack_pred").alias("pred")))
            name = [F.lit(f"stack_{layer}").alias(model_col), F.col("stack_pred").alias(pred_col)]
            preds = preds.select(id_col, model_col, pred_col).unionByName(oof.select(id_col, *name))
            if test is not None:
                tests = tests.select(id_col, model_col, pred_col).unionByName(test.select(id_col, *name))
    return functools.reduce(DataFrame.unionByName, out)


# --------------------------------------------------------------------- M03
class PredictionRepository:
    """OOF predictions, test predictions and scores per model id, as
    Parquet tables partitioned by ``model_id`` under a shared folder."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model_id: str, oof: DataFrame, test: DataFrame | None, score: float) -> None:
        for kind, d in (("oof", oof), ("test", test)):
            if d is not None:
                (d.withColumn("model_id", F.lit(model_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("model_id")
                 .parquet(f"{self.root}/{kind}"))
        self._note(model_id, float(score))

    def _note(self, model_id: str, score: float | None) -> None:
        """Append to the score log; a NULL score says the model was removed."""
        s = self.spark.createDataFrame([(model_id, score, time.time_ns())], "model_id string, score double, saved long")
        s.write.mode("append").parquet(f"{self.root}/scores")

    def scores(self) -> DataFrame:
        """The latest score of every model that is still here."""
        log = self.spark.read.parquet(f"{self.root}/scores")
        return log.groupBy("model_id").agg(F.max_by("score", "saved").alias("score")).where("score is not null")

    def select(self, kind: str = "oof", min_score: float | None = None, ids: Sequence[str] | None = None) -> DataFrame:
        d = self.spark.read.parquet(f"{self.root}/{kind}")
        if ids is not None:
            d = d.where(F.col("model_id").isin(list(ids)))
        if min_score is not None:
            keep = self.scores().where(F.col("score") >= min_score).select("model_id")
            d = d.join(keep, "model_id", "left_semi")
        return d

    def merge_from(self, other: "PredictionRepository", kind: str = "oof") -> None:
        """Copy the other repository's models that are not here yet."""
        mine = self.spark.read.parquet(f"{self.root}/{kind}").select("model_id").distinct()
        new = other.spark.read.parquet(f"{other.root}/{kind}").join(mine, "model_id", "left_anti")
        new = _materialise(new)
        new.write.mode("append").partitionBy("model_id").parquet(f"{self.root}/{kind}")
        ids = new.select("model_id").distinct().join(other.scores(), "model_id").collect()  # one row per model
        for r in ids:
            self._note(r["model_id"], r["score"])

    def remove(self, model_id: str) -> None:
        """Delete the model's partitions and note that its score is void; no
        other model's files are touched."""
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(model_id)
        for kind in ("oof", "test"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/model_id={name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._note(model_id, None)


# --------------------------------------------------------------------- M04
FAMILIES: dict[str, Callable] = {}


def _families() -> dict[str, Callable]:
    """Estimators by family name: ``(label, **params) -> estimator``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
    return {"logistic": lambda y, **p: LogisticRegression(featuresCol="features", labelCol=y, **p),
            "boosted_trees": lambda y, **p: GBTClassifier(featuresCol="features", labelCol=y, **p),
            "random_forest": lambda y, **p: RandomForestClassifier(featuresCol="features", labelCol=y, **p),
            "naive_bayes": lambda y, **p: NaiveBayes(featuresCol="features", labelCol=y, modelType="gaussian", **p),
            **FAMILIES}


def _is_ridge(params: Mapping) -> bool:
    """A logistic regression that Newton's method solves: no l1 share, nothing
    but the penalty and a number of iterations that suffices."""
    return not params.get("elasticNetParam") and set(params) <= {"regParam", "maxIter", "elasticNetParam"}


def random_search(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int,
                  spaces: Mapping[str, Mapping[str, Sequence]], n_iter: int, seed: int = 0,
                  valid: Column | None = None) -> DataFrame:
    """``n_iter`` seeded draws per model family from its parameter space
    (add families to ``FAMILIES``), scored by cross-validated AUC, or by the
    AUC on the ``valid`` rows of a model fitted on the others. Draws of ridge
    logistic regressions are fitted together (``batch_fit``)."""
    from pyspark.ml.functions import vector_to_array
    from tessera.operators.batch_fit import cv_aucs
    rng = np.random.RandomState(seed)
    families, rows = _families(), []
    train = _materialise(train.select(*dict.fromkeys([id_col, label, fold, *features]),
                                      *([valid.alias("_valid")] if valid is not None else [])))
    ridge = []  # (row, penalty) of the draws that share one batched fit
    for family, space in spaces.items():
        for _ in range(n_iter):
            params = {kk: vv[rng.randint(len(vv))] for kk, vv in space.items()}
            shown = json.dumps(params, sort_keys=True)
            if valid is None and family == "logistic" and "logistic" not in FAMILIES and _is_ridge(params):
                ridge.append((len(rows), float(params.get("regParam", 0.0))))
                rows.append((len(rows), family, shown, None))
                continue
            if valid is None:
                est = (lambda f=family, p=params: families[f](label, **p))
                oof, _ = oof_predict(train, features, label, fold, id_col, k, estimator=est)
            else:
                x = assemble(train, features)
                m = families[family](label, **params).fit(x.where("not _valid"))
                oof = m.transform(x.where("_valid")).select(id_col, vector_to_array("probability")[1].alias("pred"))
            score = auc(oof.join(train.select(id_col, label), id_col), label, "pred", id_col)
            rows.append((len(rows), family, shown, float(score)))
    for (at, _), score in zip(ridge, cv_aucs(train, [list(features)] * len(ridge), label, fold, k, [c for _, c in ridge])[0]):
        rows[at] = (*rows[at][:3], float(score))
    return train.sparkSession.createDataFrame(rows, "run long, family string, params string, auc double")


def top_n(results: DataFrame, metric: str, n: int, ascending: bool = False, tie: str | None = None) -> DataFrame:
    """The best ``n`` runs by ``metric`` (the cap is the feature)."""
    order = [F.col(metric).asc() if ascending else F.col(metric).desc()]
    if tie:
        order.append(F.col(tie).asc())
    return results.orderBy(*order).limit(n)


# ---------------------------------------------------------------- M07-M10
def rank_weighted_blend(df: DataFrame, preds: Sequence[str], weights: Sequence[float], id_col: str,
                        name: str = "blend") -> DataFrame:
    """Each prediction becomes ``p * (rank + 1) / N`` (pandas average
    rank), the weighted average of those is taken, then ranked again."""
    n = df.count()
    out = average_ranks(df, preds, {p: f"_r_{p}" for p in preds})
    for p in preds:
        out = out.withColumn(f"{p}_rank", F.col(p) * (F.col(f"_r_{p}") + 1) / F.lit(n)).drop(f"_r_{p}")
    tot = float(sum(weights))
    blend = sum((F.col(f"{p}_rank") * F.lit(float(w)) for p, w in zip(preds, weights)), F.lit(0.0)) / F.lit(tot)
    out = out.withColumn(name, blend)
    return average_rank(out, name, id_col, name=f"{name}_RANK")


def weighted_blend(preds: Sequence[str], weights: Sequence[float]) -> Column:
    """``sum w * p``."""
    return sum((F.col(p) * F.lit(float(w)) for p, w in zip(preds, weights)), F.lit(0.0))


def blend_weight_search(df: DataFrame, preds: Sequence[str], label: str, n_weight: int = 5, n_search: int = 100,
                        seed: int = 0) -> DataFrame:
    """Random integer weight vectors in [0, n_weight) (seeded; all-zero
    draws skipped), each scored by log-loss of the weighted mean prediction.
    A task multiplies blocks of its rows with the matrix of all candidates
    and returns one loss sum per candidate; Spark adds them. Rows with a NULL
    prediction or label are left out. Returns (candidate, weights, logloss)."""
    rng = np.random.RandomState(seed)
    cands = [[int(x) for x in w] for w in (rng.randint(n_weight, size=len(preds)) for _ in range(n_search)) if w.sum()]
    w = np.array(cands, float).T
    whole = w.sum(axis=0)

    def losses(batches):
        total, n = np.zeros(len(cands)), 0
        for b in batches:
            x = np.stack([np.asarray(c, float) for c in b.columns], axis=1)
            for i in range(0, len(x), 1024):
                y, p = x[i:i + 1024, :1], np.clip(x[i:i + 1024, 1:] @ w / whole, EPS, 1 - EPS)
                total -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cands))), pa.array(total),
                                          pa.array(np.full(len(cands), n))], names=["candidate", "loss", "n"])

    d = df.select(F.col(label).cast("double"), *[F.col(p).cast("double") for p in preds]).dropna()
    sums = d.mapInArrow(losses, "candidate long, loss double, n long").groupBy("candidate").agg(
        (F.sum("loss") / F.sum("n")).alias("logloss"))
    names = df.sparkSession.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(cands)],
                                            "candidate long, weights string")
    return names.join(sums, "candidate").select("candidate", "weights", "logloss")


def combine_predictions(preds_long: DataFrame, id_col: str, scores: DataFrame | None = None,
                        min_score: float | None = None, model_col: str = "model", pred_col: str = "pred"):
    """Predictions of many models (long) joined by id into one row per
    id, keeping only models whose score passes ``min_score``."""
    d = preds_long
    if scores is not None and min_score is not None:
        d = d.join(scores.where(F.col("score") >= min_score).select(model_col), model_col, "left_semi")
    models = _model_names(d, model_col)
    return d.groupBy(id_col).pivot(model_col, models).agg(F.first(pred_col))


# ---------------------------------------------------------------- M11-M15
def pseudo_label(train: DataFrame, test_pred: DataFrame, test: DataFrame, label: str, id_col: str,
                 pred: str = "pred", hi: float = 0.9, lo: float | None = 0.05) -> DataFrame:
    """Confident test rows join the training set with their predicted
    label (1 above ``hi``, 0 below ``lo``)."""
    conf = test_pred.where((F.col(pred) > hi) | ((F.col(pred) < lo) if lo is not None else F.lit(False)))
    lab = conf.select(id_col, (F.col(pred) > hi).cast("int").alias(label))
    return train.unionByName(test.drop(label).join(lab, id_col), allowMissingColumns=True)


def adversarial_selection(train: DataFrame, test: DataFrame, features: Sequence[str], id_col: str, keep_n: int,
                          k: int = 3, drop_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Classify train vs test rows (out-of-fold); drop the least
    test-like ``drop_share`` of the remaining train rows each round until
    ``keep_n`` remain. Returns the kept train ids."""
    from tessera.operators.sampling import kfold
    cur = _materialise(train.select(id_col, *features))
    test = _materialise(test.select(id_col, *features))
    while cur.count() > keep_n:
        both = (cur.withColumn("_is_test", F.lit(0))
                .unionByName(test.select(id_col, *features).withColumn("_is_test", F.lit(1))))
        both = kfold(both, id_col, k, seed=seed, label="_is_test")
        oof, _ = oof_predict(both, features, "_is_test", "fold", id_col, k)
        scored = cur.join(oof, id_col)
        n = scored.count()
        drop = max(1, min(int(n * drop_share), n - keep_n))
        ranked = global_rank(scored, ["pred", id_col], pos="_ar", total=None)
        cur = ranked.where(F.col("_ar") >= drop).select(id_col, *features)
        cur = _materialise(cur)
    return cur.select(id_col)


def calibrated_svm(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int,
                   test: DataFrame | None = None) -> DataFrame:
    """Sigmoid calibration of a linear SVM. A train row gets the raw
    score of the SVM that did not see its fold, calibrated by a logistic
    regression on the scores of the other folds; a test row the mean raw
    score of the K SVMs, calibrated on all folds. (id, part, svm_score,
    calibrated)."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import vector_to_array
    tr = _materialise(assemble(train.select(id_col, label, fold, *features), features))
    te = _materialise(assemble(test.select(id_col, *features), features)) if test is not None else None
    margin = vector_to_array("rawPrediction")[1].alias("svm_score")
    raw, new = [], []
    for f in range(k):
        m = LinearSVC(featuresCol="features", labelCol=label, maxIter=20).fit(tr.where(F.col(fold) != f))
        raw.append(m.transform(tr.where(F.col(fold) == f)).select(id_col, label, fold, margin))
        if te is not None:
            new.append(m.transform(te).select(id_col, margin))
    raw = _materialise(assemble(functools.reduce(DataFrame.unionByName, raw), ["svm_score"], "_score"))

    def calibrate(on: DataFrame, rows: DataFrame, part: str) -> DataFrame:
        m = LogisticRegression(featuresCol="_score", labelCol=label).fit(on)
        return m.transform(rows).select(id_col, F.lit(part).alias("part"), "svm_score",
                                        vector_to_array("probability")[1].alias("calibrated"))

    out = [calibrate(raw.where(F.col(fold) != f), raw.where(F.col(fold) == f), "train") for f in range(k)]
    if te is not None:
        mean = functools.reduce(DataFrame.unionByName, new).groupBy(id_col).agg(F.avg("svm_score").alias("svm_score"))
        out.append(calibrate(raw, assemble(mean, ["svm_score"], "_score"), "test"))
    return functools.reduce(DataFrame.unionByName, out)


def bagging(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, id_col: str, n_bags: int = 3,
            fraction: float = 0.7, seed: int = 0, column_fraction: float = 1.0, replace: bool = False) -> DataFrame:
    """N models, each on a draw of the rows and a seeded draw of
    ``column_fraction`` of the columns; test predictions averaged. The rows are
    a hash-drawn ``fraction`` or, with ``replace``, a bootstrap sample of that
    rate, carried as weights."""
    from pyspark.ml.functions import vector_to_array
    from tessera.functions.columns import hash_unit
    from tessera.operators.sampling import bootstrap_weights
    rng = np.random.RandomState(seed)
    tr = train.select(id_col, label, *features)
    tr = _materialise(bootstrap_weights(tr, id_col, n_bags, seed, fraction, "_w") if replace else tr)
    te = _materialise(test.select(id_col, *features))
    out = []
    for b in range(n_bags):
        n = max(1, round(column_fraction * len(features)))
        cols = [features[i] for i in sorted(rng.choice(len(features), n, replace=False))]
        if replace:
            m = default_estimator(label).setWeightCol(f"_w{b}").fit(assemble(tr.where(F.col(f"_w{b}") > 0), cols))
        else:
            bag = tr.where(hash_unit(id_col, F.lit(str(seed)), F.lit(str(b))) < fraction)
            m = default_estimator(label).fit(assemble(bag, cols))
        out.append(m.transform(assemble(te, cols)).select(id_col, vector_to_array("probability")[1].alias("pred")))
    return functools.reduce(DataFrame.unionByName, out).groupBy(id_col).agg(F.avg("pred").alias("bag_pred"))


def score_agreement(runs: DataFrame, cols_: Sequence[str]) -> DataFrame:
    """Correlation between every pair of score columns over the runs."""
    import itertools
    return runs.agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in itertools.combinations(cols_, 2)])
