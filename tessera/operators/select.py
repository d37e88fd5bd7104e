"""Feature selection.

Univariate scores (correlation, chi-square, ANOVA F, AUC, information gain,
variance) are computed for all features in one pass over a long
``(row, feature, value)`` table or one multi-column aggregate; the driver
only sees one number per feature. Model-based selection (L07-L12) loops
over ``pyspark.ml`` fits on an assembled, persisted frame.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import model as M
from tessera.operators.batch_fit import Model, cv_aucs, fit_logistic


def long_format(df: DataFrame, id_col: str | None, features: Sequence[str], label: str | None = None) -> DataFrame:
    """([id,] [label,] feature, value) rows: one row per feature value."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    keep = ([id_col] if id_col else []) + ([label] if label else [])
    return df.select(*keep, F.expr(f"stack({len(features)}, {pairs}) as (feature, value)"))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> dict:
    """All pairwise Pearson correlations (pairwise-complete rows, as pandas).

    Every task reduces its rows to four p x p matrices by matrix products
    (counts, sums, squares and cross products of centred values under the
    masks of non-NULL pairs), one row per feature; Spark adds them up by
    feature. The plan has p aggregates for the means, not p (p - 1) / 2, and
    the driver gets the p x p result."""
    features = list(features)
    p = len(features)
    mean = df.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)) for f in features]).first()
    centre = np.array(list(mean), float)
    parts = "i int, n array<double>, x array<double>, xx array<double>, xy array<double>"

    def rows(mats):
        cols = [pa.ListArray.from_arrays(pa.array(np.arange(p + 1) * p, pa.int32()), pa.array(m.ravel())) for m in mats]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), *cols], names=["i", "n", "x", "xx", "xy"])

    def partial(batches):
        total = np.zeros((4, p, p))
        for b in batches:
            v = np.stack([np.asarray(c.fill_null(float("nan")), float) for c in b.columns], axis=1) - centre
            known = ~np.isnan(v)
            v, m = np.where(known, v, 0.0), known.astype(float)
            total += np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
        yield rows(total)

    def add(table):
        mats = [np.asarray(table.column(c).combine_chunks().flatten()).reshape(-1, p).sum(axis=0) for c in ("n", "x", "xx", "xy")]
        return pa.table([table.column("i").slice(0, 1), *[pa.array([m], pa.list_(pa.float64())) for m in mats]],
                        names=["i", "n", "x", "xx", "xy"])

    got = (df.select(*[F.col(f).cast("double") for f in features]).mapInArrow(partial, parts)
           .groupBy("i").applyInArrow(add, parts).collect())
    n, x, xx, xy = np.zeros((4, p, p))
    for r in got:
        n[r.i], x[r.i], xx[r.i], xy[r.i] = r.n, r.x, r.xx, r.xy
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = (n * xy - x * x.T) / np.sqrt((n * xx - x * x) * (n * xx.T - x.T * x.T))
    return {(features[i], features[j]): None if n[i, j] < 2 or not np.isfinite(corr[i, j]) else float(corr[i, j])
            for i, j in itertools.combinations(range(p), 2)}


def correlation_cut(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Drop column j when |corr(i, j)| > threshold for some earlier i.
    Returns (feature, position, max_abs_corr_with_earlier, drop)."""
    cm = correlation_matrix(df, features)
    rows = []
    for j, fj in enumerate(features):
        m = [abs(cm[(fi, fj)]) for fi in features[:j] if cm[(fi, fj)] is not None]
        mx = max(m) if m else None
        rows.append((fj, j, mx, bool(mx is not None and mx > threshold)))
    return df.sparkSession.createDataFrame(rows, "feature string, position long, max_abs_corr double, drop boolean")


def target_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """|corr(x, y)| per feature, ranked (1 = strongest)."""
    row = df.agg(*[F.corr(f, label).alias(f) for f in features]).first()
    rows = sorted(((f, abs(row[f]) if row[f] is not None else None) for f in features),
                  key=lambda t: (-(t[1] or 0.0), t[0]))
    return df.sparkSession.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                           "feature string, abs_corr double, rank long")


def class_counts(labels: DataFrame, label: str) -> dict:
    """Rows per class, from the table that has one row per example."""
    return {r[label]: r["n"] for r in labels.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def chi2_scores(long: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """Scikit-learn's ``chi2`` for non-negative features: per class the
    observed sum of feature values against class share x feature total. The
    class shares come from ``labels`` (one row per example), so ``long`` may
    leave out its zeros."""
    n = class_counts(labels, label)
    p1 = F.lit(n.get(1, 0) / max(1, sum(n.values())))
    per = long.groupBy("feature").agg(
        F.sum(F.when(F.col(label) == 1, F.col("value")).otherwise(0.0)).alias("o1"),
        F.sum(F.when(F.col(label) == 0, F.col("value")).otherwise(0.0)).alias("o0"),
        F.sum("value").alias("tot"))
    e1, e0 = p1 * F.col("tot"), (1 - p1) * F.col("tot")
    chi = F.try_divide((F.col("o1") - e1) * (F.col("o1") - e1), e1) + \
        F.try_divide((F.col("o0") - e0) * (F.col("o0") - e0), e0)
    return per.select("feature", chi.alias("chi2"))


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best features by ``score`` (ties by name)."""
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(k)


def anova_f(long: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """One-way ANOVA F statistic of each feature across label classes
    (``f_classif``), NULL and left out values counted as 0: class sizes come
    from ``labels`` (one row per example)."""
    n = class_counts(labels, label)
    total, k = sum(n.values()), len(n)
    size = F.create_map(*[F.lit(x) for kv in n.items() for x in (kv[0], float(kv[1]))]) if n else F.lit(None)
    v = F.coalesce(F.col("value"), F.lit(0.0))
    g = long.where(F.col(label).isNotNull()).groupBy("feature", label).agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    t = g.groupBy("feature").agg(F.sum("s").alias("S"), F.sum("ss").alias("SS"),
                                 F.sum(F.col("s") * F.col("s") / F.element_at(size, F.col(label))).alias("B"))
    ss_between = F.col("B") - F.col("S") * F.col("S") / total
    f = F.try_divide(ss_between / (k - 1), (F.col("SS") - F.col("B")) / (total - k)) if 1 < k < total \
        else F.lit(None).cast("double")
    return t.select("feature", f.alias("f"))


def percentile_keep(scores: DataFrame, score: str, percentile: float) -> DataFrame:
    """Keep features scoring at or above the (100 - percentile)-th
    percentile of all scores (a handful of numbers per feature)."""
    thr = scores.agg(F.percentile(score, 1 - percentile / 100.0).alias("t")).first()["t"]
    return scores.withColumn("keep", F.col(score) >= F.lit(thr))


def feature_auc(long: DataFrame, label: str, id_col: str) -> DataFrame:
    """ROC-AUC of every feature against the label, all features in one
    distributed pass (rank within feature, average ranks for ties)."""
    return M.auc_by_group(long, "feature", label, "value", id_col)


def information_gain(df: DataFrame, features: Sequence[str], label: str, eps: float = 1e-10) -> DataFrame:
    """Entropy of the label minus the weighted entropies after splitting
    on each (discrete) feature value; the reference's entropy, eps inside
    the logs: ``-(eps+p)/t*log2((eps+p)/t) - n/t*log2((eps+n)/t)``."""
    def H(p, n):
        t = p + n
        return -((F.lit(eps) + p) / t) * F.log2((F.lit(eps) + p) / t) - (n / t) * F.log2((F.lit(eps) + n) / t)

    tot = df.agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    P, N = float(tot["p"]), float(tot["n"])
    long = long_format(df, None, features, label)
    g = long.groupBy("feature", "value").agg(F.sum(F.col(label)).cast("double").alias("p"),
                                             F.count(F.lit(1)).cast("double").alias("t"))
    part = g.select("feature", (F.col("t") / F.lit(N) * H(F.col("p"), F.col("t") - F.col("p"))).alias("h"))
    base = H(F.lit(P), F.lit(N - P))
    return part.groupBy("feature").agg((base - F.sum("h")).alias("info_gain"))


def correlation_clusters(df: DataFrame, features: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """KMeans on the rows of the correlation matrix; in each cluster the
    column with the fewest NULLs is kept."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors
    cm = correlation_matrix(df, features)
    nulls = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()

    def c(a, b):
        if a == b:
            return 1.0
        v = cm.get((a, b), cm.get((b, a)))
        return 0.0 if v is None else float(v)

    rows = [(f, Vectors.dense([c(f, g) for g in features]), int(nulls[f])) for f in features]
    mat = df.sparkSession.createDataFrame(rows, ["feature", "features", "nulls"])
    km = KMeans(k=k, seed=seed).fit(mat)
    out = km.transform(mat).select("feature", F.col("prediction").alias("cluster"), "nulls")
    w = Window.partitionBy("cluster").orderBy("nulls", "feature")  # a table of p features
    return out.withColumn("keep", F.row_number().over(w) == 1)


def importance_intersection(train: DataFrame, features: Sequence[str], label: str, top_n: int,
                            seed: int = 0) -> DataFrame:
    """Features in the top N both by gain importance and by split count
    of a boosted-tree model (split counts read from the fitted trees)."""
    from pyspark.ml.classification import GBTClassifier
    m = GBTClassifier(featuresCol="features", labelCol=label, maxIter=10, seed=seed).fit(
        M.assemble(train, features))
    gain = m.featureImportances.toArray()
    splits = [0] * len(features)
    for line in m.toDebugString.splitlines():
        line = line.strip()
        if line.startswith("If (feature "):
            splits[int(line.split()[2])] += 1
    by_gain = sorted(range(len(features)), key=lambda i: (-gain[i], features[i]))[:top_n]
    by_split = sorted(range(len(features)), key=lambda i: (-splits[i], features[i]))[:top_n]
    rows = [(features[i], float(gain[i]), splits[i], i in by_gain and i in by_split) for i in range(len(features))]
    return train.sparkSession.createDataFrame(rows, "feature string, gain double, splits long, keep boolean")


def importance_search(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int,
                      top: Sequence[int], seed: int = 0) -> DataFrame:
    """Gain and split counts averaged over the K models that leave one
    fold out; then, for every N in ``top``, the CV AUC of the features in the
    top N of both. (n, features, cv_auc, best)."""
    train = _loop_input(train, [id_col, label, fold, *features])
    ranks = {f: [0.0, 0.0] for f in features}
    for i in range(k):
        for r in importance_intersection(train.where(F.col(fold) != i), features, label, len(features), seed).collect():
            ranks[r.feature][0] += r.gain / k
            ranks[r.feature][1] += r.splits / k
    sets = []
    for n in top:
        both = [set(sorted(features, key=lambda f: (-ranks[f][j], f))[:n]) for j in (0, 1)]
        sets.append([f for f in features if f in both[0] & both[1]])
    rows = [(n, ",".join(c), s) for n, c, s in zip(top, sets, cv_aucs(train, sets, label, fold, k)[0])]
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows],
                                              "n long, features string, cv_auc double, best boolean")


def forward_rounds(train: DataFrame, candidates: Sequence[str], label: str, fold: str, id_col: str, k: int,
                   base: Sequence[str] = (), max_rounds: int | None = None) -> DataFrame:
    """L11, round-based: each round tries every candidate that is left, all in
    one fit, and adds the one with the best CV AUC; ends when none improves it.
    One row per round: (round, added, cv_auc)."""
    train = _loop_input(train, [id_col, label, fold, *base, *candidates])
    cur, left, rows = list(base), list(candidates), []
    best = None
    while left and (max_rounds is None or len(rows) < max_rounds):
        now, *aucs = cv_aucs(train, [cur, *[cur + [f] for f in left]], label, fold, k)[0]
        best = now if best is None else best
        score, f = max(zip(aucs, left))
        if score <= best:
            break
        cur.append(f)
        left.remove(f)
        best = score
        rows.append((len(rows) + 1, f, float(score)))
    return train.sparkSession.createDataFrame(rows, "round long, added string, cv_auc double")


def _cv_auc(train, feats, label, fold, id_col, k) -> float:
    """Out-of-fold AUC of one column set."""
    return cv_aucs(train, [feats], label, fold, k)[0][0]


def _loop_input(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Selection loops refit many times: write the input once to the shared
    checkpoint folder so no round recomputes its lineage."""
    return M._materialise(train.select(*dict.fromkeys(cols)))


def drop_one_report(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int) -> DataFrame:
    """CV AUC with all features and without each one, all in one fit; the
    gain of dropping a feature = score without it - full score."""
    train = _loop_input(train, [id_col, label, fold, *features])
    sets = [list(features), *[[x for x in features if x != f] for f in features]]
    full, *aucs = cv_aucs(train, sets, label, fold, k)[0]
    rows = [("<none>", full, 0.0), *[(f, s, s - full) for f, s in zip(features, aucs)]]
    return train.sparkSession.createDataFrame(rows, "dropped string, cv_auc double, gain double")


def backward_elimination(train: DataFrame, features: Sequence[str], label: str, fold: str, id_col: str, k: int,
                         min_features: int = 1) -> DataFrame:
    """Each round drop the feature whose removal improves CV most (all
    removals of a round in one fit); stop when none improves. One row per
    round."""
    train = _loop_input(train, [id_col, label, fold, *features])
    cur, rows = list(features), []
    while True:
        trial = [[x for x in cur if x != f] for f in cur] if len(cur) > min_features else []
        now, *aucs = cv_aucs(train, [cur, *trial], label, fold, k)[0]
        if not rows:
            rows.append((0, ",".join(cur), now))
        if not trial:
            break
        s, f = max(zip(aucs, cur))
        if s <= rows[-1][2]:
            break
        cur.remove(f)
        rows.append((len(rows), ",".join(cur), s))
    return train.sparkSession.createDataFrame(rows, "round long, features string, cv_auc double")


def forward_selection(train: DataFrame, candidates: Sequence[str], label: str, fold: str, id_col: str, k: int,
                      holdout: DataFrame | None = None, base: Sequence[str] = ()) -> DataFrame:
    """Greedy one pass: add a candidate when the CV score improves (and
    the holdout AUC too, when a holdout is given). The candidates up to the
    next addition share the columns chosen so far, so all that are left are
    fitted together and fitted again only after an addition."""
    train = _loop_input(train, [id_col, label, fold, *base, *candidates])
    cur, left, rows = list(base), list(candidates), []
    best, best_ho = None, 0.5
    while left:
        (now, *cv), (_, *ho) = cv_aucs(train, [cur, *[cur + [f] for f in left]], label, fold, k, holdout=holdout)
        best = now if best is None else best
        for i, f in enumerate(left):
            ok = cv[i] > best
            shown = ho[i] if ok else None
            ok = ok and (holdout is None or ho[i] > best_ho)
            rows.append((f, float(cv[i]), shown, ok))
            if ok:
                cur.append(f)
                best, best_ho = cv[i], ho[i] if holdout is not None else best_ho
                break
        left = left[i + 1:]
    return train.sparkSession.createDataFrame(rows, "candidate string, cv_auc double, holdout_auc double, added boolean")


def recursive_elimination(train: DataFrame, features: Sequence[str], label: str, n_keep: int) -> DataFrame:
    """Refit a logistic regression and drop the smallest |coefficient| on
    columns of unit deviation until ``n_keep`` remain."""
    train = _loop_input(train, [label, *features])
    std = train.agg(*[F.stddev_samp(F.col(f).cast("double")).alias(f) for f in features]).first()
    cur, order = list(features), []
    while len(cur) > n_keep:
        fitted = fit_logistic(train, label, [Model(tuple(cur))])
        size = {c: abs(b) * (std[c] or 0.0) for c, b in zip(fitted.columns, fitted.coefficients[0])}
        order.append(min(cur, key=lambda c: (size[c], c)))
        cur.remove(order[-1])
    rows = [(f, i + 1) for i, f in enumerate(order)] + [(f, None) for f in cur]
    return train.sparkSession.createDataFrame(rows, "feature string, dropped_round long")


def variance_threshold(df: DataFrame, features: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Population variance of every feature in one aggregate; drop the
    ones at or below the threshold."""
    row = df.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    rows = [(f, row[f], bool(row[f] is not None and row[f] <= threshold)) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, variance double, drop boolean")


def cumulative_importance(imp: DataFrame, feature: str, importance: str, threshold: float) -> DataFrame:
    """Importances normalised to sum 1, sorted descending, running sum;
    features are kept while the running sum stays within ``threshold``. The
    window runs over the importance table (one row per feature)."""
    tot = Window.partitionBy()
    w = Window.orderBy(F.desc(importance), F.col(feature)).rowsBetween(Window.unboundedPreceding, 0)
    norm = F.col(importance) / F.sum(importance).over(tot)
    out = imp.select(feature, importance, norm.alias("normalized"))
    out = out.withColumn("cumulative", F.sum("normalized").over(w))
    return out.withColumn("keep", F.col("cumulative") <= F.lit(threshold))
