"""Many logistic regressions over one table at once.

Selection loops (L08-L12) and parameter searches (M04) fit the same rows again
and again: another set of columns, another fold left out, another penalty.
Here all of them are solved together by Newton's method. One pass over the rows
per iteration forms, for every model, the gradient and the Hessian as masked
matrix products in Arrow batches: the columns of a model are a mask on its
coefficients, its fold a mask on the rows. A task returns one row per model,
Spark adds them up, and the driver solves one small system per model. A fit of
ninety models reads the table as often as a fit of one.

The objective of a model is that of ``LogisticRegression(regParam=l2)``: mean
log-loss of its rows plus ``l2 / 2`` times the squares of the coefficients on
columns scaled to unit sample deviation over these rows; the intercept is free.
Rows with a NULL or NaN among the columns, label or fold are left out. A
constant column has coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = 1 << 23   # doubles of gradients and Hessians formed at a time
ROWS = 2048       # rows multiplied at a time
NO_FOLD = -(1 << 40)  # no row has it


class Model(NamedTuple):
    """``columns`` of one regression, the ``fold`` it leaves out (None: all
    rows) and its penalty."""

    columns: tuple[str, ...]
    fold: int | None = None
    l2: float = 0.01


class Fitted(NamedTuple):
    """Coefficients per model on the raw columns (0 where a column is not
    used), intercepts, and the passes over the table it took."""

    columns: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int


def _frame(df: DataFrame, columns: Sequence[str], label: str, fold: str | None) -> DataFrame:
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    f = F.col(fold).cast("int") if fold else F.lit(-1)
    out = df.select(*x, F.col(label).cast("double").alias("y"), f.alias("f"))
    keep = F.col("y").isNotNull() & F.col("f").isNotNull()
    for i in range(len(columns)):
        keep = keep & F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    return out.where(keep)


def _blocks(b: pa.RecordBatch, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x = np.column_stack([b.column(f"x{i}").to_numpy() for i in range(p)]) if p else np.zeros((b.num_rows, 0))
    y, f = b.column("y").to_numpy(), b.column("f").to_numpy()
    for s in range(0, len(y), ROWS):
        yield x[s:s + ROWS], y[s:s + ROWS], f[s:s + ROWS]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(df: DataFrame, label: str, models: Sequence[Model], fold: str | None = None,
                 max_iter: int = 30, tol: float = 1e-9) -> Fitted:
    """All ``models`` over ``df``; ``fold`` is the column of fold numbers."""
    columns = sorted({c for m in models for c in m.columns})
    p = len(columns)
    rows = _frame(df, columns, label, fold)
    # rows, sums and squares per fold: deviations of every model's rows
    stats = rows.groupBy("f").agg(F.count(F.lit(1)), *[F.sum(f"x{i}") for i in range(p)],
                                  *[F.sum(F.col(f"x{i}") * F.col(f"x{i}")) for i in range(p)]).collect()
    if not stats:
        return Fitted(columns, np.zeros((len(models), p)), np.zeros(len(models)), 1)
    per = {r[0]: np.array(r[1:], float) for r in stats}
    whole = sum(per.values())
    mean = whole[1:p + 1] / whole[0]

    def deviation(total: np.ndarray) -> np.ndarray:
        n, s, q = total[0], total[1:p + 1], total[p + 1:]
        return np.sqrt(np.maximum(q - s * s / max(n, 1), 0) / max(n - 1, 1))

    scale = deviation(whole)
    flat = scale <= 1e-12 * np.maximum(1, np.abs(mean))
    scale[flat] = 1.0
    mine = [whole - per.get(m.fold, 0) if m.fold is not None else whole for m in models]
    n = np.array([max(t[0], 1) for t in mine])
    use = np.array([[c in m.columns for c in columns] for m in models]).reshape(len(models), p) & ~flat
    weight = np.array([m.l2 * (deviation(t) / scale) ** 2 for m, t in zip(models, mine)]).reshape(len(models), p)
    use, weight = np.hstack([use, np.ones((len(models), 1), bool)]), np.hstack([weight, np.zeros((len(models), 1))])
    left = np.array([NO_FOLD if m.fold is None else m.fold for m in models])

    beta = np.zeros((len(models), p + 1))
    last, step = np.full(len(models), np.inf), np.zeros_like(beta)
    pairs = np.triu_indices(p + 1)
    group = max(1, STATE // (len(pairs[0]) + p + 2))
    active, passes = np.arange(len(models)), 1
    for _ in range(max_iter):
        loss, grad, hess = {}, {}, {}
        for at in range(0, len(active), group):
            for i, l, g, h in _pass(rows, p, mean, scale, beta, left, active[at:at + group], pairs):
                loss[i], grad[i], hess[i] = l, np.array(g), np.array(h)
        passes += 1
        going = []
        for i in active:
            if i not in loss:
                continue  # no row is left for this model
            now = loss[i] / n[i] + 0.5 * (weight[i] * beta[i] ** 2).sum()
            if now > last[i] + 1e-12 * max(1, abs(last[i])):  # the step went too far
                step[i] /= 2
                beta[i] -= step[i]
                going.append(i)
                continue
            last[i], on = now, use[i]
            m = np.zeros((p + 1, p + 1))
            m[pairs] = hess[i]
            m = (m + np.triu(m, 1).T)[np.ix_(on, on)] / n[i] + np.diag(weight[i, on] + 1e-12)
            step[i] = 0
            step[i, on] = np.linalg.solve(m, -(grad[i][on] / n[i] + weight[i, on] * beta[i, on]))
            beta[i] += step[i]
            if np.abs(step[i]).max() > tol * max(1, np.abs(beta[i]).max()):
                going.append(i)
        active = np.array(going, int)
        if not len(active):
            break
    raw = beta[:, :p] / scale
    return Fitted(columns, raw, beta[:, p] - raw @ mean, passes)


def _pass(rows: DataFrame, p: int, mean, scale, beta, left, active, pairs) -> list:
    """(model, loss, gradient, Hessian) of the active models, summed over the rows."""
    b, out = beta[active].T.copy(), left[active]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(active)
        loss, grad, hess = np.zeros(m), np.zeros((p + 1, m)), np.zeros((len(pairs[0]), m))
        seen = np.zeros(m, bool)
        for batch in batches:
            for x, y, f in _blocks(batch, p):
                x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
                z = x @ b
                mask = f[:, None] != out[None, :]
                prob = _sigmoid(z)
                loss += ((np.logaddexp(0, z) - y[:, None] * z) * mask).sum(0)
                grad += x.T @ ((prob - y[:, None]) * mask)
                hess += (x[:, pairs[0]] * x[:, pairs[1]]).T @ (prob * (1 - prob) * mask)
                seen |= mask.any(0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(active[at]), pa.array(loss[at]), pa.array(grad.T[at].tolist(), pa.list_(pa.float64())),
             pa.array(hess.T[at].tolist(), pa.list_(pa.float64()))], names=["model", "loss", "grad", "hess"])

    schema = "model long, loss double, grad array<double>, hess array<double>"

    def add(t: pa.Table) -> pa.Table:
        total = [np.sum(np.stack([np.asarray(v) for v in t.column(c).to_pylist()]), axis=0) for c in ("grad", "hess")]
        return pa.table({"model": t.column("model")[:1], "loss": [sum(t.column("loss").to_pylist())],
                         "grad": pa.array([total[0].tolist()], pa.list_(pa.float64())),
                         "hess": pa.array([total[1].tolist()], pa.list_(pa.float64()))})

    return rows.mapInArrow(partial, schema).groupBy("model").applyInArrow(add, schema).collect()


def scores(df: DataFrame, label: str, fitted: Fitted, models: Sequence[Model], sets: Sequence[int],
           fold: str | None = None) -> DataFrame:
    """Rows (``set``, ``y``, ``p``): every row scored for each set by the model
    of that set that left the row's fold out. ``sets`` numbers the set of each
    model; without ``fold`` every model scores every row."""
    p = len(fitted.columns)
    left = np.array([NO_FOLD if m.fold is None else m.fold for m in models])
    b, c, which = fitted.coefficients.T.copy(), fitted.intercepts, np.array(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, f in _blocks(batch, p):
                prob = _sigmoid(x @ b + c)
                row, model = np.nonzero(f[:, None] == left[None, :] if fold else np.ones(prob.shape, bool))
                yield pa.RecordBatch.from_arrays([pa.array(which[model]), pa.array(y[row]), pa.array(prob[row, model])],
                                                 names=["set", "y", "p"])

    return _frame(df, fitted.columns, label, fold).mapInArrow(run, "set long, y double, p double")


def cv_aucs(train: DataFrame, sets: Sequence[Sequence[str]], label: str, fold: str, k: int,
            l2: Sequence[float] | float = 0.01, holdout: DataFrame | None = None
            ) -> tuple[list[float], list[float | None]]:
    """Out-of-fold AUC of every column set, all fitted together; with
    ``holdout`` also the AUC there of each set fitted on all of ``train``. An
    empty set scores 0.5."""
    from tessera.operators.model import auc_by_group
    l2 = [l2] * len(sets) if isinstance(l2, (int, float)) else list(l2)
    use = [s for s, c in enumerate(sets) if c]
    models = [(s, Model(tuple(sets[s]), f, l2[s])) for s in use for f in range(k)]
    full = [(s, Model(tuple(sets[s]), None, l2[s])) for s in use] if holdout is not None else []
    if not use:
        return [0.5] * len(sets), [None if holdout is None else 0.5] * len(sets)
    both = models + full
    fitted = fit_logistic(train, label, [m for _, m in both], fold)
    inner = Fitted(fitted.columns, fitted.coefficients[:len(models)], fitted.intercepts[:len(models)], fitted.passes)
    long = scores(train, label, inner, [m for _, m in models], [s for s, _ in models], fold)
    got = {r["set"]: r["auc"] for r in auc_by_group(long, "set", "y", "p", "set").collect()}
    cv = [got.get(s) if c and got.get(s) is not None else 0.5 for s, c in enumerate(sets)]
    if holdout is None:
        return cv, [None] * len(sets)
    outer = Fitted(fitted.columns, fitted.coefficients[len(models):], fitted.intercepts[len(models):], fitted.passes)
    long = scores(holdout, label, outer, [m for _, m in full], [s for s, _ in full])
    got = {r["set"]: r["auc"] for r in auc_by_group(long, "set", "y", "p", "set").collect()}
    return cv, [got.get(s) if c and got.get(s) is not None else 0.5 for s, c in enumerate(sets)]
