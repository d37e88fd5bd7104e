"""Factorisation machines of all folds over one table at once.

``FMClassifier`` reads the rows once per step and fold, row by row. Here the
machines of all folds, which leave one fold out each, take a step together: one
pass forms the gradients of all in Arrow batches, Spark adds them up in pieces,
and the driver holds the ``buckets x (factors + 1) + 1`` numbers of each model,
whatever the rows. Start, objective and steps are those of ``FMClassifier``
with ``solver="adamW"`` over whole batches (logistic loss, decoupled decay, end
when a step is under ``tol``), up to the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import written

BLOCK = 1 << 15   # rows of a block
PIECE = 1 << 14   # numbers of a model added up at a time
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


def _padded(features: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of sparse rows, filled up to ``width`` with zeros."""
    slots, values = features.field("indices"), features.field("values")
    at = np.arange(width) < np.asarray(slots.value_lengths())[:, None]
    i, x = np.zeros(at.shape, np.int32), np.zeros(at.shape)
    i[at], x[at] = np.asarray(slots.flatten()), np.asarray(values.flatten())
    return i, x


def _raw(w: np.ndarray, i: np.ndarray, x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Margins of rows, and the sums of value times factor per factor."""
    v = np.ascontiguousarray(w[:n * k].reshape(n, k).T)
    s = [np.einsum("rc,rc->r", f[i], x) for f in v]
    squares = np.einsum("rc,rc,rc->r", (v * v).sum(0)[i], x, x)
    z = w[-1] + np.einsum("rc,rc->r", w[n * k:-1][i], x) + 0.5 * (sum(f * f for f in s) - squares)
    return z, s


def _probability(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _gradient(w: np.ndarray, i: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, k: int) -> np.ndarray:
    z, s = _raw(w, i, x, n, k)
    m = _probability(z) - y
    mx, flat = m[:, None] * x, i.ravel()
    own = np.bincount(flat, (mx * x).ravel(), n)
    v = np.stack([np.bincount(flat, (mx * f[:, None]).ravel(), n) for f in s], 1) - own[:, None] * w[:n * k].reshape(n, k)
    return np.concatenate([v.ravel(), np.bincount(flat, mx.ravel(), n), [m.sum()]])


def _blocks(width: int):
    """Rows as blocks of plain numbers: a step then copies bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(some):
            return pa.RecordBatch.from_pydict({c: pa.array([np.concatenate(a).tobytes()], pa.binary())
                                               for c, a in zip("fyix", zip(*some))})

        some = []
        for b in batches:
            some.append((b.column("f").to_numpy(), b.column("y").to_numpy(), *_padded(b.column("features"), width)))
            if sum(len(c[0]) for c in some) >= BLOCK:
                yield block(some)
                some = []
        if some:
            yield block(some)
    return run


def _step(weights, going: list[int], width: int, n: int, k: int):
    """Gradient sums and rows of the machines that go on, in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        grad, rows = {m: np.zeros(len(w[m])) for m in going}, dict.fromkeys(going, 0)
        for b in batches:
            for f, y, i, x in zip(*(b.column(c) for c in ("f", "y", "i", "x"))):
                f, y = np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(y.as_buffer())
                i = np.frombuffer(i.as_buffer(), np.int32).reshape(-1, width)
                x = np.frombuffer(x.as_buffer()).reshape(-1, width)
                for m in going:
                    on = f != m
                    grad[m] += _gradient(w[m], i[on], x[on], y[on], n, k)
                    rows[m] += int(on.sum())
        for m in going:
            if rows[m]:
                for p in range(0, len(grad[m]), PIECE):
                    yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int32()), "p": pa.array([p], pa.int32()),
                                                      "n": pa.array([rows[m]], pa.int64()),
                                                      "g": pa.array([grad[m][p:p + PIECE].tobytes()], pa.binary())})
    return run


def _added(t: pa.Table) -> pa.Table:
    g = sum(np.frombuffer(x.as_buffer()) for x in t.column("g"))
    return pa.table({"m": t.column("m")[:1], "p": t.column("p")[:1],
                     "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "g": pa.array([g.tobytes()], pa.binary())})


def _scores(weights, n: int, k: int, width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            i, x = _padded(b.column("features"), width)
            f, p = b.column("f").to_numpy(), np.zeros(b.num_rows)
            for m in range(len(w)):
                on = f == m
                p[on] = _probability(_raw(w[m], i[on], x[on], n, k)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=[b.schema.names[0], name])
    return run


def out_of_fold(rows: DataFrame, id_col: str, k_folds: int, width: int, buckets: int, factors: int, max_iter: int,
                step: float, reg: float, seed: int, name: str, tol: float = 1e-6) -> DataFrame:
    """``id_col`` and the probability of every row of folds 0 .. ``k_folds`` - 1
    under the machine of the other folds. ``rows`` has ``id_col``, ``f``, ``y``
    (0, 1 or NULL: not learnt from) and sparse ``features`` of at most ``width``
    slots."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors
    spark, k = rows.sparkSession, factors
    # the vectors by their plain fields, which Arrow knows
    plain = T.StructType([T.StructField(c.name, c.dataType.sqlType() if c.name == "features" else c.dataType) for c in rows.schema])
    rows = written(rows, "machine-rows", plain)
    learnt = rows.where("y is not null and f is not null").select("f", "y", "features")
    blocks = written(learnt.mapInArrow(_blocks(width), "f binary, y binary, i binary, x binary"), "machine-blocks")
    # the start of FMClassifier: its model after no step, which any rows give
    two = spark.createDataFrame([(float(y), Vectors.sparse(buckets, {0: 1.0})) for y in (0, 1)], ["y", "features"])
    start = FMClassifier(labelCol="y", factorSize=k, maxIter=0, seed=seed, solver="adamW").fit(two).factors.toArray()
    w = [np.concatenate([start.ravel(), np.zeros(buckets + 1)]) for _ in range(k_folds)]
    first, second = [np.zeros(len(x)) for x in w], [np.zeros(len(x)) for x in w]
    going = list(range(k_folds))
    for t in range(1, max_iter + 1):
        sent = spark.sparkContext.broadcast(w)
        parts = blocks.mapInArrow(_step(sent, going, width, buckets, k), "m int, p int, n long, g binary") \
            .groupBy("m", "p").applyInArrow(_added, "m int, p int, n long, g binary").collect()
        grad, count = {m: np.zeros(len(w[m])) for m in going}, {}
        for r in parts:
            g = np.frombuffer(bytes(r["g"]))
            grad[r["m"]][r["p"]:r["p"] + len(g)], count[r["m"]] = g, r["n"]
        left = []
        for m in count:
            g, before = grad[m] / count[m], w[m]
            first[m] = BETA1 * first[m] + (1 - BETA1) * g
            second[m] = BETA2 * second[m] + (1 - BETA2) * g * g
            move = step * (first[m] / (1 - BETA1 ** t)) / (np.sqrt(second[m] / (1 - BETA2 ** t)) + EPS)
            w[m] = before - (move + reg * before)
            if np.linalg.norm(w[m] - before) >= tol * max(np.linalg.norm(w[m]), 1.0):
                left.append(m)
        sent.unpersist()
        going = sorted(left)
        if not going:
            break
    out = T.StructType([rows.schema[id_col], T.StructField(name, T.DoubleType())])
    mine = rows.where(F.col("f").between(0, k_folds - 1)).select(id_col, "f", "features")
    return mine.mapInArrow(_scores(spark.sparkContext.broadcast(w), buckets, k, width, name), out)
