"""Factorisations of many sparse matrices at once, as joins and sums.

A matrix is a table of cells ``_g`` (which matrix), ``_r``, ``_c``, ``_v``;
all matrices of a task share one table, so twenty of them cost the jobs of
one. A factor is a table with one row per (``_g``, row or column) and one
column ``_0`` ... per dimension. Cells times a factor is a join and a partially
aggregated sum: a row or column that holds a third of all cells is combined
before the shuffle. What reaches the driver are k x k matrices per ``_g``.

Start values are hashes of the row or column key, sums are the only other
source of the numbers: two runs agree up to the order of summation, whatever
the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import hash_unit
from tessera.session import written


def once(df: DataFrame) -> DataFrame:
    return written(df, "factor")


def dims(k: int) -> list[str]:
    return [f"_{i}" for i in range(k)]


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Count matrices key x value of every (key, value) column pair, in one
    pass over ``df``. Rows with a NULL on either side are left out."""
    entries = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("_g"), F.col(a).cast("string").alias("_r"),
                                 F.col(b).cast("string").alias("_c")) for a, b in pairs])
    e = df.select(F.explode(entries).alias("e")).select("e.*").where("_r is not null and _c is not null")
    return e.groupBy("_g", "_r", "_c").agg(F.count(F.lit(1)).cast("double").alias("_v"))


def hashed_factor(cells: DataFrame, side: str, k: int, seed: int, low: float, high: float) -> DataFrame:
    """One row per key of ``side`` with start values in [low, high)."""
    def start(i: int) -> Column:
        u = hash_unit("_g", side, F.lit(f"{seed}:{side}:{i}"))
        return (F.lit(low) + F.lit(high - low) * u).alias(f"_{i}")

    return cells.select("_g", side).distinct().select("_g", side, *[start(i) for i in range(k)])


def product(cells: DataFrame, factor: DataFrame, on: str, to: str, k: int) -> DataFrame:
    """The matrix (or its transpose) times the factor over ``on``."""
    return cells.join(factor, ["_g", on]).groupBy("_g", to).agg(
        *[F.sum(F.col("_v") * F.col(d)).alias(d) for d in dims(k)])


def _by_matrix(b: pa.RecordBatch, k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(matrix, rows of the batch, their k columns)."""
    x = np.column_stack([b.column(d).to_numpy() for d in dims(k)])
    code = b.column("_g").dictionary_encode()
    at = code.indices.to_numpy()
    for i, g in enumerate(code.dictionary.to_pylist()):
        rows = np.flatnonzero(at == i)
        yield g, rows, x[rows]


def grams(factor: DataFrame, k: int) -> dict[str, np.ndarray]:
    """Factor' x factor per matrix: one k x k sum per task, added up by Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for g, _, x in _by_matrix(b, k):
                total[g] = total.get(g, 0) + x.T @ x
        for g, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * (k * k)), pa.array(np.arange(k * k)), pa.array(m.ravel())], names=["_g", "at", "v"])

    rows = factor.select("_g", *dims(k)).mapInArrow(partial, "_g string, at long, v double") \
        .groupBy("_g", "at").agg(F.sum("v").alias("v")).collect()
    out = {r["_g"]: np.zeros(k * k) for r in rows}
    for r in rows:
        out[r["_g"]][r["at"]] = r["v"]
    return {g: (m.reshape(k, k) + m.reshape(k, k).T) / 2 for g, m in out.items()}


def times(factor: DataFrame, key: str, matrices: Mapping[str, np.ndarray]) -> DataFrame:
    """Every row times the small matrix of its ``_g``."""
    k, m = next(iter(matrices.values())).shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, m))
            for g, rows, x in _by_matrix(b, k):
                out[rows] = x @ matrices[g]
            yield pa.RecordBatch.from_arrays([b.column("_g"), b.column(key), *[pa.array(c) for c in out.T]],
                                             names=["_g", key, *dims(m)])

    return factor.select("_g", key, *dims(k)).mapInArrow(
        run, ", ".join(["_g string", f"{key} string", *[f"{d} double" for d in dims(m)]]))


def orthonormal(factor: DataFrame, key: str, k: int, passes: int = 1) -> DataFrame:
    """Tall-skinny orthonormalisation from the Gram matrix; directions without
    weight become zero columns. Two passes reach machine precision."""
    for _ in range(passes):
        turn = {}
        for g, m in grams(factor, k).items():
            w, u = np.linalg.eigh(m)
            scale = np.where(w > max(w.max(), 0) * 1e-14, 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)
            turn[g] = u * scale
        if not turn:
            return factor
        factor = times(factor, key, turn)
    return factor


SHORT = 512  # a side with at most so many keys per matrix: its Gram matrix is small


def _turn(m: np.ndarray) -> np.ndarray:
    """What makes the columns with Gram matrix ``m`` orthonormal."""
    w, u = np.linalg.eigh((m + m.T) / 2)
    return u * np.where(w > max(w.max(), 0) * 1e-14, 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)


def _dense(b: pa.RecordBatch, width: Mapping[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(matrix, rows of the batch, their cells as a dense block) of lines."""
    entries = b.column("_l")
    flat, size = entries.flatten(), np.asarray(entries.value_lengths())
    line = np.repeat(np.arange(b.num_rows), size)
    at, v = flat.field("_i").to_numpy(), flat.field("_v").to_numpy()
    code = b.column("_g").dictionary_encode()
    mine = code.indices.to_numpy()
    for i, g in enumerate(code.dictionary.to_pylist()):
        rows = np.flatnonzero(mine == i)
        for s in range(0, len(rows), 2048):
            part = rows[s:s + 2048]
            place = np.full(b.num_rows, -1)
            place[part] = np.arange(len(part))
            hit = place[line] >= 0
            x = np.zeros((len(part), width[g]))
            x[place[line[hit]], at[hit]] = v[hit]
            yield g, part, x


def _short_gram(lines: DataFrame, width: Mapping[str, int]) -> dict[str, np.ndarray]:
    """Short side x short side per matrix: one partial sum per task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for g, _, x in _dense(b, width):
                total[g] = total.get(g, 0) + x.T @ x
        for g, m in total.items():
            at = np.flatnonzero(np.triu(m))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at), pa.array(m.ravel()[at])],
                                             names=["_g", "at", "v"])

    out = {g: np.zeros(n * n) for g, n in width.items()}
    for r in lines.select("_g", "_l").mapInArrow(partial, "_g string, at long, v double") \
            .groupBy("_g", "at").agg(F.sum("v").alias("v")).collect():
        out[r["_g"]][r["at"]] = r["v"]
    full = {g: m.reshape(width[g], width[g]) for g, m in out.items()}
    return {g: m + np.triu(m, 1).T for g, m in full.items()}


def _short_svd(cells: DataFrame, short: str, k: int, size: int, max_iter: int, tol: float,
               seed: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The rounds of ``randomised_svd`` where one side is short: every product
    of the basis with A and A' follows from that side's Gram matrix, which one
    pass over the cells forms. Rows of U S before the signs, singular values."""
    far = "_r" if short == "_c" else "_c"
    start = hashed_factor(cells, "_c", size, seed, -1.0, 1.0)
    if short == "_r":
        start = product(cells, start, "_c", "_r", size)
    keys: dict[str, list] = {}
    basis: dict[str, list] = {}
    for r in start.orderBy("_g", short).collect():  # at most SHORT rows per matrix
        keys.setdefault(r["_g"], []).append(r[short])
        basis.setdefault(r["_g"], []).append([r[d] or 0.0 for d in dims(size)])
    y = {g: np.array(v) for g, v in basis.items()}
    width = {g: len(v) for g, v in keys.items()}
    codes = cells.sparkSession.createDataFrame([(g, x, i) for g, v in keys.items() for i, x in enumerate(v)],
                                               f"_g string, {short} string, _i int")
    lines = once(cells.join(F.broadcast(codes), ["_g", short]).groupBy("_g", far).agg(
        F.collect_list(F.struct("_i", F.coalesce("_v", F.lit(0.0)).alias("_v"))).alias("_l")))
    gram = _short_gram(lines, width)
    before: dict[str, np.ndarray] = {}
    for _ in range(max_iter):
        # the basis times A'A: on the short side itself, or as A times the long side's basis
        back = {g: gram[g] @ y[g] for g in y}
        square = {g: (b.T @ b if short == "_c" else y[g].T @ b) for g, b in back.items()}
        values = {g: np.maximum(np.linalg.eigvalsh((m + m.T) / 2)[::-1][:k], 0) ** 0.25 for g, m in square.items()}
        y = {g: back[g] @ _turn(m) for g, m in square.items()}
        if all(g in before and np.abs(v - before[g]).max() <= tol * max(v[0], 1e-300) for g, v in values.items()):
            break
        before = values
    turn, sigma = {}, {}
    for g, p in y.items():
        for _ in range(2):  # A p, or p itself on the short side, orthonormal
            p = p @ _turn(p.T @ gram[g] @ p if short == "_c" else p.T @ p)
        b = gram[g] @ p
        m = b.T @ b if short == "_c" else p.T @ b
        w, u = np.linalg.eigh((m + m.T) / 2)
        s = np.sqrt(np.maximum(w[::-1][:k], 0))
        s[s < 1e-7 * s[0]] = 0.0
        turn[g], sigma[g] = p @ (u[:, ::-1][:, :k] * s), s
    if short == "_r":
        rows = [(g, x, *map(float, v)) for g in keys for x, v in zip(keys[g], turn[g])]
        return cells.sparkSession.createDataFrame(
            rows, "_g string, _r string, " + ", ".join(f"{d} double" for d in dims(k))), sigma

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, k))
            for g, part, x in _dense(b, width):
                out[part] = x @ turn[g]
            yield pa.RecordBatch.from_arrays([b.column("_g"), b.column("_r"), *[pa.array(c) for c in out.T]],
                                             names=["_g", "_r", *dims(k)])

    return lines.select("_g", "_r", "_l").mapInArrow(
        run, "_g string, _r string, " + ", ".join(f"{d} double" for d in dims(k))), sigma


def randomised_svd(cells: DataFrame, k: int, oversample: int = 12, max_iter: int = 30, tol: float = 1e-8,
                   seed: int = 0) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Truncated SVD of every matrix by randomised subspace iteration. A round
    multiplies a basis of l = k + oversample columns by A and A' (a join and a
    sum each) and orthonormalises it from l x l Gram matrices, until the k
    leading singular values stand still to ``tol``; with a side of at most
    ``SHORT`` keys the rounds run on that side's Gram matrix. Returns (``_g``, ``_r``,
    ``_0`` ...: the rows of U S) and the singular values per matrix. Signs are
    fixed by a hashed projection; dimensions beyond the rank are zero."""
    cells = once(cells)
    # no basis is wider than the shorter side of the largest matrix
    sides = cells.groupBy("_g").agg(F.count_distinct("_r").alias("r"), F.count_distinct("_c").alias("c")) \
        .agg(F.max(F.least("r", "c")).alias("least"), F.max("r").alias("_r"), F.max("c").alias("_c")).first()
    size = max(k, min(k + oversample, sides["least"] or 0))
    short = next((x for x in ("_c", "_r") if sides[x] and sides[x] <= SHORT), None)
    if short:
        rows, sigma = _short_svd(cells, short, k, size, max_iter, tol, seed)
        return _signed(once(rows), k), sigma
    right = hashed_factor(cells, "_c", size, seed, -1.0, 1.0)
    before: dict[str, np.ndarray] = {}
    for _ in range(max_iter):
        back = once(product(cells, once(product(cells, right, "_c", "_r", size)), "_r", "_c", size))
        # right is orthonormal from the second round on: the Gram matrix of A'A right holds fourth powers
        values = {g: np.maximum(np.linalg.eigvalsh(m)[::-1][:k], 0) ** 0.25 for g, m in grams(back, size).items()}
        right = orthonormal(back, "_c", size)
        if all(g in before and np.abs(v - before[g]).max() <= tol * max(v[0], 1e-300) for g, v in values.items()):
            break
        before = values
    left = once(orthonormal(once(product(cells, once(right), "_c", "_r", size)), "_r", size, passes=2))
    found = grams(once(product(cells, left, "_r", "_c", size)), size)
    if not found:
        return cells.select("_g", "_r", *[F.lit(0.0).alias(d) for d in dims(k)]), {}
    turn, sigma = {}, {}
    for g, m in found.items():
        w, u = np.linalg.eigh(m)
        s = np.sqrt(np.maximum(w[::-1][:k], 0))
        s[s < 1e-7 * s[0]] = 0.0
        turn[g], sigma[g] = u[:, ::-1][:, :k] * s, s
    rows = once(times(left, "_r", turn))
    return _signed(rows, k), sigma


def _signed(rows: DataFrame, k: int) -> DataFrame:
    weight = hash_unit("_g", "_r", F.lit("sign")) + 0.5
    lean = {r[0]: np.where(np.array(r[1:]) < 0, -1.0, 1.0)
            for r in rows.groupBy("_g").agg(*[F.sum(F.col(d) * weight) for d in dims(k)]).collect()}
    return times(rows, "_r", {g: np.diag(v) for g, v in lean.items()})


def non_negative(cells: DataFrame, k: int, max_iter: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """W and H of every matrix (zero cells count) by multiplicative updates."""
    cells = once(cells)
    w, h = once(hashed_factor(cells, "_r", k, seed, 0.1, 1.1)), once(hashed_factor(cells, "_c", k, seed, 0.1, 1.1))

    def step(mine: DataFrame, other: DataFrame, me: str, you: str) -> DataFrame:
        top = product(cells, other, you, me, k).select("_g", me, *[F.col(d).alias(f"t{d}") for d in dims(k)])
        under = times(mine, me, grams(other, k)).select("_g", me, *[F.col(d).alias(f"u{d}") for d in dims(k)])
        return once(mine.join(top, ["_g", me]).join(under, ["_g", me]).select(
            "_g", me, *[(F.col(d) * F.col(f"t{d}") / (F.col(f"u{d}") + 1e-12)).alias(d) for d in dims(k)]))

    for _ in range(max_iter if not cells.isEmpty() else 0):
        w = step(w, h, "_r", "_c")
        h = step(h, w, "_c", "_r")
    return w, h


def topics(cells: DataFrame, k: int, max_iter: int = 30, seed: int = 0, alpha: float | None = None,
           eta: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Latent Dirichlet topics of every matrix by collapsed variational
    updates of order zero: a cell's mixture is proportional to (row count +
    alpha) (column count + eta) / (topic count + W eta), and the counts are the
    sums of the mixtures. Returns topic shares per row and per column."""
    alpha, eta = alpha or 1.0 / k, eta or 1.0 / k
    cells = once(cells)
    width = {r[0]: r[1] for r in cells.groupBy("_g").agg(F.count_distinct("_c")).collect()}
    rows = once(hashed_factor(cells, "_r", k, seed, 1.0, 1.0))
    cols_ = once(hashed_factor(cells, "_c", k, seed, 0.5, 1.5))

    def totals(factor: DataFrame) -> DataFrame:
        """Topic counts per matrix, one row each."""
        got = factor.groupBy("_g").agg(*[F.sum(d) for d in dims(k)]).collect()
        return factor.sparkSession.createDataFrame(
            [(r[0], *[float(x) + width[r[0]] * eta for x in r[1:]]) for r in got],
            "_g string, " + ", ".join(f"n{d} double" for d in dims(k)))

    def step(to: str) -> DataFrame:
        j = cells.join(rows.select("_g", "_r", *[F.col(d).alias(f"r{d}") for d in dims(k)]), ["_g", "_r"]) \
            .join(cols_.select("_g", "_c", *[F.col(d).alias(f"c{d}") for d in dims(k)]), ["_g", "_c"]) \
            .join(F.broadcast(totals(cols_)), "_g")
        part = [(F.col(f"r{d}") + alpha) * (F.col(f"c{d}") + eta) / F.col(f"n{d}") for d in dims(k)]
        j = j.select("_g", to, "_v", *[p.alias(d) for p, d in zip(part, dims(k))])
        whole = sum((F.col(d) for d in dims(k)[1:]), F.col("_0"))
        return once(j.groupBy("_g", to).agg(*[F.sum(F.col("_v") * F.col(d) / whole).alias(d) for d in dims(k)]))

    for _ in range(max_iter if width else 0):
        rows = step("_r")
        cols_ = step("_c")

    def shares(factor: DataFrame, key: str, prior: float) -> DataFrame:
        whole = sum((F.col(d) for d in dims(k)[1:]), F.col("_0")) + k * prior
        return factor.select("_g", key, *[((F.col(d) + prior) / whole).alias(d) for d in dims(k)])

    return shares(rows, "_r", alpha), shares(cols_, "_c", eta)
