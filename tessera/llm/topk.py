"""Operator 13: exact top-k search by no-random-access aggregation.

The score of a candidate is the integer inner product with the query, a sum
of one part per component. Candidates are cut into blocks; a block keeps, per
component, its rows sorted by value. For a query every component is a list
sorted by part (read from the other end if the query's component is negative).

Per block and query, all lists are read in step, from the best part down. At a
depth, a row's upper bound is what was read of it plus, per list it has not
been met in, the last part read there; its lower bound takes the last part of
the whole list instead. A row whose upper bound is under the k-th best lower
bound or final score so far cannot qualify. Reading stops when few enough rows
are left, or at the end of the lists; the scores of those left are resolved
then. The k best so far are kept from one part of the block to the next, so
later parts are left after a shorter read.

The stated query set meets all rows in blocks: every block is one sort group
of its rows followed by the queries, which stream past, so a task holds one
block (``block_rows`` at most) and one batch of queries. Per query and block at
most k + 1 rows leave. Any number of blocks gives the same rows.

Defined cases: vectors that are NULL or hold NULL, NaN or an infinity take no
part, neither as query nor as candidate; a query meets vectors of its own
length only; repeated rows are rows of their own (a copy of the query is a
candidate, and a repeated query is answered again); ties go to the smaller
``vec_id``, NULL last; a row without id is a candidate, never a query; scores
that pass a long are cut to its ends; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PART_ROWS = 2048        # rows whose lists are read together
FIRST_ROWS = 512        # the first part of a block, read to the end
DEPTHS = (0.65, 0.85)   # shares of a list read before the rows left are counted
EXACT = float(1 << 52)  # sums below this are exact in doubles
LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "query_id long, query_key string, query_rows long, vec_id long, score long, copies long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component; NULL if the vector takes no part."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fits, F.transform(x, lambda v: F.floor(v * scale)))


class Part:
    """Rows of a block with one sorted list per component."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        order = np.argsort(-x, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)                                  # list by list, best value first
        self.values = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T)
        self.place = np.empty_like(self.rows)                                      # where a row stands in a list
        np.put_along_axis(self.place, self.rows, np.arange(self.n)[None, :], axis=1)

    def candidates(self, q: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best or reach ``limit``, with final scores."""
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) + len(down):
            return np.arange(self.n), np.zeros(self.n)
        few = max(4 * k, self.n // 8)
        for depth in [] if limit == -np.inf else [max(1, int(self.n * d)) for d in DEPTHS]:
            # what lies between a part that was read and the last one read of its list
            last_up = self.values[up, depth - 1] * q[up]
            last_down = self.values[down, self.n - depth] * q[down]
            over = np.concatenate((
                (self.values[up, :depth] * q[up, None] - last_up[:, None]).ravel(),
                (self.values[down, self.n - depth:] * q[down, None] - last_down[:, None]).ravel()))
            met = np.concatenate((self.rows[up, :depth].ravel(), self.rows[down, self.n - depth:].ravel()))
            upper = np.bincount(met, weights=over, minlength=self.n) + last_up.sum() + last_down.sum()
            left = np.flatnonzero(upper >= limit)
            if len(left) > few:  # lower bounds of the most promising rows may raise the limit
                best = np.argpartition(upper, -2 * k)[-2 * k:]
                lower = self._lower(q, up, down, best, depth)
                limit = max(limit, np.partition(lower, -k)[-k])
                left = left[upper[left] >= limit]
            if len(left) <= few:
                return left, self.x[left] @ q
        parts = np.concatenate(((self.values[up] * q[up, None]).ravel(), (self.values[down] * q[down, None]).ravel()))
        met = np.concatenate((self.rows[up].ravel(), self.rows[down].ravel()))
        return np.arange(self.n), np.bincount(met, weights=parts, minlength=self.n)

    def _lower(self, q, up, down, rows, depth) -> np.ndarray:
        value = self.x[rows]
        read_up = self.place[up][:, rows].T < depth
        read_down = self.place[down][:, rows].T >= self.n - depth
        least_up, least_down = self.values[up, -1] * q[up], self.values[down, 0] * q[down]
        return (np.where(read_up, value[:, up] * q[up], least_up).sum(1)
                + np.where(read_down, value[:, down] * q[down], least_down).sum(1))


class Block:
    """One block of candidates; ``ids`` are sorted with None last."""

    def __init__(self, ids: list, x: list[list[int]], copies: list[int]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.copies = [copies[i] for i in order]
        self.big = max((abs(v) for r in x for v in r), default=0)
        self.x = [x[i] for i in order]
        self.width = len(x[0]) if x else 0
        at = [0, FIRST_ROWS, *range(FIRST_ROWS + PART_ROWS, len(ids), PART_ROWS), len(ids)]
        self.parts = []
        if self.big * self.big * max(1, self.width) < EXACT:
            dense = np.array(self.x, np.float64).reshape(len(ids), self.width)
            # rows dealt over the parts, so that the first one is like the others
            deal = np.random.default_rng(len(ids)).permutation(len(ids))
            self.parts = [(deal[s:e], Part(dense[deal[s:e]])) for s, e in zip(at, at[1:]) if s < min(e, len(ids))]

    def search(self, query_id: int, q: list[int], k: int) -> list[tuple[int, int, int]]:
        """(id, score, copies) of the rows that may be among the k best."""
        want = k + 1  # the query's own row may be among them
        reach = max((abs(v) for v in q), default=0)
        if reach * self.big * max(1, self.width) < EXACT and (self.parts or not self.ids):
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            vector = np.array(q, np.float64)
            for at, part in self.parts:
                limit = scores[want - 1] if len(scores) >= want else -np.inf
                left, score = part.candidates(vector, want, limit)
                rows, scores = np.concatenate((rows, at[left])), np.concatenate((scores, score))
                best = np.lexsort((rows, -scores))[:want] if len(rows) <= 4 * want else _best(rows, scores, want)
                rows, scores = rows[best], scores[best]
            found = [(int(r), int(s)) for r, s in zip(rows, scores)]
        else:  # beyond the range of doubles: whole numbers
            exact = [(sum(a * b for a, b in zip(q, r)), i) for i, r in enumerate(self.x)]
            found = [(i, min(max(s, LONG[0]), LONG[1])) for s, i in sorted(exact, key=lambda e: (-e[0], e[1]))[:want]]
        out = []
        for i, score in found:
            copies = self.copies[i] - (self.ids[i] == query_id and self.x[i] == q)
            if copies:
                out.append((self.ids[i], score, min(copies, k)))
        return out


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best by score, ties to the smaller row."""
    edge = np.partition(scores, -k)[-k]
    keep = np.flatnonzero(scores >= edge)
    return keep[np.lexsort((rows[keep], -scores[keep]))[:k]]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, rows = None, None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["width"], r["block"]) != key:
                    key, block, rows = (r["width"], r["block"]), None, []
                if not r["query"]:
                    rows.append((r["vec_id"], r["x"], r["n"]))
                    continue
                if block is None:
                    block = Block(*map(list, zip(*rows))) if rows else Block([], [], [])
                out += [(r["vec_id"], r["key"], r["n"], *f) for f in block.search(r["vec_id"], r["x"], k)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))],
                    names=["query_id", "query_key", "query_rows", "vec_id", "score", "copies"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256,
          every: int = 50, block_rows: int = 1 << 18, least_rows: int = 1 << 12) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of every row whose id
    ``every`` divides. A block has at least ``least_rows`` rows, while there
    are not two blocks per core, and ``block_rows`` at most."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    rows = materialise(rows.where(F.col("x").isNotNull()).groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("n")),
                       "topk-vectors")
    spark = vectors.sparkSession
    total = rows.count()
    blocks = max(-(-total // block_rows), min(-(-total // least_rows), 2 * spark.sparkContext.defaultParallelism), 1)
    rows = rows.withColumn("width", F.size("x"))
    candidates = rows.select("width", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("block"),
                             F.lit(False).alias("query"), "vec_id", "x", "n", F.lit("").alias("key"))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id",
        "x", "n", F.sha2(F.array_join("x", ","), 256).alias("key"))
    # a block with its queries behind it; blocks are dealt one to a task
    stream = candidates.unionByName(queries).repartitionById(blocks, F.col("block")) \
        .sortWithinPartitions("block", "width", "query")
    found = stream.mapInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id", "query_key", "query_rows") \
        .orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("query_rows")))) \
        .select("query_id", "rank", "vec_id", "score")
