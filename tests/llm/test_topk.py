"""Exact top-k search against all inner products."""

import math
from collections import Counter

import numpy as np
import pytest

from tessera.llm.topk import Block, Part, top_k
from tests.conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, label int, x string, query string, rank string"


def expected(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e in rows
          if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = Counter()
    for a, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(ok)
                  if a != b and len(c) == len(q)]
        out.update((i, r + 1, None if null else j, min(max(-s, -(1 << 63)), (1 << 63) - 1))
                   for r, (s, null, j) in enumerate(sorted(scored)[:k]))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, e, 0, "x", "x", "x") for i, e in rows], SCHEMA)
    assert Counter(map(tuple, top_k(df, **how).collect())) == expected(rows, how.get("k", 5))


@pytest.mark.parametrize("how", [{}, {"least_rows": 40}, {"block_rows": 64, "least_rows": 16}])
def test_whole_table(spark, how):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert Counter(map(tuple, top_k(df, **how).collect())) == expected(rows)


def test_ties_and_many_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) / 256 for v in rng.integers(-3, 4, 6)]) for i in rng.permutation(4000)]
    check(spark, rows)
    check(spark, rows[:1500], k=3, least_rows=300)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, [0.0, 0.0]), (100, None), (150, [1.0, None]),
            (200, [nan, 1.0]), (250, [inf, 1.0]), (300, []), (1, []), (None, [1.0, 2.0]), (None, [1.0, 2.0]),
            (2, [1.0, 2.0]), (3, [-0.001, 0.001]), (-50, [5.0, -5.0]), (350, [1.0, 2.0, 3.0]), (400, [3e38, -3e38]),
            (4, [1e30, 1e30])]
    rows = [(i, e) for i, e in rows if i not in (400, 4)]
    check(spark, rows)
    check(spark, [(50, [1.0])])
    check(spark, [])


def test_values_beyond_doubles_do_not_crash(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0], 0, "", "", ""), (1, [3e38, 2.0], 0, "", "", ""), (2, [-3e38, 0.5], 0, "", "", "")], SCHEMA)
    assert [tuple(r) for r in top_k(df).orderBy("rank").collect()] == [
        (0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))]


def test_many_copies_of_the_best_vector(spark):
    check(spark, [(i, [1.0, 1.0]) for i in range(400)] + [(50, [1.0, 1.0])] * 3 + [(1000 + i, [0.5, 0.1]) for i in range(30)])


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(32 * rng.standard_normal((2048, 32)))
    part, short = Part(x), 0
    for _ in range(20):
        q = np.floor(32 * rng.standard_normal(32))
        score = x @ q
        limit = np.sort(score)[-20]
        rows, found = part.candidates(q, 6, limit)
        assert set(np.flatnonzero(score >= max(limit, np.sort(score)[-6]))) <= set(rows) and (found == score[rows]).all()
        short += len(rows) < part.n
    assert short == 20
    block = Block(list(range(2048)), x.astype(int).tolist(), [1] * 2048)
    assert [s for _, s, _ in block.search(-1, x[3].astype(int).tolist(), 5)][0] == int(x[3] @ x[3])
