import random

import numpy as np
import xxhash

from tessera.llm import simhash as S
from tests.llm.helpers import EDGE, docs, prose


def slow_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=3):
    low = list(range(len(ids)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                low[find(i)] = find(j)
    key = lambda i: (ids[i] is None, ids[i] or 0)
    best = {}
    for i in range(len(ids)):
        r = find(i)
        best[r] = min(best.get(r, i), i, key=key)
    return [ids[best[find(i)]] for i in range(len(ids))]


def corpus():
    rng = random.Random(3)
    rows = list(EDGE)
    for g in range(12):
        base = prose(g, 150)
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "zz"
            rows.append((100 * g + c + 20, " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = S.simhash_dups(docs(spark, rows)).collect()
    fps = [slow_fingerprint(t or "") for _, t in rows]
    want = slow_components([d for d, _ in rows], fps)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == \
        sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want)], key=str)


def test_bit_sliced_distance():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False)))
                    for b in base for _ in range(70)], np.uint64)
    near = np.unpackbits(S.within(fps, S.planes(fps), 3).view(np.uint8), axis=1, bitorder="little")[:, :len(fps)]
    want = [[bin(int(a) ^ int(b)).count("1") <= 3 for b in fps] for a in fps]
    assert (near.astype(bool) == np.array(want)).all()


def test_forests_connect_the_same():
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([(1 << int(a)) | (1 << int(b)) | (c << 40) for a, b, c in rng.integers(0, 30, (60, 3))],
                             np.uint64))
    want = slow_components(list(range(len(fps))), [int(f) for f in fps], 1)
    for edges in ([(int(fps[a]), int(fps[b])) for a, b in S.forest(fps, 1)], list(S.small_forests([fps], 1))):
        assert len(edges) == len(fps) - len(set(want))
        low = {int(f): int(f) for f in fps}
        for _ in fps:
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        assert [int(np.flatnonzero(fps == low[int(f)])[0]) for f in fps] == want


def test_oversized_buckets_are_cut_into_block_pairs(spark):
    fps = [int(x) for x in np.random.default_rng(2).integers(0, 2**12, 400)]  # shares most pieces
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    low = {f: f for f in set(fps)}
    edges = S.links(df, 1, block=16).collect()
    for _ in range(60):
        for r in edges:
            low[r.u] = low[r.v] = min(low[r.u], low[r.v])
    ids = sorted(set(fps))
    want = slow_components(ids, ids, 1)
    assert [low[f] for f in ids] == want


def test_empty_table(spark):
    assert S.simhash_dups(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = [r for r in corpus() if r[0] is not None]
    ids = {r.doc_id for r in S.drop_near_copies(docs(spark, rows)).collect()}
    want = slow_components([d for d, _ in rows], [slow_fingerprint(t or "") for _, t in rows])
    assert ids == set(want)


def test_stage_tells_rows_without_or_with_the_same_id_apart(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    kept = S.drop_near_copies(docs(spark, [(1, a), (None, a), (None, b), (None, b), (7, "x y z w"), (7, b + " eight nine ten"),
                                           (7, "x y z w"), (8, "x y z w")]))
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    assert rows == [(False, 1, a), (False, 7, b + " eight nine ten"), (False, 7, "x y z w"), (True, 0, b)]
    assert kept.columns == docs(spark, []).columns
