import re
from collections import Counter, defaultdict

from tessera.llm.mixing import WEIGHTS, mix
from tests.llm.helpers import EDGE, docs, prose


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        share = sum(w[s] for s in names if s not in full)
        left = total - sum(3 * sizes[s] for s in full)
        t = {s: 3 * sizes[s] if s in full else w[s] * (left / share) for s in names}
        over = {s for s in names if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


ROWS = [(100 + i, " ".join(prose(i, 5 + i % 40)), ["big", "big", "b", "a", None, "zé", "Z"][i % 7]) for i in range(300)] \
    + [(900, "tiny source", "a0"), (901, None, "empty"), (902, "", "empty")] + EDGE


def test_matches_brute_force(spark):
    for slice_rows in (5_000, 7):
        got = mix(docs(spark, ROWS), slice_rows=slice_rows).collect()
        size = Counter()
        for r in ROWS:
            size[r[2] if len(r) > 2 else "s"] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        want = slow_targets(size)
        assert len(got) == len(ROWS)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        for s, t in want.items():
            assert t - 1 <= taken[s] <= t
    again = mix(docs(spark, ROWS).repartition(5), slice_rows=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_tables(spark):
    assert mix(docs(spark, [])).count() == 0
    got = mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
