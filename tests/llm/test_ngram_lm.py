import math
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm.ngram_lm import score_texts
from tests.llm.helpers import EDGE, docs, prose


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + ["<end>"]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


def slow(rows, order):
    """Textbook interpolation over dictionaries."""
    count = defaultdict(Counter)
    for d, t in rows:
        if not held(d):
            s = ["<begin>"] + tokens(t)
            for i in range(len(s)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        count[k][tuple(s[i - k + 1:i + 1])] += 1
    uni = {k: c for k, c in count[1].items() if k != ("<begin>",)}
    total, types = sum(uni.values()), len(uni)
    lam = {k: min(0.999, max(0.001, sum(c == 1 for c in count[k].values()) / max(1, sum(count[k].values()))))
           for k in range(2, order + 1)}

    def p(h, w):
        if not h:
            return (uni.get((w,), 0) + 0.5) / (total + 0.5 * (types + 1))
        k, low = len(h) + 1, p(h[1:], w)
        c = count[k - 1][h]
        return (1 - lam[k]) * count[k][h + (w,)] / c + lam[k] * low if c else low

    out = []
    for d, t in rows:
        s = tokens(t)
        full = ["<begin>"] + s
        base = sum(math.log10(p((), w)) for w in s)
        score = sum(math.log10(p(tuple(full[max(0, i - order + 1):i]), full[i])) for i in range(1, len(full)))
        out.append((d, held(d), len(s), sum((w,) in uni for w in s), total, base, score))
    return out


ROWS = [(100 + i, " ".join(prose(i % 23, 30 + i % 50, 60))) for i in range(150)] + \
       [(r[0], r[1] if len(r[1] or "") < 1000 else r[1][:3000]) for r in EDGE] + [(400 + i, "New Words %d" % i) for i in range(20)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    for block_rows in (10_000, 16):
        got = sorted(score_texts(docs(spark, ROWS), order=order, block_rows=block_rows).collect(), key=str)
        want = sorted(slow(ROWS, order), key=lambda r: str(r))
        assert len(got) == len(want)
        by = defaultdict(list)
        for w in want:
            by[w[0]].append(w)
        for r in got:
            w = min(by[r.doc_id], key=lambda w: abs(w[5] - r.base_score))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
            assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score == pytest.approx(w[6], rel=1e-9)


def test_distribution_sums_to_one(spark):
    """Over all words after a known context, an unknown one included."""
    train = [(1, "a b a c"), (2, "b a a")]
    vocabulary = ["a", "b", "c", "unseen"]
    assert not held(1) and not held(2)
    tests = [(i, f"a {w}") for i, w in enumerate(vocabulary, 1000) ]
    tests = [(next(x for x in range(i * 50, i * 50 + 50) if held(x)), t) for i, t in tests]
    rows = train + tests + [(next(x for x in range(10, 60) if held(x)), "a")]
    got = {r.doc_id: r.score for r in score_texts(docs(spark, rows)).collect()}
    ref = {d: s for (d, *_, s) in slow(rows, 2)}
    assert all(got[d] == pytest.approx(ref[d]) for d in got)


def test_edges(spark):
    assert score_texts(docs(spark, [])).count() == 0
    one = next(i for i in range(100) if held(i))
    r = score_texts(docs(spark, [(one, "only held out")])).first()  # nothing to learn from
    assert (r.n_known, r.train_tokens) == (0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(0)
