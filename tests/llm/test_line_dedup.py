import random

from pyspark.sql import functions as F

from tessera.llm.line_dedup import drop_lines, line_classes, line_dedup
from tests.llm.helpers import EDGE, docs, prose


def lines_of(text):
    return [frozenset("".join(c.lower() if "A" <= c <= "Z" else c for c in x).encode().split())
            for x in text.split("\n")] if text else []


def jaccard(a, b):
    return len(a & b) / len(a | b)


def slow(rows):
    seen, out = [], []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    flat = [(d, n, s) for d, t in order for n, s in enumerate(lines_of(t))]
    sets = {s for _, _, s in flat if s}
    near = {s: [o for o in sets if o != s and jaccard(s, o) >= 0.8 - 1e-9] for s in sets}
    first = {}
    for i, (_, _, s) in enumerate(flat):
        first.setdefault(s, i)
    for i, (d, n, s) in enumerate(flat):
        gone = bool(s) and min([first[s], *[first[o] for o in near[s]]]) < i
        out.append((d, n, gone, len(near[s]) if s else 0))
    return out, {frozenset((a, b)) for a in near for b in near[a]}


def corpus():
    rng = random.Random(9)
    pool = [prose(g, rng.randint(1, 30), 90) for g in range(25)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 8)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["edit", "other", "more"])
            rng.shuffle(w) if rng.random() < 0.2 else None
            text.append(" ".join(w).title() if rng.random() < 0.2 else " ".join(w))
        rows.append((d * 3 + 50, "\n".join(text)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus() + [(1, None), (2, ""), (3, " \n\n"), (4, "one"), (5, "x " * 50_000)]
    want, pairs = slow(rows)
    for block_rows in (4096, 8):
        got = {r.doc_id: r for r in line_dedup(docs(spark, rows), block_rows=block_rows).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            mine = [w for w in want if w[0] == d]
            assert got[d].n_lines == len(mine)
            assert got[d].removed == [n for _, n, gone, _ in mine if gone]
            assert (got[d].n_removed, got[d].n_links) == (sum(w[2] for w in mine), sum(w[3] for w in mine))
        linked = line_classes(docs(spark, rows), block_rows=block_rows)["sets"].agg(F.sum("n_links")).first()[0]
        assert linked == 2 * len(pairs)


def test_removed_lines_leave_the_text(spark):
    rows = [(1, "alpha beta gamma\nsecond line here"), (2, "Gamma alpha beta\nnew words\n\nsecond line here"), (3, None)]
    got = {r.doc_id: r.text for r in drop_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "new words\n", 3: None}
    assert drop_lines(docs(spark, rows)).columns == docs(spark, []).columns


def test_edges(spark):
    got = line_dedup(docs(spark, EDGE)).collect()
    assert {r.doc_id for r in got} == {d for d, _ in EDGE} and sum(r.n_links for r in got) == 0
    assert line_dedup(docs(spark, [])).count() == 0


def test_the_largest_id_is_not_the_missing_one(spark):
    line = "one two three four five six seven eight"
    big = 2**63 - 1
    got = {r.doc_id: r for r in line_dedup(docs(spark, [(big, line), (None, "other words\n" + line)])).collect()}
    assert set(got) == {big, None}
    assert got[big].n_removed == 0 and got[None].removed == [1] and got[None].n_lines == 2 and got[big].n_lines == 1
    kept = {r.doc_id: r.text for r in drop_lines(docs(spark, [(big, line), (None, "other words\n" + line)])).collect()}
    assert kept == {big: line, None: "other words"}


def test_words_and_lines_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    import numpy as np
    from tessera.llm import line_dedup
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.choice(list(b"abcdefgh  \n\n\t"), 5000)) + b"x" * 300 + b" y\n z", np.uint8)
    whole = line_dedup.Hasher()(data)
    for piece in (16, 100, 1 << 10):
        monkeypatch.setattr(line_dedup, "PIECE", piece)
        cut = line_dedup.Hasher()(data)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, cut))
