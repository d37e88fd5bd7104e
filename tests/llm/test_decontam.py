import random

import numpy as np

from tessera.llm.decontam import COMMON, WORD, ItemBlock, _found, decontaminate, drop_contaminated, sellers
from tests.llm.helpers import EDGE, docs, prose


def slow_distance(item, text):
    """Smallest word edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def case(n_docs=120, seed=5):
    rng = random.Random(seed)
    common = prose(1, 60, 60)
    items = [(i, " ".join(prose(100 + i, rng.randint(12, 60), 80) + rng.sample(common, 5))) for i in range(25)]
    rows, planted = [], 0
    for d in range(n_docs):
        w = [rng.choice(common) if rng.random() < 0.5 else x for x in prose(500 + d, 200)]
        if d % 2:
            _, t = rng.choice(items)
            piece = t.split()
            for _ in range(rng.randint(0, len(piece) // 5)):
                at = rng.randrange(len(piece))
                kind = rng.random()
                if kind < 0.4:
                    piece[at] = "edit"
                elif kind < 0.7:
                    del piece[at]
                else:
                    piece.insert(at, "more")
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," if rng.random() < 0.1 else x for x in piece]
            planted += 1
        rows.append((d + 100, " ".join(w)))
    return items, rows, planted


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_recall_against_brute_force(spark):
    items, rows, planted = case()
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate(docs(spark, rows), bench(spark, items)).collect()}
    want = {}
    for d, t in rows:
        text = WORD.findall(t.lower())
        for i, x in items:
            item = WORD.findall(x.lower())
            k = slow_distance(item, text)
            if k <= len(item) // 5:
                want[d, i] = k
    assert len(want) >= planted * 0.9
    assert set(found) <= set(want)                                  # verified: nothing else
    assert len(found) >= 0.95 * len(want)                           # target recall
    assert all(found[x] >= want[x] for x in found)
    assert np.mean([found[x] == want[x] for x in found]) > 0.95
    blocks = {(r.doc_id, r.item_id) for r in
              decontaminate(docs(spark, rows), bench(spark, items), items_per_block=4).collect()}
    assert blocks <= set(want) and len(blocks) >= 0.95 * len(want)


def test_sellers():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 30)
        assert sellers(a, b)[0] == slow_distance(a.tolist(), b.tolist())


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    items = [(1, item), (2, None), (3, ""), (4, "too short"), (5, item.upper()), (None, item)]
    rows = [*EDGE, (50, item), (50, item), (None, item), (51, item + " " + item), (52, item[:-10])]
    got = sorted([(r.doc_id, r.item_id) for r in decontaminate(docs(spark, rows), bench(spark, items)).collect()], key=str)
    ids = [50, 50, None, 51, 52]
    assert got == sorted([(d, i) for d in ids for i in (1, 5, None)], key=str)
    assert decontaminate(docs(spark, []), bench(spark, items)).count() == 0
    assert decontaminate(docs(spark, rows), bench(spark, [])).count() == 0
    left = drop_contaminated(docs(spark, rows), bench(spark, items))
    assert left.columns == docs(spark, []).columns and left.count() == len(EDGE)


def contained(block, items, texts):
    """Pairs (text, item) found and those of brute force."""
    found = {(t, block.ids[c]) for t, x in enumerate(texts) for c in _found(block, x)}
    want = set()
    for t, x in enumerate(texts):
        text, words = x.split(), set(x.split())
        for i, y in items:
            item = y.split()
            k = len(item) // 5
            # every edit spoils one word of the item at most
            if sum(w in words for w in item) >= len(item) - k and slow_distance(item, text) <= k:
                want.add((t, i))
    return found, want


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.random()
        w[at:at + (kind < 0.7)] = [] if kind < 0.3 else ["edit"]
    return w


def test_items_of_one_template():
    """More than COMMON items share their first words, as in benchmarks made of a template."""
    rng = random.Random(3)
    for n in (24, 32, 40, 50):
        head = [f"template{j}" for j in range(n // 3 + 1)]
        items = [(i, " ".join(head + prose(1000 * n + i, n - len(head), 3000))) for i in range(COMMON + 16)]
        block = ItemBlock(items)
        picked = rng.sample(items, 30)
        texts = [" ".join(prose(j, 40, 3000) + t.split() + prose(50 + j, 40, 3000)) for j, (_, t) in enumerate(picked)]
        found, want = contained(block, items, texts)
        assert len(want) == 30 and found == want
        texts = [" ".join(prose(j, 40, 3000) + edited(rng, t.split(), n // 5) + prose(50 + j, 40, 3000))
                 for j, (_, t) in enumerate(picked)]
        found, want = contained(block, items, texts)
        assert len(want) >= 30 and found <= want and len(found) >= 0.95 * len(want)
    found, want = contained(block, items, [" ".join(head), " ".join(head * 3)])
    assert found == want == set()


def test_edits_at_the_head():
    """All edits in the first words, or the head cut off, also at the start of a document."""
    for n in (12, 24, 40, 50, 60):
        items = [(i, " ".join(prose(2000 * n + i, n, 3000))) for i in range(25)]
        block, k = ItemBlock(items), n // 5
        for put in (lambda j: prose(9000 + j, k, 3000), lambda j: []):
            body = [(put(j), t.split()[k:]) for j, (_, t) in enumerate(items)]
            for front in (30, 0):
                texts = [" ".join(prose(j, front, 3000) + head + t + prose(50 + j, 30, 3000))
                         for j, (head, t) in enumerate(body)]
                found, want = contained(block, items, texts)
                assert len(want) >= 25 and found <= want and len(found) >= 0.95 * len(want), (n, front)


def test_long_items():
    """Reading passages, with all the edits allowed at random places."""
    for n in (65, 100, 200, 400):
        rng = random.Random(n)
        items = [(i, " ".join(prose(3000 * n + i, n, 3000))) for i in range(40)]
        texts = [" ".join(prose(j, 30, 3000) + edited(rng, t.split(), n // 5) + prose(50 + j, 30, 3000))
                 for j, t in items]
        found, want = contained(ItemBlock(items), items, texts)
        assert len(want) >= 40 and found <= want and len(found) >= 0.95 * len(want), n


def test_short_items_and_scripts_without_spaces(spark):
    from tessera.llm.decontam import ItemBlock
    han = "人工智能正在改变我们的世界和生活方式"
    items = [(1, "two plus two equals"), (2, "Entropy!"), (3, han), (4, "... !!!"), (5, "two plus two equals"), (6, "plus two")]
    block = ItemBlock(items)

    def ids(text):
        return sorted(block.every[k] for k in _found(block, text))

    assert ids("so Two plus two equals four") == [1, 5, 6]
    assert ids("two plus three equals") == [] and ids("entropy") == [2] and ids("entropys") == []
    assert ids("前言" + han[:8] + "已" + han[9:] + "结束") == [3]
    assert ids("前言" + han[::-1]) == []
    from tessera.llm.decontam import decontaminate
    from tests.llm.helpers import docs
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs(spark, [(9, "a two plus two equals b"), (8, "nothing")]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.item_words, r.start_word) for r in got) == [
        (9, 1, 0, 4, 1), (9, 5, 0, 4, 1), (9, 6, 0, 2, 2)]
