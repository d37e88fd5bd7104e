"""Spelling variants against the deletion neighbourhoods of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.spelling import Index, Letters, Words, roots, spelling_variants
from tests.conftest import SF001
from tests.llm.helpers import DOC_SCHEMA, EDGE, docs


def expected(rows, min_count=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= min_count}
    swapped, shorter, near = defaultdict(list), defaultdict(list), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            swapped[w[:i] + "*" + w[i + 1:]].append(w)
            shorter[w[:i] + w[i + 1:]].append(w)
    for group in swapped.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for x in shorter.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def got(df, **how):
    rows = spelling_variants(df, **how).collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("how", [{}, {"list_rows": 5, "bucket_postings": 3000}])
def test_whole_table(spark, how):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    assert got(df, **how) == expected([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rows = EDGE + [(20, "Hello hello HELLO hallo hallo hallo hallo hallo hallo hellos hellos hellos"), (21, "Ünder Ünder Ünder under under under"),
                   (22, ("z" * 70_000 + " ") * 3 + ("z" * 69_999 + "y ") * 3 + ("z" * 69_999 + " ") * 3),
                   (23, "banana banana banana bananana bananana bananana banan banan banan"), (24, "a×b×cde a×b×cde a×b×cde"),
                   (None, "x1y2 hallo-hallo_hallo")] + [(30 + i, "aaaaaa aaaaaaa aaaaaaaa bbbbb") for i in range(4)]
    assert got(docs(spark, rows)) == expected([(r[0], r[1]) for r in rows])
    assert got(spark.createDataFrame([], DOC_SCHEMA)) == {}


def test_dense_words_in_cut_lists(spark):
    """All words share their grams: every list is long, blocks are dealt in pairs."""
    words = [f"{a}{b}aaa{c}{d}" for a in "abc" for b in "abcd" for c in "abcd" for d in "abc"]
    rows = [(i, " ".join(words + words[: i * 20])) for i in range(5)]
    assert got(docs(spark, rows), list_rows=4) == expected([(r[0], r[1]) for r in rows])


def test_a_gram_at_two_places_of_a_word_links_once(spark):
    """One letter many times over: a gram and its neighbour place are one list."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 10))) for _ in range(3000)]
    words += [x * n for x in "abc" for n in range(5, 10)]
    rows = [(i, " ".join(words)) for i in range(3)]
    assert got(docs(spark, rows)) == expected([(r[0], r[1]) for r in rows])


def test_a_chain_of_forms_ends_at_its_root(spark):
    chain = [f"word{'abcdefghij'[:i]}" for i in range(1, 11)]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2 ** i)))]
    assert got(docs(spark, rows)) == expected([(1, rows[0][1])])
    forms = spark.createDataFrame([(str(i), str(i + 1) if i < 40 else None) for i in range(41)], "word string, form string")
    assert {r["root"] for r in roots(forms).collect()} == {"40"}


def test_an_edit_keeps_all_but_the_affected_grams():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé"), rng.integers(5, 12))) for _ in range(400)]
    t = Letters([w.encode("latin-1") for w in words])
    index = Index({q: np.unique(t.grams(q)[t.left >= q])[::2].astype(np.int64) for q in (2, 3)})
    gram, word, pos, affected = index.decompose(t)
    assert (np.bincount(word) > affected).all()
    for i, w in enumerate(words):
        mine = Counter(gram[word == i].tolist())
        for at in range(len(w) + 1):
            for v in (w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]):
                if v and v != w:
                    other = Counter(index.decompose(Letters([v.encode("latin-1")]))[0].tolist())
                    assert (mine & other).total() >= mine.total() - affected[i]


def test_comparison_of_pairs():
    text = [b"kitten", b"sitten", b"kitte", b"kittens", b"kitchen", b"q" * 50, b"q" * 49, b"q" * 48 + b"ab"]
    w = Words(text)
    near = {(a, b) for a in range(8) for b in range(8) if a != b and 0 <= len(text[b]) - len(text[a]) <= 1
            and len(w.near(np.array([a]), np.array([b])))}
    assert near == {(0, 1), (1, 0), (2, 0), (0, 3), (6, 5)}
