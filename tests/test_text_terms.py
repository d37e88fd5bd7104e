"""Terms of texts: dealt once by document, packed by term for the join with a dictionary."""

import math
import re
from collections import Counter

import pytest

from tessera.operators import category as C

DOCS = [(1, "red red blue"), (2, "red green the"), (2, "red the the"), (None, "blue x"), (None, "blue"), (3, None), (4, ""),
        *((i, f"the w{i % 7} w{i}") for i in range(10, 60))]
LABELS = [(1, 1), (2, 0), (2, 0), (4, 1), (None, 1), (99, 0), *((i, i % 3 % 2) for i in range(10, 40))]


def _exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def _terms(spark):
    docs = spark.createDataFrame(DOCS, "d long, t string").repartition(5)
    return C.word_terms(docs, "d", "t").withColumnRenamed("tf", "x")


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_naive_bayes_feature_over_repeated_and_lost_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(C, "TASK_TERMS", 4)
    count = Counter((d, w) for d, t in DOCS if t for w in t.split())
    fit, n = {}, Counter(y for _, y in LABELS)
    for (d, w), x in count.items():
        for i, y in LABELS:
            if d is not None and i == d:
                fit.setdefault(w, Counter())[y] += x
    r = {w: math.log((c[1] + 1) / (n[1] + 1)) - math.log((c[0] + 1) / (n[0] + 1)) for w, c in fit.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        terms = _terms(spark)
        ratios = C.nb_ratios(terms, "d", "term", "x", spark.createDataFrame(LABELS, "d long, y int"), "y")
        got = C.nb_log_ratio(terms, "d", "term", "x", ratios).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {(d, w): x * r[w] for (d, w), x in count.items() if w in r}
    assert len(got) == len(want) and (None, "blue") in want
    assert all(abs(want[g["d"], g["term"]] - g["nb"]) < 1e-9 for g in got)


def test_words_are_dealt_by_document_and_packed_by_term(spark, monkeypatch):
    terms = _terms(spark)
    assert [x.split("#")[0] for x in _exchanges(terms)] == ["d"]
    monkeypatch.setattr(C, "TASK_TERMS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = C.packed(terms.coalesce(1), "d", "term", "x").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(d, r["term"], x) for r in rows for d, x in zip(r["_docs"], r["_values"])} == {tuple(r) for r in terms.collect()}
    the = [len(r["_docs"]) for r in rows if r["term"] == "the"]
    assert sum(the) == 51 and 1 < len(the) < 51  # more than one row, far fewer than one per document


def test_character_ngrams_are_dealt_by_the_length_of_the_texts(spark, monkeypatch):
    """A task's share is bounded, whatever the texts hold; equal ids count together."""
    monkeypatch.setattr(C, "TASK_TERMS", 100)
    docs = spark.createDataFrame([(i % 90, f"part {i} ring") for i in range(100)] + [(None, "ring"), (7, None), (8, "")],
                                 "d long, t string").repartition(1)
    terms = C.char_terms(docs, "d", "t", (2, 3))
    n = re.findall(r"hashpartitioning\(d#\d+L?, (\d+)\), REPARTITION_BY_NUM", terms._jdf.queryExecution().executedPlan().toString())
    assert len(_exchanges(terms)) == len(n) == 1 and int(n[0]) >= 20
    want = Counter((d, t[i:i + k]) for d, t in ((r.d, r.t) for r in docs.collect()) if t
                   for k in (2, 3) for i in range(len(t) - k + 1))
    assert {(r.d, r.term): r.tf for r in terms.collect()} == want
    idf = C.tfidf_fit(terms, 103)
    assert "Aggregate" not in idf._jdf.queryExecution().executedPlan().toString()  # a table whose size is known
