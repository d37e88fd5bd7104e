"""The pipeline against its stages done by brute force on the small table."""

import re

import corpus_pipeline as P
from tests.conftest import SF001
from tests.llm.test_decontam import slow_distance
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import slow_components, slow_fingerprint

from tessera.llm.decontam import WORD
from tessera.llm.toxicity import score_toxicity


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF001}/labels.parquet")).collect() if r.predicted}
    left = [i for i in sorted(rows) if i not in toxic]
    texts = {}
    for i in left:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    left = sorted(texts.values())
    comp = slow_components(left, [slow_fingerprint(rows[i].text or "") for i in left])
    left = [i for i, c in zip(left, comp) if i == c]
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    words = {i: WORD.findall((rows[i].text or "").lower()) for i in left}
    shared = {i: [x for x in items if len(set(x) & set(words[i])) >= 0.5 * len(set(x))] for i in left}
    left = [i for i in left if not any(slow_distance(x, words[i]) <= len(x) // 5 for x in shared[i])]
    got = P.run(spark, SF001).collect()
    assert sorted(r.doc_id for r in got) == left
    size = {}
    for i in left:
        size[rows[i].source] = size.get(rows[i].source, 0) + len((rows[i].text or "").encode().split())
    for s, t in slow_targets(size).items():
        assert t - 1 <= sum(r.taken for r in got if r.source == s) <= t


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("false")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, SF001).count() == 0


def test_stages_take_awkward_rows(spark):
    """NULLs in every column, blank and very long texts, repeated rows, extra
    columns: nothing crashes, clean documents stay, copies and blanks merge."""
    from tests.llm.helpers import EDGE, docs
    out = docs(spark, [*EDGE, (70, "clean words of one kind", None), (71, "you idiot"), (72, None, None)])
    for name, stage in P.STAGES[:-1]:
        new = stage(spark, out, SF001)
        assert new.columns == out.columns, name
        out = P.materialise(new, "test-stage")
    ids = {r.doc_id for r in out.collect()}
    assert {1, 4, 5, 6, 7, 8, 70} <= ids and not ids & {2, 3, 71, 72}
    last = P.STAGES[-1][1](spark, out, SF001)
    assert last.count() == out.count()
