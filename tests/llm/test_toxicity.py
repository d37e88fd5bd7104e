import zlib

import numpy as np

from tessera.llm import toxicity as T
from tests.conftest import SF01
from tests.llm.helpers import EDGE, docs, prose


def test_grammar():
    m = T.Matcher(["grump"])
    kinds = {"you are an idiot.": "insult at target", "what a grumpling, really": "insult",
             "that is not stupid": "denied", "the witness said the idiot left": "quoted",
             "i will kill you": "threat at target", "nothing here": None, "I kill time. You wait": "threat",
             "the idiomatic use": None}
    for text, want in kinds.items():
        got = [T.PATTERNS[i] for i, n in enumerate(m.counts(text)) if n]
        assert got == ([want] if want else []), text


def test_composition_runs_left_to_right():
    machine = T.grammar()
    state = machine.start
    for s in ("negation", "other", "insult", "other", "other", "other", "insult"):
        state, _ = machine.step(state, s)
    assert T.pattern(state) == 0  # the second insult is out of the negation's scope


def test_learns_unknown_stems_and_scores_held_out(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for d in range(600):
        w, toxic = prose(d, 60), int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                w[int(rng.integers(60))] = "qwerr" + "".join(rng.choice(list("abcde"), 3))
        rows.append((d, " ".join(w)))
        labels.append((d, toxic))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.score_toxicity(docs(spark, rows), lab).collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.98
    # labels of the held-out fold are not read
    flipped = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels],
                                    "doc_id long, toxic int")
    again = T.score_toxicity(docs(spark, rows), flipped).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_held_out_accuracy_on_documents(spark):
    d, lab = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score_toxicity(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.94


def test_edges(spark):
    lab = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (None, 1, "x"), (4, None, "x")],
                                "doc_id long, toxic int, text string")
    got = T.score_toxicity(docs(spark, EDGE), lab).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    none = lab.where("false")
    got = T.score_toxicity(docs(spark, [(1, "you idiot"), (2, "fine"), (3, None)]), none).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)] == [1, 0, 0]
    assert T.score_toxicity(docs(spark, []), lab).count() == 0
    out = T.drop_toxic(docs(spark, [(1, "you idiot"), (2, "fine"), (None, None)]), none)
    assert out.columns == docs(spark, []).columns and {r.doc_id for r in out.collect()} == {2, None}
