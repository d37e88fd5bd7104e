import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import DedupState, drop_copies, exact_dedup
from tests.llm.helpers import EDGE, docs

ROWS = [(10, "a  b"), (11, "a b"), (9, "a\t\nb"), (12, "A b"), (13, "a b "), (None, "a b"), *EDGE]


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i, d))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out.append((m[3], first[3], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check(res, rows):
    got = res.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({b[3] for b in brute(rows)})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_matches_brute_force(spark):
    check(exact_dedup(docs(spark, ROWS)), ROWS)


def test_digests_that_collide_are_split_by_the_bytes(spark):
    check(exact_dedup(docs(spark, ROWS), digest=lambda n: F.substring(F.md5(n.cast("binary")), 1, 1)), ROWS)
    check(exact_dedup(docs(spark, ROWS), digest=lambda n: F.lit("same")), ROWS)


def test_state_goes_on_over_batches(spark):
    book = DedupState(spark, max_bytes_per_batch=1)
    book.ingest(docs(spark, [(5, "x"), (6, "y")]).repartition(2))
    book.ingest(docs(spark, [(3, "x"), (7, "z")]))
    state = {(r["first"].id, r.n) for r in book.state().collect()}
    assert state == {(3, 2), (6, 1), (7, 1)}


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_stage_keeps_one_row_of_each_text(spark):
    out = drop_copies(docs(spark, ROWS))
    assert out.columns == docs(spark, []).columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})
