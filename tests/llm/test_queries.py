"""The registered queries of the thirteen operators on the small tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tessera.llm.queries import QUERIES, SQL
from tools.oracle_check import digest, duck

CONTRACT = {
    "op1_exact_dedup": "doc_id bigint keep_id bigint group_size bigint kept boolean text_sha256 string",
    "op3_html_text": "page_id bigint url string text string n_chars bigint",
    "op4_simhash": "doc_id bigint fingerprint string component_id bigint",
    "op5_pii": "doc_id bigint n_email bigint n_ip bigint n_card bigint n_phone bigint base_sha256 string spans string",
    "op6_mixing": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op7_lm_score": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint "
                    "base_score double score double",
    "op8_toxicity": "doc_id bigint held_out boolean score double predicted int",
    "op11_conversation_repair": "conv_id bigint gaps bigint blank bigint duplicate bigint truncated bigint illegal bigint "
                                "cost bigint audit string repaired_sha256 string",
    "op12_spelling_variants": "word string form string root string n bigint n_near bigint form_n bigint",
    "op13_top_k": "query_id bigint rank int vec_id bigint score bigint",
}
ROWS = {"op3_html_text": "select count(*) from pages", "op11_conversation_repair": "select count(distinct conv_id) from conversations",
        "op12_spelling_variants": None, "op13_top_k": "select 5 * count(*) from embeddings where vec_id % 50 = 0"}


def test_all_operators_and_the_pipeline_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_row_counts(spark, name):
    df = QUERIES[name](spark, SF001)
    assert " ".join(f"{c} {t}" for c, t in df.dtypes) == CONTRACT[name]
    count = ROWS.get(name, "select count(*) from documents")
    assert count is None or df.count() == duck(SF001).execute(count).fetchone()[0]


@pytest.mark.parametrize("name", SQL)
def test_query_matches_duckdb(spark, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF001).execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows)[0] == digest(cols, cur.fetchall())[0]


def test_scores_beat_the_base_on_held_out_texts(spark):
    r = QUERIES["op7_lm_score"](spark, SF001).where("held_out").selectExpr(
        "sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert r.s > r.b
