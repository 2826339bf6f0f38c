import pytest

from check import difference, tables
from pulse.llm.oracle import SQL
from pulse.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    mine = QUERIES[name](spark, FOLDER).toPandas()
    assert len(mine) > 0 and difference(mine, tables(FOLDER).execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_its_columns(spark, name):
    columns = {
        "op1_token_store": "doc_id start n_tokens ids_crc32",
        "op4_language_id": "doc_id held_out lang_pred score",
        "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op7_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_decontamination": "doc_id item_id score",
        "op13_html_extraction": "page_id url text n_chars",
        "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }[name].split()
    assert QUERIES[name](spark, FOLDER).columns[: len(columns)] == columns
