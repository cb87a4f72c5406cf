"""The registered queries over the test tables: against SQL where there is one, else their shape."""

import duckdb
import pytest
from oracle_check import compare, connect

import __spark_entry__
from vigia.llm.oracle import ORACLE
from vigia.llm.queries import QUERIES

COLUMNS = {
    "op1_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_token_count": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_html_density": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op9_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


@pytest.mark.parametrize("name", COLUMNS)
def test_query_covers_its_table(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    table = {"op1": "embeddings", "op5": "pages"}.get(name.partition("_")[0], "documents")
    rows = duckdb.sql(f"SELECT count(*) FROM '{sf_dir}/{table}.parquet'").fetchall()[0][0]
    if name == "op8_decontamination":
        assert 0 < out.count() < rows
    elif name == "op1_multi_index":
        assert out.select("query_id").distinct().count() == rows // 20
    else:
        assert out.count() == rows


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
