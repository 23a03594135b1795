import importlib.util

import pytest

import corpus_pipeline
from checks.compare import TABLES, _normal
from eventlens.llm.queries import llm_oracles, llm_queries
from tests.llm.conftest import SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query(spark, name):
    """Every query gives rows; those with SQL give the same rows as that."""
    import duckdb
    import pandas as pd

    frame = llm_queries()[name](spark, SF)
    actual = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    assert len(actual)
    if name in llm_oracles():
        connection = duckdb.connect()
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        expected = connection.sql(llm_oracles()[name]).df().astype(object)
        assert sorted(actual.columns) == sorted(expected.columns)
        assert _normal(actual) == _normal(expected)


def test_contract_columns(spark):
    heads = {
        "op1_": "doc_id fingerprint component_id", "op3_": "doc_id held_out score predicted",
        "op5_": "page_id host path rule verdict", "op6_": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op10_": "doc_id held_out lang_pred score",
        "op11_": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op12_": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op13_": "word form root n n_near form_n",
    }
    for name, build in llm_queries().items():
        for head, columns in heads.items():
            if name.startswith(head):
                assert build(spark, SF).columns[: len(columns.split())] == columns.split()


def test_pipeline(spark, tmp_path):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*documents.columns, "copy", "shuffle_key"] and out.count() > 50


def test_stages_on_odd_and_empty_tables(spark, frame):
    from tests.llm.conftest import ODD

    for rows in (ODD, []):
        docs = frame(rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.schema.fieldNames() == SCHEMA.fieldNames()
            out.collect()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(importlib.util.find_spec("eventlens").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "eventlens.llm" not in path.read_text()
