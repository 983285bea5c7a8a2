from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    """Rows (doc_id, text, lang, source) of the smallest table."""
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
