"""Queries with a SQL twin equal it; all queries return whole tables."""

import pytest
import sqlcheck

import __spark_entry__ as entry
from skyspine.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return sqlcheck.duck(SF)


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_twin(spark, con, key):
    assert sqlcheck.compare(llm.queries()[key](spark, SF), con, llm.oracle_sql()[key]) == ""


@pytest.mark.parametrize("key", ["op1_toxicity", "op9_langid", "op10_pii_crf", "op12_alignment", "op13_token_counts"])
def test_one_row_per_document(spark, con, key):
    got = sorted(r["doc_id"] for r in llm.queries()[key](spark, SF).collect())
    assert got == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_all_are_registered():
    assert set(llm.queries()) | {"pipeline"} <= set(entry.queries())
    assert {k.split("_")[0] for k in llm.queries()} == {f"op{n}" for n in range(1, 14)}
