"""Every query against its SQL on the smallest tables."""

import oracle
import pytest
import quillgraph.queries  # noqa: F401
from quillgraph.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf)) == oracle.sql_rows(con, SQL[name])


def test_entry_and_registration(spark, sf):
    import __spark_entry__ as e

    names = e.queries()
    assert set(QUERIES) <= set(names) and set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).count() > 0


def test_bucketed_recall(spark, sf):
    exact = {(r.question_id, r.chunk_id) for r in QUERIES["cosine_batch"](spark, sf).collect()}
    near = {(r.question_id, r.chunk_id) for r in QUERIES["bucketed_topk"](spark, sf).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_bucketed_recall_on_more_vectors(spark):
    sf = "/root/testdata/sf0.1"
    exact = {(r.question_id, r.chunk_id) for r in QUERIES["cosine_batch"](spark, sf).collect()}
    near = {(r.question_id, r.chunk_id) for r in QUERIES["bucketed_topk"](spark, sf).collect()}
    assert len(exact) == 200 and len(exact & near) / len(exact) >= 0.9
