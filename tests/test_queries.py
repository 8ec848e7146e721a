"""Every query with SQL against DuckDB, and the others for a result, over the smallest tables."""

import pytest

from lodestone.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, connection, name):
    same(QUERIES[name](spark, SF), connection, ORACLE_SQL[name])


def test_queries_without_sql_have_a_plain_version():
    """Those are tested in test_brute.py and test_operators.py."""
    assert QUERIES.keys() - ORACLE_SQL.keys() == {"ann_graph_recall", "ann_ivf_recall", "chunk_recursive", "chunk_semantic", "quota_pack", "agent_loop", "trace_scores", "loop_statistics", "lsa_dense", "reranker_weights", "ann_coded_topk", "ann_coded_recall", "neighbour_graph", "postings_read", "trace_ids", "synthetic_corpus"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
