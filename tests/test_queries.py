"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quillrank.plans import ORACLES, QUERIES
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf_dir, name):
    check(spark, con, QUERIES[name], ORACLES[name], sf_dir)


def test_without_sql(spark, sf_dir):
    assert sorted(set(QUERIES) - set(ORACLES)) == ["citation_rewrite", "html_lines", "mmr_select", "strategy_cross_document", "strategy_listing"]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "node_id", "score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
