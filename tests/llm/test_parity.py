"""Operators that SQL can express, on all rows."""

import pytest

from tests.parity import compare
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_operator_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


def test_thirteen_operators_and_the_pipeline():
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in e.queries()
