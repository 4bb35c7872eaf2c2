"""Every registered query against its independent SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from starling.plans import base, catalog  # noqa: F401
from tests.conftest import DATA, same_rows

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_every_query_has_an_oracle():
    """Queries that SQL cannot express belong to the document operators, which have their own tests."""
    assert set(base.REGISTRY) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(base.REGISTRY))
def test_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.01")
    mine, theirs = same_rows(df, oracle, ORACLE[name])
    assert mine, "no rows: the parameters select nothing"
    assert any(v not in ("None", "0", "0.0") for row in mine for v in row)
    assert mine == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["d_year", "brand_id", "brand", "sum_agg"] and df.count() > 0
