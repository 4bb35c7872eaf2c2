"""Numbers of rows in bands, without the pairs of both: against plain counting."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from starling.operators.ordered import in_bands
from starling.plans import base, catalog  # noqa: F401
from tests.conftest import Tables, rows


@pytest.mark.parametrize("kind", ["double", "decimal(12,2)", "int"])
def test_counts_are_those_of_the_pairs(spark, kind):
    draw = random.Random(kind)
    make = {"double": float, "int": int, "decimal(12,2)": lambda x: Decimal(round(x, 2))}[kind]
    values = [(draw.choice([None, make(0), make(7), *[make(draw.uniform(-50, 50)) for _ in range(40)]]),) for _ in range(300)]
    bands = [(j, a, a + draw.choice([0, 1, 5, 80])) for j, a in enumerate(make(draw.uniform(-60, 60)) for _ in range(60))]
    bands += [(100, None, make(0)), (101, make(0), None), (102, None, None), (103, make(5), make(4)), (104, make(999), None), (105, None, make(-999)), (106, make(0), make(0))]
    bands += [(None, make(-5), make(5)), *bands[:5]]  # a null name, and bands that come twice
    df, two = spark.createDataFrame(values, f"v {kind}"), spark.createDataFrame(bands, f"j int, lo {kind}, hi {kind}")
    want = [(*b, n) for b in bands if (n := sum(v is not None and (b[1] is None or v >= b[1]) and (b[2] is None or v <= b[2]) for v, in values))]
    if kind != "double":  # decimals as Spark gives them back
        want = [tuple(r) for r in spark.createDataFrame(want, f"j int, lo {kind}, hi {kind}, n long").collect()]
    assert rows(in_bands(df, "v", two, "lo", "hi", 3, "n")) == sorted(want, key=repr)
    pairs = in_bands(df, "v", two, "lo", "hi", 3).groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    assert rows(in_bands(df, "v", two, "lo", "hi", 3, "n").groupBy("j").agg(F.sum("n").alias("n"))) == rows(pairs)
    assert in_bands(df.limit(0), "v", two, "lo", "hi", 3, "n").collect() == [] == in_bands(df, "v", two.limit(0), "lo", "hi", 3, "n").collect()


def test_parts_with_many_orders_form_no_pairs(spark):
    """Every part's band holds every order: 4 * 10^10 pairs, counted from 400,000 rows."""
    n = 200_000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(50).alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    orders = spark.range(n).select((89_600.0 + F.col("id") % 700).alias("o_totalprice"))
    tables = Tables({"part": part, "orders": orders})
    tables["source"] = lambda name: {"part": part, "orders": orders}[name]
    got = base.REGISTRY["join_bands_of_parts"](tables)
    assert got.count() == n and got.agg(F.min("orders"), F.max("orders")).first() == (n, n)
