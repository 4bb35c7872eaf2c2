import pytest
from pyspark.sql import functions as F

from starling.operators import checks
from starling.plans import integrity
from tests.conftest import rows


def test_clean_star_has_no_orphans_and_no_duplicates(tiny):
    assert not integrity.check_foreign_keys(tiny).filter("orphan_rows > 0").collect()
    assert not integrity.check_primary_keys(tiny).filter("rows <> distinct_keys or null_keys > 0").collect()
    assert not integrity.check_return_keys(tiny).filter("orphan_rows > 0").collect()


def test_broken_star_is_found(tiny):
    tables = {x: tiny[x] for x in integrity.STAR}
    tables["store"] = tables["store"].filter("s_store_sk <> 3")
    links = integrity.foreign_keys({x: df.columns for x, df in tables.items()})
    bad = {(r.child, r.column): r.orphan_rows for r in checks.foreign_key_profile(tables, links).filter("orphan_rows > 0").collect()}
    assert bad[("store_sales", "ss_store_sk")] == tiny.store_sales.filter("ss_store_sk = 3").count() > 0
    assert set(c for _, c in bad) == {"ss_store_sk", "sr_store_sk"}
    twice = tiny.store.unionByName(tiny.store.filter("s_store_sk = 1"))
    assert rows(checks.duplicate_keys(twice, ["s_store_sk"])) == [(1, 2)]
    assert checks.orphans(tables["store_sales"], tables["store"], ("ss_store_sk", "s_store_sk")).count() == bad[("store_sales", "ss_store_sk")]


def test_number_of_foreign_keys(tiny):
    assert len(integrity.foreign_keys({x: tiny[x].columns for x in integrity.STAR})) == 104


@pytest.mark.parametrize("values, keys, want", [
    ([1, 2, None], [2], [1]), ([1, 2, None], [2, None], []), ([1, None], [], [None, 1]), ([1, 2], [None], [])])
def test_not_in_follows_sql(spark, values, keys, want):
    left = spark.createDataFrame([(v,) for v in values], "a int")
    right = spark.createDataFrame([(k,) for k in keys], "b int")
    got = [r.a for r in checks.not_in(left, "a", right, "b").collect()]
    left.createOrReplaceTempView("ni_left")
    right.createOrReplaceTempView("ni_right")
    sql = [r.a for r in spark.sql("select a from ni_left where a not in (select b from ni_right)").collect()]
    assert sorted(got, key=str) == sorted(sql, key=str) == sorted(want, key=str)


def test_row_counts_against_expectation(spark):
    got = rows(checks.row_counts({"a": spark.range(3), "b": spark.range(2)}, {"a": 3, "b": 5}))
    assert got == [("a", 3, 3, True), ("b", 2, 5, False)]


def test_missing_rows_compares_nulls(spark):
    table = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    sample = spark.createDataFrame([(1, None), (2, "y")], "a int, b string")
    assert rows(checks.missing_rows(sample, table)) == [(2, "y")]


def test_cell_differences(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 2), (3, "q", 3)], "k int, s string, n int")
    assert rows(checks.cell_differences(a, b, ["k"])) == [(1, "n", "1", "5"), (2, "s", None, "z")]


def test_same_content_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, s string")
    assert checks.same_content(a, a.orderBy(F.desc("k"))).collect()[0].same
    assert not checks.same_content(a, a.distinct()).collect()[0].same
    assert not checks.same_content(a, a.withColumn("s", F.coalesce("s", F.lit("")))).collect()[0].same


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rows(checks.null_counts(df, ["a", "b"])) == [("a", 1), ("b", 2)]


def test_answers_in_both_layouts(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0, "x y"), (7, 2.346, None)], "a int, b double, c string")
    (tmp_path / "p.ans").write_text("A|B|C\n|1.00|x y\n7|2.35|\n")
    (tmp_path / "r.ans").write_text("         A          B C\n---------- ---------- ----------\n"
                                    "         7       2.35\n                 1.00 x y\n\n\n")
    for name in ("p.ans", "r.ans"):
        golden = checks.read_answer(spark, str(tmp_path / name), df.schema)
        assert golden.count() == 2
        assert checks.compare_answer(df, golden).count() == 0
    other = df.withColumn("b", F.col("b") + 1)
    assert checks.compare_answer(other, golden).groupBy("side").count().count() == 2
