import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from starling.operators.ranking import global_ranks, surrogate_keys
from starling.plans import refresh
from starling.plans.increments import Increments, Refused
from tests.conftest import rows


def test_lost_dates_and_clock(spark):
    df = spark.createDataFrame([("1999-03-04",), ("-4713-11-2",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(refresh.day_of("d")).collect()] == [datetime.date(1999, 3, 4), None, None, None]
    clock = spark.createDataFrame([("01:02:03",), ("23:59:59",)], "t string")
    assert [r[0] for r in clock.select(refresh.seconds_of("t")).collect()] == [3723, 86399]


def test_look_up_keeps_unknown_and_drops_closed(spark):
    rows_ = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    dim = spark.createDataFrame([(1, "a", "1997-01-01"), (2, "a", None), (3, "b", "1997-01-01")], "sk int, bk string, ended string")
    got = refresh.look_up(rows_, dim, "id", "bk", "x_", "sk", current="ended").select("id", "x_sk")
    assert rows(got) == sorted([("a", 2), ("c", None), (None, None)], key=repr)


def test_type1_overwrites_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "old", 5), (2, "b", "old", 6)], "sk int, id string, v string, n int")
    updates = spark.createDataFrame([("a", None), ("z", "new")], "id string, v string")
    once = refresh.update_type1(target, updates, "id", ["v"])
    assert rows(once) == rows(spark.createDataFrame([(1, "a", None, 5), (2, "b", "old", 6)], target.schema))
    assert rows(refresh.update_type1(once, updates, "id", ["v"])) == rows(once)


def test_type2_closes_and_inserts(spark):
    target = spark.createDataFrame(
        [(1, "K0001", datetime.date(1995, 1, 1), datetime.date(1997, 1, 1), "v1"), (2, "K0001", datetime.date(1997, 1, 1), None, "v2"),
         (3, "K0002", datetime.date(1997, 1, 1), None, "w")], "sk int, id string, s date, e date, v string")
    updates = spark.createDataFrame([("K0001", "v3"), ("K0003", "n")], "id string, v string")
    got = {r.sk: r for r in refresh.update_type2(target, updates, "sk", "id", "s", "e", "2002-06-30").collect()}
    today = datetime.date(2002, 6, 30)
    assert len(got) == 5 and got[2].e == today and got[1].e == datetime.date(1997, 1, 1) and got[3].e is None
    assert (got[4].id, got[4].v, got[4].s, got[4].e) == ("K0001", "v3", today, None) and got[5].id == "K0003"


def test_increments_keep_every_line_with_a_current_item(tiny):
    n = tiny.s_purchase_lineitem.join(tiny.s_purchase, F.col("plin_purchase_id") == F.col("purc_purchase_id")).count()
    assert refresh.store_sales_increment(tiny).count() == n
    lost = refresh.catalog_sales_increment(tiny).filter("cs_sold_date_sk is null").count()
    assert 0 < lost < tiny.s_catalog_order_lineitem.count()


def test_append_adds_rows(spark, tiny, tmp_path):
    path = str(tmp_path / "fact")
    increment = refresh.store_returns_increment(tiny)
    refresh.append(increment, path)
    refresh.append(increment, path)
    assert spark.read.parquet(path).count() == 2 * increment.count()


def test_customer_refresh_changes_some_and_only_some(tiny):
    changed = refresh.refresh_customer(tiny).join(tiny.customer.select("c_customer_sk", F.col("c_last_name").alias("was")), "c_customer_sk")
    n = changed.filter("c_last_name <> was").count()
    assert 0 < n < tiny.customer.count()


def test_extract_limit_is_deterministic(tiny):
    got = [r.item_item_id for r in refresh.extract_item(tiny, 5).collect()]
    assert sorted(got) == sorted(r.item_item_id for r in refresh.extract_item(tiny).orderBy("item_item_id").limit(5).collect())


def test_only_once_drops_all_copies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(refresh.only_once(df, "k")) == [("b", 3)]


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 5)), min_size=1, max_size=60))
def test_global_ranks_equal_window_rank(spark, values):
    df = spark.createDataFrame([(i, p, x / 8, y / 2) for i, (p, x, y) in enumerate(values)], "id int, p string, x double, y double")
    got = global_ranks(df, "p", rx=("x", F.floor("x")), ry=("y", F.floor("y")))
    want = df.withColumn("rx", F.rank().over(Window.partitionBy("p").orderBy("x"))).withColumn(
        "ry", F.rank().over(Window.partitionBy("p").orderBy("y")))
    assert rows(got) == rows(want)


def test_surrogate_keys_follow_key_order(spark):
    df = spark.range(250).select(F.format_string("ID%08d", F.pmod(F.col("id") * 7919, F.lit(100003))).alias("k"))
    got = surrogate_keys(df, "k", F.lit(1000), "sk")
    want = df.withColumn("sk", F.lit(1000) + F.row_number().over(Window.orderBy("k")))
    assert rows(got) == rows(want)


def test_ranks_and_keys_keep_nulls_ties_and_uneven_keys(spark):
    data = [(g, v, i) for i, (g, v) in enumerate([("a", 1.0), ("a", None), ("a", 2.0), ("a", 2.0), ("a", -5000.5), (None, 3.0), (None, None), ("b", 1e9), ("b", 1.5)])]
    df = spark.createDataFrame(data, "g string, v double, i int")
    got = global_ranks(df, "g", rk=("v", F.floor(F.col("v") * 1000)))
    want = df.withColumn("rk", F.rank().over(Window.partitionBy("g").orderBy("v")))
    assert rows(got.select("g", "v", "i", "rk")) == rows(want.select("g", "v", "i", "rk"))
    keys = spark.createDataFrame([(k,) for k in ["K0001", None, "K0003", "", "K", "K00010000000000000007", "AAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAB"]], "k string")
    got = surrogate_keys(keys, "k", F.lit(10), "sk")
    want = keys.withColumn("sk", 10 + F.row_number().over(Window.orderBy(F.asc_nulls_first("k"))))
    assert rows(got.select("k", "sk")) == rows(want.select("k", "sk"))


def test_only_once_counts_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert rows(refresh.only_once(df, "k")) == [(2, "c")]
    assert "SortAggregate" not in refresh.only_once(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_append_counts_what_is_stored(spark, tiny):
    got = {r.fact: r for r in refresh.refresh_append(tiny).collect()}
    for fact, build in refresh.INCREMENTS.items():
        before, added = tiny[fact].count(), build.build(tiny).count() if hasattr(build, "build") else build(tiny).count()
        assert (got[fact].rows_before, got[fact].rows_added, got[fact].rows_after) == (before, added, before + added)


def test_increment_is_taken_whole_or_not_at_all(spark, tmp_path):
    kept = Increments(spark, str(tmp_path / "facts"))
    assert kept.read("a") is None and kept.taken() == {}
    a, b = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string"), spark.createDataFrame([(1,), (1,)], "k int")
    known = lambda table, stored, new: new.join(stored.select("k").distinct(), "k", "left_semi")
    first = kept.add({"a": a, "b": b}, known)
    with pytest.raises(Refused) as refused:  # b fits nothing stored, a does not fit
        kept.add({"b": b.filter("k > 1"), "a": a}, known)
    assert refused.value.counts == {"b": 0, "a": 1}
    broken = spark.createDataFrame([(3,)], "k int").select(F.raise_error(F.lit("lost")).cast("int").alias("k"))
    with pytest.raises(Exception, match="lost"):
        kept.add({"a": a, "b": broken})
    (tmp_path / "facts" / "left_by_a_dead_writer" / "a").mkdir(parents=True)
    assert list(kept.taken()) == [first] and rows(kept.read("a")) == rows(a) and rows(kept.read("b")) == rows(b)
    assert sorted(p.name for p in (tmp_path / "facts").iterdir()) == sorted([first, "left_by_a_dead_writer", "taken"])
    kept.add({"a": spark.createDataFrame([(2, 5)], "k int, more int")}, known)
    assert rows(kept.read("a")) == rows(spark.createDataFrame([(1, "x", None), (None, "n", None), (2, None, 5)], "k int, v string, more int"))
