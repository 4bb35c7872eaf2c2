"""What jobs over every fact store: each fact once, no shuffle files, nothing of a refused increment; on rows made here."""

import datetime

import pytest
from pyspark.sql import functions as F

from starling.plans import base, catalog, star as definitions  # noqa: F401
from starling.plans.increments import Increments, Refused
from starling.plans.warehouse import Star, shuffles_dropped
from tests.conftest import rows


def day(n):
    return datetime.datetime(1995, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Order tables with repeated and null keys, lines without their order and repeated lines of one part."""
    at = str(tmp_path_factory.mktemp("source"))
    words = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None]
    tables = {
        "region": ([(i, f"R{i}") for i in range(3)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION_{i}", i % 3) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", i % 25, i * 10.5, "BUILDING") for i in range(30)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"S{i}", i % 25, i * 3.5) for i in range(12)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(i, f"red part {i}", f"Brand#{i % 5}", "TIN", i % 50 or None, 900.0 + i) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, i % 30 if i % 13 else None, "OFP"[i % 3], 90_000.0 + 7 * i, day(i * 3 % 900) if i % 19 else None, words[i % 6]) for i in range(200)] + [(5, 1, "O", 1.0, day(1), "1-URGENT")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 210 if i % 41 else None, i * 7 % 40 if i % 43 else None, i % 12, i % 4, float(i % 50 + 1) if i % 47 else None, 100.0 + i, i % 11 / 100, 0.0, "RNA"[i % 3], "O", day(i % 900 + 5)) for i in range(900)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def stored(spark, source, tmp_path_factory):
    """A star of which every table is stored."""
    out = Star.of(spark, source, str(tmp_path_factory.mktemp("stored")))
    for table in definitions.TABLES:
        out[table].count()
    return out


def check(spark, source, stored, folder, name):
    """The same rows whether the facts were stored before or not, and no fact is stored for them."""
    fresh = Star.of(spark, source, folder)
    want = rows(base.REGISTRY[name](stored))
    assert want and rows(base.REGISTRY[name](fresh)) == want
    assert not [x for x in definitions.FROM_LINES if fresh.staged(x)]
    assert all(stored.staged(x) for x in definitions.FROM_LINES)


@pytest.mark.parametrize("name", ["refresh_append", "refresh_append_refused", "check_row_counts", "check_primary_keys", "check_return_keys"])
def test_jobs_over_every_fact_store_none(spark, source, stored, tmp_path, name):
    check(spark, source, stored, str(tmp_path), name)


def test_derived_facts_equal_stored_ones(spark, source, stored, tmp_path):
    lazily = Star.of(spark, source, str(tmp_path)).lazily()
    for table in definitions.TABLES:
        assert rows(lazily[table]) == rows(stored[table]), table
    assert stored.inventory.count() > 0 and stored.lines.count() > 0


def test_lines_are_stored_without_what_is_worked_out(stored):
    kept = stored.spark.read.parquet(f"{stored.folder}/order_lines").columns
    assert not stored.staged("lines") and not set(kept) & {"x_list", "x_sale", "x_cost", "x_disc", "coupon", "ship", "rqty", "sale", "cost"}
    assert {"x_list", "coupon", "sale"} <= set(stored.lines.columns)


def test_stock_unfolds_last_and_equals_the_grouped_weeks(spark, stored):
    """Weeks after an order are neither shuffled nor grouped; lost weeks, items and quantities among them."""
    text = stored.derive("inventory")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in text and not any(x in text.split("Generate explode")[0] for x in ("Exchange", "Aggregate"))
    oracle, d = definitions.Duck().stock(), definitions.Spark()
    grouped = d.finish(f"select inv_date_sk, inv_item_sk, inv_warehouse_sk, x from {oracle}").replace("unnest(range(8))", d.unnest(8))
    mine = d.finish(f"select inv_date_sk, inv_item_sk, inv_warehouse_sk, x from {d.stock()}")
    want, got = [rows(spark.sql(q.replace("from lines", "from {lines}"), lines=stored.lines)) for q in (grouped, mine)]
    assert got == want and {tuple(x is None for x in r) for r in want} >= {(True, False, False, True), (False, True, False, True), (False, False, False, False)}


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_ = tracker.shuffleStatuses().size(), spark.conf.get(key, None)
    with shuffles_dropped(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "a"))
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(key, None) == set_
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7


def test_a_refused_increment_keeps_one_table_at_a_time(spark, tmp_path):
    """Of tables after the one that refuses only the counts are wanted: their files go before the next is written."""
    kept = Increments(spark, str(tmp_path))
    two = spark.createDataFrame([(1,), (None,)], "k int")
    kept.add({x: two for x in "abcd"})
    seen = []

    def known(table, stored, new):
        own = next(p for p in tmp_path.iterdir() if p.is_dir() and p.name not in (*kept.taken(), "taken"))
        seen.append(sorted(p.name for p in own.iterdir()))
        return new.join(stored, "k", "left_semi").filter(F.lit(table != "a"))

    with pytest.raises(Refused) as refused:
        kept.add({x: two for x in "abcd"}, known)
    assert refused.value.counts == {"a": 0, "b": 1, "c": 1, "d": 1}
    assert seen == [["a"], ["a", "b"], ["c"], ["d"]]
    assert len(kept.taken()) == 1 and rows(kept.read("d")) == rows(two) and len(list(tmp_path.iterdir())) == 2
