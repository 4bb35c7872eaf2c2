"""Plans are what the cluster should run."""

import re

import pytest
from pyspark.sql import functions as F

from starling.plans import base, star as definitions, warehouse
from starling.plans.warehouse import Star
from tests.conftest import DATA, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    """The star laid out by day."""
    return Star.of(spark, f"{DATA}/sf0.001", str(tmp_path_factory.mktemp("star")), by_day=True)


def test_no_python_and_no_cartesian_product(tiny):
    for name, q in base.REGISTRY.items():
        if re.fullmatch(r"q\d\d.*", name):
            text = plan(q(tiny, **q.bind))
            assert "Python" not in text and "CartesianProduct" not in text, name
            # A nested loop only ever attaches a single row.
            for build in re.findall(r"BroadcastNestedLoopJoin (\w+)", text):
                assert build == "BuildRight", name


def test_scan_is_pruned_and_filtered(tiny):
    text = plan(base.REGISTRY["q96"](tiny))
    fact = next(x for x in text.splitlines() if "FileScan" in x and "ss_sold_time_sk" in x)
    assert set(re.findall(r"(ss_\w+)#", fact.split("DataFilters")[0])) == {"ss_sold_time_sk", "ss_hdemo_sk", "ss_store_sk"}
    assert "IsNotNull(ss_store_sk)" in fact
    store = next(x for x in text.splitlines() if "FileScan" in x and "s_store_name" in x)
    assert "EqualTo(s_store_name,ese)" in store


def test_days_prune_partitions_of_large_facts(by_day, tiny):
    dates = by_day.date_dim.filter("d_year = 1999 and d_moy = 3")
    df = by_day.store_sales.join(dates, F.col("ss_sold_date_sk") == F.col("d_date_sk")).groupBy("ss_item_sk").count()
    assert "dynamicpruning" in plan(df).lower()
    # Between them these read every fact.
    for name in ("q03", "q42", "q05", "q21", "q40", "q49", "q77"):
        q = base.REGISTRY[name]
        assert rows(q(by_day, **q.bind)) == rows(q(tiny, **q.bind)), name


def test_top_ranks_are_limited_before_the_shuffle(tiny):
    text = plan(base.REGISTRY["q67"](tiny))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning(i_category")


def test_product_lines_read_every_channel_once(tiny):
    from starling.plans import queries_01_20 as some
    month = tiny.date_dim.filter("d_year = 2000 and d_moy = 11")
    text = plan(some.line_sales(tiny, 1998, month=month, week=month.filter("d_dom < 8")))
    for p in ("ss", "cs", "ws"):
        assert len(re.findall(rf"ReadSchema: struct<[^>]*{p}_item_sk", text)) == 1
    assert text.count("FileScan") <= 3 + 1 + 3 * 3  # channels, items, and the days of three spans for each channel


def test_staged_once_per_session_and_source(spark):
    one, two = Star.of(spark, f"{DATA}/sf0.001"), Star.of(spark, f"{DATA}/sf0.001")
    assert one is two and one.store is two.store
    other = Star.of(spark.newSession(), f"{DATA}/sf0.001")
    assert other is not one and other.folder == one.folder


def test_later_application_stages_nothing(spark, tmp_path, monkeypatch):
    """What an application leaves is found by the next one, which knows only folder, source and version."""
    sf_dir, folder = f"{DATA}/sf0.001", str(tmp_path)
    want = rows(Star.of(spark, sf_dir, folder).store)
    monkeypatch.setattr(warehouse, "_stars", {})
    monkeypatch.setattr(warehouse, "_versions", {})
    monkeypatch.setattr(Star, "_write", lambda *a: pytest.fail("staged again"))
    star = Star.of(spark, sf_dir, folder)
    assert rows(star.store) == want
    other = Star.of(spark, sf_dir, folder, version="another state")
    assert other.folder != star.folder and not other.staged("store")
    star.remove()
    assert not star.staged("store")


def test_half_written_table_is_not_taken(spark, tmp_path):
    star = Star.of(spark, f"{DATA}/sf0.001", str(tmp_path))
    spark.range(3).write.parquet(f"{star.folder}/store")  # no marker: its writer was interrupted
    assert "s_store_sk" in star.store.columns


def test_a_folder_is_required():
    from types import SimpleNamespace
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        warehouse.shared_folder(bare)


def test_refresh_orders_follow_any_order_number(spark, tmp_path):
    source, big = f"{DATA}/sf0.001", str(tmp_path / "big")
    for name in definitions.SOURCES:
        df = spark.read.parquet(f"{source}/{name}.parquet")
        for key in ("l_orderkey", "o_orderkey"):
            if key in df.columns:
                df = df.withColumn(key, F.col(key) + 5_000_000_000)
        df.write.parquet(f"{big}/{name}.parquet")
    star = Star.of(spark, big, str(tmp_path / "star"))
    last = star.store_sales.agg(F.max("ss_ticket_number")).first()[0]
    assert last > 5_000_000_000 and star.s_purchase.agg(F.min("purc_purchase_id")).first()[0] > last


def test_definitions_name_every_table_once():
    assert set(definitions.FACT_DATE) <= set(definitions.TABLES) and set(definitions.REFRESH) <= set(definitions.TABLES)
