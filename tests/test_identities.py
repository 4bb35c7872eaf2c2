"""Identities that need no oracle."""

import pytest
from pyspark.sql import Window, functions as F

from starling.functions.exact import avg
from starling.operators.relational import rollup_avg, rollup_of, union_all, with_group
from starling.plans import queries_01_20 as a, queries_21_45 as b, queries_46_72 as m, staged, variants as v
from tests.conftest import rows


@pytest.mark.parametrize("base, variant", [
    (a.q05, v.q05a), (a.q18, v.q18a), (b.q27, v.q27a), (m.q51, v.q51a), (m.q67, v.q67a)])
def test_variant_equals_base(tiny, base, variant):
    assert rows(base(tiny)) == rows(variant(tiny))


@pytest.mark.parametrize("job", list(staged.SPECS))
def test_pushdown_modes_agree(tiny, job):
    modes = ["np", "fp"] + (["pp"] if staged.SPECS[job][1] else [])
    results = [rows(staged.on_star(job, mode)(tiny)) for mode in modes]
    assert all(r == results[0] for r in results)


def test_trimmed_extract_with_profit_filter_differs():
    plain, kept = (staged.job_of("intersect", "pp", profitable_only=f) for f in (False, True))
    assert plain["datasets"]["store_sales"]["query"] != kept["datasets"]["store_sales"]["query"]


def test_rollup_of_equals_plain_rollup_and_union_of_groupings(tiny):
    df = tiny.store_sales.join(tiny.item, F.col("ss_item_sk") == F.col("i_item_sk"))
    keys = ["i_category", "i_class"]
    mine = rollup_of(df, keys, {"v": F.col("ss_quantity")}).drop("lochierarchy")
    plain = df.rollup(*keys).agg(F.sum("ss_quantity").alias("v"))
    spelled = union_all(*[df.groupBy(*keys[:n]).agg(F.sum("ss_quantity").alias("v")).select(
        *[F.col(k) if i < n else F.lit(None).cast("string").alias(k) for i, k in enumerate(keys)], "v") for n in (2, 1, 0)])
    assert rows(mine) == rows(plain) == rows(spelled)


def test_rollup_avg_equals_plain_rollup(tiny):
    df = tiny.item
    mine = rollup_avg(df, ["i_category", "i_class"], {"p": F.col("i_current_price")}).drop("lochierarchy")
    plain = df.rollup("i_category", "i_class").agg(avg("i_current_price").alias("p"))
    assert rows(mine) == rows(plain)


def test_group_totals_equal_window(tiny):
    df = tiny.store_sales.select("ss_item_sk", "ss_store_sk", "ss_quantity")
    mine = with_group(df, ["ss_store_sk"], total=F.sum("ss_quantity"))
    window = df.withColumn("total", F.sum("ss_quantity").over(Window.partitionBy("ss_store_sk")))
    assert rows(mine) == rows(window)


def test_neighbour_months_equal_rank_self_join(tiny):
    got = m.monthly_deviation(tiny, "store_sales", "ss", tiny.store, ("ss_store_sk", "s_store_sk"),
                              ["s_store_name", "s_company_name"], 1999).select("i_category", "i_brand", "s_store_name", "d_moy", "psum", "nsum")
    months = "d_year = 1999 or (d_year = 1998 and d_moy = 12) or (d_year = 2000 and d_moy = 1)"
    sums = (tiny.store_sales.join(tiny.date_dim.filter(months), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
            .join(tiny.store, F.col("ss_store_sk") == F.col("s_store_sk")).join(tiny.item, F.col("ss_item_sk") == F.col("i_item_sk"))
            .groupBy("i_category", "i_brand", "s_store_name", "d_year", "d_moy").agg(F.sum("ss_sales_price").alias("s")))
    keys = ["i_category", "i_brand", "s_store_name"]
    ranked = sums.withColumn("rn", F.rank().over(Window.partitionBy(*keys).orderBy("d_year", "d_moy")))
    prev = ranked.select(*keys, (F.col("rn") + 1).alias("rn"), F.col("s").alias("psum"))
    after = ranked.select(*keys, (F.col("rn") - 1).alias("rn"), F.col("s").alias("nsum"))
    spelled = ranked.filter("d_year = 1999").join(prev, keys + ["rn"]).join(after, keys + ["rn"]).select(*keys, "d_moy", "psum", "nsum")
    assert rows(got) and set(rows(got)) <= set(rows(spelled))
