"""The twelve query variants, and choices of output columns and null order made at run time.

A variant spells a base query's rollup as a union of groupings, or its running sums as a
self join.  The answer is the base query's, so each runs the base plan; the oracle keeps the
spelled-out form and checks that both agree.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from starling.operators.relational import matching, role, rollup_avg, star
from starling.plans.base import REGISTRY, query
from starling.plans import queries_01_20 as a, queries_21_45 as b, queries_46_72 as m, queries_73_99 as z

c = F.col


@query("q05a", a.CHANNEL_COLUMNS, "channel id", 100)
def q05a(t, sales_date="1999-08-04"):
    return a.q05.build(t, sales_date)


@query("q14a", "channel i_brand_id:i i_class_id:i i_category_id:i sum_sales:n number_sales:i",
       "channel i_brand_id i_class_id i_category_id", 100)
def q14a(t, year=1998):
    return a.q14.build(t, year).withColumnRenamed("sales", "sum_sales")


@query("q18a", a.Q18_COLUMNS, a.Q18_ORDER, 100)
def q18a(t, **params):
    return a.q18.build(t, **params)


@query("q22a", " ".join(b.HIERARCHY) + " qoh:n", "qoh " + " ".join(b.HIERARCHY), 100)
def q22a(t, dms=1188):
    """As q22, for stock in known warehouses; the reference's stray inner grouping is dropped."""
    stock = matching(b.stock_by_item(t, dms), t.warehouse, ("inv_warehouse_sk", "w_warehouse_sk"))
    return rollup_avg(stock, b.HIERARCHY, {"qoh": c("inv_quantity_on_hand")})


@query("q27a", b.Q27_COLUMNS, "i_item_id s_state", 100)
def q27a(t, **params):
    return b.q27.build(t, **params)


@query("q36a", "gross_margin:n i_category i_class lochierarchy:i rank_within_parent:i", b.PARENT_ORDER, 100)
def q36a(t, **params):
    return b.q36.build(t, **params)


@query("q51a", m.CUMULATIVE, "item_sk d_date", 100)
def q51a(t, dms=1188):
    """Running sums joined by a full outer join on coalesced keys, then running maxima."""
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk", "d_date")

    def running(ch, p):
        daily = (star(t[f"{ch}_sales"], (dates, f"{p}_sold_date_sk", "d_date_sk"))
                 .filter(c(f"{p}_item_sk").isNotNull()).groupBy(c(f"{p}_item_sk").alias("item_sk"), "d_date")
                 .agg(F.sum(f"{p}_sales_price").alias("price")))
        w = Window.partitionBy("item_sk").orderBy("d_date").rowsBetween(*m.RUNNING)
        return role(daily.select("item_sk", "d_date", F.sum("price").over(w).alias("sales")), f"{ch}_")

    both = running("web", "ws").join(running("store", "ss"), (c("web_item_sk") == c("store_item_sk"))
                                     & (c("web_d_date") == c("store_d_date")), "full")
    days = both.select(F.coalesce("web_item_sk", "store_item_sk").alias("item_sk"),
                       F.coalesce("web_d_date", "store_d_date").alias("d_date"), "web_sales", "store_sales")
    w = Window.partitionBy("item_sk").orderBy("d_date").rowsBetween(*m.RUNNING)
    return (days.withColumn("web_cumulative", F.max("web_sales").over(w))
            .withColumn("store_cumulative", F.max("store_sales").over(w))
            .filter("web_cumulative > store_cumulative"))


@query("q67a", m.Q67_COLUMNS, m.Q67_ORDER, 100)
def q67a(t, dms=1188):
    return m.q67.build(t, dms)


@query("q70a", "total_sum:n s_state s_county lochierarchy:i rank_within_parent:i", b.PARENT_ORDER, 100)
def q70a(t, dms=1188):
    return m.q70.build(t, dms)


@query("q77a", z.Q77_COLUMNS, "channel id", 100)
def q77a(t, sales_date="1999-08-04"):
    return z.q77.build(t, sales_date)


@query("q80a", a.CHANNEL_COLUMNS, "channel id", 100)
def q80a(t, sales_date="1999-08-04"):
    return z.q80.build(t, sales_date)


@query("q86a", "total_sum:n i_category i_class lochierarchy:i rank_within_parent:i", b.PARENT_ORDER, 100)
def q86a(t, dms=1188):
    return z.q86.build(t, dms)


# ---- choices made at run time -----------------------------------------------------------------

MONTHS = "avg_monthly_sales sum_sales psum nsum"
for _chosen in (REGISTRY["q47"].choose("q47_by_brand", f"i_category i_brand d_year {MONTHS}", "_gap i_brand"),
                REGISTRY["q47"].choose("q47_by_store", f"s_store_name s_company_name d_year d_moy {MONTHS}", "_gap s_store_name"),
                REGISTRY["q57"].choose("q57_by_center", f"cc_name d_year d_moy {MONTHS}", "_gap cc_name"),
                REGISTRY["q78"].choose("q78_by_customer", "ss_customer_sk ratio store_qty store_wholesale_cost store_sales_price other_chan_qty "
                                       "other_chan_wholesale_cost other_chan_sales_price"),
                REGISTRY["q05"].choose("q05_nulls_last", " ".join(name for name, _ in REGISTRY["q05"].cols), " ".join(REGISTRY["q05"].order), "last")):
    REGISTRY[_chosen.name] = _chosen
