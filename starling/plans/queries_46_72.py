"""Decision-support queries 46 to 72."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from starling.functions.exact import avg, count_if, ratio, sum_if
from starling.operators.ranking import top_ranks
from starling.operators.relational import (lowest, matching, pick, role, rollup_of, star, union_all,
                                           with_group)
from starling.operators.replicated import if_small
from starling.plans.base import allowed, query
from starling.plans.queries_01_20 import buyers, weekly_by_day
from starling.plans.queries_21_45 import PARENT_ORDER, ranked_in_parent, three_channels
from starling.plans.star import CITIES, DAY_NAMES, STATES

c = F.col


def tickets_by_city(t, days, homes, cities, **sums):
    """Ticket totals of households buying in a city that is not their home city."""
    stores = t.store.filter(c("s_city").isin(*cities))
    bought = pick(t.customer_address, "ca_address_sk", bought_city="ca_city")
    tickets = (star(t.store_sales, (t.date_dim.filter(days), "ss_sold_date_sk", "d_date_sk"),
                    (stores, "ss_store_sk", "s_store_sk"),
                    (t.household_demographics.filter(homes), "ss_hdemo_sk", "hd_demo_sk"))
               .groupBy("ss_ticket_number", "ss_customer_sk", "ss_addr_sk")
               .agg(*[F.sum(x).alias(n) for n, x in sums.items()]))
    tickets = star(tickets, (bought, "ss_addr_sk", "ca_address_sk")).drop("ca_address_sk")
    return star(tickets, (t.customer, "ss_customer_sk", "c_customer_sk"),
                (t.customer_address, "c_current_addr_sk", "ca_address_sk")).filter("ca_city <> bought_city")


@query("q46", "c_last_name c_first_name ca_city bought_city ss_ticket_number:i amt:n profit:n",
       "c_last_name c_first_name ca_city bought_city ss_ticket_number", 100)
def q46(t, deps=5, vehicles=3, year=1999, cities=tuple(CITIES[:5])):
    return tickets_by_city(t, c("d_dow").isin(6, 0) & c("d_year").between(year, year + 2),
                           (c("hd_dep_count") == deps) | (c("hd_vehicle_count") == vehicles), cities,
                           amt="ss_coupon_amt", profit="ss_net_profit")


def monthly_deviation(t, table, p, outlet, link, outlet_keys, year):
    """Months of a year whose sales differ by more than a tenth from the year's monthly mean.

    The previous and next month come from ``lag`` and ``lead`` over at most 14 months per brand
    and outlet; a month without both neighbours drops out, as do null keys.
    """
    months = ((c("d_year") == year) | ((c("d_year") == year - 1) & (c("d_moy") == 12))
              | ((c("d_year") == year + 1) & (c("d_moy") == 1)))
    keys = ["i_category", "i_brand", *outlet_keys]
    sums = (star(t[table], (t.date_dim.filter(months), f"{p}_sold_date_sk", "d_date_sk"),
                 (outlet, *link), (t.item, f"{p}_item_sk", "i_item_sk"))
            .groupBy(*keys, "d_year", "d_moy").agg(F.sum(f"{p}_sales_price").alias("sum_sales"))
            .dropna(subset=keys))
    year_of, order = Window.partitionBy(*keys, "d_year"), Window.partitionBy(*keys).orderBy("d_year", "d_moy")
    out = (sums.withColumn("avg_monthly_sales", F.try_divide(
               F.sum("sum_sales").over(year_of).cast("double"), F.count("sum_sales").over(year_of).cast("double")))
           .withColumn("psum", F.lag("sum_sales").over(order))
           .withColumn("nsum", F.lead("sum_sales").over(order))
           .withColumn("first", F.lag(F.lit(1)).over(order)).withColumn("last", F.lead(F.lit(1)).over(order)))
    gap = c("sum_sales").cast("double") - c("avg_monthly_sales")
    return (out.filter((c("d_year") == year) & c("first").isNotNull() & c("last").isNotNull()
                       & (c("avg_monthly_sales") > 0)).withColumn("_gap", gap)
            .filter(F.abs("_gap") / c("avg_monthly_sales") > 0.1))


MONTH_COLUMNS = "d_year:i d_moy:i avg_monthly_sales:n sum_sales:n psum:n nsum:n"


@query("q47", "i_category i_brand s_store_name s_company_name " + MONTH_COLUMNS, "_gap s_store_name", 100)
def q47(t, year=1999):
    return monthly_deviation(t, "store_sales", "ss", t.store, ("ss_store_sk", "s_store_sk"),
                             ["s_store_name", "s_company_name"], year)


@query("q48", "sum_quantity:i")
def q48(t, marital=("M", "D", "W"), education=("4 yr Degree", "2 yr Degree", "College"),
        states=tuple(STATES[:9]), year=1999):
    people = t.customer_demographics.filter(c("cd_marital_status").isin(*marital))
    rows = star(t.store_sales, (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                (t.store, "ss_store_sk", "s_store_sk"), (people, "ss_cdemo_sk", "cd_demo_sk"),
                (t.customer_address.filter("ca_country = 'United States'"), "ss_addr_sk", "ca_address_sk"))
    person, place = F.lit(False), F.lit(False)
    for i, (lo, hi, worst, best) in enumerate([(100, 150, 0, 2000), (50, 100, 150, 3000), (150, 200, 50, 25000)]):
        person = person | ((c("cd_marital_status") == marital[i]) & (c("cd_education_status") == education[i])
                           & c("ss_sales_price").between(lo, hi))
        place = place | (c("ca_state").isin(*states[3 * i:3 * i + 3]) & c("ss_net_profit").between(worst, best))
    return rows.filter(person & place).agg(F.sum("ss_quantity").alias("sum_quantity"))


@query("q49", "channel item:i return_ratio:n return_rank:i currency_rank:i",
       "channel return_rank currency_rank item", 100, min_return=1000)
def q49(t, year=1999, month=12, min_return=10000):
    """A row is one item of a channel, so the reference's union has no equal rows to merge."""
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month)).select("d_date_sk")
    parts = []
    for channel, sales, s, returns, r, order, amount in (
            ("web", "web_sales", "ws", "web_returns", "wr", "order_number", "return_amt"),
            ("catalog", "catalog_sales", "cs", "catalog_returns", "cr", "order_number", "return_amount"),
            ("store", "store_sales", "ss", "store_returns", "sr", "ticket_number", "return_amt")):
        sold = star(t[sales].filter((c(f"{s}_net_profit") > 1) & (c(f"{s}_net_paid") > 0)
                                    & (c(f"{s}_quantity") > 0)), (dates, f"{s}_sold_date_sk", "d_date_sk"))
        # The filter on the returned amount makes the reference's outer join an inner one.
        back = t[returns].filter(c(f"{r}_{amount}") > min_return)
        both = sold.join(back, (c(f"{s}_{order}") == c(f"{r}_{order}")) & (c(f"{s}_item_sk") == c(f"{r}_item_sk")))
        ratios = both.groupBy(c(f"{s}_item_sk").alias("item")).agg(
            ratio(F.sum(F.coalesce(f"{r}_return_quantity", F.lit(0))), F.sum(f"{s}_quantity")).alias("return_ratio"),
            ratio(F.sum(F.coalesce(f"{r}_{amount}", F.lit(0))), F.sum(f"{s}_net_paid")).alias("currency_ratio"))
        parts.append(ratios.withColumn("channel", F.lit(channel)))
    ratios = union_all(*parts).checkpoint()  # one row an item; read three times below
    return top_ranks(ratios, "channel", 10,
                     return_rank=("return_ratio", F.floor(c("return_ratio") * 1000)),
                     currency_rank=("currency_ratio", F.floor(c("currency_ratio") * 1000)))


def delay_counts(days):
    """Rows by 30-day bucket of a delay."""
    marks = ["d30", "d60", "d90", "d120"]
    cells = [count_if(days <= 30).alias("d30")]
    cells += [count_if((days > 30 * i) & (days <= 30 * (i + 1))).alias(marks[i]) for i in (1, 2, 3)]
    return cells + [count_if(days > 120).alias("more")]


DELAY_COLUMNS = "d30:i d60:i d90:i d120:i more:i"
STORE_ADDRESS = ("s_store_name s_company_id s_street_number s_street_name s_street_type s_suite_number "
                 "s_city s_county s_state s_zip")


@query("q50", STORE_ADDRESS.replace("s_company_id", "s_company_id:i") + " " + DELAY_COLUMNS, STORE_ADDRESS, 100)
def q50(t, year=1999, month=8):
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month)).select("d_date_sk")
    back = star(t.store_returns, (dates, "sr_returned_date_sk", "d_date_sk")).drop("d_date_sk")
    rows = t.store_sales.join(back, (c("ss_ticket_number") == c("sr_ticket_number"))
                              & (c("ss_item_sk") == c("sr_item_sk")) & (c("ss_customer_sk") == c("sr_customer_sk")))
    rows = star(rows, (t.date_dim.select("d_date_sk"), "ss_sold_date_sk", "d_date_sk"),
                (t.store, "ss_store_sk", "s_store_sk"))
    return rows.groupBy(*STORE_ADDRESS.split()).agg(*delay_counts(c("sr_returned_date_sk") - c("ss_sold_date_sk")))


RUNNING = (Window.unboundedPreceding, 0)


def daily_by_channel(t, dms):
    """Sales per item and day, one column per channel, null where the channel sold nothing.

    Both channels are stacked and grouped once, which gives the rows of a full outer join on
    item and day.
    """
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk", "d_date")
    parts = [star(t[f"{ch}_sales"], (dates, f"{p}_sold_date_sk", "d_date_sk"))
             .select(c(f"{p}_item_sk").alias("item_sk"), "d_date", F.lit(ch).alias("ch"),
                     c(f"{p}_sales_price").alias("price")) for ch, p in (("web", "ws"), ("store", "ss"))]
    return (union_all(*parts).filter("item_sk is not null").groupBy("item_sk", "d_date")
            .agg(*[sum_if(c("ch") == ch, "price").alias(ch) for ch in ("web", "store")]))


CUMULATIVE = "item_sk:i d_date:d web_sales:n store_sales:n web_cumulative:n store_cumulative:n"


@query("q51", CUMULATIVE, "item_sk d_date", 100)
def q51(t, dms=1188):
    w = Window.partitionBy("item_sk").orderBy("d_date").rowsBetween(*RUNNING)
    sums = daily_by_channel(t, dms)
    cume = sums.select("item_sk", "d_date", *[F.when(c(ch).isNotNull(), F.sum(ch).over(w)).alias(f"{ch}_sales")
                                              for ch in ("web", "store")])
    return (cume.withColumn("web_cumulative", F.max("web_sales").over(w))
            .withColumn("store_cumulative", F.max("store_sales").over(w))
            .filter("web_cumulative > store_cumulative"))


def brand_month(t, manager, month, year):
    dates = t.date_dim.filter((c("d_moy") == month) & (c("d_year") == year))
    return (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (t.item.filter(c("i_manager_id") == manager), "ss_item_sk", "i_item_sk"))
            .groupBy("d_year", c("i_brand_id").alias("brand_id"), c("i_brand").alias("brand"))
            .agg(F.sum("ss_ext_sales_price").alias("ext_price")))


@query("q52", "d_year:i brand_id:i brand ext_price:n", "d_year -ext_price brand_id", 100)
def q52(t, month=11, year=1999):
    return brand_month(t, 1, month, year)


def period_deviation(t, key, period, dms, name):
    """Periods of selected product lines differing by more than a tenth from the key's mean.

    The window holds one row per period of a year, four or twelve per key.
    """
    first = (c("i_category").isin("Books", "Children", "Electronics")
             & c("i_class").isin("personal", "portable", "reference", "self-help")
             & c("i_brand").isin("scholaramalgamalg #14", "scholaramalgamalg #7", "exportiunivamalg #9",
                                 "scholaramalgamalg #9"))
    second = (c("i_category").isin("Women", "Music", "Men")
              & c("i_class").isin("accessories", "classical", "fragrances", "pants")
              & c("i_brand").isin("amalgimporto #1", "edu packscholar #1", "exportiimporto #1", "importoamalg #1"))
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11))
    sums = (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (t.item.filter(first | second), "ss_item_sk", "i_item_sk"), (t.store, "ss_store_sk", "s_store_sk"))
            .groupBy(key, period).agg(F.sum("ss_sales_price").alias("sum_sales")))
    w = Window.partitionBy(key)
    mean = F.try_divide(F.sum("sum_sales").over(w).cast("double"), F.count("sum_sales").over(w).cast("double"))
    return (sums.withColumn(name, mean).filter(c(name) > 0)
            .filter(F.abs(c("sum_sales").cast("double") - c(name)) / c(name) > 0.1))


@query("q53", "i_manufact_id:i sum_sales:n avg_quarterly_sales:n", "avg_quarterly_sales sum_sales i_manufact_id", 100)
def q53(t, dms=1188):
    return period_deviation(t, "i_manufact_id", "d_qoy", dms, "avg_quarterly_sales")


@query("q54", "segment:i num_customers:i segment_base:i", "segment num_customers", 100)
def q54(t, year=1999, month=5, category="Women", clazz="accessories"):
    here = (c("d_year") == year) & (c("d_moy") == month)
    bought = union_all(pick(t.catalog_sales, day="cs_sold_date_sk", who="cs_bill_customer_sk", what="cs_item_sk"),
                       pick(t.web_sales, day="ws_sold_date_sk", who="ws_bill_customer_sk", what="ws_item_sk"))
    items = t.item.filter((c("i_category") == category) & (c("i_class") == clazz))
    chosen = star(bought, (t.date_dim.filter(here), "day", "d_date_sk"), (items, "what", "i_item_sk"))
    people = matching(t.customer, chosen, ("c_customer_sk", "who")).select("c_customer_sk", "c_current_addr_sk")
    # A purchase counts once per store of the customer's county and state: carry that number.
    stores = t.store.groupBy("s_county", "s_state").agg(F.count(F.lit(1)).alias("stores"))
    near = star(people, (t.customer_address, "c_current_addr_sk", "ca_address_sk")).join(
        stores, (c("ca_county") == c("s_county")) & (c("ca_state") == c("s_state")))
    # One row: the month's sequence number, from which the next three months follow.
    seq = t.date_dim.filter(here).agg(F.min("d_month_seq").alias("seq"))
    later = t.date_dim.join(F.broadcast(seq), c("d_month_seq").between(c("seq") + 1, c("seq") + 3))
    spent = (star(t.store_sales, (later, "ss_sold_date_sk", "d_date_sk"))
             .groupBy("ss_customer_sk").agg(F.sum("ss_ext_sales_price").alias("spent")))
    revenue = star(near, (spent, "c_customer_sk", "ss_customer_sk")).withColumn("revenue", c("spent") * c("stores"))
    return (revenue.groupBy((c("revenue") / 50).cast("int").alias("segment"))
            .agg(F.count(F.lit(1)).alias("num_customers")).withColumn("segment_base", c("segment") * 50))


@query("q55", "brand_id:i brand ext_price:n", "-ext_price brand_id", 100)
def q55(t, year=1999, month=11, manager=13):
    return brand_month(t, manager, month, year)


@query("q56", "i_item_id total_sales:n", "total_sales", 100)
def q56(t, year=1999, month=3, gmt=-5, colors=("powder", "snow", "floral")):
    items = matching(t.item, t.item.filter(c("i_color").isin(*colors)), ("i_item_id", "i_item_id"))
    return three_channels(t, "i_item_id", year, month, gmt, items)


@query("q57", "i_category i_brand cc_name " + MONTH_COLUMNS, "_gap cc_name", 100)
def q57(t, year=1999):
    return monthly_deviation(t, "catalog_sales", "cs", t.call_center, ("cs_call_center_sk", "cc_call_center_sk"),
                             ["cc_name"], year)


def days_of_weeks(t, *days):
    """All calendar days of the weeks holding the given days."""
    weeks = t.date_dim.filter(c("d_date").isin(*[F.to_date(F.lit(d)) for d in days]))
    return matching(t.date_dim, weeks, ("d_week_seq", "d_week_seq")).select("d_date_sk")


def per_item_id(t, dates, table, p, day, measure, name):
    return (star(t[table], (dates, day, "d_date_sk")).groupBy(c(f"{p}_item_sk").alias("sk"))
            .agg(F.sum(measure).alias("v")).join(t.item, c("sk") == c("i_item_sk"))
            .groupBy("i_item_id").agg(F.sum("v").alias(name)))


@query("q58", "item_id ss_item_rev:n ss_dev:n cs_item_rev:n cs_dev:n ws_item_rev:n ws_dev:n average:n",
       "item_id ss_item_rev", 100)
def q58(t, sales_date="1999-03-15"):
    dates = days_of_weeks(t, sales_date)
    parts = {p: per_item_id(t, dates, table, p, f"{p}_sold_date_sk", f"{p}_ext_sales_price", f"{p}_item_rev")
             for table, p in (("store_sales", "ss"), ("catalog_sales", "cs"), ("web_sales", "ws"))}
    both = parts["ss"].join(parts["cs"], "i_item_id").join(parts["ws"], "i_item_id")
    rev = {p: c(f"{p}_item_rev").cast("double") for p in parts}
    near = F.lit(True)
    for a in parts:
        for b in parts:
            if a != b:
                near = near & rev[a].between(rev[b] * 0.9, rev[b] * 1.1)
    mean = (c("ss_item_rev") + c("cs_item_rev") + c("ws_item_rev")).cast("double") / 3
    return (both.filter(near).withColumn("average", mean).withColumnRenamed("i_item_id", "item_id")
            .withColumns({f"{p}_dev": F.try_divide(rev[p], mean) * 100 for p in parts}))


@query("q59", "s_store_name1 s_store_id1 d_week_seq1:i " + " ".join(f"{d[:3].lower()}_ratio:n" for d in DAY_NAMES),
       "s_store_name1 s_store_id1 d_week_seq1", 100)
def q59(t, dms=1188):
    by_day = (star(t.store_sales, (t.date_dim, "ss_sold_date_sk", "d_date_sk"))
              .filter(c("d_month_seq").between(dms - 1, dms + 24)))
    weeks = star(weekly_by_day(by_day, t.date_dim, "ss_sales_price", "ss_store_sk"),
                 (t.store, "ss_store_sk", "s_store_sk"))

    def year_of(first, mark):
        # One row per calendar day of the period, as the reference's join yields.
        days = t.date_dim.filter(c("d_month_seq").between(first, first + 11)).select(c("d_week_seq").alias("_w"))
        return role(weeks.join(days, c("d_week_seq") == c("_w")).select(
            "s_store_name", "s_store_id", "d_week_seq", *[d[:3].lower() for d in DAY_NAMES]), mark)

    both = year_of(dms, "a_").join(year_of(dms + 12, "b_"), (c("a_s_store_id") == c("b_s_store_id"))
                                   & (c("a_d_week_seq") == c("b_d_week_seq") - 52))
    return both.select(c("a_s_store_name").alias("s_store_name1"), c("a_s_store_id").alias("s_store_id1"),
                       c("a_d_week_seq").alias("d_week_seq1"),
                       *[ratio(f"a_{d}", f"b_{d}").alias(f"{d}_ratio") for d in (n[:3].lower() for n in DAY_NAMES)])


@query("q60", "i_item_id total_sales:n", "i_item_id total_sales", 100)
def q60(t, year=1999, month=9, gmt=-5, category="Music"):
    items = matching(t.item, t.item.filter(c("i_category") == category), ("i_item_id", "i_item_id"))
    return three_channels(t, "i_item_id", year, month, gmt, items)


@query("q61", "promotions:n total:n share:n", "promotions total", 100)
def q61(t, year=1999, month=11, gmt=-5, category="Jewelry"):
    promos = (t.promotion.filter("p_channel_dmail = 'Y' or p_channel_email = 'Y' or p_channel_tv = 'Y'")
              .select("p_promo_sk"))
    rows = star(t.store_sales,
                (t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month)), "ss_sold_date_sk", "d_date_sk"),
                (t.item.filter(c("i_category") == category), "ss_item_sk", "i_item_sk"),
                (t.store.filter(c("s_gmt_offset") == gmt), "ss_store_sk", "s_store_sk"),
                (t.customer, "ss_customer_sk", "c_customer_sk"),
                (t.customer_address.filter(c("ca_gmt_offset") == gmt), "c_current_addr_sk", "ca_address_sk"))
    # Promotional and all sales in one pass over the same rows.
    rows = rows.join(promos, c("ss_promo_sk") == c("p_promo_sk"), "left")
    return rows.agg(sum_if(c("p_promo_sk").isNotNull(), "ss_ext_sales_price").alias("promotions"),
                    F.sum("ss_ext_sales_price").alias("total")).withColumn(
        "share", ratio("promotions", "total") * 100)


def shipping_delays(t, table, p, outlet, link, name, dms):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")
    return (star(t[table], (if_small(dates), f"{p}_ship_date_sk", "d_date_sk"),
                 (if_small(t.warehouse), f"{p}_warehouse_sk", "w_warehouse_sk"),
                 (if_small(t.ship_mode), f"{p}_ship_mode_sk", "sm_ship_mode_sk"), (outlet, *link))
            .groupBy(F.substring("w_warehouse_name", 1, 20).alias("warehouse"), "sm_type", name)
            .agg(*delay_counts(c(f"{p}_ship_date_sk") - c(f"{p}_sold_date_sk"))))


@query("q62", "warehouse sm_type web_name " + DELAY_COLUMNS, "warehouse sm_type web_name", 100)
def q62(t, dms=1188):
    return shipping_delays(t, "web_sales", "ws", t.web_site, ("ws_web_site_sk", "web_site_sk"), "web_name", dms)


@query("q63", "i_manager_id:i sum_sales:n avg_monthly_sales:n", "i_manager_id avg_monthly_sales sum_sales", 100)
def q63(t, dms=1188):
    return period_deviation(t, "i_manager_id", "d_moy", dms, "avg_monthly_sales")


PLACE = [f"{s}_{n}" for s in "bc" for n in ("street_number", "street_name", "city", "zip")]


@query("q64", "product_name store_name store_zip " + " ".join(PLACE) + " syear1:i cnt1:i s11:n s21:n s31:n s12:n "
       "s22:n s32:n syear2:i cnt2:i", "product_name store_name cnt2")
def q64(t, colors=("powder", "khaki", "brown", "honeydew", "floral", "deep"), price=20, year=1999):
    items = t.item.filter(c("i_color").isin(*colors) & c("i_current_price").between(price, price + 10)
                          & c("i_current_price").between(price + 1, price + 15))
    # Items whose catalog value is more than twice their refunds, among the wanted items only.
    cs = star(t.catalog_sales, (items, "cs_item_sk", "i_item_sk"))
    refund = c("cr_refunded_cash") + c("cr_reversed_charge") + c("cr_store_credit")
    sound = (cs.join(t.catalog_returns, (c("cs_item_sk") == c("cr_item_sk"))
                     & (c("cs_order_number") == c("cr_order_number")))
             .groupBy(c("cs_item_sk").alias("ui_item_sk"))
             .agg(F.sum("cs_ext_list_price").alias("sale"), F.sum(refund).alias("refund"))
             .filter("sale > 2 * refund").select("ui_item_sk"))
    years = t.date_dim.filter(c("d_year").isin(year, year + 1))
    sales = star(t.store_sales, (items, "ss_item_sk", "i_item_sk"), (sound, "ss_item_sk", "ui_item_sk"),
                 (pick(years, d1_sk="d_date_sk", syear="d_year"), "ss_sold_date_sk", "d1_sk"))
    sales = sales.join(t.store_returns, (c("ss_item_sk") == c("sr_item_sk"))
                       & (c("ss_ticket_number") == c("sr_ticket_number")))
    home = pick(t.household_demographics, hd_sk="hd_demo_sk", band="hd_income_band_sk")
    band = pick(t.income_band, ib_sk="ib_income_band_sk")
    place = ("ca_address_sk", "ca_street_number", "ca_street_name", "ca_city", "ca_zip")
    rows = star(sales, (t.store, "ss_store_sk", "s_store_sk"), (t.customer, "ss_customer_sk", "c_customer_sk"),
                (pick(t.customer_demographics, cd1_sk="cd_demo_sk", ms1="cd_marital_status"), "ss_cdemo_sk", "cd1_sk"),
                (pick(t.customer_demographics, cd2_sk="cd_demo_sk", ms2="cd_marital_status"), "c_current_cdemo_sk", "cd2_sk"),
                (t.promotion, "ss_promo_sk", "p_promo_sk"),
                (role(home, "h1_"), "ss_hdemo_sk", "h1_hd_sk"), (role(home, "h2_"), "c_current_hdemo_sk", "h2_hd_sk"),
                (role(band, "i1_"), "h1_band", "i1_ib_sk"), (role(band, "i2_"), "h2_band", "i2_ib_sk"),
                (role(t.customer_address.select(*place), "b_"), "ss_addr_sk", "b_ca_address_sk"),
                (role(t.customer_address.select(*place), "c_"), "c_current_addr_sk", "c_ca_address_sk"),
                (pick(t.date_dim, d2_sk="d_date_sk", fsyear="d_year"), "c_first_sales_date_sk", "d2_sk"),
                (pick(t.date_dim, d3_sk="d_date_sk", s2year="d_year"), "c_first_shipto_date_sk", "d3_sk"))
    keys = [c("i_product_name").alias("product_name"), c("i_item_sk").alias("item_sk"),
            c("s_store_name").alias("store_name"), c("s_zip").alias("store_zip")]
    keys += [c(f"{s}_ca_{n}").alias(f"{s}_{n}") for s in "bc" for n in ("street_number", "street_name", "city", "zip")]
    cross = (rows.filter("ms1 <> ms2").groupBy(*keys, "syear", "fsyear", "s2year")
             .agg(F.count(F.lit(1)).alias("cnt"), F.sum("ss_wholesale_cost").alias("s1"),
                  F.sum("ss_list_price").alias("s2"), F.sum("ss_coupon_amt").alias("s3")))
    now, later = cross.filter(c("syear") == year), role(cross.filter(c("syear") == year + 1), "n_")
    both = now.join(later, (c("item_sk") == c("n_item_sk")) & (c("store_name") == c("n_store_name"))
                    & (c("store_zip") == c("n_store_zip")) & (c("n_cnt") <= c("cnt")))
    return both.select("product_name", "store_name", "store_zip", *PLACE, c("syear").alias("syear1"),
                       c("cnt").alias("cnt1"), c("s1").alias("s11"), c("s2").alias("s21"), c("s3").alias("s31"),
                       c("n_s1").alias("s12"), c("n_s2").alias("s22"), c("n_s3").alias("s32"),
                       c("n_syear").alias("syear2"), c("n_cnt").alias("cnt2"))


@query("q65", "s_store_name i_item_desc revenue:n i_current_price:n i_wholesale_cost:n i_brand",
       "s_store_name i_item_desc", 100)
def q65(t, dms=1188):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")
    revenue = (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk")).groupBy("ss_store_sk", "ss_item_sk")
               .agg(F.sum("ss_sales_price").alias("revenue")))
    low = with_group(revenue, ["ss_store_sk"], ave=avg("revenue")).filter(
        c("revenue").cast("double") <= F.lit(0.1) * c("ave"))
    return star(low, (t.store, "ss_store_sk", "s_store_sk"), (t.item, "ss_item_sk", "i_item_sk"))


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WAREHOUSE = "w_warehouse_name w_warehouse_sq_ft w_city w_county w_state w_country"
NET = "net_paid net_paid_inc_tax net_paid_inc_ship net_paid_inc_ship_tax net_profit"


@query("q66", WAREHOUSE.replace("sq_ft", "sq_ft:i") + " ship_carriers year:i "
       + " ".join(f"{m}_sales:n" for m in MONTHS) + " " + " ".join(f"{m}_sales_per_sq_foot:n" for m in MONTHS)
       + " " + " ".join(f"{m}_net:n" for m in MONTHS), "w_warehouse_name", 100)
def q66(t, year=1999, time_one=30838, carriers=("DHL", "BARIAN"), net_one="net_paid", net_two="net_paid_inc_tax",
        sales_one="ext_sales_price", sales_two="sales_price"):
    for net in (net_one, net_two):
        allowed(net, NET)
    for price in (sales_one, sales_two):
        allowed(price, "sales_price ext_sales_price ext_list_price")
    parts = []
    for table, p, price, net in (("web_sales", "ws", sales_one, net_one), ("catalog_sales", "cs", sales_two, net_two)):
        rows = star(t[table], (t.date_dim.filter(c("d_year") == year), f"{p}_sold_date_sk", "d_date_sk"),
                    (t.time_dim.filter(c("t_time").between(time_one, time_one + 28800)), f"{p}_sold_time_sk", "t_time_sk"),
                    (t.ship_mode.filter(c("sm_carrier").isin(*carriers)), f"{p}_ship_mode_sk", "sm_ship_mode_sk"))
        parts.append(rows.select(c(f"{p}_warehouse_sk").alias("wh"), c("d_year").alias("year"), "d_moy",
                                 (c(f"{p}_{price}") * c(f"{p}_quantity")).alias("sales"),
                                 (c(f"{p}_{net}") * c(f"{p}_quantity")).alias("net")))
    cells = [F.sum(F.when(c("d_moy") == i, c(x)).otherwise(0)).alias(f"{m}_{x}")
             for x in ("sales", "net") for i, m in enumerate(MONTHS, 1)]
    sums = (star(union_all(*parts), (t.warehouse, "wh", "w_warehouse_sk"))
            .groupBy(*WAREHOUSE.split(), "year").agg(*cells))
    return sums.withColumn("ship_carriers", F.lit(",".join(carriers))).withColumns(
        {f"{m}_sales_per_sq_foot": ratio(f"{m}_sales", "w_warehouse_sq_ft") for m in MONTHS})


PRODUCT_PERIOD = ["i_category", "i_class", "i_brand", "i_product_name", "d_year", "d_qoy", "d_moy", "s_store_id"]
Q67_COLUMNS = "i_category i_class i_brand i_product_name d_year:i d_qoy:i d_moy:i s_store_id sumsales:n rk:i"
Q67_ORDER = " ".join(PRODUCT_PERIOD) + " sumsales rk"


def product_period_rows(t, dms):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11))
    return star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"), (t.item, "ss_item_sk", "i_item_sk"),
                (t.store, "ss_store_sk", "s_store_sk"))


def worth():
    return F.coalesce(c("ss_sales_price") * c("ss_quantity"), F.lit(0))


@query("q67", Q67_COLUMNS, Q67_ORDER, 100)
def q67(t, dms=1188):
    rolled = rollup_of(product_period_rows(t, dms), PRODUCT_PERIOD, {"sumsales": worth()})
    return lowest(rolled, "sumsales", 100, "i_category", descending=True, name="rk")


@query("q68", "c_last_name c_first_name ca_city bought_city ss_ticket_number:i extended_price:n extended_tax:n list_price:n",
       "c_last_name ss_ticket_number", 100)
def q68(t, deps=4, vehicles=3, year=1999, cities=("Midway", "Fairview")):
    return tickets_by_city(t, c("d_dom").between(1, 2) & c("d_year").between(year, year + 2),
                           (c("hd_dep_count") == deps) | (c("hd_vehicle_count") == vehicles), cities,
                           extended_price="ss_ext_sales_price", list_price="ss_ext_list_price", extended_tax="ss_ext_tax")


Q69_KEYS = "cd_gender cd_marital_status cd_education_status cd_purchase_estimate cd_credit_rating"


@query("q69", "cd_gender cd_marital_status cd_education_status cnt1:i cd_purchase_estimate:i cnt2:i "
       "cd_credit_rating cnt3:i", Q69_KEYS, 100)
def q69(t, year=1999, month=1, states=("TN", "GA", "CA")):
    dates = t.date_dim.filter((c("d_year") == year) & c("d_moy").between(month, month + 2))
    people = star(t.customer, (t.customer_address.filter(c("ca_state").isin(*states)), "c_current_addr_sk", "ca_address_sk"))
    people = matching(people, buyers(t, "store_sales", "ss_customer_sk", "ss_sold_date_sk", dates), ("c_customer_sk", "who"))
    for table, who, day in (("web_sales", "ws_bill_customer_sk", "ws_sold_date_sk"),
                            ("catalog_sales", "cs_ship_customer_sk", "cs_sold_date_sk")):
        people = matching(people, buyers(t, table, who, day, dates), ("c_customer_sk", "who"), how="left_anti")
    return (star(people, (t.customer_demographics, "c_current_cdemo_sk", "cd_demo_sk")).groupBy(*Q69_KEYS.split())
            .agg(*[F.count(F.lit(1)).alias(f"cnt{i}") for i in (1, 2, 3)]))


def profit_by_state(t, dms):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")
    rows = star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"), (t.store, "ss_store_sk", "s_store_sk"))
    # The reference ranks each state inside its own group, so every state ranks first: the
    # "top five" test keeps every state that sold anything and only drops a null state.
    return rollup_of(rows.filter("s_state is not null"), ["s_state", "s_county"], {"total_sum": c("ss_net_profit")})


@query("q70", "total_sum:n s_state s_county lochierarchy:i rank_within_parent:i", PARENT_ORDER, 100)
def q70(t, dms=1188):
    return ranked_in_parent(profit_by_state(t, dms), "s_state", "total_sum", descending=True)


@query("q71", "brand_id:i brand t_hour:i t_minute:i ext_price:n", "-ext_price brand_id")
def q71(t, year=1999, month=11):
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month)).select("d_date_sk")
    rows = union_all(*[pick(star(t[table], (dates, f"{p}_sold_date_sk", "d_date_sk")), what=f"{p}_item_sk",
                            when=f"{p}_sold_time_sk", price=f"{p}_ext_sales_price")
                       for table, p in (("web_sales", "ws"), ("catalog_sales", "cs"), ("store_sales", "ss"))])
    return (star(rows, (t.item.filter("i_manager_id = 1"), "what", "i_item_sk"),
                 (t.time_dim.filter("t_meal_time in ('breakfast', 'dinner')"), "when", "t_time_sk"))
            .groupBy(c("i_brand_id").alias("brand_id"), c("i_brand").alias("brand"), "t_hour", "t_minute")
            .agg(F.sum("price").alias("ext_price")))


@query("q72", "i_item_desc w_warehouse_name d_week_seq:i no_promo:i promo:i total_cnt:i",
       "-total_cnt i_item_desc w_warehouse_name d_week_seq", 100)
def q72(t, potential=">10000", year=1999, marital="D"):
    sold = t.date_dim.filter(c("d_year") == year).select("d_date_sk", "d_week_seq", c("d_date").alias("sold"))
    shipped = pick(t.date_dim, ship_sk="d_date_sk", shipped="d_date")
    orders = star(t.catalog_sales, (sold, "cs_sold_date_sk", "d_date_sk"),
                  (t.household_demographics.filter(c("hd_buy_potential") == potential), "cs_bill_hdemo_sk", "hd_demo_sk"),
                  (t.customer_demographics.filter(c("cd_marital_status") == marital), "cs_bill_cdemo_sk", "cd_demo_sk"),
                  (shipped, "cs_ship_date_sk", "ship_sk")).filter(c("shipped") > F.date_add("sold", 5))
    orders = orders.join(t.promotion.select("p_promo_sk"), c("cs_promo_sk") == c("p_promo_sk"), "left")
    # An outer join to returns repeats a line once per return: carry the number of returns.
    back = t.catalog_returns.groupBy("cr_item_sk", "cr_order_number").agg(F.count(F.lit(1)).alias("returns"))
    orders = orders.join(back, (c("cs_item_sk") == c("cr_item_sk"))
                         & (c("cs_order_number") == c("cr_order_number")), "left")
    # Lines of one item, week and quantity meet the same stock rows: count them before the join,
    # so a best seller reaches it as a few rows per week.
    lines = orders.groupBy("cs_item_sk", "d_week_seq", "cs_quantity", c("p_promo_sk").isNull().alias("plain")).agg(
        F.sum(F.coalesce("returns", F.lit(1))).alias("n"))
    weeks = matching(t.date_dim, sold, ("d_week_seq", "d_week_seq")).select(
        c("d_date_sk").alias("inv_day"), c("d_week_seq").alias("inv_week"))
    stock = star(t.inventory, (weeks, "inv_date_sk", "inv_day"))
    short = lines.join(stock, (c("cs_item_sk") == c("inv_item_sk")) & (c("d_week_seq") == c("inv_week"))
                       & (c("inv_quantity_on_hand") < c("cs_quantity")))
    counts = short.groupBy("cs_item_sk", "inv_warehouse_sk", "d_week_seq").agg(
        sum_if(c("plain"), "n").alias("no_promo"), sum_if(~c("plain"), "n").alias("promo"), F.sum("n").alias("total_cnt"))
    return (star(counts, (t.item, "cs_item_sk", "i_item_sk"), (t.warehouse, "inv_warehouse_sk", "w_warehouse_sk"))
            .groupBy("i_item_desc", "w_warehouse_name", "d_week_seq")
            .agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("no_promo", "promo", "total_cnt")]))
