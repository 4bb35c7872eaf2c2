"""Decision-support queries 73 to 99."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from starling.functions.exact import avg, count_if, ratio, sum_if
from starling.operators.relational import (matching, pick, rollup_of, star, union_all, with_scalar)
from starling.plans.base import allowed, query
from starling.plans.queries_01_20 import (CHANNEL_COLUMNS, ORDER_COLUMNS, SHARE_COLUMNS, channel_rollup,
                                          class_share, many_warehouses, order_summary, window_of_days,
                                          yearly_totals)
from starling.plans.queries_21_45 import (PARENT_ORDER, TICKET_COLUMNS, busy_tickets, excess_discount,
                                          name_days_by_channel, ranked_in_parent, returners, stocked_and_sold)
from starling.plans.queries_46_72 import DELAY_COLUMNS, days_of_weeks, per_item_id, shipping_delays
from starling.plans.star import COUNTIES, STATES

c = F.col


@query("q73", TICKET_COLUMNS, "-cnt c_last_name")
def q73(t, potentials=(">10000", "Unknown"), year=1999, counties=tuple(COUNTIES[:4])):
    return busy_tickets(t, c("d_dom").between(1, 2), potentials, (year, year + 1, year + 2), counties, 1, 5, 1)


@query("q74", "customer_id customer_first_name customer_last_name",
       "customer_first_name customer_id customer_last_name", 100)
def q74(t, year=1998, agg="sum"):
    f = {"sum": F.sum, "min": F.min, "max": F.max, "avg": avg, "stddev_samp": F.stddev_samp}
    y = yearly_totals(t, year, {"s": c("ss_net_paid"), "w": c("ws_net_paid")}, f[allowed(agg, " ".join(f))])
    return pick(y.filter("s1 > 0 and w1 > 0").filter(ratio("w2", "w1") > ratio("s2", "s1")),
                customer_id="c_customer_id", customer_first_name="c_first_name", customer_last_name="c_last_name")


LINE_KEYS = ["i_brand_id", "i_class_id", "i_category_id", "i_manufact_id"]


@query("q75", "prev_year:i year:i i_brand_id:i i_class_id:i i_category_id:i i_manufact_id:i prev_yr_cnt:i "
       "curr_yr_cnt:i sales_cnt_diff:i sales_amt_diff:n", "sales_cnt_diff", 100)
def q75(t, category="Books", year=1999):
    dates = t.date_dim.filter(c("d_year").isin(year - 1, year)).select("d_date_sk", "d_year")
    items = t.item.filter(c("i_category") == category)
    parts = []
    for sales, s, returns, r, order, amount in (
            ("catalog_sales", "cs", "catalog_returns", "cr", "order_number", "return_amount"),
            ("store_sales", "ss", "store_returns", "sr", "ticket_number", "return_amt"),
            ("web_sales", "ws", "web_returns", "wr", "order_number", "return_amt")):
        sold = star(t[sales], (dates, f"{s}_sold_date_sk", "d_date_sk"), (items, f"{s}_item_sk", "i_item_sk"))
        # Only the wanted items' returns reach the join.
        back = matching(t[returns], items, (f"{r}_item_sk", "i_item_sk"))
        rows = sold.join(back, (c(f"{s}_{order}") == c(f"{r}_{order}"))
                         & (c(f"{s}_item_sk") == c(f"{r}_item_sk")), "left")
        parts.append(rows.select("d_year", *LINE_KEYS, (
            c(f"{s}_quantity") - F.coalesce(f"{r}_return_quantity", F.lit(0))).alias("cnt"),
            (c(f"{s}_ext_sales_price") - F.coalesce(f"{r}_{amount}", F.lit(0))).alias("amt")))
    # Equal details merge across and within channels, as the reference's plain union does.
    detail = union_all(*parts).distinct().dropna(subset=LINE_KEYS)
    # Both years in one grouping instead of a self join.
    both = detail.groupBy(*LINE_KEYS).agg(*[
        sum_if(c("d_year") == y, m).alias(f"{tag}_{m}") for tag, y in (("prev", year - 1), ("curr", year))
        for m in ("cnt", "amt")], *[count_if(c("d_year") == y).alias(f"{tag}_n")
                                    for tag, y in (("prev", year - 1), ("curr", year))])
    return (both.filter("prev_n > 0 and curr_n > 0").filter(ratio("curr_cnt", "prev_cnt") < 0.9)
            .select(F.lit(year - 1).alias("prev_year"), F.lit(year).alias("year"), *LINE_KEYS,
                    c("prev_cnt").alias("prev_yr_cnt"), c("curr_cnt").alias("curr_yr_cnt"),
                    (c("curr_cnt") - c("prev_cnt")).alias("sales_cnt_diff"),
                    (c("curr_amt") - c("prev_amt")).alias("sales_amt_diff")))


@query("q76", "channel col_name d_year:i d_qoy:i i_category sales_cnt:i sales_amt:n",
       "channel col_name d_year d_qoy i_category", 100)
def q76(t, null_ss="ss_store_sk", null_ws="ws_ship_customer_sk", null_cs="cs_ship_addr_sk"):
    remote = ("{0}_bill_customer_sk {0}_bill_hdemo_sk {0}_bill_addr_sk {0}_ship_customer_sk {0}_ship_cdemo_sk "
              "{0}_ship_hdemo_sk {0}_ship_addr_sk {0}_ship_mode_sk {0}_warehouse_sk {0}_promo_sk ")
    allowed(null_ss, "ss_customer_sk ss_cdemo_sk ss_hdemo_sk ss_addr_sk ss_store_sk ss_promo_sk")
    allowed(null_ws, remote.format("ws") + "ws_web_page_sk ws_web_site_sk")
    allowed(null_cs, remote.format("cs"))
    parts = []
    for channel, p, col in (("store", "ss", null_ss), ("web", "ws", null_ws), ("catalog", "cs", null_cs)):
        rows = t[f"{channel}_sales"].filter(c(col).isNull())
        # Item and day keep the partial sums small before the category is looked up.
        sums = rows.groupBy(c(f"{p}_sold_date_sk").alias("day"), c(f"{p}_item_sk").alias("what")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(f"{p}_ext_sales_price").alias("v"))
        parts.append(sums.select(F.lit(channel).alias("channel"), F.lit(col).alias("col_name"), "day", "what", "n", "v"))
    return (star(union_all(*parts), (t.date_dim, "day", "d_date_sk"), (t.item, "what", "i_item_sk"))
            .groupBy("channel", "col_name", "d_year", "d_qoy", "i_category")
            .agg(F.sum("n").alias("sales_cnt"), F.sum("v").alias("sales_amt")))


def channel_profits(t, sales_date):
    """Channel, outlet, sales, returns and profit of 30 days, before any rollup."""
    dates = window_of_days(t, sales_date, 30).select("d_date_sk")

    def sums(table, day, outlet, **measures):
        return (star(t[table], (dates, day, "d_date_sk")).groupBy(c(outlet).alias("id"))
                .agg(*[F.sum(x).alias(n) for n, x in measures.items()]))

    def known(df, dim, key):
        return matching(df, dim, ("id", key))

    def outer(sold, back, channel):
        back = back.withColumnRenamed("id", "back_id")
        return (sold.join(back, c("id") == c("back_id"), "left")
                .select(F.lit(channel).alias("channel"), "id", "sales",
                        F.coalesce("returns", F.lit(0)).alias("returns"),
                        (c("profit") - F.coalesce("loss", F.lit(0))).alias("profit")))

    store = outer(
        known(sums("store_sales", "ss_sold_date_sk", "ss_store_sk", sales="ss_ext_sales_price", profit="ss_net_profit"), t.store, "s_store_sk"),
        known(sums("store_returns", "sr_returned_date_sk", "sr_store_sk", returns="sr_return_amt", loss="sr_net_loss"), t.store, "s_store_sk"),
        "store channel")
    web = outer(
        known(sums("web_sales", "ws_sold_date_sk", "ws_web_page_sk", sales="ws_ext_sales_price", profit="ws_net_profit"), t.web_page, "wp_web_page_sk"),
        known(sums("web_returns", "wr_returned_date_sk", "wr_web_page_sk", returns="wr_return_amt", loss="wr_net_loss"), t.web_page, "wp_web_page_sk"),
        "web channel")
    # The reference pairs every selling call center with every returning one, so each center
    # repeats once per returning center.  Their sums follow from one row of totals.
    sold = sums("catalog_sales", "cs_sold_date_sk", "cs_call_center_sk", sales="cs_ext_sales_price", profit="cs_net_profit")
    back = (sums("catalog_returns", "cr_returned_date_sk", "cr_call_center_sk", returns="cr_return_amount", loss="cr_net_loss")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("returns").alias("returns"),
                 F.sum("loss").alias("loss"), F.count("loss").alias("m")))
    catalog = (with_scalar(sold, back).filter("n > 0")
               .select(F.lit("catalog channel").alias("channel"), "id", (c("sales") * c("n")).alias("sales"),
                       "returns", (c("profit") * c("m") - c("loss")).alias("profit")))
    return union_all(*[x.select("channel", "id", *[c(m).cast("decimal(38,2)").alias(m)
                                                   for m in ("sales", "returns", "profit")])
                       for x in (store, catalog, web)])


Q77_COLUMNS = CHANNEL_COLUMNS.replace("id ", "id:i ", 1)


@query("q77", Q77_COLUMNS, "channel id", 100)
def q77(t, sales_date="1999-08-04"):
    return channel_rollup(channel_profits(t, sales_date))


@query("q78", "ss_sold_year:i ss_item_sk:i ss_customer_sk:i ratio:n store_qty:i store_wholesale_cost:n "
       "store_sales_price:n other_chan_qty:i other_chan_wholesale_cost:n other_chan_sales_price:n",
       "ss_sold_year ss_item_sk ss_customer_sk -store_qty -store_wholesale_cost -store_sales_price "
       "other_chan_qty other_chan_wholesale_cost other_chan_sales_price ratio", 100)
def q78(t, year=1999):
    dates = t.date_dim.filter(c("d_year") == year).select("d_date_sk")
    parts = []
    for sales, s, who, returns, r, order in (
            ("store_sales", "ss", "ss_customer_sk", "store_returns", "sr", "ticket_number"),
            ("web_sales", "ws", "ws_bill_customer_sk", "web_returns", "wr", "order_number"),
            ("catalog_sales", "cs", "cs_bill_customer_sk", "catalog_returns", "cr", "order_number")):
        rows = star(t[sales], (dates, f"{s}_sold_date_sk", "d_date_sk"))
        kept = matching(rows, t[returns], (f"{s}_{order}", f"{r}_{order}"),
                        (f"{s}_item_sk", f"{r}_item_sk"), how="left_anti")
        parts.append(kept.groupBy(c(f"{s}_item_sk").alias("item"), c(who).alias("who")).agg(
            F.sum(f"{s}_quantity").alias("qty"), F.sum(f"{s}_wholesale_cost").alias("wc"),
            F.sum(f"{s}_sales_price").alias("sp")).withColumn("tag", F.lit(s)))
    # A null customer never equals another, so it cannot have bought elsewhere.
    both = (union_all(*parts).filter("who is not null").groupBy("item", "who")
            .agg(*[sum_if(c("tag") == s, m).alias(f"{s}_{m}") for s in ("ss", "ws", "cs") for m in ("qty", "wc", "sp")],
                 F.max(c("tag") == "ss").alias("in_store")))
    other = {m: F.coalesce(f"ws_{m}", F.lit(0)) + F.coalesce(f"cs_{m}", F.lit(0)) for m in ("qty", "wc", "sp")}
    return (both.filter("in_store and ws_qty > 0 and cs_qty > 0")
            .select(F.lit(year).alias("ss_sold_year"), c("item").alias("ss_item_sk"), c("who").alias("ss_customer_sk"),
                    F.round(ratio("ss_qty", F.coalesce(c("ws_qty") + c("cs_qty"), F.lit(1))), 2).alias("ratio"),
                    c("ss_qty").alias("store_qty"), c("ss_wc").alias("store_wholesale_cost"),
                    c("ss_sp").alias("store_sales_price"), other["qty"].alias("other_chan_qty"),
                    other["wc"].alias("other_chan_wholesale_cost"), other["sp"].alias("other_chan_sales_price")))


@query("q79", "c_last_name c_first_name city ss_ticket_number:i amt:n profit:n",
       "c_last_name c_first_name city profit", 100)
def q79(t, deps=6, vehicles=2, year=1998):
    homes = t.household_demographics.filter((c("hd_dep_count") == deps) | (c("hd_vehicle_count") > vehicles))
    tickets = (star(t.store_sales,
                    (t.date_dim.filter((c("d_dow") == 1) & c("d_year").between(year, year + 2)), "ss_sold_date_sk", "d_date_sk"),
                    (t.store.filter("s_number_employees between 200 and 295"), "ss_store_sk", "s_store_sk"),
                    (homes, "ss_hdemo_sk", "hd_demo_sk"))
               .groupBy("ss_ticket_number", "ss_customer_sk", "ss_addr_sk", "s_city")
               .agg(F.sum("ss_coupon_amt").alias("amt"), F.sum("ss_net_profit").alias("profit")))
    return (star(tickets, (t.customer, "ss_customer_sk", "c_customer_sk"))
            .withColumn("city", F.substring("s_city", 1, 30)))


def promoted_outlets(t, sales_date):
    """Sales, returns and profit by outlet for dear items promoted other than on television."""
    dates = window_of_days(t, sales_date, 30).select("d_date_sk")
    items, promos = t.item.filter("i_current_price > 50"), t.promotion.filter("p_channel_tv = 'N'")
    parts = []
    for channel, prefix, sales, s, returns, r, order, amount, outlet, fk, pk, ident in (
            ("store channel", "store", "store_sales", "ss", "store_returns", "sr", "ticket_number", "return_amt",
             t.store, "ss_store_sk", "s_store_sk", "s_store_id"),
            ("catalog channel", "catalog_page", "catalog_sales", "cs", "catalog_returns", "cr", "order_number",
             "return_amount", t.catalog_page, "cs_catalog_page_sk", "cp_catalog_page_sk", "cp_catalog_page_id"),
            ("web channel", "web_site", "web_sales", "ws", "web_returns", "wr", "order_number", "return_amt",
             t.web_site, "ws_web_site_sk", "web_site_sk", "web_site_id")):
        sold = star(t[sales], (dates, f"{s}_sold_date_sk", "d_date_sk"), (items, f"{s}_item_sk", "i_item_sk"),
                    (promos, f"{s}_promo_sk", "p_promo_sk"), (outlet, fk, pk))
        rows = sold.join(t[returns], (c(f"{s}_item_sk") == c(f"{r}_item_sk"))
                         & (c(f"{s}_{order}") == c(f"{r}_{order}")), "left")
        sums = rows.groupBy(ident).agg(
            F.sum(f"{s}_ext_sales_price").alias("sales"), F.sum(F.coalesce(f"{r}_{amount}", F.lit(0))).alias("returns"),
            F.sum(c(f"{s}_net_profit") - F.coalesce(f"{r}_net_loss", F.lit(0))).alias("profit"))
        parts.append(sums.select(F.lit(channel).alias("channel"), F.concat(F.lit(prefix), ident).alias("id"),
                                 "sales", "returns", "profit"))
    return union_all(*parts)


@query("q80", CHANNEL_COLUMNS, "channel id", 100)
def q80(t, sales_date="1999-08-04"):
    return channel_rollup(promoted_outlets(t, sales_date))


Q81_NAMES = ("c_customer_id c_salutation c_first_name c_last_name ca_street_number ca_street_name ca_street_type "
             "ca_suite_number ca_city ca_county ca_state ca_zip ca_country ca_gmt_offset ca_location_type ctr_total_return")


@query("q81", Q81_NAMES.replace("ca_gmt_offset", "ca_gmt_offset:n") + ":n", Q81_NAMES, 100)
def q81(t, state="CA", year=1999):
    return returners(t, "catalog_returns", "cr", year, state, "cr_return_amt_inc_tax")


@query("q82", "i_item_id i_item_desc i_current_price:n", "i_item_id", 100)
def q82(t, start="1999-05-25", makers=(4, 9, 17, 28), price=30):
    return stocked_and_sold(t, "store_sales", "ss_item_sk", start, makers, price)


@query("q83", "item_id sr_item_qty:i sr_dev:n cr_item_qty:i cr_dev:n wr_item_qty:i wr_dev:n average:n",
       "item_id sr_item_qty", 100)
def q83(t, one="1999-06-30", two="1999-09-27", three="1999-11-17"):
    dates = days_of_weeks(t, one, two, three)
    parts = {p: per_item_id(t, dates, table, p, f"{p}_returned_date_sk", f"{p}_return_quantity", f"{p}_item_qty")
             for table, p in (("store_returns", "sr"), ("catalog_returns", "cr"), ("web_returns", "wr"))}
    both = parts["sr"].join(parts["cr"], "i_item_id").join(parts["wr"], "i_item_id")
    total = (c("sr_item_qty") + c("cr_item_qty") + c("wr_item_qty")).cast("double")
    return (both.withColumnRenamed("i_item_id", "item_id").withColumn("average", total / 3)
            .withColumns({f"{p}_dev": F.try_divide(c(f"{p}_item_qty").cast("double"), total) / 3 * 100 for p in parts}))


@query("q84", "customer_id customername", "customer_id", 100)
def q84(t, city="Midway", income=38128):
    bands = t.income_band.filter((c("ib_lower_bound") >= income) & (c("ib_upper_bound") <= income + 50000))
    people = star(t.customer, (t.customer_address.filter(c("ca_city") == city), "c_current_addr_sk", "ca_address_sk"),
                  (t.household_demographics, "c_current_hdemo_sk", "hd_demo_sk"),
                  (bands, "hd_income_band_sk", "ib_income_band_sk"),
                  (t.customer_demographics, "c_current_cdemo_sk", "cd_demo_sk"))
    name = F.concat(F.coalesce("c_last_name", F.lit("")), F.lit(", "), F.coalesce("c_first_name", F.lit("")))
    people = people.select(c("c_customer_id").alias("customer_id"), name.alias("customername"), "cd_demo_sk")
    return star(t.store_returns.select("sr_cdemo_sk"), (people, "sr_cdemo_sk", "cd_demo_sk"))


@query("q85", "reason avg_quantity:n avg_refunded_cash:n avg_fee:n",
       "reason avg_quantity avg_refunded_cash avg_fee", 100)
def q85(t, marital=("M", "S", "W"), education=("Advanced Degree", "College", "2 yr Degree"),
        states=tuple(STATES[:9]), year=1999):
    person, place = F.lit(False), F.lit(False)
    for i, (lo, hi, worst, best) in enumerate([(100, 150, 100, 200), (50, 100, 150, 300), (150, 200, 50, 250)]):
        person = person | ((c("ms1") == marital[i]) & (c("es1") == education[i]) & c("ws_sales_price").between(lo, hi))
        place = place | (c("ca_state").isin(*states[3 * i:3 * i + 3]) & c("ws_net_profit").between(worst, best))
    cd1 = pick(t.customer_demographics.filter(c("cd_marital_status").isin(*marital)),
               cd1_sk="cd_demo_sk", ms1="cd_marital_status", es1="cd_education_status")
    cd2 = pick(t.customer_demographics, cd2_sk="cd_demo_sk", ms2="cd_marital_status", es2="cd_education_status")
    sold = star(t.web_sales, (t.date_dim.filter(c("d_year") == year), "ws_sold_date_sk", "d_date_sk"),
                (t.web_page, "ws_web_page_sk", "wp_web_page_sk"))
    back = star(t.web_returns, (cd1, "wr_refunded_cdemo_sk", "cd1_sk"), (cd2, "wr_returning_cdemo_sk", "cd2_sk"),
                (t.customer_address.filter("ca_country = 'United States'"), "wr_refunded_addr_sk", "ca_address_sk"),
                (t.reason, "wr_reason_sk", "r_reason_sk")).filter("ms1 = ms2 and es1 = es2")
    rows = sold.join(back, (c("ws_item_sk") == c("wr_item_sk")) & (c("ws_order_number") == c("wr_order_number")))
    return (rows.filter(person & place).groupBy("r_reason_desc")
            .agg(avg("ws_quantity").alias("avg_quantity"), avg("wr_refunded_cash").alias("avg_refunded_cash"),
                 avg("wr_fee").alias("avg_fee")).withColumn("reason", F.substring("r_reason_desc", 1, 20)))


def paid_by_class(t, dms):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")
    rows = star(t.web_sales, (dates, "ws_sold_date_sk", "d_date_sk"), (t.item, "ws_item_sk", "i_item_sk"))
    return rollup_of(rows, ["i_category", "i_class"], {"total_sum": c("ws_net_paid")})


@query("q86", "total_sum:n i_category i_class lochierarchy:i rank_within_parent:i", PARENT_ORDER, 100)
def q86(t, dms=1188):
    return ranked_in_parent(paid_by_class(t, dms), "i_category", "total_sum", descending=True)


@query("q87", "cnt:i")
def q87(t, dms=1188):
    return name_days_by_channel(t, dms).filter("s and not c and not w").agg(F.count(F.lit(1)).alias("cnt"))


HALF_HOURS = ["h8_30_to_9", "h9_to_9_30", "h9_30_to_10", "h10_to_10_30", "h10_30_to_11", "h11_to_11_30",
              "h11_30_to_12", "h12_to_12_30"]


@query("q88", " ".join(f"{h}:i" for h in HALF_HOURS))
def q88(t, hours=(3, 0, 1), store="ese"):
    homes = F.lit(False)
    for h in hours:
        homes = homes | ((c("hd_dep_count") == h) & (c("hd_vehicle_count") <= h + 2))
    # Half hours since midnight: 8:30 is 17.  Eight counts from one scan.
    half = (c("t_hour") * 2 + F.floor(c("t_minute") / 30)).cast("int")
    times = t.time_dim.withColumn("half", half).filter(c("half").between(17, 24))
    rows = star(t.store_sales, (times, "ss_sold_time_sk", "t_time_sk"),
                (t.household_demographics.filter(homes), "ss_hdemo_sk", "hd_demo_sk"),
                (t.store.filter(c("s_store_name") == store), "ss_store_sk", "s_store_sk"))
    return rows.agg(*[F.count_if(c("half") == 17 + i).alias(h) for i, h in enumerate(HALF_HOURS)])


@query("q89", "i_category i_class i_brand s_store_name s_company_name d_moy:i sum_sales:n avg_monthly_sales:n",
       "_gap s_store_name", 100)
def q89(t, year=1999, cats_a=("Books", "Electronics", "Sports"), classes_a=("personal", "portable", "reference"),
        cats_b=("Men", "Jewelry", "Women"), classes_b=("accessories", "classical", "pants")):
    items = t.item.filter((c("i_category").isin(*cats_a) & c("i_class").isin(*classes_a))
                          | (c("i_category").isin(*cats_b) & c("i_class").isin(*classes_b)))
    keys = ["i_category", "i_brand", "s_store_name", "s_company_name"]
    sums = (star(t.store_sales, (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                 (items, "ss_item_sk", "i_item_sk"), (t.store, "ss_store_sk", "s_store_sk"))
            .groupBy(*keys, "i_class", "d_moy").agg(F.sum("ss_sales_price").alias("sum_sales")))
    w = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum("sum_sales").over(w).cast("double"), F.count("sum_sales").over(w).cast("double"))
    gap = c("sum_sales").cast("double") - c("avg_monthly_sales")
    return (sums.withColumn("avg_monthly_sales", mean).filter("avg_monthly_sales <> 0").withColumn("_gap", gap)
            .filter(F.abs("_gap") / c("avg_monthly_sales") > 0.1))


@query("q90", "am_pm_ratio:n", "am_pm_ratio", 100)
def q90(t, deps=6, hour_am=8, hour_pm=19):
    am, pm = c("t_hour").between(hour_am, hour_am + 1), c("t_hour").between(hour_pm, hour_pm + 1)
    rows = star(t.web_sales, (t.time_dim.filter(am | pm), "ws_sold_time_sk", "t_time_sk"),
                (t.household_demographics.filter(c("hd_dep_count") == deps), "ws_ship_hdemo_sk", "hd_demo_sk"),
                (t.web_page.filter("wp_char_count between 5000 and 5200"), "ws_web_page_sk", "wp_web_page_sk"))
    return rows.agg(ratio(F.count_if(am), F.count_if(pm)).alias("am_pm_ratio"))


@query("q91", "call_center call_center_name manager returns_loss:n", "-returns_loss")
def q91(t, year=1999, month=12, potential="0-500", gmt=-7):
    people = t.customer_demographics.filter("(cd_marital_status = 'M' and cd_education_status = 'Unknown') or "
                                            "(cd_marital_status = 'W' and cd_education_status = 'Advanced Degree')")
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month))
    return (star(t.catalog_returns, (dates, "cr_returned_date_sk", "d_date_sk"),
                 (t.call_center, "cr_call_center_sk", "cc_call_center_sk"),
                 (t.customer, "cr_returning_customer_sk", "c_customer_sk"), (people, "c_current_cdemo_sk", "cd_demo_sk"),
                 (t.household_demographics.filter(c("hd_buy_potential").startswith(potential)), "c_current_hdemo_sk", "hd_demo_sk"),
                 (t.customer_address.filter(c("ca_gmt_offset") == gmt), "c_current_addr_sk", "ca_address_sk"))
            .groupBy(c("cc_call_center_id").alias("call_center"), c("cc_name").alias("call_center_name"),
                     c("cc_manager").alias("manager"), "cd_marital_status", "cd_education_status")
            .agg(F.sum("cr_net_loss").alias("returns_loss")))


@query("q92", "excess_discount_amount:n", "excess_discount_amount", 100)
def q92(t, manufact=16, start="1999-01-07"):
    return excess_discount(t, "web_sales", "ws", manufact, start)


@query("q93", "ss_customer_sk:i sumsales:n", "sumsales ss_customer_sk", 100)
def q93(t, reason="reason 7"):
    # The reason is a property of the return, so the outer join keeps matched rows only.
    back = star(t.store_returns, (t.reason.filter(c("r_reason_desc") == reason), "sr_reason_sk", "r_reason_sk"))
    rows = t.store_sales.join(back, (c("sr_item_sk") == c("ss_item_sk"))
                              & (c("sr_ticket_number") == c("ss_ticket_number")))
    kept = c("ss_quantity") - F.coalesce("sr_return_quantity", F.lit(0))
    return rows.groupBy("ss_customer_sk").agg(F.sum(kept * c("ss_sales_price")).alias("sumsales"))


def web_orders(t, year, month, state):
    return star(t.web_sales, (window_of_days(t, f"{year}-{month:02d}-01", 60), "ws_ship_date_sk", "d_date_sk"),
                (t.customer_address.filter(c("ca_state") == state), "ws_ship_addr_sk", "ca_address_sk"),
                (t.web_site.filter("web_company_name = 'pri'"), "ws_web_site_sk", "web_site_sk"))


@query("q94", ORDER_COLUMNS, "order_count", 100)
def q94(t, year=1999, month=2, state="GA"):
    rows = matching(web_orders(t, year, month, state).filter("ws_warehouse_sk is not null"),
                    many_warehouses(t.web_sales, "ws"), ("ws_order_number", "order_no"))
    rows = matching(rows, t.web_returns, ("ws_order_number", "wr_order_number"), how="left_anti")
    return order_summary(rows, "ws")


@query("q95", ORDER_COLUMNS, "order_count", 100)
def q95(t, year=1999, month=2, state="GA"):
    rows = matching(web_orders(t, year, month, state), many_warehouses(t.web_sales, "ws"), ("ws_order_number", "order_no"))
    rows = matching(rows, t.web_returns, ("ws_order_number", "wr_order_number"))
    return order_summary(rows, "ws")


@query("q96", "cnt:i", "cnt", 100)
def q96(t, hour=20, deps=7):
    rows = star(t.store_sales, (t.time_dim.filter((c("t_hour") == hour) & (c("t_minute") >= 30)), "ss_sold_time_sk", "t_time_sk"),
                (t.household_demographics.filter(c("hd_dep_count") == deps), "ss_hdemo_sk", "hd_demo_sk"),
                (t.store.filter("s_store_name = 'ese'"), "ss_store_sk", "s_store_sk"))
    return rows.agg(F.count(F.lit(1)).alias("cnt"))


@query("q97", "store_only:i catalog_only:i store_and_catalog:i", "", 100)
def q97(t, dms=1188):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")

    def pairs(table, day, who, what, mark):
        return (star(t[table], (dates, day, "d_date_sk"))
                .select(c(who).alias(f"{mark}_who"), c(what).alias(f"{mark}_what")).distinct())

    both = pairs("store_sales", "ss_sold_date_sk", "ss_customer_sk", "ss_item_sk", "s").join(
        pairs("catalog_sales", "cs_sold_date_sk", "cs_bill_customer_sk", "cs_item_sk", "c"),
        (c("s_who") == c("c_who")) & (c("s_what") == c("c_what")), "full")
    return both.agg(count_if(c("s_who").isNotNull() & c("c_who").isNull()).alias("store_only"),
                    count_if(c("s_who").isNull() & c("c_who").isNotNull()).alias("catalog_only"),
                    count_if(c("s_who").isNotNull() & c("c_who").isNotNull()).alias("store_and_catalog"))


@query("q98", SHARE_COLUMNS, "i_category i_class i_item_id i_item_desc revenueratio")
def q98(t, sdate="1999-02-22", categories=("Sports", "Books", "Home")):
    return class_share(t, t.store_sales, "ss", sdate, categories)


@query("q99", "warehouse sm_type cc_name " + DELAY_COLUMNS, "warehouse sm_type cc_name", 100)
def q99(t, dms=1188):
    return shipping_delays(t, "catalog_sales", "cs", t.call_center, ("cs_call_center_sk", "cc_call_center_sk"), "cc_name", dms)
