"""Decision-support queries 21 to 45."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from starling.functions.exact import avg, ratio, stddev_of_moments, stddev_samp, sum_if
from starling.operators.relational import (lowest, matching, pick, role, rollup_avg, rollup_of, star,
                                           union_all, with_scalar)
from starling.operators.replicated import if_small
from starling.plans.base import allowed, query
from starling.plans.queries_01_20 import (buyers, demographic_averages, over_group_average,
                                          rebuy_chain, weekly_by_day, window_of_days)
from starling.plans.star import COUNTIES, DAY_NAMES, STATES

c = F.col


def around(t, day: str, days: int):
    """Calendar rows within ``days`` before and after a day, with a ``before`` flag."""
    mid = F.to_date(F.lit(day))
    return (t.date_dim.filter(c("d_date").between(F.date_sub(mid, days), F.date_add(mid, days)))
            .select("d_date_sk", (c("d_date") < mid).alias("before")))


@query("q21", "w_warehouse_name i_item_id inv_before:i inv_after:i", "w_warehouse_name i_item_id", 100)
def q21(t, sales_date="2000-07-05"):
    stock = star(t.inventory, (around(t, sales_date, 30), "inv_date_sk", "d_date_sk"),
                 (t.item.filter("i_current_price between 0.99 and 1.49"), "inv_item_sk", "i_item_sk"),
                 (if_small(t.warehouse), "inv_warehouse_sk", "w_warehouse_sk"))
    sides = (stock.groupBy("w_warehouse_name", "i_item_id")
             .agg(F.sum(F.when(c("before"), c("inv_quantity_on_hand")).otherwise(0)).alias("inv_before"),
                  F.sum(F.when(~c("before"), c("inv_quantity_on_hand")).otherwise(0)).alias("inv_after")))
    return sides.filter((c("inv_before") > 0)
                        & ratio("inv_after", "inv_before").between(2.0 / 3.0, 3.0 / 2.0))


HIERARCHY = ["i_product_name", "i_brand", "i_class", "i_category"]


def stock_by_item(t, dms):
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk")
    return star(t.inventory, (dates, "inv_date_sk", "d_date_sk"), (t.item, "inv_item_sk", "i_item_sk"))


@query("q22", " ".join(HIERARCHY) + " qoh:n", "qoh " + " ".join(HIERARCHY), 100)
def q22(t, dms=1188):
    return rollup_avg(stock_by_item(t, dms), HIERARCHY, {"qoh": c("inv_quantity_on_hand")})


def frequent_and_best(t, year, frequent, top_percent):
    """Items sold more than ``frequent`` times on one day, and the customers spending the most."""
    years = t.date_dim.filter(c("d_year").between(year, year + 3)).select("d_date_sk")
    in_years = star(t.store_sales, (years, "ss_sold_date_sk", "d_date_sk"))
    # The description prefix and the date follow from their keys, so the keys alone are grouped.
    items = matching(in_years.groupBy("ss_item_sk", "ss_sold_date_sk").agg(F.count(F.lit(1)).alias("cnt"))
                     .filter(c("cnt") > frequent), t.item, ("ss_item_sk", "i_item_sk"))
    spent = F.sum(c("ss_quantity") * c("ss_sales_price"))
    known = ("ss_customer_sk", "c_customer_sk")
    most = (matching(in_years.groupBy("ss_customer_sk").agg(spent.alias("spent")), t.customer, known)
            .agg(F.max("spent").cast("double").alias("most")))
    each = matching(t.store_sales.groupBy("ss_customer_sk").agg(spent.alias("spent")), t.customer, known)
    best = (with_scalar(each, most)
            .filter(c("spent").cast("double") > F.lit(top_percent / 100.0) * c("most")))
    return items, best


def best_customers_buying(t, year, month, frequent, top_percent):
    items, best = frequent_and_best(t, year, frequent, top_percent)
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month))
    rows = []
    for table, p in (("catalog_sales", "cs"), ("web_sales", "ws")):
        sales = star(t[table], (dates, f"{p}_sold_date_sk", "d_date_sk"))
        sales = matching(sales, items, (f"{p}_item_sk", "ss_item_sk"))
        sales = matching(sales, best, (f"{p}_bill_customer_sk", "ss_customer_sk"))
        rows.append(sales.select(F.lit(p).alias("channel"), c(f"{p}_bill_customer_sk").alias("who"),
                                 (c(f"{p}_quantity") * c(f"{p}_list_price")).alias("sales")))
    return union_all(*rows)


@query("q23", "sum_sales:n", frequent=1, top_percent=40)
def q23(t, year=1998, month=3, frequent=4, top_percent=95):
    return (best_customers_buying(t, year, month, frequent, top_percent)
            .agg(F.sum("sales").alias("sum_sales")))


@query("q23_customers", "c_last_name c_first_name sales:n", "c_last_name c_first_name sales", 100,
       frequent=1, top_percent=40)
def q23_customers(t, year=1998, month=3, frequent=4, top_percent=95):
    """Second statement of q23: the same sales per channel and customer name."""
    rows = best_customers_buying(t, year, month, frequent, top_percent)
    return (star(rows.groupBy("channel", "who").agg(F.sum("sales").alias("sales")),
                 (t.customer, "who", "c_customer_sk"))
            .groupBy("channel", "c_last_name", "c_first_name").agg(F.sum("sales").alias("sales")))


def returned_by_colour(t, colour, market, amount):
    """Net paid for returned goods of a colour, for buyers above 5% of the mean group."""
    allowed(amount, "ss_net_paid ss_net_paid_inc_tax ss_net_profit ss_sales_price ss_ext_sales_price")
    rows = star(t.store_sales, (t.store.filter(c("s_market_id") == market), "ss_store_sk", "s_store_sk"))
    rows = rows.join(t.store_returns, (c("ss_ticket_number") == c("sr_ticket_number"))
                     & (c("ss_item_sk") == c("sr_item_sk")))
    # A sale matches every address of the store's zip and the buyer's birth country: carry the
    # number of such addresses per state as a weight.
    places = (t.customer_address.groupBy(F.upper("ca_country").alias("country"), "ca_zip", "ca_state")
              .agg(F.count(F.lit(1)).alias("places")))
    people = star(rows, (t.customer, "ss_customer_sk", "c_customer_sk"), (t.item, "ss_item_sk", "i_item_sk"))
    sold = people.join(places, (c("c_birth_country") == c("country")) & (c("s_zip") == c("ca_zip")))
    groups = sold.groupBy("c_last_name", "c_first_name", "s_store_name", "ca_state", "s_state", "i_color",
                          "i_current_price", "i_manager_id", "i_units", "i_size").agg(
        F.sum(c(amount) * c("places")).alias("netpaid"))
    bar = groups.agg((avg("netpaid") * 0.05).alias("bar"))
    paid = (groups.filter(c("i_color") == colour).groupBy("c_last_name", "c_first_name", "s_store_name")
            .agg(F.sum("netpaid").alias("paid")))
    return with_scalar(paid, bar).filter(c("paid").cast("double") > c("bar"))


@query("q24", "c_last_name c_first_name s_store_name paid:n", "c_last_name c_first_name s_store_name")
def q24(t, colour="brown", market=5, amount="ss_net_paid"):
    return returned_by_colour(t, colour, market, amount)


@query("q24_second", "c_last_name c_first_name s_store_name paid:n", "c_last_name c_first_name s_store_name")
def q24_second(t, colour="snow", market=5, amount="ss_net_paid"):
    """Second statement of q24: the other colour."""
    return returned_by_colour(t, colour, market, amount)


CHAIN_KEYS = ["i_item_id", "i_item_desc", "s_store_id", "s_store_name"]


def chosen(agg: str, name: str):
    """The requested aggregate from summed moments."""
    allowed(agg, "sum min max avg stddev_samp")
    return {"sum": c(f"s_{name}"), "min": c(f"min_{name}"), "max": c(f"max_{name}"),
            "avg": ratio(f"s_{name}", f"n_{name}"),
            "stddev_samp": F.round(stddev_of_moments(name), 4)}[agg]


@query("q25", " ".join(CHAIN_KEYS) + " store_sales_profit:n store_returns_loss:n catalog_sales_profit:n",
       " ".join(CHAIN_KEYS), 100)
def q25(t, year=1999, agg="sum"):
    d = t.date_dim.filter(c("d_year") == year)
    later = d.filter(c("d_moy").between(4, 10))
    out = rebuy_chain(t, d.filter("d_moy = 4"), later, later, CHAIN_KEYS, store_sales="ss_net_profit",
                      store_returns="sr_net_loss", catalog_sales="cs_net_profit")
    return out.select(*CHAIN_KEYS, chosen(agg, "store_sales").alias("store_sales_profit"),
                      chosen(agg, "store_returns").alias("store_returns_loss"),
                      chosen(agg, "catalog_sales").alias("catalog_sales_profit"))


@query("q26", "i_item_id agg1:n agg2:n agg3:n agg4:n", "i_item_id", 100)
def q26(t, gender="F", marital="W", education="Primary", year=1999):
    return demographic_averages(t, t.catalog_sales, "cs", gender, marital, education, year)


def q27_rows(t, year, gender, marital, education, states):
    people = t.customer_demographics.filter(
        (c("cd_gender") == gender) & (c("cd_marital_status") == marital)
        & (c("cd_education_status") == education))
    return star(t.store_sales, (people, "ss_cdemo_sk", "cd_demo_sk"),
                (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                (t.store.filter(c("s_state").isin(*states)), "ss_store_sk", "s_store_sk"),
                (t.item, "ss_item_sk", "i_item_sk"))


Q27_VALUES = ["ss_quantity", "ss_list_price", "ss_coupon_amt", "ss_sales_price"]
Q27_COLUMNS = "i_item_id s_state g_state:i agg1:n agg2:n agg3:n agg4:n"


@query("q27", Q27_COLUMNS, "i_item_id s_state", 100)
def q27(t, year=1999, gender="M", marital="S", education="College", states=tuple(STATES[:6])):
    rolled = rollup_avg(q27_rows(t, year, gender, marital, education, states), ["i_item_id", "s_state"],
                        {f"agg{i + 1}": c(v) for i, v in enumerate(Q27_VALUES)})
    return rolled.withColumn("g_state", (c("lochierarchy") > 0).cast("int"))


@query("q28", " ".join(f"b{i}_lp:n b{i}_cnt:i b{i}_cntd:i" for i in range(1, 7)))
def q28(t, list_price=(8, 90, 142, 135, 122, 154), coupon=(459, 2323, 1214, 607, 836, 732),
        wholesale=(57, 31, 79, 38, 17, 7)):
    spans = [(0, 5), (6, 10), (11, 15), (16, 20), (21, 25), (26, 30)]
    bucket = F.lit(None)
    for i, (lo, hi) in enumerate(spans):
        fits = (c("ss_list_price").between(list_price[i], list_price[i] + 10)
                | c("ss_coupon_amt").between(coupon[i], coupon[i] + 1000)
                | c("ss_wholesale_cost").between(wholesale[i], wholesale[i] + 20))
        bucket = F.when(c("ss_quantity").between(lo, hi) & fits, i + 1).otherwise(bucket)
    # The quantity spans are disjoint, so one pass serves all six; grouping by price first makes
    # the distinct count a plain count.
    prices = (t.store_sales.withColumn("bucket", bucket).filter("bucket is not null")
              .groupBy("bucket", "ss_list_price").agg(F.count("ss_list_price").alias("n")))
    cells = []
    for i in range(1, 7):
        here = c("bucket") == i
        total = sum_if(here, c("ss_list_price") * c("n"))
        cells += [ratio(total, sum_if(here, "n")).alias(f"b{i}_lp"),
                  F.coalesce(sum_if(here, "n"), F.lit(0)).alias(f"b{i}_cnt"),
                  F.count(F.when(here, c("ss_list_price"))).alias(f"b{i}_cntd")]
    return prices.agg(*cells)


@query("q29", " ".join(CHAIN_KEYS) + " store_sales_quantity:n store_returns_quantity:n catalog_sales_quantity:n",
       " ".join(CHAIN_KEYS), 100)
def q29(t, year=1998, month=4, agg="stddev_samp"):
    d = t.date_dim.filter(c("d_year") == year)
    out = rebuy_chain(t, d.filter(c("d_moy") == month), d.filter(c("d_moy").between(month, month + 3)),
                      t.date_dim.filter(c("d_year").between(year, year + 2)), CHAIN_KEYS,
                      store_sales="ss_quantity", store_returns="sr_return_quantity",
                      catalog_sales="cs_quantity")
    return out.select(*CHAIN_KEYS, *[chosen(agg, n).alias(f"{n}_quantity")
                                     for n in ("store_sales", "store_returns", "catalog_sales")])


def returners(t, table, p, year, state, amount):
    """Customers whose returns exceed 1.2x the mean of the state they returned from."""
    totals = (star(t[table], (t.date_dim.filter(c("d_year") == year), f"{p}_returned_date_sk", "d_date_sk"),
                   (t.customer_address, f"{p}_returning_addr_sk", "ca_address_sk"))
              .groupBy(c(f"{p}_returning_customer_sk").alias("who"), c("ca_state").alias("state"))
              .agg(F.sum(amount).alias("ctr_total_return")))
    home = t.customer_address.filter(c("ca_state") == state)
    return star(over_group_average(totals, "state", "ctr_total_return"),
                (t.customer, "who", "c_customer_sk"), (home, "c_current_addr_sk", "ca_address_sk"))


Q30_NAMES = ("c_customer_id c_salutation c_first_name c_last_name c_preferred_cust_flag c_birth_day "
             "c_birth_month c_birth_year c_birth_country c_login c_email_address c_last_review_date "
             "ctr_total_return")


@query("q30", " ".join(n + {"c_birth_day": ":i", "c_birth_month": ":i", "c_birth_year": ":i",
                            "ctr_total_return": ":n"}.get(n, "") for n in Q30_NAMES.split()), Q30_NAMES, 100)
def q30(t, state="GA", year=1999):
    return returners(t, "web_returns", "wr", year, state, "wr_return_amt")


@query("q31", "ca_county d_year:i web_q1_q2_increase:n store_q1_q2_increase:n web_q2_q3_increase:n "
       "store_q2_q3_increase:n", "ca_county")
def q31(t, year=1999):
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_qoy") <= 3))

    def quarters(table, p, addr):
        rows = star(t[table], (dates, f"{p}_sold_date_sk", "d_date_sk"),
                    (t.customer_address, addr, "ca_address_sk"))
        return (rows.groupBy("ca_county", "d_qoy").agg(F.sum(f"{p}_ext_sales_price").alias("v"))
                .withColumn("tag", F.lit(p)))

    both = union_all(quarters("store_sales", "ss", "ss_addr_sk"),
                     quarters("web_sales", "ws", "ws_bill_addr_sk")).filter("ca_county is not null")
    q = both.groupBy("ca_county").agg(*[sum_if((c("tag") == p) & (c("d_qoy") == i), "v").alias(f"{p}{i}")
                                        for p in ("ss", "ws") for i in (1, 2, 3)])
    grew = [(ratio(f"ws{i + 1}", f"ws{i}"), ratio(f"ss{i + 1}", f"ss{i}")) for i in (1, 2)]
    q = q.filter("ws1 > 0 and ss1 > 0 and ws2 > 0 and ss2 > 0")
    return (q.filter((grew[0][0] > grew[0][1]) & (grew[1][0] > grew[1][1]))
            .select("ca_county", F.lit(year).alias("d_year"), grew[0][0].alias("web_q1_q2_increase"),
                    grew[0][1].alias("store_q1_q2_increase"), grew[1][0].alias("web_q2_q3_increase"),
                    grew[1][1].alias("store_q2_q3_increase")))


def excess_discount(t, table, p, manufact, start):
    """Discounts above 1.3x the item's average discount over 90 days."""
    items = t.item.filter(c("i_manufact_id") == manufact).select("i_item_sk")
    rows = star(t[table], (window_of_days(t, start, 90).select("d_date_sk"), f"{p}_sold_date_sk", "d_date_sk"),
                (items, f"{p}_item_sk", "i_item_sk")).select("i_item_sk", f"{p}_ext_discount_amt")
    return (over_group_average(rows, "i_item_sk", f"{p}_ext_discount_amt", 1.3)
            .agg(F.sum(f"{p}_ext_discount_amt").alias("excess_discount_amount")))


@query("q32", "excess_discount_amount:n", "excess_discount_amount", 100)
def q32(t, manufact=16, start="1999-01-07"):
    return excess_discount(t, "catalog_sales", "cs", manufact, start)


def three_channels(t, key, year, month, gmt, items):
    """Revenue per ``key`` over store, catalog and web for one month and time zone."""
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month))
    homes = t.customer_address.filter(c("ca_gmt_offset") == gmt)
    parts = [star(t[table], (dates, f"{p}_sold_date_sk", "d_date_sk"), (items, f"{p}_item_sk", "i_item_sk"),
                  (homes, addr, "ca_address_sk")).groupBy(key)
             .agg(F.sum(f"{p}_ext_sales_price").alias("total_sales"))
             for table, p, addr in (("store_sales", "ss", "ss_addr_sk"),
                                    ("catalog_sales", "cs", "cs_bill_addr_sk"),
                                    ("web_sales", "ws", "ws_bill_addr_sk"))]
    return union_all(*parts).groupBy(key).agg(F.sum("total_sales").alias("total_sales"))


@query("q33", "i_manufact_id:i total_sales:n", "total_sales", 100)
def q33(t, year=1999, month=3, gmt=-5, category="Books"):
    makers = t.item.filter(c("i_category") == category)
    items = matching(t.item, makers, ("i_manufact_id", "i_manufact_id"))
    return three_channels(t, "i_manufact_id", year, month, gmt, items)


def busy_tickets(t, days, potentials, years, counties, lo, hi, min_ratio):
    """Tickets with ``lo`` to ``hi`` lines from households of a buying potential."""
    homes = (t.household_demographics
             .filter(c("hd_buy_potential").isin(*potentials) & (c("hd_vehicle_count") > 0))
             .filter(ratio("hd_dep_count", "hd_vehicle_count") > min_ratio))
    tickets = (star(t.store_sales,
                    (t.date_dim.filter(days & c("d_year").isin(*years)), "ss_sold_date_sk", "d_date_sk"),
                    (t.store.filter(c("s_county").isin(*counties)), "ss_store_sk", "s_store_sk"),
                    (homes, "ss_hdemo_sk", "hd_demo_sk"))
               .groupBy("ss_ticket_number", "ss_customer_sk").agg(F.count(F.lit(1)).alias("cnt"))
               .filter(c("cnt").between(lo, hi)))
    return star(tickets, (t.customer, "ss_customer_sk", "c_customer_sk"))


TICKET_COLUMNS = "c_last_name c_first_name c_salutation c_preferred_cust_flag ss_ticket_number:i cnt:i"


@query("q34", TICKET_COLUMNS, "c_last_name c_first_name c_salutation -c_preferred_cust_flag", lo=3)
def q34(t, potentials=(">10000", "Unknown"), year=1998, counties=tuple(COUNTIES), lo=15, hi=20):
    days = c("d_dom").between(1, 3) | c("d_dom").between(25, 28)
    return busy_tickets(t, days, potentials, (year, year + 1, year + 2), counties, lo, hi, 1.2)


Q35_KEYS = "ca_state cd_gender cd_marital_status cd_dep_count cd_dep_employed_count cd_dep_college_count"


@query("q35", "ca_state cd_gender cd_marital_status cd_dep_count:i cnt1:i a1:n a2:n a3:n "
       "cd_dep_employed_count:i cnt2:i b1:n b2:n b3:n cd_dep_college_count:i cnt3:i c1:n c2:n c3:n",
       Q35_KEYS, 100)
def q35(t, year=1999, aggs=("sum", "avg", "stddev_samp")):
    f = {"sum": F.sum, "min": F.min, "max": F.max, "avg": avg, "stddev_samp": stddev_samp}
    dates = t.date_dim.filter((c("d_year") == year) & (c("d_qoy") < 4))
    in_store = buyers(t, "store_sales", "ss_customer_sk", "ss_sold_date_sk", dates)
    remote = union_all(buyers(t, "web_sales", "ws_bill_customer_sk", "ws_sold_date_sk", dates),
                       buyers(t, "catalog_sales", "cs_ship_customer_sk", "cs_sold_date_sk", dates))
    people = matching(matching(t.customer, in_store, ("c_customer_sk", "who")),
                      remote, ("c_customer_sk", "who"))
    cells = [F.count(F.lit(1)).alias(f"cnt{i}") for i in (1, 2, 3)]
    for mark, col in zip("abc", Q35_KEYS.split()[3:]):
        cells += [f[allowed(a, " ".join(f))](col).alias(f"{mark}{i}") for i, a in enumerate(aggs, 1)]
    return (star(people, (t.customer_address, "c_current_addr_sk", "ca_address_sk"),
                 (t.customer_demographics, "c_current_cdemo_sk", "cd_demo_sk"))
            .groupBy(*Q35_KEYS.split()).agg(*cells))


def ranked_in_parent(rolled, parent, value, descending=False):
    """Rank within the level, and within the parent at the finest level."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    rolled = rolled.withColumn("_parent", F.when(c("lochierarchy") == 0, c(parent)))
    return rolled.withColumn("rank_within_parent", F.rank().over(
        Window.partitionBy("lochierarchy", "_parent").orderBy(order)))


def margin_by_class(t, year, states):
    rows = star(t.store_sales, (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                (t.store.filter(c("s_state").isin(*states)), "ss_store_sk", "s_store_sk"),
                (t.item, "ss_item_sk", "i_item_sk"))
    rolled = rollup_of(rows, ["i_category", "i_class"],
                       {"profit": c("ss_net_profit"), "sales": c("ss_ext_sales_price")})
    return ranked_in_parent(rolled.withColumn("gross_margin", ratio("profit", "sales")),
                            "i_category", "gross_margin")


PARENT_ORDER = "-lochierarchy _parent rank_within_parent"


@query("q36", "gross_margin:n i_category i_class lochierarchy:i rank_within_parent:i", PARENT_ORDER, 100)
def q36(t, year=1999, states=tuple(STATES[:8])):
    return margin_by_class(t, year, states)


def stocked_and_sold(t, table, fk, start, makers, price):
    """Items of a price band with 100 to 500 on hand within 60 days that the channel sells."""
    items = t.item.filter(c("i_current_price").between(price, price + 30) & c("i_manufact_id").isin(*makers))
    stocked = (star(t.inventory.filter("inv_quantity_on_hand between 100 and 500"),
                    (items, "inv_item_sk", "i_item_sk"),
                    (window_of_days(t, start, 60), "inv_date_sk", "d_date_sk"))
               .select("i_item_sk", "i_item_id", "i_item_desc", "i_current_price").distinct())
    return (star(t[table].select(fk), (stocked, fk, "i_item_sk"))
            .select("i_item_id", "i_item_desc", "i_current_price").distinct())


@query("q37", "i_item_id i_item_desc i_current_price:n", "i_item_id", 100)
def q37(t, start="1999-02-01", makers=(6, 13, 20, 35), price=20):
    return stocked_and_sold(t, "catalog_sales", "cs_item_sk", start, makers, price)


def name_days_by_channel(t, dms):
    """Per customer name and day, a flag for each channel bought in.

    One grouping of all channels answers intersect and except alike; nulls compare equal in a
    grouping as they do in a set operation.
    """
    dates = t.date_dim.filter(c("d_month_seq").between(dms, dms + 11)).select("d_date_sk", "d_date")
    parts = []
    for tag, table, who, day in (("s", "store_sales", "ss_customer_sk", "ss_sold_date_sk"),
                                 ("c", "catalog_sales", "cs_bill_customer_sk", "cs_sold_date_sk"),
                                 ("w", "web_sales", "ws_bill_customer_sk", "ws_sold_date_sk")):
        days = star(t[table], (dates, day, "d_date_sk")).select(c(who).alias("who"), "d_date").distinct()
        parts.append(days.withColumn("tag", F.lit(tag)))
    people = t.customer.select("c_customer_sk", "c_last_name", "c_first_name")
    return (star(union_all(*parts), (people, "who", "c_customer_sk"))
            .groupBy("c_last_name", "c_first_name", "d_date")
            .agg(*[F.max(c("tag") == tag).alias(tag) for tag in "scw"]))


@query("q38", "cnt:i")
def q38(t, dms=1188):
    return name_days_by_channel(t, dms).filter("s and c and w").agg(F.count(F.lit(1)).alias("cnt"))


def volatile_stock(t, year, month):
    """Monthly mean and coefficient of variation of stock above 1, two months side by side."""
    dates = t.date_dim.filter((c("d_year") == year) & c("d_moy").isin(month, month + 1))
    inv = (star(t.inventory, (dates.select("d_date_sk", "d_moy"), "inv_date_sk", "d_date_sk"))
           .groupBy("inv_warehouse_sk", "inv_item_sk", "d_moy")
           .agg(avg("inv_quantity_on_hand").alias("mean"), F.stddev_samp("inv_quantity_on_hand").alias("dev"))
           .withColumn("cov", F.try_divide("dev", "mean")).filter("cov > 1"))
    inv = matching(matching(inv, t.item, ("inv_item_sk", "i_item_sk")),
                   t.warehouse, ("inv_warehouse_sk", "w_warehouse_sk"))
    now, then = (role(inv.filter(c("d_moy") == month + i), f"m{i + 1}_") for i in (0, 1))
    both = now.join(then, (c("m1_inv_item_sk") == c("m2_inv_item_sk"))
                    & (c("m1_inv_warehouse_sk") == c("m2_inv_warehouse_sk")))
    return both.select(c("m1_inv_warehouse_sk").alias("w1"), c("m1_inv_item_sk").alias("i1"),
                       c("m1_d_moy").alias("moy1"), c("m1_mean").alias("mean1"), c("m1_cov").alias("raw"),
                       F.round("m1_cov", 4).alias("cov1"), c("m2_inv_warehouse_sk").alias("w2"),
                       c("m2_inv_item_sk").alias("i2"), c("m2_d_moy").alias("moy2"),
                       c("m2_mean").alias("mean2"), F.round("m2_cov", 4).alias("cov2"))


Q39_COLUMNS = "w1:i i1:i moy1:i mean1:n cov1:n w2:i i2:i moy2:i mean2:n cov2:n"
Q39_ORDER = "w1 i1 moy1 mean1 cov1 moy2 mean2 cov2"


@query("q39", Q39_COLUMNS, Q39_ORDER)
def q39(t, year=1999, month=2):
    return volatile_stock(t, year, month)


@query("q39_high", Q39_COLUMNS, Q39_ORDER)
def q39_high(t, year=1999, month=2):
    """Second statement of q39: first month above 1.5."""
    return volatile_stock(t, year, month).filter("raw > 1.5")


@query("q40", "w_state i_item_id sales_before:n sales_after:n", "w_state i_item_id", 100)
def q40(t, sales_date="1999-03-11"):
    sales = star(t.catalog_sales, (around(t, sales_date, 30), "cs_sold_date_sk", "d_date_sk"),
                 (t.item.filter("i_current_price between 0.99 and 1.49"), "cs_item_sk", "i_item_sk"),
                 (if_small(t.warehouse), "cs_warehouse_sk", "w_warehouse_sk"))
    rows = sales.join(t.catalog_returns, (c("cs_order_number") == c("cr_order_number"))
                      & (c("cs_item_sk") == c("cr_item_sk")), "left")
    net = c("cs_sales_price") - F.coalesce("cr_refunded_cash", F.lit(0))
    return rows.groupBy("w_state", "i_item_id").agg(
        F.sum(F.when(c("before"), net).otherwise(0)).alias("sales_before"),
        F.sum(F.when(~c("before"), net).otherwise(0)).alias("sales_after"))


# Eight looks: category, two colours, two units, two sizes.
LOOKS = (("Women", ("powder", "khaki"), ("Ounce", "Oz"), ("medium", "extra large")),
         ("Women", ("brown", "honeydew"), ("Bunch", "Ton"), ("N/A", "small")),
         ("Men", ("floral", "deep"), ("N/A", "Dozen"), ("petite", "large")),
         ("Men", ("light", "cornflower"), ("Ounce", "Ton"), ("medium", "extra large")),
         ("Women", ("midnight", "snow"), ("Oz", "Bunch"), ("medium", "extra large")),
         ("Women", ("cyan", "papaya"), ("N/A", "Ounce"), ("N/A", "small")),
         ("Men", ("powder", "brown"), ("Dozen", "Oz"), ("petite", "large")),
         ("Men", ("khaki", "snow"), ("Bunch", "N/A"), ("medium", "extra large")))


@query("q41", "i_product_name", "i_product_name", 100, manufact=1)
def q41(t, manufact=700, looks=LOOKS):
    wanted = F.lit(False)
    for category, colors, units, sizes in looks:
        wanted = wanted | ((c("i_category") == category) & c("i_color").isin(*colors)
                           & c("i_units").isin(*units) & c("i_size").isin(*sizes))
    items = t.item.filter(c("i_manufact_id").between(manufact, manufact + 40))
    return matching(items, t.item.filter(wanted), ("i_manufact", "i_manufact")).select("i_product_name").distinct()


@query("q42", "d_year:i i_category_id:i i_category sum_ext_sales_price:n",
       "-sum_ext_sales_price d_year i_category_id i_category", 100)
def q42(t, month=11, year=1999):
    dates = t.date_dim.filter((c("d_moy") == month) & (c("d_year") == year))
    return (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (t.item.filter("i_manager_id = 1"), "ss_item_sk", "i_item_sk"))
            .groupBy("d_year", "i_category_id", "i_category")
            .agg(F.sum("ss_ext_sales_price").alias("sum_ext_sales_price")))


@query("q43", "s_store_name s_store_id " + " ".join(f"{d[:3].lower()}_sales:n" for d in DAY_NAMES),
       "s_store_name s_store_id " + " ".join(f"{d[:3].lower()}_sales" for d in DAY_NAMES), 100)
def q43(t, gmt=-5, year=1999):
    rows = star(t.store_sales, (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                (t.store.filter(c("s_gmt_offset") == gmt), "ss_store_sk", "s_store_sk"))
    return rows.groupBy("s_store_name", "s_store_id").agg(
        *[sum_if(c("d_day_name") == d, "ss_sales_price").alias(f"{d[:3].lower()}_sales") for d in DAY_NAMES])


@query("q44", "rnk:i best_performing worst_performing", "rnk", 100)
def q44(t, store=4, null_col="ss_addr_sk"):
    allowed(null_col, "ss_customer_sk ss_cdemo_sk ss_hdemo_sk ss_addr_sk ss_promo_sk")
    here = t.store_sales.filter(c("ss_store_sk") == store)
    bar = here.filter(c(null_col).isNull()).agg((avg("ss_net_profit") * 0.9).alias("bar"))
    items = with_scalar(here.groupBy("ss_item_sk").agg(avg("ss_net_profit").alias("profit")), bar)
    items = items.filter("profit > bar").select("ss_item_sk", "profit")
    up = star(lowest(items, "profit", 10, name="rnk"), (t.item, "ss_item_sk", "i_item_sk"))
    down = star(lowest(items, "profit", 10, descending=True, name="rnk2"), (t.item, "ss_item_sk", "i_item_sk"))
    return (pick(up, "rnk", best_performing="i_product_name")
            .join(pick(down, "rnk2", worst_performing="i_product_name"), c("rnk") == c("rnk2")))


@query("q45", "ca_zip place sum_sales_price:n", "ca_zip place", 100)
def q45(t, gbobc="ca_city", year=1999, qoy=2):
    allowed(gbobc, "ca_city ca_county ca_state")
    zips = ["85669", "86197", "88274", "83405", "86475", "85392", "85460", "80348", "81792"]
    ids = (t.item.filter(c("i_item_sk").isin(2, 3, 5, 7, 11, 13, 17, 19, 23, 29))
           .select(c("i_item_id").alias("listed")).distinct())
    items = t.item.join(ids, c("i_item_id") == c("listed"), "left")
    dates = t.date_dim.filter((c("d_qoy") == qoy) & (c("d_year") == year))
    return (star(t.web_sales, (dates, "ws_sold_date_sk", "d_date_sk"), (items, "ws_item_sk", "i_item_sk"),
                 (t.customer, "ws_bill_customer_sk", "c_customer_sk"),
                 (t.customer_address, "c_current_addr_sk", "ca_address_sk"))
            .filter(F.substring("ca_zip", 1, 5).isin(*zips) | c("listed").isNotNull())
            .groupBy("ca_zip", c(gbobc).alias("place")).agg(F.sum("ws_sales_price").alias("sum_sales_price")))
