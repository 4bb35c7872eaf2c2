"""Decision-support queries 1 to 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from starling.functions.exact import avg, moments, ratio, stddev_of_moments, sum_if
from starling.operators.relational import (matching, pick, role, rollup_avg, rollup_of, star,
                                           union_all, with_group, with_scalar)
from starling.plans.base import allowed, query
from starling.plans.star import COUNTIES, DAY_NAMES, STATES, ZIPS

c = F.col


def over_group_average(totals, group: str, value: str, factor: float = 1.2):
    """Rows whose value exceeds ``factor`` times their group's average (null groups drop out)."""
    mean = totals.groupBy(c(group).alias("_grp")).agg((avg(value) * factor).alias("_bar"))
    return (totals.join(mean, c(group) == c("_grp"))
            .filter(c(value).cast("double") > c("_bar")).drop("_grp", "_bar"))


@query("q01", "c_customer_id", "c_customer_id", 100)
def q01(t, year=1999, state="TN", agg_field="sr_return_amt"):
    allowed(agg_field, "sr_return_amt sr_fee sr_refunded_cash sr_return_amt_inc_tax "
                       "sr_reversed_charge sr_store_credit sr_return_tax")
    totals = (star(t.store_returns, (t.date_dim.filter(c("d_year") == year),
                                     "sr_returned_date_sk", "d_date_sk"))
              .groupBy("sr_customer_sk", "sr_store_sk").agg(F.sum(agg_field).alias("total")))
    return star(over_group_average(totals, "sr_store_sk", "total"),
                (t.store.filter(c("s_state") == state), "sr_store_sk", "s_store_sk"),
                (t.customer, "sr_customer_sk", "c_customer_sk"))


def weekly_by_day(sales, dates, price, *keys):
    """One sum per weekday, by week and ``keys``."""
    return (sales.groupBy("d_week_seq", *keys)
            .agg(*[sum_if(c("d_day_name") == d, price).alias(d[:3].lower()) for d in DAY_NAMES]))


DAYS = [d[:3].lower() for d in DAY_NAMES]


@query("q02", "d_week_seq1:i " + " ".join(f"{d}_ratio:n" for d in DAYS), "d_week_seq1")
def q02(t, year=1999):
    sales = union_all(pick(t.web_sales, day="ws_sold_date_sk", price="ws_ext_sales_price"),
                      pick(t.catalog_sales, day="cs_sold_date_sk", price="cs_ext_sales_price"))
    # Sum by day first: the calendar join then sees at most one row per day.
    daily = sales.groupBy("day").agg(F.sum("price").alias("price"))
    weeks = weekly_by_day(star(daily, (t.date_dim, "day", "d_date_sk")), t.date_dim, "price")

    def of_year(y, mark):
        # One row per calendar day of the year, as the reference's join yields.
        days = t.date_dim.filter(c("d_year") == y).select(c("d_week_seq").alias("_w"))
        return role(weeks.join(days, c("d_week_seq") == c("_w")).drop("_w"), mark)

    both = of_year(year, "a_").join(of_year(year + 1, "b_"),
                                    c("a_d_week_seq") == c("b_d_week_seq") - 53)
    return both.select(c("a_d_week_seq").alias("d_week_seq1"), *[
        F.round(ratio(f"a_{d}", f"b_{d}"), 2).alias(f"{d}_ratio") for d in DAYS])


@query("q03", "d_year:i brand_id:i brand sum_agg:n", "d_year -sum_agg brand_id", 100)
def q03(t, month=11, manufact=16, aggc="ss_ext_sales_price"):
    allowed(aggc, "ss_ext_sales_price ss_sales_price ss_ext_discount_amt ss_net_profit")
    return (star(t.store_sales,
                 (t.date_dim.filter(c("d_moy") == month), "ss_sold_date_sk", "d_date_sk"),
                 (t.item.filter(c("i_manufact_id") == manufact), "ss_item_sk", "i_item_sk"))
            .groupBy("d_year", c("i_brand_id").alias("brand_id"), c("i_brand").alias("brand"))
            .agg(F.sum(aggc).alias("sum_agg")))


CUSTOMER_COLUMNS = ("c_customer_id c_first_name c_last_name c_preferred_cust_flag "
                    "c_birth_country c_login c_email_address").split()
SALES_OF = {"s": ("store_sales", "ss_customer_sk", "ss_sold_date_sk"),
            "c": ("catalog_sales", "cs_bill_customer_sk", "cs_sold_date_sk"),
            "w": ("web_sales", "ws_bill_customer_sk", "ws_sold_date_sk")}


def yearly_totals(t, year, measures, agg=F.sum):
    """Per customer, one column per channel and year (``s1``, ``s2``, ``w1`` ..).

    Channels are cut down to customer totals before any customer attribute is joined; the
    totals then pivot in one aggregation in place of a self join per channel and year.
    """
    parts = []
    for tag, measure in measures.items():
        table, who, day = SALES_OF[tag]
        days = t.date_dim.filter(c("d_year").isin(year, year + 1))
        parts.append(star(t[table], (days, day, "d_date_sk"))
                     .groupBy(c(who).alias("who"), c("d_year"))
                     .agg(agg(measure).alias("total")).withColumn("tag", F.lit(tag)))
    people = t.customer.select("c_customer_sk", *CUSTOMER_COLUMNS)
    return (star(union_all(*parts), (people, "who", "c_customer_sk")).groupBy(*CUSTOMER_COLUMNS)
            .agg(*[sum_if((c("tag") == tag) & (c("d_year") == year + i), "total").alias(f"{tag}{i + 1}")
                   for tag in measures for i in (0, 1)]))


CUSTOMER_CHOICE = "c_preferred_cust_flag c_birth_country c_login c_email_address"


@query("q04", "customer_id customer_first_name customer_last_name choice",
       "customer_id customer_first_name customer_last_name choice", 100)
def q04(t, year=1998, select_one="c_preferred_cust_flag"):
    allowed(select_one, CUSTOMER_CHOICE)
    margin = {tag: (c(f"{p}_ext_list_price") - c(f"{p}_ext_wholesale_cost")
                    - c(f"{p}_ext_discount_amt") + c(f"{p}_ext_sales_price"))
              for tag, p in (("s", "ss"), ("c", "cs"), ("w", "ws"))}
    y = yearly_totals(t, year, margin).filter("s1 > 0 and c1 > 0 and w1 > 0")
    return pick(y.filter((ratio("c2", "c1") > ratio("s2", "s1"))
                         & (ratio("c2", "c1") > ratio("w2", "w1"))),
                customer_id="c_customer_id", customer_first_name="c_first_name",
                customer_last_name="c_last_name", choice=select_one)


def sales_and_returns(sales, returns, dates, outlet, key, ident):
    """Sales, profit, returns and loss of one channel by outlet within the given dates."""
    zero = F.lit(0).cast("decimal(12,2)")
    s = sales.select("outlet", "day", "sales", "profit",
                     zero.alias("returns"), zero.alias("loss"))
    r = returns.select("outlet", "day", zero.alias("sales"), zero.alias("profit"),
                       "returns", "loss")
    rows = union_all(*[star(x, (dates, "day", "d_date_sk")) for x in (s, r)])
    by_key = rows.groupBy("outlet").agg(*[F.sum(m).alias(m) for m in
                                          ("sales", "profit", "returns", "loss")])
    return (star(by_key, (outlet, "outlet", key)).groupBy(c(ident).alias("id"))
            .agg(*[F.sum(m).alias(m) for m in ("sales", "profit", "returns", "loss")]))


def window_of_days(t, start: str, days: int):
    """Calendar rows of ``start`` and the given number of days after it."""
    first = F.to_date(F.lit(start))
    return t.date_dim.filter(c("d_date").between(first, F.date_add(first, days)))


def channel_rollup(*channels):
    """Sales, returns and profit rolled up by channel and outlet."""
    return rollup_of(union_all(*channels), ["channel", "id"],
                     {m: c(m) for m in ("sales", "returns", "profit")})


CHANNEL_COLUMNS = "channel id sales:n returns:n profit:n"


@query("q05", CHANNEL_COLUMNS, "channel id", 100)
def q05(t, sales_date="1999-08-04"):
    dates = window_of_days(t, sales_date, 14).select("d_date_sk")
    store = sales_and_returns(
        pick(t.store_sales, outlet="ss_store_sk", day="ss_sold_date_sk",
             sales="ss_ext_sales_price", profit="ss_net_profit"),
        pick(t.store_returns, outlet="sr_store_sk", day="sr_returned_date_sk",
             returns="sr_return_amt", loss="sr_net_loss"), dates, t.store, "s_store_sk", "s_store_id")
    catalog = sales_and_returns(
        pick(t.catalog_sales, outlet="cs_catalog_page_sk", day="cs_sold_date_sk",
             sales="cs_ext_sales_price", profit="cs_net_profit"),
        pick(t.catalog_returns, outlet="cr_catalog_page_sk", day="cr_returned_date_sk",
             returns="cr_return_amount", loss="cr_net_loss"),
        dates, t.catalog_page, "cp_catalog_page_sk", "cp_catalog_page_id")
    # A web return carries no site: look it up on its sale, after the date filter.
    returned = matching(t.web_returns, dates, ("wr_returned_date_sk", "d_date_sk"))
    sited = returned.join(t.web_sales, (c("wr_item_sk") == c("ws_item_sk"))
                          & (c("wr_order_number") == c("ws_order_number")), "left")
    web = sales_and_returns(
        pick(t.web_sales, outlet="ws_web_site_sk", day="ws_sold_date_sk",
             sales="ws_ext_sales_price", profit="ws_net_profit"),
        pick(sited, outlet="ws_web_site_sk", day="wr_returned_date_sk",
             returns="wr_return_amt", loss="wr_net_loss"),
        dates, t.web_site, "web_site_sk", "web_site_id")

    def tagged(df, channel, prefix):
        return df.select(F.lit(channel).alias("channel"), F.concat(F.lit(prefix), "id").alias("id"),
                         "sales", "returns", (c("profit") - c("loss")).alias("profit"))

    return channel_rollup(tagged(store, "store channel", "store"),
                          tagged(catalog, "catalog channel", "catalog_page"),
                          tagged(web, "web channel", "web_site"))


@query("q06", "state cnt:i", "cnt state", 100)
def q06(t, year=1999, month=3):
    seq = t.date_dim.filter((c("d_year") == year) & (c("d_moy") == month))
    dates = matching(t.date_dim, seq, ("d_month_seq", "d_month_seq"))
    bar = t.item.groupBy(c("i_category").alias("cat")).agg((avg("i_current_price") * 1.2).alias("bar"))
    dear = (t.item.join(bar, c("i_category") == c("cat"))
            .filter(c("i_current_price").cast("double") > c("bar")))
    return (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (dear, "ss_item_sk", "i_item_sk"),
                 (t.customer, "ss_customer_sk", "c_customer_sk"),
                 (t.customer_address, "c_current_addr_sk", "ca_address_sk"))
            .groupBy(c("ca_state").alias("state")).agg(F.count(F.lit(1)).alias("cnt"))
            .filter("cnt >= 10"))


def demographic_averages(t, sales, p, gender, marital, education, year):
    """Average quantity and prices per item for one demographic, without email/event promotions."""
    people = t.customer_demographics.filter(
        (c("cd_gender") == gender) & (c("cd_marital_status") == marital)
        & (c("cd_education_status") == education))
    promos = t.promotion.filter("p_channel_email = 'N' or p_channel_event = 'N'")
    who = "ss_cdemo_sk" if p == "ss" else f"{p}_bill_cdemo_sk"
    return (star(sales, (people, who, "cd_demo_sk"),
                 (t.date_dim.filter(c("d_year") == year), f"{p}_sold_date_sk", "d_date_sk"),
                 (promos, f"{p}_promo_sk", "p_promo_sk"), (t.item, f"{p}_item_sk", "i_item_sk"))
            .groupBy("i_item_id")
            .agg(*[avg(f"{p}_{m}").alias(f"agg{i + 1}") for i, m in
                   enumerate(("quantity", "list_price", "coupon_amt", "sales_price"))]))


@query("q07", "i_item_id agg1:n agg2:n agg3:n agg4:n", "i_item_id", 100)
def q07(t, gender="M", marital="S", education="College", year=1999):
    return demographic_averages(t, t.store_sales, "ss", gender, marital, education, year)


@query("q08", "s_store_name net_profit:n", "s_store_name", 100)
def q08(t, year=1999, qoy=2, zips=tuple(ZIPS[:14])):
    prefix = F.substring("ca_zip", 1, 5)
    listed = t.customer_address.select(prefix.alias("zip")).filter(c("zip").isin(*zips))
    preferred = (star(t.customer.filter("c_preferred_cust_flag = 'Y'"),
                      (t.customer_address, "c_current_addr_sk", "ca_address_sk"))
                 .groupBy(prefix.alias("zip")).agg(F.count(F.lit(1)).alias("n")).filter("n > 10"))
    # Each store row counts once per matching zip: carry the multiplicity, not the copies.
    regions = (listed.intersect(preferred.select("zip"))
               .groupBy(F.substring("zip", 1, 2).alias("region")).agg(F.count(F.lit(1)).alias("times")))
    stores = t.store.join(regions, F.substring("s_zip", 1, 2) == c("region"))
    dates = t.date_dim.filter((c("d_qoy") == qoy) & (c("d_year") == year))
    return (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (stores, "ss_store_sk", "s_store_sk"))
            .groupBy("s_store_name").agg(F.sum(c("ss_net_profit") * c("times")).alias("net_profit")))


BUCKETS = [(1, 20), (21, 40), (41, 60), (61, 80), (81, 100)]


@query("q09", " ".join(f"bucket{i}:n" for i in range(1, 6)))
def q09(t, agg_then="ss_ext_discount_amt", agg_else="ss_net_paid",
        rc=(9000, 10000, 9000, 10000, 9000)):
    allowed(agg_then, "ss_ext_discount_amt ss_ext_sales_price ss_ext_list_price ss_ext_tax")
    allowed(agg_else, "ss_net_paid ss_net_paid_inc_tax ss_net_profit")
    cells = []
    for i, (lo, hi) in enumerate(BUCKETS, 1):
        inside = c("ss_quantity").between(lo, hi)
        cells.append(F.when(F.count_if(inside) > rc[i - 1], avg(F.when(inside, c(agg_then))))
                     .otherwise(avg(F.when(inside, c(agg_else)))).alias(f"bucket{i}"))
    # One scan; the reason row only fixes the number of output rows.
    return with_scalar(t.reason.filter("r_reason_sk = 1"), t.store_sales.agg(*cells))


def buyers(t, table, who, day, dates):
    return pick(star(t[table], (dates, day, "d_date_sk")), who=who)


DEMOGRAPHY = ("cd_gender cd_marital_status cd_education_status cd_purchase_estimate "
              "cd_credit_rating cd_dep_count cd_dep_employed_count cd_dep_college_count").split()


@query("q10", "cd_gender cd_marital_status cd_education_status cnt1:i cd_purchase_estimate:i cnt2:i "
       "cd_credit_rating cnt3:i cd_dep_count:i cnt4:i cd_dep_employed_count:i cnt5:i "
       "cd_dep_college_count:i cnt6:i", " ".join(DEMOGRAPHY), 100)
def q10(t, counties=tuple(COUNTIES[:5]), month=1, year=1999):
    dates = t.date_dim.filter((c("d_year") == year) & c("d_moy").between(month, month + 3))
    in_store = buyers(t, "store_sales", "ss_customer_sk", "ss_sold_date_sk", dates)
    # "exists web or exists catalog" is membership in the union of both key sets.
    remote = union_all(buyers(t, "web_sales", "ws_bill_customer_sk", "ws_sold_date_sk", dates),
                       buyers(t, "catalog_sales", "cs_ship_customer_sk", "cs_sold_date_sk", dates))
    people = star(t.customer, (t.customer_address.filter(c("ca_county").isin(*counties)),
                               "c_current_addr_sk", "ca_address_sk"))
    people = matching(matching(people, in_store, ("c_customer_sk", "who")),
                      remote, ("c_customer_sk", "who"))
    n = F.count(F.lit(1))
    return (star(people, (t.customer_demographics, "c_current_cdemo_sk", "cd_demo_sk"))
            .groupBy(*DEMOGRAPHY).agg(*[n.alias(f"cnt{i}") for i in range(1, 7)]))


@query("q11", "customer_id customer_first_name customer_last_name choice",
       "customer_id customer_first_name customer_last_name choice", 100)
def q11(t, year=1998, select_one="c_email_address"):
    allowed(select_one, CUSTOMER_CHOICE)
    paid = {"s": c("ss_ext_list_price") - c("ss_ext_discount_amt"),
            "w": c("ws_ext_list_price") - c("ws_ext_discount_amt")}
    y = yearly_totals(t, year, paid).filter("s1 > 0 and w1 > 0")
    return pick(y.filter(ratio("w2", "w1") > ratio("s2", "s1")),
                customer_id="c_customer_id", customer_first_name="c_first_name",
                customer_last_name="c_last_name", choice=select_one)


SHARE_COLUMNS = "i_item_id i_item_desc i_category i_class i_current_price:n itemrevenue:n revenueratio:n"
SHARE_ORDER = "i_category i_class i_item_id i_item_desc revenueratio"


def class_share(t, sales, p, start, categories):
    """Item revenue within 30 days and its percentage of the class revenue."""
    revenue = (star(sales, (window_of_days(t, start, 30), f"{p}_sold_date_sk", "d_date_sk"),
                    (t.item.filter(c("i_category").isin(*categories)), f"{p}_item_sk", "i_item_sk"))
               .groupBy("i_item_id", "i_item_desc", "i_category", "i_class", "i_current_price")
               .agg(F.sum(f"{p}_ext_sales_price").alias("itemrevenue")))
    return (with_group(revenue, ["i_class"], total=F.sum("itemrevenue"))
            .withColumn("revenueratio", ratio(c("itemrevenue") * 100, "total")))


@query("q12", SHARE_COLUMNS, SHARE_ORDER, 100)
def q12(t, sdate="1999-02-22", categories=("Sports", "Books", "Home")):
    return class_share(t, t.web_sales, "ws", sdate, categories)


@query("q13", "avg_quantity:n avg_ext_sales_price:n avg_ext_wholesale_cost:n sum_ext_wholesale_cost:n")
def q13(t, marital=("M", "S", "W"), education=("Advanced Degree", "College", "2 yr Degree"),
        states=tuple(STATES[:9]), year=2001):
    people = t.customer_demographics.filter(c("cd_marital_status").isin(*marital))
    # The keys are common to every branch of the reference's OR, so they join as plain equalities
    # and the branches stay behind as a filter.
    rows = star(t.store_sales, (t.date_dim.filter(c("d_year") == year), "ss_sold_date_sk", "d_date_sk"),
                (t.store, "ss_store_sk", "s_store_sk"), (people, "ss_cdemo_sk", "cd_demo_sk"),
                (t.household_demographics.filter("hd_dep_count in (1, 3)"), "ss_hdemo_sk", "hd_demo_sk"),
                (t.customer_address.filter("ca_country = 'United States'"), "ss_addr_sk", "ca_address_sk"))

    def person(i, lo, hi, deps):
        return ((c("cd_marital_status") == marital[i]) & (c("cd_education_status") == education[i])
                & c("ss_sales_price").between(lo, hi) & (c("hd_dep_count") == deps))

    def place(i, lo, hi):
        return c("ca_state").isin(*states[3 * i:3 * i + 3]) & c("ss_net_profit").between(lo, hi)

    return (rows.filter(person(0, 100, 150, 3) | person(1, 50, 100, 1) | person(2, 150, 200, 1))
            .filter(place(0, 100, 200) | place(1, 150, 300) | place(2, 50, 250))
            .agg(avg("ss_quantity").alias("avg_quantity"),
                 avg("ss_ext_sales_price").alias("avg_ext_sales_price"),
                 avg("ss_ext_wholesale_cost").alias("avg_ext_wholesale_cost"),
                 F.sum("ss_ext_wholesale_cost").alias("sum_ext_wholesale_cost")))


LINE = ["i_brand_id", "i_class_id", "i_category_id"]
LINES_OF = {"store": ("store_sales", "ss"), "catalog": ("catalog_sales", "cs"), "web": ("web_sales", "ws")}


def line_sales(t, year, **periods):
    """Per channel and product line: sales value and rows with one over three years, and sales and rows of each period.

    ``periods`` names sets of days.  Every channel is read once, for the years and all periods
    together, and summed by item before any item attribute is joined; an item without a product
    line stays, as it counts in the average.
    """
    spans = {"years": t.date_dim.filter(c("d_year").between(year, year + 2)), **periods}
    days = (union_all(*[days.select("d_date_sk", F.lit(name).alias("span")) for name, days in spans.items()])
            .groupBy("d_date_sk").agg(*[F.max(c("span") == name).alias(f"in_{name}") for name in spans]))
    parts = []
    for channel, (table, p) in LINES_OF.items():
        worth = c(f"{p}_quantity") * c(f"{p}_list_price")
        sums = [F.max("in_years").alias("in_years"), F.count(F.when(c("in_years"), worth)).alias("valued")]
        for name in spans:
            sums += [F.sum(F.when(c(f"in_{name}"), worth)).alias(f"{name}_sales"),
                     F.count(F.when(c(f"in_{name}"), 1)).alias(f"{name}_rows")]
        parts.append(star(t[table], (days, f"{p}_sold_date_sk", "d_date_sk"))
                     .groupBy(c(f"{p}_item_sk").alias("item")).agg(*sums).withColumn("channel", F.lit(channel)))
    stacked = union_all(*parts).join(t.item.select("i_item_sk", *LINE), c("item") == c("i_item_sk"), "left")
    return stacked.groupBy("channel", *LINE).agg(
        F.max("in_years").alias("in_years"), *[F.sum(x).alias(x) for x in ("valued", *[f"{n}_{k}" for n in spans for k in ("sales", "rows")])])


def big_lines(t, year, **periods):
    """Product lines sold in all three channels over three years, per period those whose sales in
    it exceed the average sale of those years.

    "In every channel" and the average come from the same grouping, which is small and kept.
    """
    lines = line_sales(t, year, **periods).checkpoint()
    mean = lines.agg(ratio(F.sum("years_sales"), F.sum("valued")).alias("average_sales"))
    shared = (lines.filter("in_years").groupBy(*LINE).agg(F.count(F.lit(1)).alias("channels"))
              .filter(c("channels") == len(LINES_OF)))
    found = with_scalar(matching(lines, shared, *[(k, k) for k in LINE]), mean)
    return {name: found.filter(c(f"{name}_sales").cast("double") > c("average_sales")).select(
        "channel", *LINE, c(f"{name}_sales").alias("sales"), c(f"{name}_rows").alias("number_sales")) for name in periods}


@query("q14", "channel i_brand_id:i i_class_id:i i_category_id:i sales:n number_sales:i",
       "channel i_brand_id i_class_id i_category_id", 100)
def q14(t, year=1998):
    month = t.date_dim.filter((c("d_year") == year + 2) & (c("d_moy") == 11))
    return rollup_of(big_lines(t, year, month=month)["month"], ["channel"] + LINE,
                     {"sales": c("sales"), "number_sales": c("number_sales")})


@query("q14_weeks", "channel i_brand_id:i i_class_id:i i_category_id:i sales:n number_sales:i "
       "last_sales:n last_number_sales:i", "channel i_brand_id i_class_id i_category_id", 100)
def q14_weeks(t, year=1998, day=11):
    """Second statement of q14: the same December week in two successive years, in the stores."""
    def week_of(y):
        week = t.date_dim.filter((c("d_year") == y) & (c("d_moy") == 12) & (c("d_dom") == day))
        return matching(t.date_dim, week, ("d_week_seq", "d_week_seq"))

    found = big_lines(t, year, last=week_of(year), this=week_of(year + 1))
    this, last = (found[name].filter("channel = 'store'") for name in ("this", "last"))
    return this.join(role(last, "last_"), [c(k) == c(f"last_{k}") for k in LINE])


@query("q15", "ca_zip sum_sales_price:n", "ca_zip", 100)
def q15(t, year=1999, qoy=2):
    zips = ["85669", "86197", "88274", "83405", "86475", "85392", "85460", "80348", "81792"]
    dates = t.date_dim.filter((c("d_qoy") == qoy) & (c("d_year") == year))
    return (star(t.catalog_sales, (dates, "cs_sold_date_sk", "d_date_sk"),
                 (t.customer, "cs_bill_customer_sk", "c_customer_sk"),
                 (t.customer_address, "c_current_addr_sk", "ca_address_sk"))
            .filter(F.substring("ca_zip", 1, 5).isin(*zips) | c("ca_state").isin("CA", "WA", "GA")
                    | (c("cs_sales_price") > 500))
            .groupBy("ca_zip").agg(F.sum("cs_sales_price").alias("sum_sales_price")))


def many_warehouses(sales, p):
    """Orders shipped from more than one warehouse.

    "Another row of the order with a different warehouse" holds exactly when the order's smallest
    and largest warehouse differ, so no pair of rows is ever built.
    """
    return (sales.groupBy(c(f"{p}_order_number").alias("order_no"))
            .agg(F.min(f"{p}_warehouse_sk").alias("lo"), F.max(f"{p}_warehouse_sk").alias("hi"))
            .filter("lo < hi").select("order_no"))


def order_summary(rows, p):
    return rows.agg(F.countDistinct(f"{p}_order_number").alias("order_count"),
                    F.sum(f"{p}_ext_ship_cost").alias("total_shipping_cost"),
                    F.sum(f"{p}_net_profit").alias("total_net_profit"))


ORDER_COLUMNS = "order_count:i total_shipping_cost:n total_net_profit:n"


@query("q16", ORDER_COLUMNS, "order_count", 100)
def q16(t, year=1999, month=2, state="GA", counties=tuple(COUNTIES[:5])):
    rows = star(t.catalog_sales.filter("cs_warehouse_sk is not null"),
                (window_of_days(t, f"{year}-{month:02d}-01", 60), "cs_ship_date_sk", "d_date_sk"),
                (t.customer_address.filter(c("ca_state") == state), "cs_ship_addr_sk", "ca_address_sk"),
                (t.call_center.filter(c("cc_county").isin(*counties)), "cs_call_center_sk", "cc_call_center_sk"))
    rows = matching(rows, many_warehouses(t.catalog_sales, "cs"), ("cs_order_number", "order_no"))
    rows = matching(rows, t.catalog_returns, ("cs_order_number", "cr_order_number"), how="left_anti")
    return order_summary(rows, "cs")


def sold_and_returned(t, sold_dates, returned_dates):
    """Store sales joined to their own return, with both dates restricted."""
    ss = star(t.store_sales, (sold_dates.select("d_date_sk"), "ss_sold_date_sk", "d_date_sk")).drop("d_date_sk")
    sr = star(t.store_returns, (returned_dates.select("d_date_sk"), "sr_returned_date_sk", "d_date_sk")).drop("d_date_sk")
    return ss.join(sr, (c("ss_ticket_number") == c("sr_ticket_number"))
                   & (c("ss_item_sk") == c("sr_item_sk")) & (c("ss_customer_sk") == c("sr_customer_sk")))


def rebuy_chain(t, sold, returned, bought, keys, **measures):
    """Moments, minimum and maximum over sale -> own return -> catalog sale of the same customer
    and item.

    Both sides shrink to moments per customer and item, and each side's moments are weighted by
    the other side's row count: the matching pairs are counted without being formed.
    """
    sides = {"store_sales": "right", "store_returns": "right", "catalog_sales": "left"}

    def parts(name):
        x = measures[name]
        return moments(x, name) + [F.min(x).alias(f"min_{name}"), F.max(x).alias(f"max_{name}")]

    chain = (sold_and_returned(t, sold, returned)
             .groupBy("ss_customer_sk", "ss_item_sk", "ss_store_sk")
             .agg(F.count(F.lit(1)).alias("left"), *parts("store_sales"), *parts("store_returns")))
    again = (star(t.catalog_sales, (bought.select("d_date_sk"), "cs_sold_date_sk", "d_date_sk"))
             .groupBy("cs_bill_customer_sk", "cs_item_sk")
             .agg(F.count(F.lit(1)).alias("right"), *parts("catalog_sales")))
    both = chain.join(again, (c("ss_customer_sk") == c("cs_bill_customer_sk"))
                      & (c("ss_item_sk") == c("cs_item_sk")))
    out = [F.sum(c(f"{m}_{n}") * c(w)).alias(f"{m}_{n}") for n, w in sides.items() for m in "nsq"]
    out += [f(f"{f.__name__}_{n}").alias(f"{f.__name__}_{n}") for n in sides for f in (F.min, F.max)]
    return (star(both, (t.item, "ss_item_sk", "i_item_sk"), (t.store, "ss_store_sk", "s_store_sk"))
            .groupBy(*keys).agg(*out))


@query("q17", "i_item_id i_item_desc s_state " + " ".join(
    f"{n}_count:i {n}_ave:n {n}_stdev:n {n}_cov:n" for n in ("store_sales", "store_returns", "catalog_sales")),
       "i_item_id i_item_desc s_state", 100)
def q17(t, year=1999):
    quarters = [f"{year}Q{i}" for i in (1, 2, 3)]
    first = t.date_dim.filter(c("d_quarter_name") == quarters[0])
    three = t.date_dim.filter(c("d_quarter_name").isin(*quarters))
    out = rebuy_chain(t, first, three, three, ["i_item_id", "i_item_desc", "s_state"],
                      store_sales="ss_quantity", store_returns="sr_return_quantity",
                      catalog_sales="cs_quantity")
    for n in ("store_sales", "store_returns", "catalog_sales"):
        mean, dev = ratio(f"s_{n}", f"n_{n}"), stddev_of_moments(n)
        out = out.withColumns({f"{n}_count": c(f"n_{n}"), f"{n}_ave": mean, f"{n}_stdev": F.round(dev, 4),
                               f"{n}_cov": F.round(F.try_divide(dev, mean), 4)})
    return out


def q18_rows(t, year, gender, education, states, months):
    people = t.customer_demographics.filter((c("cd_gender") == gender)
                                            & (c("cd_education_status") == education))
    return star(t.catalog_sales, (t.date_dim.filter(c("d_year") == year), "cs_sold_date_sk", "d_date_sk"),
                (people, "cs_bill_cdemo_sk", "cd_demo_sk"),
                (t.customer.filter(c("c_birth_month").isin(*months)), "cs_bill_customer_sk", "c_customer_sk"),
                (pick(t.customer_demographics, own_demo="cd_demo_sk"), "c_current_cdemo_sk", "own_demo"),
                (t.customer_address.filter(c("ca_state").isin(*states)), "c_current_addr_sk", "ca_address_sk"),
                (t.item, "cs_item_sk", "i_item_sk"))


Q18_VALUES = ["cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit",
              "c_birth_year", "cd_dep_count"]
Q18_KEYS = ["i_item_id", "ca_country", "ca_state", "ca_county"]
Q18_COLUMNS = "i_item_id ca_country ca_state ca_county " + " ".join(f"agg{i}:n" for i in range(1, 8))
Q18_ORDER = "ca_country ca_state ca_county i_item_id"


@query("q18", Q18_COLUMNS, Q18_ORDER, 100)
def q18(t, year=1999, gender="M", education="College", states=tuple(STATES[:7]), months=(1, 3, 5, 7, 9, 11)):
    return rollup_avg(q18_rows(t, year, gender, education, states, months), Q18_KEYS,
                      {f"agg{i + 1}": c(v).cast("decimal(12,2)") for i, v in enumerate(Q18_VALUES)})


@query("q19", "brand_id:i brand i_manufact_id:i i_manufact ext_price:n",
       "-ext_price brand brand_id i_manufact_id i_manufact", 100)
def q19(t, year=1999, month=11, manager=8):
    dates = t.date_dim.filter((c("d_moy") == month) & (c("d_year") == year))
    return (star(t.store_sales, (dates, "ss_sold_date_sk", "d_date_sk"),
                 (t.item.filter(c("i_manager_id") == manager), "ss_item_sk", "i_item_sk"),
                 (t.store, "ss_store_sk", "s_store_sk"), (t.customer, "ss_customer_sk", "c_customer_sk"),
                 (t.customer_address, "c_current_addr_sk", "ca_address_sk"))
            .filter(F.substring("ca_zip", 1, 5) != F.substring("s_zip", 1, 5))
            .groupBy(c("i_brand_id").alias("brand_id"), c("i_brand").alias("brand"),
                     "i_manufact_id", "i_manufact")
            .agg(F.sum("ss_ext_sales_price").alias("ext_price")))


@query("q20", SHARE_COLUMNS, SHARE_ORDER, 100)
def q20(t, sdate="1999-02-22", categories=("Sports", "Books", "Home")):
    return class_share(t, t.catalog_sales, "cs", sdate, categories)
