"""Data maintenance: build fact increments and dimension updates, and apply them.

Refresh tables arrive with business keys and text dates.  Fact increments look the surrogate
keys up; type-1 dimensions are overwritten by business key; type-2 dimensions close the current
row and gain a new one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starling.operators.ranking import surrogate_keys
from starling.operators.relational import pick, role, star, union_all
from starling.plans.base import query
from starling.plans.increments import COPIES, Increments, Refused
from starling.plans.warehouse import lazily, shuffles_dropped

c = F.col
TODAY = "2002-06-30"  # date of the maintenance run in the registered jobs


# ---- fact increments -------------------------------------------------------------------------

def day_of(text: str) -> Column:
    """Date of a text column; lost dates, written as a year before the calendar or empty, are null."""
    x = c(text)
    return F.to_date(F.when(x.contains("-47") | (F.trim(x) == ""), None).otherwise(F.substring(x, 1, 10)), "yyyy-MM-dd")


def seconds_of(text: str) -> Column:
    """Seconds since midnight of ``hh:mm:ss``."""
    h, m, s = (F.substring(text, at, 2).cast("int") for at in (1, 4, 7))
    return h * 3600 + m * 60 + s


def look_up(rows: DataFrame, dim: DataFrame, key: Column | str, ident: str, mark: str, *attributes: str,
            current: str | None = None) -> DataFrame:
    """Left join a dimension by business key, its columns under ``mark``.

    With ``current``, rows that found only closed versions drop out and rows that found nothing
    stay, as an outer join followed by "end date is null" leaves them.
    """
    dim = role(dim.select(*dict.fromkeys([ident, *attributes, *([current] if current else [])])), mark)
    out = rows.join(dim, (c(key) if isinstance(key, str) else key) == c(mark + ident), "left")
    return out.filter(c(mark + current).isNull()) if current else out


def customer_keys(rows, t, key, mark):
    return look_up(rows, t.customer, key, "c_customer_id", mark, "c_customer_sk", "c_current_cdemo_sk",
                   "c_current_hdemo_sk", "c_current_addr_sk")


ITEM = ("i_item_sk", "i_wholesale_cost", "i_current_price")


def item_keys(rows, t, key):
    return look_up(rows, t.item, key, "i_item_id", "i_", *ITEM, current="i_rec_end_date")


def sale_columns(p: str, price: str, qty: str, coupon: str, tax: str) -> dict[str, Column]:
    """Money columns that every sales increment derives alike."""
    listed, cost = c("i_i_current_price"), c("i_i_wholesale_cost")
    paid = c(price) * c(qty) - c(coupon)
    return {f"{p}_quantity": c(qty), f"{p}_wholesale_cost": cost, f"{p}_list_price": listed,
            f"{p}_sales_price": c(price), f"{p}_ext_discount_amt": (listed - c(price)) * c(qty),
            f"{p}_ext_sales_price": c(price) * c(qty), f"{p}_ext_wholesale_cost": cost * c(qty),
            f"{p}_ext_list_price": listed * c(qty), f"{p}_ext_tax": listed * c(tax), f"{p}_coupon_amt": c(coupon),
            f"{p}_net_paid": paid, f"{p}_net_paid_inc_tax": paid * (1 + c(tax)),
            f"{p}_net_profit": paid - c(qty) * cost}


def store_sales_increment(t) -> DataFrame:
    heads = customer_keys(t.s_purchase, t, "purc_customer_id", "c_")
    heads = look_up(heads, t.store, "purc_store_id", "s_store_id", "s_", "s_store_sk", "s_tax_precentage",
                    current="s_rec_end_date")
    heads = look_up(heads, t.date_dim, day_of("purc_purchase_date"), "d_date", "d_", "d_date_sk")
    heads = look_up(heads, t.time_dim, "purc_purchase_time", "t_time", "t_", "t_time_sk")
    rows = look_up(t.s_purchase_lineitem, t.promotion, "plin_promotion_id", "p_promo_id", "p_", "p_promo_sk")
    rows = item_keys(rows, t, "plin_item_id").join(heads, c("purc_purchase_id") == c("plin_purchase_id"))
    return rows.select(*[v.alias(k) for k, v in {
        "ss_sold_date_sk": c("d_d_date_sk"), "ss_sold_time_sk": c("t_t_time_sk"), "ss_item_sk": c("i_i_item_sk"),
        "ss_customer_sk": c("c_c_customer_sk"), "ss_cdemo_sk": c("c_c_current_cdemo_sk"),
        "ss_hdemo_sk": c("c_c_current_hdemo_sk"), "ss_addr_sk": c("c_c_current_addr_sk"),
        "ss_store_sk": c("s_s_store_sk"), "ss_promo_sk": c("p_p_promo_sk"), "ss_ticket_number": c("purc_purchase_id"),
        **sale_columns("ss", "plin_sale_price", "plin_quantity", "plin_coupon_amt", "s_s_tax_precentage")}.items()])


def remote_heads(t, orders, p, outlet, ident, sk, tax, end):
    """Order headers of catalog or web with bill and ship customers, outlet, mode, day and time."""
    heads = customer_keys(customer_keys(orders, t, f"{p}_bill_customer_id", "b_"), t, f"{p}_ship_customer_id", "h_")
    heads = look_up(heads, outlet, f"{p}_{'call_center' if p == 'cord' else 'web_site'}_id", ident, "o_", sk, tax, current=end)
    heads = look_up(heads, t.ship_mode, f"{p}_ship_mode_id", "sm_ship_mode_id", "m_", "sm_ship_mode_sk")
    heads = look_up(heads, t.date_dim, day_of(f"{p}_order_date"), "d_date", "d_", "d_date_sk")
    return look_up(heads, t.time_dim, f"{p}_order_time", "t_time", "t_", "t_time_sk")


def remote_lines(t, lines, p):
    rows = item_keys(look_up(lines, t.date_dim, day_of(f"{p}_ship_date"), "d_date", "e_", "d_date_sk"), t, f"{p}_item_id")
    rows = look_up(rows, t.warehouse, f"{p}_warehouse_id", "w_warehouse_id", "w_", "w_warehouse_sk")
    return look_up(rows, t.promotion, f"{p}_promotion_id", "p_promo_id", "p_", "p_promo_sk")


def remote_keys(p: str, order: str) -> dict[str, Column]:
    out = {f"{p}_sold_date_sk": c("d_d_date_sk"), f"{p}_sold_time_sk": c("t_t_time_sk"),
           f"{p}_ship_date_sk": c("e_d_date_sk"), f"{p}_item_sk": c("i_i_item_sk")}
    for who, mark in (("bill", "b_"), ("ship", "h_")):
        out |= {f"{p}_{who}_customer_sk": c(mark + "c_customer_sk"), f"{p}_{who}_cdemo_sk": c(mark + "c_current_cdemo_sk"),
                f"{p}_{who}_hdemo_sk": c(mark + "c_current_hdemo_sk"), f"{p}_{who}_addr_sk": c(mark + "c_current_addr_sk")}
    return out | {f"{p}_ship_mode_sk": c("m_sm_ship_mode_sk"), f"{p}_warehouse_sk": c("w_w_warehouse_sk"),
                  f"{p}_promo_sk": c("p_p_promo_sk"), f"{p}_order_number": c(order)}


def catalog_sales_increment(t) -> DataFrame:
    heads = remote_heads(t, t.s_catalog_order, "cord", t.call_center, "cc_call_center_id", "cc_call_center_sk",
                         "cc_tax_percentage", "cc_rec_end_date")
    pages = role(t.catalog_page.select("cp_catalog_page_sk", "cp_catalog_number", "cp_catalog_page_number"), "g_")
    rows = remote_lines(t, t.s_catalog_order_lineitem, "clin").join(
        pages, (c("clin_catalog_number") == c("g_cp_catalog_number"))
        & (c("clin_catalog_page_number") == c("g_cp_catalog_page_number")), "left")
    rows = rows.join(heads, c("cord_order_id") == c("clin_order_id"))
    money = sale_columns("cs", "clin_sales_price", "clin_quantity", "clin_coupon_amt", "o_cc_tax_percentage")
    shipping = c("clin_ship_cost") * c("clin_quantity")
    return rows.select(*[v.alias(k) for k, v in {
        **remote_keys("cs", "cord_order_id"), "cs_call_center_sk": c("o_cc_call_center_sk"),
        "cs_catalog_page_sk": c("g_cp_catalog_page_sk"), **money, "cs_ext_ship_cost": shipping,
        "cs_net_paid_inc_ship": money["cs_net_paid"] + shipping,
        "cs_net_paid_inc_ship_tax": money["cs_net_paid"] + shipping + money["cs_ext_tax"]}.items()])


def web_sales_increment(t) -> DataFrame:
    """As the catalog's.  The reference carries no web shipping cost and nets the wholesale cost
    from the amount paid with shipping; both are kept.  Page and site land in their own columns."""
    heads = remote_heads(t, t.s_web_order, "word", t.web_site, "web_site_id", "web_site_sk", "web_tax_percentage",
                         "web_rec_end_date")
    rows = look_up(remote_lines(t, t.s_web_order_lineitem, "wlin"), t.web_page, "wlin_web_page_id", "wp_web_page_id",
                   "g_", "wp_web_page_sk", current="wp_rec_end_date")
    rows = rows.join(heads, c("word_order_id") == c("wlin_order_id"))
    money = sale_columns("ws", "wlin_sales_price", "wlin_quantity", "wlin_coupon_amt", "o_web_tax_percentage")
    shipping = c("wlin_ship_cost") * c("wlin_quantity")
    return rows.select(*[v.alias(k) for k, v in {
        **remote_keys("ws", "word_order_id"), "ws_web_page_sk": c("g_wp_web_page_sk"), "ws_web_site_sk": c("o_web_site_sk"),
        **money, "ws_ext_ship_cost": F.lit(0).cast("decimal(7,2)"), "ws_net_paid_inc_ship": money["ws_net_profit"],
        "ws_net_paid_inc_ship_tax": money["ws_net_paid"] + shipping + money["ws_ext_tax"]}.items()])


def return_columns(p: str, s: str, amount: str, credit: str, source_credit: str) -> dict[str, Column]:
    amt, tax, fee = c(f"{s}_return_amt"), c(f"{s}_return_tax"), c(f"{s}_return_fee")
    back = c(f"{s}_refunded_cash") + c(f"{s}_reversed_charge") + c(f"{s}_{source_credit}")
    return {f"{p}_return_quantity": c(f"{s}_return_qty"), f"{p}_{amount}": amt, f"{p}_return_tax": tax,
            f"{p}_return_amt_inc_tax": amt + tax, f"{p}_fee": fee,
            f"{p}_return_ship_cost": c(f"{s}_return_ship_cost"), f"{p}_refunded_cash": c(f"{s}_refunded_cash"),
            f"{p}_reversed_charge": c(f"{s}_reversed_charge"), f"{p}_{credit}": c(f"{s}_{source_credit}"),
            f"{p}_net_loss": amt + tax + fee - back}


def return_rows(t, rows, s):
    rows = look_up(rows, t.date_dim, day_of(f"{s}_return_date"), "d_date", "d_", "d_date_sk")
    rows = look_up(rows, t.time_dim, seconds_of(f"{s}_return_time"), "t_time", "t_", "t_time_sk")
    return item_keys(look_up(rows, t.reason, f"{s}_reason_id", "r_reason_id", "r_", "r_reason_sk"), t, f"{s}_item_id")


def store_returns_increment(t) -> DataFrame:
    rows = customer_keys(return_rows(t, t.s_store_returns, "sret"), t, "sret_customer_id", "c_")
    rows = look_up(rows, t.store, "sret_store_id", "s_store_id", "s_", "s_store_sk", current="s_rec_end_date")
    return rows.select(*[v.alias(k) for k, v in {
        "sr_returned_date_sk": c("d_d_date_sk"), "sr_return_time_sk": c("t_t_time_sk"), "sr_item_sk": c("i_i_item_sk"),
        "sr_customer_sk": c("c_c_customer_sk"), "sr_cdemo_sk": c("c_c_current_cdemo_sk"),
        "sr_hdemo_sk": c("c_c_current_hdemo_sk"), "sr_addr_sk": c("c_c_current_addr_sk"),
        "sr_store_sk": c("s_s_store_sk"), "sr_reason_sk": c("r_r_reason_sk"), "sr_ticket_number": c("sret_ticket_number"),
        **return_columns("sr", "sret", "return_amt", "store_credit", "store_credit")}.items()])


def remote_returns_increment(t, s, p, source, outlet_col, outlet, ident, sk, end, amount, credit, source_credit):
    rows = return_rows(t, source, s)
    # The reference books the returning customer as the refunded one and the reverse; kept.
    rows = customer_keys(customer_keys(rows, t, f"{s}_return_customer_id", "b_"), t, f"{s}_refund_customer_id", "h_")
    rows = look_up(rows, outlet, outlet_col, ident, "o_", sk, current=end)
    keys = {f"{p}_returned_date_sk": c("d_d_date_sk"), f"{p}_returned_time_sk": c("t_t_time_sk"), f"{p}_item_sk": c("i_i_item_sk")}
    for who, mark in (("refunded", "b_"), ("returning", "h_")):
        keys |= {f"{p}_{who}_customer_sk": c(mark + "c_customer_sk"), f"{p}_{who}_cdemo_sk": c(mark + "c_current_cdemo_sk"),
                 f"{p}_{who}_hdemo_sk": c(mark + "c_current_hdemo_sk"), f"{p}_{who}_addr_sk": c(mark + "c_current_addr_sk")}
    keys |= {f"{p}_{sk.split('_', 1)[1]}": c("o_" + sk), f"{p}_reason_sk": c("r_r_reason_sk"), f"{p}_order_number": c(f"{s}_order_id")}
    return rows.select(*[v.alias(k) for k, v in {**keys, **return_columns(p, s, amount, credit, source_credit)}.items()])


def catalog_returns_increment(t) -> DataFrame:
    return remote_returns_increment(t, "cret", "cr", t.s_catalog_returns, "cret_call_center_id", t.call_center,
                                    "cc_call_center_id", "cc_call_center_sk", "cc_rec_end_date", "return_amount",
                                    "store_credit", "merchant_credit")


def web_returns_increment(t) -> DataFrame:
    return remote_returns_increment(t, "wret", "wr", t.s_web_returns, "wret_web_page_id", t.web_page, "wp_web_page_id",
                                    "wp_web_page_sk", "wp_rec_end_date", "return_amt", "account_credit", "account_credit")


INCREMENTS = {"store_sales": store_sales_increment, "catalog_sales": catalog_sales_increment,
              "web_sales": web_sales_increment, "store_returns": store_returns_increment,
              "catalog_returns": catalog_returns_increment, "web_returns": web_returns_increment}


def append(increment: DataFrame, path: str) -> None:
    """Add an increment to a stored fact."""
    increment.write.mode("append").option("compression", COPIES).parquet(path)


# ---- dimension updates -----------------------------------------------------------------------

def one_per_key(updates: DataFrame, key: str) -> DataFrame:
    """One update per business key; of several the greatest row, whatever the order of arrival."""
    rest = [x for x in updates.columns if x != key]
    return updates.groupBy(key).agg(F.max(F.struct(*rest)).alias("_u")).select(key, "_u.*")


def update_type1(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` of the rows whose business key has an update, also with null."""
    new = role(one_per_key(updates.select(key, *columns), key).withColumn("hit", F.lit(True)), "_n_")
    joined = target.join(new, c(key) == c(f"_n_{key}"), "left")
    return joined.select(*[
        F.when(c("_n_hit"), c(f"_n_{x}").cast(target.schema[x].dataType)).otherwise(c(x)).alias(x) if x in columns else c(x)
        for x in target.columns])


def update_type2(target: DataFrame, updates: DataFrame, sk: str, key: str, start: str, end: str, today: str) -> DataFrame:
    """Close the current row of each updated business key and add the update as the new current
    row, numbered on from the largest surrogate key in order of the business key."""
    day = F.to_date(F.lit(today))
    keys = updates.select(c(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    closed = (target.join(keys, c(key) == c("_key"), "left")
              .withColumn(end, F.when(c("_hit") & c(end).isNull(), day).otherwise(c(end))).select(*target.columns))
    last = target.agg(F.max(sk).alias("_last"))
    new = surrogate_keys(one_per_key(updates, key).crossJoin(F.broadcast(last)), key, c("_last"), sk)
    new = new.withColumn(start, day).withColumn(end, F.lit(None).cast("date"))
    return closed.unionByName(new.select(*[c(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns
                                           else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]))


def with_current(updates: DataFrame, target: DataFrame, key: str, end: str, renames: dict[str, str]) -> DataFrame:
    """Give each update the attributes it does not carry from the current row of its key.

    ``renames`` maps target columns to update columns; an update without a current row drops out.
    """
    held = [x for x in target.columns if x not in renames and x != end]
    current = role(target.filter(c(end).isNull()).select(*dict.fromkeys([key, *held])), "_c_")
    out = updates.join(current, c(renames[key]) == c(f"_c_{key}"))
    return out.select(*[c(f"_c_{x}").alias(x) for x in held], *[c(u).alias(x) for x, u in renames.items()])


def with_day(rows: DataFrame, t, text: str, name: str, how: str = "left") -> DataFrame:
    """Replace a date by its surrogate key; ``inner`` drops rows without one."""
    days = pick(t.date_dim, _day="d_date", _sk="d_date_sk")
    return rows.join(days, c(text).cast("date") == c("_day"), how).withColumn(name, c("_sk")).drop("_day", "_sk")


# ---- refresh tables taken back out of the star ------------------------------------------------

def first(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The reference samples arbitrary rows; here the first by key, or all of them."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def day_text(rows: DataFrame, t, sk: str, name: str, how: str = "left") -> DataFrame:
    days = pick(t.date_dim, _sk="d_date_sk", _day="d_date")
    return rows.join(days, c(sk) == c("_sk"), how).withColumn(name, c("_day")).drop("_sk", "_day")


def extract_customer(t, limit: int | None = None) -> DataFrame:
    birth = F.make_date("c_birth_year", "c_birth_month", "c_birth_day")
    rows = star(t.customer, (t.customer_address, "c_current_addr_sk", "ca_address_sk"),
                (t.customer_demographics, "c_current_cdemo_sk", "cd_demo_sk"),
                (t.household_demographics, "c_current_hdemo_sk", "hd_demo_sk"),
                (t.income_band, "hd_income_band_sk", "ib_income_band_sk"))
    rows = day_text(rows, t, "c_first_shipto_date_sk", "ship_day", "inner")
    rows = day_text(rows, t, "c_first_sales_date_sk", "sale_day", "inner")
    rows = rows.withColumn("birth", birth).join(pick(t.date_dim, _day="d_date"), c("birth") == c("_day"))
    names = {"cust_customer_id": "c_customer_id", "cust_salutation": "c_salutation", "cust_last_name": "c_last_name",
             "cust_first_name": "c_first_name", "cust_preffered_flag": "c_preferred_cust_flag", "cust_birth_date": "birth",
             "cust_birth_country": "c_birth_country", "cust_login_id": "c_login", "cust_email_address": "c_email_address",
             "cust_first_shipto_date": "ship_day", "cust_first_purchase_date": "sale_day",
             "cust_last_review_date": "c_last_review_date", "cust_street_number": "ca_street_number",
             "cust_suite_number": "ca_suite_number", "cust_street_name1": "ca_street_name", "cust_street_name2": "ca_street_name",
             "cust_street_type": "ca_street_type", "cust_city": "ca_city", "cust_zip": "ca_zip", "cust_county": "ca_county",
             "cust_state": "ca_state", "cust_country": "ca_country", "cust_loc_type": "ca_location_type",
             "cust_gender": "cd_gender", "cust_marital_status": "cd_marital_status", "cust_educ_status": "cd_education_status",
             "cust_credit_rating": "cd_credit_rating", "cust_purch_est": "cd_purchase_estimate",
             "cust_buy_potential": "hd_buy_potential", "cust_depend_cnt": "hd_dep_count",
             "cust_depend_emp_cnt": "cd_dep_employed_count", "cust_depend_college_cnt": "cd_dep_college_count",
             "cust_vehicle_cnt": "hd_vehicle_count"}
    out = rows.select(*[c(v).alias(k) for k, v in names.items()], (c("ib_lower_bound") + 800).alias("cust_annual_income"))
    return first(out, limit, "cust_customer_id")


def extract_item(t, limit: int | None = None) -> DataFrame:
    """Current items; a business key with several current rows is left out altogether."""
    rows = pick(t.item.filter("i_rec_end_date is null"), item_item_id="i_item_id", item_item_description="i_item_desc",
                item_list_price="i_current_price", item_wholesale_cost="i_wholesale_cost", item_manager_id="i_manager_id",
                item_size="i_size", item_formulation="i_formulation", item_color="i_color", item_units="i_units",
                item_container="i_container")
    return only_once(first(rows, limit, "item_item_id"), "item_item_id")


def only_once(rows: DataFrame, *keys: str) -> DataFrame:
    """Drop every row whose key occurs more than once.

    Keys are counted map-side, where a key with very many copies becomes one row, and the rows of
    the others are found by their keys; null keys are keys like others.
    """
    once = role(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(*keys), "_k_")
    return rows.join(once, reduce(Column.__and__, [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys]), "left_semi")


def extract_inventory(t, year: int = 2001, days: tuple[int, int] = (10, 15)) -> DataFrame:
    dates = t.date_dim.filter((c("d_year") == year) & c("d_dom").between(*days)).select("d_date_sk", "d_date")
    rows = star(t.inventory, (dates, "inv_date_sk", "d_date_sk"),
                (t.item.filter("i_rec_end_date is null"), "inv_item_sk", "i_item_sk"), (t.warehouse, "inv_warehouse_sk", "w_warehouse_sk"))
    rows = pick(rows, invn_warehouse_id="w_warehouse_id", invn_item_id="i_item_id", invn_date="d_date", invn_qty_on_hand="inv_quantity_on_hand")
    return only_once(rows, "invn_warehouse_id", "invn_item_id", "invn_date")


PROMO = ("cost response_target channel_dmail channel_email channel_catalog channel_tv channel_radio channel_press "
         "channel_event channel_demo channel_details purpose discount_active").split()


def extract_promotion(t, limit: int | None = None) -> DataFrame:
    rows = day_text(day_text(t.promotion, t, "p_start_date_sk", "prom_start_date"), t, "p_end_date_sk", "prom_end_date")
    return first(rows.select(c("p_promo_id").alias("prom_promotion_id"), c("p_promo_name").alias("prom_promotion_name"),
                             "prom_start_date", "prom_end_date", *[c(f"p_{x}").alias(f"prom_{x}") for x in PROMO]),
                 limit, "prom_promotion_id")


STORE = {"s_store_id": "stor_store_id", "s_store_name": "stor_name", "s_number_employees": "stor_employees",
         "s_floor_space": "stor_floor_space", "s_hours": "stor_hours", "s_manager": "stor_store_manager",
         "s_market_id": "stor_market_id", "s_geography_class": "stor_geography_class",
         "s_market_manager": "stor_market_manager", "s_tax_precentage": "stor_tax_percentage"}


def extract_store(t, limit: int | None = None) -> DataFrame:
    """Current stores that have closed."""
    rows = day_text(t.store.filter("s_rec_end_date is null"), t, "s_closed_date_sk", "stor_closed_date", "inner")
    return first(rows.select("stor_closed_date", *[c(k).alias(v) for k, v in STORE.items()]), limit, "stor_store_id")


SITE = {"web_site_id": "wsit_web_site_id", "web_name": "wsit_site_name", "web_class": "wsit_site_class",
        "web_manager": "wsit_site_manager", "web_tax_percentage": "wsit_tax_percentage"}


def extract_web_site(t, limit: int | None = None, closed_only: bool = True) -> DataFrame:
    """Current sites; the reference takes only those that have closed."""
    rows = day_text(t.web_site.filter("web_rec_end_date is null"), t, "web_open_date_sk", "wsit_open_date", "inner")
    rows = day_text(rows, t, "web_close_date_sk", "wsit_closed_date", "inner" if closed_only else "left")
    return first(rows.select("wsit_open_date", "wsit_closed_date", *[c(k).alias(v) for k, v in SITE.items()]), limit, "wsit_web_site_id")


PAGE = {"wp_web_page_id": "wpag_web_page_id", "wp_autogen_flag": "wpag_autogen_flag", "wp_url": "wpag_url",
        "wp_type": "wpag_type", "wp_char_count": "wpag_char_cnt", "wp_link_count": "wpag_link_cnt",
        "wp_image_count": "wpag_image_cnt", "wp_max_ad_count": "wpag_max_ad_cnt"}


def extract_web_page(t, limit: int | None = None) -> DataFrame:
    rows = day_text(t.web_page.filter("wp_rec_end_date is null"), t, "wp_creation_date_sk", "wpag_create_date")
    rows = day_text(rows, t, "wp_access_date_sk", "wpag_access_date")
    return first(rows.select("wpag_create_date", "wpag_access_date", *[c(k).alias(v) for k, v in PAGE.items()]), limit, "wpag_web_page_id")


def extract_warehouse(t, limit: int | None = None) -> DataFrame:
    return first(pick(t.warehouse, wrhs_warehouse_id="w_warehouse_id", wrhs_warehouse_desc="w_warehouse_name",
                      wrhs_warehouse_sq_ft="w_warehouse_sq_ft"), limit, "wrhs_warehouse_id")


CENTER = {"cc_call_center_id": "call_center_id", "cc_name": "call_center_name", "cc_class": "call_center_class",
          "cc_employees": "call_center_employees", "cc_sq_ft": "call_center_sq_ft", "cc_hours": "call_center_hours",
          "cc_manager": "call_center_manager", "cc_tax_percentage": "call_center_tax_percentage"}


def extract_call_center(t, limit: int | None = None) -> DataFrame:
    rows = day_text(t.call_center.filter("cc_rec_end_date is null"), t, "cc_open_date_sk", "call_open_date")
    rows = day_text(rows, t, "cc_closed_date_sk", "call_closed_date")
    return first(rows.select("call_open_date", "call_closed_date", *[c(k).alias(v) for k, v in CENTER.items()]), limit, "call_center_id")


def extract_catalog_page(t, limit: int | None = None) -> DataFrame:
    rows = day_text(day_text(t.catalog_page, t, "cp_start_date_sk", "cpag_start_date"), t, "cp_end_date_sk", "cpag_end_date")
    return first(pick(rows, "cpag_start_date", "cpag_end_date", cpag_id="cp_catalog_page_id", cpag_department="cp_department",
                      cpag_catalog_number="cp_catalog_number", cpag_description="cp_description", cpag_type="cp_type"),
                 limit, "cpag_id")


# ---- updates built from refresh tables --------------------------------------------------------

def customer_updates(t, source: DataFrame) -> DataFrame:
    """Customers with their demographics found again by attributes and their income by band."""
    people = role(t.customer_demographics, "")
    rows = source.join(people, reduce(Column.__and__, [c(a) == c(b) for a, b in (
        ("cust_gender", "cd_gender"), ("cust_marital_status", "cd_marital_status"), ("cust_educ_status", "cd_education_status"),
        ("cust_purch_est", "cd_purchase_estimate"), ("cust_credit_rating", "cd_credit_rating"),
        ("cust_depend_cnt", "cd_dep_count"), ("cust_depend_emp_cnt", "cd_dep_employed_count"),
        ("cust_depend_college_cnt", "cd_dep_college_count"))]))
    homes = star(t.household_demographics, (t.income_band, "hd_income_band_sk", "ib_income_band_sk"))
    rows = rows.join(homes, (c("cust_buy_potential") == c("hd_buy_potential")) & (c("cust_depend_cnt") == c("hd_dep_count"))
                     & (c("cust_vehicle_cnt") == c("hd_vehicle_count"))
                     & F.round("cust_annual_income", 0).between(c("ib_lower_bound"), c("ib_upper_bound")))
    held = pick(t.customer, _id="c_customer_id", _addr="c_current_addr_sk")
    rows = rows.join(held, c("cust_customer_id") == c("_id"), "left")
    # The reference takes the first ship-to day from the first purchase and the reverse; kept.
    rows = with_day(rows, t, "cust_first_purchase_date", "shipto_sk", "inner")
    rows = with_day(rows, t, "cust_first_shipto_date", "sales_sk", "inner")
    rows = rows.withColumn("birth", c("cust_birth_date").cast("date")).withColumns(
        {"birth_day": F.dayofmonth("birth"), "birth_month": F.month("birth"), "birth_year": F.year("birth")})
    return pick(rows, c_customer_id="cust_customer_id", c_current_cdemo_sk="cd_demo_sk", c_current_hdemo_sk="hd_demo_sk",
                c_current_addr_sk="_addr", c_first_shipto_date_sk="shipto_sk", c_first_sales_date_sk="sales_sk",
                c_salutation="cust_salutation", c_first_name="cust_first_name", c_last_name="cust_last_name",
                c_preferred_cust_flag="cust_preffered_flag", c_birth_day="birth_day", c_birth_month="birth_month",
                c_birth_year="birth_year", c_birth_country="cust_birth_country", c_login="cust_login_id",
                c_email_address="cust_email_address", c_last_review_date="cust_last_review_date")


def zip_offsets(t) -> DataFrame:
    """Time zone of each zip code, from the known addresses."""
    return t.customer_address.groupBy(c("ca_zip").alias("zipg_zip")).agg(F.min("ca_gmt_offset").alias("zipg_gmt_offset"))


def address_updates(t, source: DataFrame) -> DataFrame:
    held = pick(t.customer, _id="c_customer_id", _addr="c_current_addr_sk")
    homes = pick(t.customer_address, _sk="ca_address_sk", ca_address_id="ca_address_id")
    rows = star(source, (zip_offsets(t), "cust_zip", "zipg_zip"), (held, "cust_customer_id", "_id"), (homes, "_addr", "_sk"))
    street = F.concat(F.rtrim("cust_street_name1"), F.lit(" "), F.rtrim("cust_street_name2"))
    return pick(rows.withColumn("street", street), "ca_address_id", ca_street_number="cust_street_number", ca_street_name="street",
                ca_street_type="cust_street_type", ca_suite_number="cust_suite_number", ca_city="cust_city",
                ca_county="cust_county", ca_state="cust_state", ca_zip="cust_zip", ca_country="cust_country",
                ca_gmt_offset="zipg_gmt_offset", ca_location_type="cust_loc_type")


def catalog_page_updates(t, source: DataFrame) -> DataFrame:
    rows = with_day(with_day(source, t, "cpag_start_date", "cp_start_date_sk", "inner"), t, "cpag_end_date", "cp_end_date_sk", "inner")
    return pick(rows, "cp_start_date_sk", "cp_end_date_sk", cp_catalog_page_id="cpag_id", cp_department="cpag_department",
                cp_catalog_number="cpag_catalog_number", cp_description="cpag_description", cp_type="cpag_type")


def promotion_updates(t, source: DataFrame) -> DataFrame:
    rows = with_day(with_day(source, t, "prom_start_date", "p_start_date_sk"), t, "prom_end_date", "p_end_date_sk")
    return rows.select(c("prom_promotion_id").alias("p_promo_id"), c("prom_promotion_name").alias("p_promo_name"),
                       "p_start_date_sk", "p_end_date_sk", *[c(f"prom_{x}").alias(f"p_{x}") for x in PROMO])


def warehouse_updates(t, source: DataFrame) -> DataFrame:
    """Name and area from the update, the address as it stands."""
    held = t.warehouse.drop("w_warehouse_sk", "w_warehouse_name", "w_warehouse_sq_ft")
    rows = source.join(held, c("wrhs_warehouse_id") == c("w_warehouse_id"))
    return pick(rows, *held.columns, w_warehouse_name="wrhs_warehouse_desc", w_warehouse_sq_ft="wrhs_warehouse_sq_ft")


def item_updates(t, source: DataFrame) -> DataFrame:
    return with_current(source, t.item, "i_item_id", "i_rec_end_date", {
        "i_item_id": "item_item_id", "i_item_desc": "item_item_description", "i_current_price": "item_list_price",
        "i_wholesale_cost": "item_wholesale_cost", "i_size": "item_size", "i_formulation": "item_formulation",
        "i_color": "item_color", "i_units": "item_units", "i_container": "item_container", "i_manager_id": "item_manager_id"})


def store_updates(t, source: DataFrame) -> DataFrame:
    rows = with_day(source, t, "stor_closed_date", "closed_sk")
    return with_current(rows, t.store, "s_store_id", "s_rec_end_date", {**STORE, "s_closed_date_sk": "closed_sk"})


def web_site_updates(t, source: DataFrame) -> DataFrame:
    rows = with_day(with_day(source, t, "wsit_open_date", "open_sk"), t, "wsit_closed_date", "close_sk")
    return with_current(rows, t.web_site, "web_site_id", "web_rec_end_date",
                        {**SITE, "web_open_date_sk": "open_sk", "web_close_date_sk": "close_sk"})


def web_page_updates(t, source: DataFrame) -> DataFrame:
    """Web pages carry all their attributes but the customer, which the new row leaves null."""
    rows = with_day(with_day(source, t, "wpag_create_date", "wp_creation_date_sk"), t, "wpag_access_date", "wp_access_date_sk")
    return rows.select("wp_creation_date_sk", "wp_access_date_sk", *[c(v).alias(k) for k, v in PAGE.items()])


def call_center_updates(t, source: DataFrame) -> DataFrame:
    """The reference swaps the opening and closing days of a call center; kept."""
    rows = with_day(with_day(source, t, "call_open_date", "opened"), t, "call_closed_date", "closed")
    return with_current(rows, t.call_center, "cc_call_center_id", "cc_rec_end_date",
                        {**CENTER, "cc_closed_date_sk": "opened", "cc_open_date_sk": "closed"})


# ---- registered jobs --------------------------------------------------------------------------

KEYED = "_sk _number _quantity".split()


def typed(names: list[str]) -> str:
    """Output columns of a fact: keys and quantities are integers, the rest money."""
    return " ".join(n + (":i" if any(n.endswith(k) for k in KEYED) else ":n") for n in names)


SOLD = ("quantity wholesale_cost list_price sales_price ext_discount_amt ext_sales_price ext_wholesale_cost "
        "ext_list_price ext_tax coupon_amt net_paid net_paid_inc_tax net_profit").split()
REMOTE = ("sold_date_sk sold_time_sk ship_date_sk item_sk bill_customer_sk bill_cdemo_sk bill_hdemo_sk bill_addr_sk "
          "ship_customer_sk ship_cdemo_sk ship_hdemo_sk ship_addr_sk ship_mode_sk warehouse_sk promo_sk order_number").split()
SHIPPED = "ext_ship_cost net_paid_inc_ship net_paid_inc_ship_tax".split()
LOSS = "return_tax return_amt_inc_tax fee return_ship_cost refunded_cash reversed_charge net_loss return_quantity".split()
BACK = ("returned_date_sk returned_time_sk item_sk refunded_customer_sk refunded_cdemo_sk refunded_hdemo_sk refunded_addr_sk "
        "returning_customer_sk returning_cdemo_sk returning_hdemo_sk returning_addr_sk reason_sk order_number").split()


def _columns(p, *groups):
    return typed([f"{p}_{x}" for g in groups for x in g])


FACT_COLUMNS = {
    "store_sales": _columns("ss", "sold_date_sk sold_time_sk item_sk customer_sk cdemo_sk hdemo_sk addr_sk store_sk promo_sk ticket_number".split(), SOLD),
    "catalog_sales": _columns("cs", REMOTE, ["call_center_sk", "catalog_page_sk"], SOLD, SHIPPED),
    "web_sales": _columns("ws", REMOTE, ["web_page_sk", "web_site_sk"], SOLD, SHIPPED),
    "store_returns": _columns("sr", "returned_date_sk return_time_sk item_sk customer_sk cdemo_sk hdemo_sk addr_sk store_sk reason_sk ticket_number".split(),
                              LOSS, ["return_amt", "store_credit"]),
    "catalog_returns": _columns("cr", BACK, ["call_center_sk"], LOSS, ["return_amount", "store_credit"]),
    "web_returns": _columns("wr", BACK, ["web_page_sk"], LOSS, ["return_amt", "account_credit"]),
}

for _fact, _build in INCREMENTS.items():
    query(f"refresh_{_fact}", FACT_COLUMNS[_fact])(_build)


# The key of each fact: a row of an item in a ticket or an order.
FACT_KEYS = {"store_sales": ["ss_item_sk", "ss_ticket_number"], "catalog_sales": ["cs_item_sk", "cs_order_number"],
             "web_sales": ["ws_item_sk", "ws_order_number"], "store_returns": ["sr_item_sk", "sr_ticket_number"],
             "catalog_returns": ["cr_item_sk", "cr_order_number"], "web_returns": ["wr_item_sk", "wr_order_number"]}


@query("refresh_append", "fact rows_before:i rows_added:i rows_after:i repeated_keys:i", "fact")
def refresh_append(t):
    """Each fact copied once, its increment appended to the stored copy, and what is stored then counted.

    Facts and refresh tables that are not stored yet are derived as they are read, so each fact is on disk once.
    ``repeated_keys``: rows beyond the first of their key; lines of one order whose parts share an
    item give some inside an increment, none reaches over from an order that was there before.
    """
    t, parts = lazily(t), []
    for fact, build in INCREMENTS.items():
        def store(path, fact=fact, build=build):
            kept = t[fact].select(*[c(f.name).cast(f.dataType) for f in t[fact].schema])
            rows = build(t)  # a column that the source does not carry is null
            added = rows.select(*[(c(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t[fact].schema])
            with shuffles_dropped(t.spark):
                kept.withColumn("_added", F.lit(False)).write.option("compression", COPIES).parquet(path)
                append(added.withColumn("_added", F.lit(True)), path)
        stored = t.spark.read.parquet(t.once(f"appended/{fact}", store))
        keyed = stored.groupBy(*FACT_KEYS[fact]).agg(F.count(F.lit(1)).alias("n"), F.sum(c("_added").cast("int")).alias("added"))
        parts.append(keyed.agg(F.sum(c("n") - c("added")).alias("rows_before"), F.sum("added").alias("rows_added"),
                               F.sum("n").alias("rows_after"), F.sum(c("n") - 1).alias("repeated_keys")).withColumn("fact", F.lit(fact)))
    return union_all(*parts)


@query("refresh_append_refused", "fact rows_stored:i rows_refused:i", "fact")
def refresh_append_refused(t):
    """The six facts and their increments taken into a store; the same increments once more are refused.

    What is stored then is the facts and one set of increments.  ``rows_refused``: rows of the
    second set whose key (no part null) was stored, the reason to refuse it whole.
    """
    t = lazily(t)

    def known(fact, stored, new):
        return new.join(stored.select(*FACT_KEYS[fact]).distinct(), FACT_KEYS[fact], "left_semi")

    def store(path):
        kept = Increments(t.spark, f"{path}/facts")
        kept.add({fact: t[fact].select(*[c(f.name).cast(f.dataType) for f in t[fact].schema]) for fact in INCREMENTS})
        more = {}
        for fact, build in INCREMENTS.items():
            rows = build(t)
            more[fact] = rows.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in t[fact].schema if f.name in rows.columns])
        kept.add(more)
        refused = {}
        try:
            kept.add(more, known)
        except Refused as found:
            refused = found.counts
        t.spark.createDataFrame([(fact, refused.get(fact, 0)) for fact in INCREMENTS], "fact string, rows_refused long").write.parquet(f"{path}/refused")

    path = t.once("increments", store)
    kept = Increments(t.spark, f"{path}/facts")
    stored = union_all(*[kept.read(fact).agg(F.count(F.lit(1)).alias("rows_stored")).withColumn("fact", F.lit(fact)) for fact in INCREMENTS])
    return stored.join(t.spark.read.parquet(f"{path}/refused"), "fact")


CUSTOMER = ("c_customer_sk:i c_customer_id c_current_cdemo_sk:i c_current_hdemo_sk:i c_current_addr_sk:i "
            "c_first_shipto_date_sk:i c_first_sales_date_sk:i c_salutation c_first_name c_last_name c_preferred_cust_flag "
            "c_birth_day:i c_birth_month:i c_birth_year:i c_birth_country c_login c_email_address c_last_review_date")


@query("refresh_customer", CUSTOMER)
def refresh_customer(t):
    source = extract_customer(t).withColumn("cust_last_name", F.upper("cust_last_name"))
    columns = [x for x in customer_updates(t, source).columns if x != "c_customer_id"]
    return update_type1(t.customer, customer_updates(t, source), "c_customer_id", columns)


@query("refresh_customer_address", "ca_address_sk:i ca_address_id ca_street_number ca_street_name ca_street_type ca_suite_number "
       "ca_city ca_county ca_state ca_zip ca_country ca_gmt_offset:n ca_location_type")
def refresh_customer_address(t):
    updates = address_updates(t, extract_customer(t).withColumn("cust_city", F.upper("cust_city")))
    return update_type1(t.customer_address, updates, "ca_address_id", [x for x in updates.columns if x != "ca_address_id"])


@query("refresh_catalog_page", "cp_catalog_page_sk:i cp_catalog_page_id cp_start_date_sk:i cp_end_date_sk:i cp_department "
       "cp_catalog_number:i cp_catalog_page_number:i cp_description cp_type")
def refresh_catalog_page(t):
    updates = catalog_page_updates(t, extract_catalog_page(t).withColumn("cpag_type", F.upper("cpag_type")))
    return update_type1(t.catalog_page, updates, "cp_catalog_page_id", [x for x in updates.columns if x != "cp_catalog_page_id"])


@query("refresh_promotion", "p_promo_sk:i p_promo_id p_start_date_sk:i p_end_date_sk:i p_item_sk:i p_promo_name "
       + " ".join(f"p_{x}" + {"cost": ":n", "response_target": ":i"}.get(x, "") for x in PROMO))
def refresh_promotion(t):
    """The start day stays: the reference's update leaves it out."""
    updates = promotion_updates(t, extract_promotion(t).withColumn("prom_cost", c("prom_cost") + 10))
    return update_type1(t.promotion, updates, "p_promo_id",
                        [x for x in updates.columns if x not in ("p_promo_id", "p_start_date_sk")])


@query("refresh_warehouse", "w_warehouse_sk:i w_warehouse_id w_warehouse_name w_warehouse_sq_ft:i w_street_number w_street_name "
       "w_street_type w_suite_number w_city w_county w_state w_zip w_country w_gmt_offset:n")
def refresh_warehouse(t):
    updates = warehouse_updates(t, extract_warehouse(t).withColumn("wrhs_warehouse_sq_ft", c("wrhs_warehouse_sq_ft") + 5))
    return update_type1(t.warehouse, updates, "w_warehouse_id", [x for x in updates.columns if x != "w_warehouse_id"])


@query("refresh_item", "i_item_sk:i i_item_id i_rec_start_date:d i_rec_end_date:d i_item_desc i_current_price:n i_wholesale_cost:n "
       "i_brand_id:i i_brand i_class_id:i i_class i_category_id:i i_category i_manufact_id:i i_manufact i_size i_formulation "
       "i_color i_units i_container i_manager_id:i i_product_name")
def refresh_item(t, today=TODAY):
    source = extract_item(t).withColumn("item_list_price", c("item_list_price") + 1)
    return update_type2(t.item, item_updates(t, source), "i_item_sk", "i_item_id", "i_rec_start_date", "i_rec_end_date", today)


ADDRESS = "street_number street_name street_type suite_number city county state zip country".split()


@query("refresh_store", "s_store_sk:i s_store_id s_rec_start_date:d s_rec_end_date:d s_closed_date_sk:i s_store_name "
       "s_number_employees:i s_floor_space:i s_hours s_manager s_market_id:i s_geography_class s_market_desc s_market_manager "
       "s_division_id:i s_division_name s_company_id:i s_company_name " + " ".join(f"s_{x}" for x in ADDRESS)
       + " s_gmt_offset:n s_tax_precentage:n")
def refresh_store(t, today=TODAY):
    source = extract_store(t).withColumn("stor_employees", c("stor_employees") + 7)
    return update_type2(t.store, store_updates(t, source), "s_store_sk", "s_store_id", "s_rec_start_date", "s_rec_end_date", today)


@query("refresh_web_site", "web_site_sk:i web_site_id web_rec_start_date:d web_rec_end_date:d web_name web_open_date_sk:i "
       "web_close_date_sk:i web_class web_manager web_mkt_id:i web_mkt_class web_mkt_desc web_market_manager web_company_id:i "
       "web_company_name " + " ".join(f"web_{x}" for x in ADDRESS) + " web_gmt_offset:n web_tax_percentage:n")
def refresh_web_site(t, today=TODAY):
    source = extract_web_site(t, closed_only=False).withColumn("wsit_site_class", F.lit("Renewed"))
    return update_type2(t.web_site, web_site_updates(t, source), "web_site_sk", "web_site_id", "web_rec_start_date",
                        "web_rec_end_date", today)


@query("refresh_web_page", "wp_web_page_sk:i wp_web_page_id wp_rec_start_date:d wp_rec_end_date:d wp_creation_date_sk:i "
       "wp_access_date_sk:i wp_autogen_flag wp_customer_sk:i wp_url wp_type wp_char_count:i wp_link_count:i wp_image_count:i "
       "wp_max_ad_count:i")
def refresh_web_page(t, today=TODAY):
    source = extract_web_page(t).withColumn("wpag_link_cnt", c("wpag_link_cnt") + 1)
    return update_type2(t.web_page, web_page_updates(t, source), "wp_web_page_sk", "wp_web_page_id", "wp_rec_start_date",
                        "wp_rec_end_date", today)


@query("refresh_call_center", "cc_call_center_sk:i cc_call_center_id cc_rec_start_date:d cc_rec_end_date:d cc_closed_date_sk:i "
       "cc_open_date_sk:i cc_name cc_class cc_employees:i cc_sq_ft:i cc_hours cc_manager cc_mkt_id:i cc_mkt_class cc_mkt_desc "
       "cc_market_manager cc_division:i cc_division_name cc_company:i cc_company_name " + " ".join(f"cc_{x}" for x in ADDRESS)
       + " cc_gmt_offset:n cc_tax_percentage:n")
def refresh_call_center(t, today=TODAY):
    source = extract_call_center(t).withColumn("call_center_employees", c("call_center_employees") + 3)
    return update_type2(t.call_center, call_center_updates(t, source), "cc_call_center_sk", "cc_call_center_id",
                        "cc_rec_start_date", "cc_rec_end_date", today)


EXTRACTS = {
    "customer": (extract_customer, " ".join(
        x + {"cust_birth_date": ":d", "cust_first_shipto_date": ":d", "cust_first_purchase_date": ":d", "cust_purch_est": ":i",
             "cust_depend_cnt": ":i", "cust_depend_emp_cnt": ":i", "cust_depend_college_cnt": ":i", "cust_vehicle_cnt": ":i",
             "cust_annual_income": ":i"}.get(x, "") for x in (
            "cust_customer_id cust_salutation cust_last_name cust_first_name cust_preffered_flag cust_birth_date cust_birth_country "
            "cust_login_id cust_email_address cust_first_shipto_date cust_first_purchase_date cust_last_review_date "
            "cust_street_number cust_suite_number cust_street_name1 cust_street_type cust_city cust_zip cust_county cust_state "
            "cust_country cust_loc_type cust_gender cust_marital_status cust_educ_status cust_credit_rating cust_purch_est "
            "cust_buy_potential cust_depend_cnt cust_depend_emp_cnt cust_depend_college_cnt cust_vehicle_cnt cust_annual_income").split())),
    "item": (extract_item, "item_item_id item_item_description item_list_price:n item_wholesale_cost:n item_manager_id:i item_size "
                           "item_formulation item_color item_units item_container"),
    "inventory": (extract_inventory, "invn_warehouse_id invn_item_id invn_date:d invn_qty_on_hand:i"),
    "promotion": (extract_promotion, "prom_promotion_id prom_promotion_name prom_start_date:d prom_end_date:d "
                  + " ".join(f"prom_{x}" + {"cost": ":n", "response_target": ":i"}.get(x, "") for x in PROMO)),
    "store": (extract_store, "stor_store_id stor_closed_date:d stor_name stor_employees:i stor_floor_space:i stor_hours "
                             "stor_store_manager stor_market_id:i stor_geography_class stor_market_manager stor_tax_percentage:n"),
    "web_site": (lambda t: extract_web_site(t, closed_only=False),
                 "wsit_web_site_id wsit_open_date:d wsit_closed_date:d wsit_site_name wsit_site_class wsit_site_manager wsit_tax_percentage:n"),
    "web_page": (extract_web_page, "wpag_web_page_id wpag_create_date:d wpag_access_date:d wpag_autogen_flag wpag_url wpag_type "
                                   "wpag_char_cnt:i wpag_link_cnt:i wpag_image_cnt:i wpag_max_ad_cnt:i"),
    "warehouse": (extract_warehouse, "wrhs_warehouse_id wrhs_warehouse_desc wrhs_warehouse_sq_ft:i"),
    "catalog_page": (extract_catalog_page, "cpag_id cpag_start_date:d cpag_end_date:d cpag_department cpag_catalog_number:i cpag_description cpag_type"),
    "call_center": (extract_call_center, "call_center_id call_open_date:d call_closed_date:d call_center_name call_center_class "
                                         "call_center_employees:i call_center_sq_ft:i call_center_hours call_center_manager "
                                         "call_center_tax_percentage:n"),
}

for _table, (_extract, _cols) in EXTRACTS.items():
    query(f"extract_{_table}", _cols)(_extract)
