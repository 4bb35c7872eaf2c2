"""The retail star, derived from the order tables.

One definition of every star table is rendered twice: as Spark SQL for the engine and as a
``WITH`` entry for the SQL oracle.  Only integer arithmetic, ``CASE``, date parts and decimal
literals are used, so both render to the same rows.  Money is kept in integer cents until the
last cast.
"""

from __future__ import annotations

import re

EPOCH_SK = 2449719  # surrogate of 1995-01-01

# Fixed value lists of the star's descriptive columns.
STATES = ["TN", "GA", "CA", "WA", "TX", "OH", "IL", "MI", "NY", "KY"]
COUNTIES = ["Williamson County", "Walker County", "Ziebach County", "Daviess County",
            "Barrow County", "Fairfield County", "Luce County", "Richland County"]
CITIES = ["Midway", "Fairview", "Oak Grove", "Five Points", "Pleasant Hill", "Centerville"]
GMT = [-5, -6, -7, -8]
ZIPS = ["85669", "86197", "88274", "83405", "86475", "85392", "85460", "80348", "81792",
        "24128", "24680", "35709", "38354", "46081", "57834", "61547", "70073", "76232",
        "83583", "91068"]
CATEGORIES = ["Women", "Men", "Children", "Shoes", "Music", "Jewelry", "Home", "Sports",
              "Books", "Electronics"]
CLASSES = ["personal", "portable", "reference", "self-help", "accessories", "classical",
           "fragrances", "pants"]
BRANDS = ["scholaramalgamalg #14", "scholaramalgamalg #7", "exportiunivamalg #9",
          "scholaramalgamalg #9", "amalgimporto #1", "edu packscholar #1",
          "exportiimporto #1", "importoamalg #1"]
COLORS = ["powder", "khaki", "brown", "honeydew", "floral", "deep", "light", "cornflower",
          "midnight", "snow", "cyan", "papaya"]
UNITS = ["Ounce", "Oz", "Bunch", "Ton", "N/A", "Dozen"]
SIZES = ["medium", "extra large", "N/A", "small", "petite", "large"]
STORE_NAMES = ["ought", "able", "pri", "ese", "anti"]
BUY_POTENTIAL = ["0-500", "501-1000", "1001-5000", "5001-10000", ">10000", "Unknown"]
EDUCATION = ["Primary", "Secondary", "College", "2 yr Degree", "4 yr Degree",
             "Advanced Degree", "Unknown"]
CREDIT = ["Low Risk", "Good", "High Risk", "Unknown"]
FIRST_NAMES = ["James", "Mary", "Robert", "Linda", "Michael", "Anna", "David", "Ruth"]
LAST_NAMES = ["Smith", "Jones", "Brown", "Moore", "Davis", "Lopez", "White", "Clark", "Hill"]
COUNTRIES = ["CANADA", "FRANCE", "JAPAN", "BRAZIL", "KENYA", "UNITED STATES"]
CARRIERS = ["UPS", "FEDEX", "DHL", "BARIAN", "USPS", "TBS", "ZOUROS", "MSC", "LATVIAN", "ALLIANCE"]
SHIP_TYPES = ["EXPRESS", "NEXT DAY", "OVERNIGHT", "REGULAR", "TWO DAY", "LIBRARY"]
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


class Spark:
    """Spark SQL rendering."""

    def finish(self, sql: str) -> str:
        sql = sql.replace(" // ", " div ")
        return re.sub(r"\bsrc_(\w+)", r"{src_\1}", sql)

    def days(self, col):
        return f"datediff(cast({col} as date), date'1995-01-01')"

    def plus_days(self, n):
        return f"date_add(date'1995-01-01', cast({n} as int))"

    def series(self, n):
        return f"(select id from range(0, {n}, 1, 1))"  # one task: n is a fixed, small number

    def unnest(self, n):
        return f"explode(sequence(0, {n - 1}))"

    def kept(self, name, sql):
        return f"{{{name}}}"  # stored under its name

    def stock(self):
        """The last order up to a week gives that week's row, with the most of the eight weeks up to it: what unfolds
        is neither shuffled nor grouped.  Orders of one week count once; a lost week is one row."""
        near = "over (partition by item, wh order by week"
        most = ", ".join(f"max(q) {near} range between {7 - k} preceding and current row)" for k in range(8))
        return f"""(select {EPOCH_SK} + (week + wk) * 7 as inv_date_sk, item as inv_item_sk, wh as inv_warehouse_sk,
             item * 131 + (week + wk) * 1713 + wh * 397 + most[wk] * 11 as x
      from (select *, explode(case when week is null then array(0)
                              else filter(sequence(0, 7), k -> next is null or next > week + k) end) as wk
            from (select week, item, wh, lead(week) {near}) as next, array({most}) as most
                  from (select od // 7 as week, pk + 1 as item, sk % 5 + 1 as wh, max(qty) as q
                        from lines group by od // 7, pk + 1, sk % 5 + 1))))"""

    def pick(self, values, idx):
        return f"element_at(array({_literals(values)}), cast(({idx}) % {len(values)} as int) + 1)"


class Duck:
    """Oracle SQL rendering."""

    def finish(self, sql: str) -> str:
        return re.sub(r"\bsrc_(\w+)", r"\1", sql)

    def days(self, col):
        return f"date_diff('day', date'1995-01-01', cast({col} as date))"

    def plus_days(self, n):
        return f"cast(date'1995-01-01' + cast({n} as int) as date)"

    def series(self, n):
        return f"(select range as id from range({n}))"

    def unnest(self, n):
        return f"unnest(range({n}))"

    def kept(self, name, sql):
        return f"({sql})"

    def stock(self):
        return f"""(select {EPOCH_SK} + (week + wk) * 7 as inv_date_sk, item as inv_item_sk,
             wh as inv_warehouse_sk,
             max(item * 131 + (week + wk) * 1713 + wh * 397 + q * 11) as x
      from (select od // 7 as week, pk + 1 as item, sk % 5 + 1 as wh, qty as q,
                   {self.unnest(8)} as wk from lines)
      group by {EPOCH_SK} + (week + wk) * 7, item, wh)"""

    def pick(self, values, idx):
        return f"([{_literals(values)}])[cast(({idx}) % {len(values)} as int) + 1]"


def _literals(values):
    return ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values)


def _ident(prefix, expr):
    width, digits = 16 - len(prefix), f"cast({expr} as string)"
    return f"concat('{prefix}', lpad({digits}, cast(greatest({width}, length({digits})) as int), '0'))"


def _money(cents, precision=12):
    return f"cast(({cents}) * 0.01 as decimal({precision},2))"


def _nullable(k, expr):
    """Every nullable fact key is null on one residue of 23."""
    return f"case when (ok + pk) % 23 = {k} then null else {expr} end"


def _order_lines(d):
    """One line per order and part.  Grouping by both keys comes before the join, so an order
    holding a third of the lines is spread by part, and the join that follows may be split."""
    return f"""select ok, pk, sk, o_custkey as ck, {d.days('o_orderdate')} as od, sd,
                   o_orderpriority as pri, flag, qty, disc, pk * 37 % 19000 + 99 as list,
                   (select count(*) from src_supplier) as outlets,
                   (select max(o_orderkey) from src_orders) as last_order
            from (select l_orderkey as ok, l_partkey as pk, min(l_suppkey) as sk,
                         min({d.days('l_shipdate')}) as sd, max(l_returnflag) as flag,
                         cast(sum(l_quantity) as bigint) * 2 - l_partkey % 2 as qty,
                         cast(round(max(l_discount) * 100) as bigint) as disc
                  from src_lineitem group by l_orderkey, l_partkey)
            join src_orders on ok = o_orderkey"""


def _lines(d):
    """Lines with their amounts, which are worked out wherever they are read."""
    return f"""
select *, list * qty as x_list, sale * qty as x_sale, cost * qty as x_cost,
       (list - sale) * qty as x_disc,
       case when ok % 7 = 0 then sale * qty // 10 else 0 end as coupon,
       list * qty * 5 // 100 as ship, (qty + 1) // 2 as rqty
from (select *, list * (100 - disc) // 100 as sale, list * (40 + pk % 70) // 100 as cost
      from {d.kept('order_lines', _order_lines(d))})
"""


# Order priorities carried by each channel; they overlap, so the same customer, item and day
# can occur in several channels.
CHANNEL = {
    "store": "pri in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')",
    "catalog": "pri in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
    "web": "pri in ('1-URGENT', '2-HIGH', '5-LOW')",
}


def _amounts(p, ship):
    """The money columns shared by the three sales facts."""
    net, tax = "(x_sale - coupon)", "((x_sale - coupon) * 8 // 100)"
    cols = [("wholesale_cost", "cost"), ("list_price", "list"), ("sales_price", "sale"),
            ("ext_discount_amt", "x_disc"), ("ext_sales_price", "x_sale"),
            ("ext_wholesale_cost", "x_cost"), ("ext_list_price", "x_list"),
            ("ext_tax", tax), ("coupon_amt", "coupon")]
    if ship:
        cols.append(("ext_ship_cost", "ship"))
    cols += [("net_paid", net), ("net_paid_inc_tax", f"{net} + {tax}")]
    if ship:
        cols += [("net_paid_inc_ship", f"{net} + ship"),
                 ("net_paid_inc_ship_tax", f"{net} + ship + {tax}")]
    cols.append(("net_profit", f"{net} - x_cost"))
    unit = ("wholesale_cost", "list_price", "sales_price")
    return ", ".join(f"{_money(e, 7 if c in unit else 12)} as {p}_{c}" for c, e in cols)


CDEMO, HDEMO = "ok * 13 % 5600 + 1", "ok * 29 % 7200 + 1"
STORE, CALL_CENTER, SITE = "ok // 3 % outlets + 1", "ok % 5 + 1", "ok // 7 % outlets + 1"


def _store_sales(d):
    return f"""
select {_nullable(1, f'{EPOCH_SK} + od')} as ss_sold_date_sk,
       {_nullable(2, 'ok * 61 % 86400')} as ss_sold_time_sk, pk + 1 as ss_item_sk,
       {_nullable(3, 'ck + 1')} as ss_customer_sk, {_nullable(4, CDEMO)} as ss_cdemo_sk,
       {_nullable(5, HDEMO)} as ss_hdemo_sk, {_nullable(6, 'ck // 3 + 1')} as ss_addr_sk,
       {_nullable(7, STORE)} as ss_store_sk, {_nullable(8, 'ok % outlets + 1')} as ss_promo_sk,
       ok + 1 as ss_ticket_number, qty as ss_quantity, {_amounts('ss', False)}
from lines where {CHANNEL['store']}
"""


def _remote_sales(p, channel, extra):
    return f"""
select {_nullable(1, f'{EPOCH_SK} + od')} as {p}_sold_date_sk,
       {_nullable(2, 'ok * 61 % 86400')} as {p}_sold_time_sk,
       {_nullable(9, f'{EPOCH_SK} + sd')} as {p}_ship_date_sk, pk + 1 as {p}_item_sk,
       {_nullable(3, 'ck + 1')} as {p}_bill_customer_sk, {_nullable(4, CDEMO)} as {p}_bill_cdemo_sk,
       {_nullable(5, HDEMO)} as {p}_bill_hdemo_sk, {_nullable(6, 'ck // 3 + 1')} as {p}_bill_addr_sk,
       {_nullable(10, 'ck // 2 + 1')} as {p}_ship_customer_sk,
       {_nullable(11, CDEMO)} as {p}_ship_cdemo_sk, {_nullable(12, HDEMO)} as {p}_ship_hdemo_sk,
       {_nullable(13, 'ck // 4 + 1')} as {p}_ship_addr_sk, {extra},
       {_nullable(16, 'ok % 25 + 1')} as {p}_ship_mode_sk,
       {_nullable(17, 'pk % 5 + 1')} as {p}_warehouse_sk,
       {_nullable(8, 'ok % outlets + 1')} as {p}_promo_sk,
       ok + 1 as {p}_order_number, qty as {p}_quantity, {_amounts(p, True)}
from lines where {CHANNEL[channel]}
"""


def _catalog_sales(d):
    return _remote_sales("cs", "catalog", f"""{_nullable(14, CALL_CENTER)} as cs_call_center_sk,
       {_nullable(15, 'sk + 1')} as cs_catalog_page_sk""")


def _web_sales(d):
    return _remote_sales("ws", "web", f"""{_nullable(14, 'sk + 1')} as ws_web_page_sk,
       {_nullable(15, SITE)} as ws_web_site_sk""")


RDATE = f"{EPOCH_SK} + od + ok % 150"


def _return_amounts(p, amount, credit):
    amt, tax = "sale * rqty", "(sale * rqty * 8 // 100)"
    fee, ship = "(50 + pk % 100)", "(list * rqty * 5 // 100)"
    cash, rev = "(sale * rqty * 6 // 10)", "(sale * rqty * 3 // 10)"
    cols = [(amount, amt), ("return_tax", tax), ("return_amt_inc_tax", f"{amt} + {tax}"),
            ("fee", fee), ("return_ship_cost", ship), ("refunded_cash", cash),
            ("reversed_charge", rev), (credit, f"{amt} - {cash} - {rev}"),
            ("net_loss", f"{tax} + {fee} + {ship}")]
    return ", ".join(f"{_money(e)} as {p}_{c}" for c, e in cols)


def _store_returns(d):
    return f"""
select {_nullable(1, RDATE)} as sr_returned_date_sk,
       {_nullable(2, 'ok * 67 % 86400')} as sr_return_time_sk, pk + 1 as sr_item_sk,
       {_nullable(3, 'ck + 1')} as sr_customer_sk, {_nullable(4, CDEMO)} as sr_cdemo_sk,
       {_nullable(5, HDEMO)} as sr_hdemo_sk, {_nullable(6, 'ck // 3 + 1')} as sr_addr_sk,
       {_nullable(7, STORE)} as sr_store_sk, {_nullable(8, 'pk % 25 + 1')} as sr_reason_sk,
       ok + 1 as sr_ticket_number, rqty as sr_return_quantity,
       {_return_amounts('sr', 'return_amt', 'store_credit')}
from lines where {CHANNEL['store']} and flag = 'R'
"""


def _remote_returns(p, channel, amount, credit, extra):
    return f"""
select {_nullable(1, RDATE)} as {p}_returned_date_sk,
       {_nullable(2, 'ok * 67 % 86400')} as {p}_returned_time_sk, pk + 1 as {p}_item_sk,
       {_nullable(3, 'ck + 1')} as {p}_refunded_customer_sk,
       {_nullable(4, CDEMO)} as {p}_refunded_cdemo_sk,
       {_nullable(5, HDEMO)} as {p}_refunded_hdemo_sk,
       {_nullable(6, 'ck // 3 + 1')} as {p}_refunded_addr_sk,
       {_nullable(10, 'ck // 2 + 1')} as {p}_returning_customer_sk,
       {_nullable(11, CDEMO)} as {p}_returning_cdemo_sk,
       {_nullable(12, HDEMO)} as {p}_returning_hdemo_sk,
       {_nullable(13, 'ck // 4 + 1')} as {p}_returning_addr_sk, {extra},
       {_nullable(8, 'pk % 25 + 1')} as {p}_reason_sk,
       ok + 1 as {p}_order_number, rqty as {p}_return_quantity, {_return_amounts(p, amount, credit)}
from lines where {CHANNEL[channel]} and flag = 'R'
"""


def _catalog_returns(d):
    return _remote_returns("cr", "catalog", "return_amount", "store_credit", f"""
       {_nullable(14, CALL_CENTER)} as cr_call_center_sk,
       {_nullable(15, 'sk + 1')} as cr_catalog_page_sk,
       {_nullable(16, 'ok % 25 + 1')} as cr_ship_mode_sk,
       {_nullable(17, 'pk % 5 + 1')} as cr_warehouse_sk""")


def _web_returns(d):
    return _remote_returns("wr", "web", "return_amt", "account_credit",
                           f"{_nullable(14, 'sk + 1')} as wr_web_page_sk")


def _inventory(d):
    """Weekly stock of an item in a warehouse for eight weeks after each order of it."""
    return f"""
select inv_date_sk, inv_item_sk, inv_warehouse_sk,
       case when x % 97 = 0 then null when x % 4 = 0 then x % 1000 else x % 150 end
         as inv_quantity_on_hand
from {d.stock()}
"""


def _date_dim(d):
    y, m, dom = "extract(year from d_date)", "extract(month from d_date)", "extract(day from d_date)"
    q = f"(({m} + 2) // 3)"
    return f"""
select d_date_sk, {_ident('DATE', 'd_date_sk')} as d_date_id, d_date,
       ({y} - 1900) * 12 + {m} - 1 as d_month_seq, (d_date_sk + 1) // 7 as d_week_seq,
       ({y} - 1900) * 4 + {q} as d_quarter_seq, {y} as d_year, (d_date_sk + 1) % 7 as d_dow,
       {m} as d_moy, {dom} as d_dom, {q} as d_qoy, {y} as d_fy_year,
       ({y} - 1900) * 4 + {q} as d_fy_quarter_seq, (d_date_sk + 1) // 7 as d_fy_week_seq,
       {d.pick(DAY_NAMES, 'd_date_sk + 1')} as d_day_name,
       concat(cast({y} as string), 'Q', cast({q} as string)) as d_quarter_name,
       case when {m} = 12 and {dom} = 25 then 'Y' else 'N' end as d_holiday,
       case when (d_date_sk + 1) % 7 in (0, 6) then 'Y' else 'N' end as d_weekend,
       case when {m} = 12 and {dom} = 26 then 'Y' else 'N' end as d_following_holiday,
       d_date_sk - {dom} + 1 as d_first_dom, d_date_sk - {dom} + 28 as d_last_dom,
       d_date_sk - 365 as d_same_day_ly, d_date_sk - 91 as d_same_day_lq,
       'N' as d_current_day, 'N' as d_current_week, 'N' as d_current_month,
       'N' as d_current_quarter, 'N' as d_current_year
from (select {EPOCH_SK} - 34697 + id as d_date_sk, {d.plus_days('id - 34697')} as d_date
      from {d.series(73049)})
"""


def _time_dim(d):
    return f"""
select id as t_time_sk, {_ident('TIME', 'id')} as t_time_id, id as t_time, id // 3600 as t_hour,
       id // 60 % 60 as t_minute, id % 60 as t_second,
       case when id < 43200 then 'AM' else 'PM' end as t_am_pm,
       {d.pick(['third', 'first', 'second'], 'id // 28800')} as t_shift,
       {d.pick(['night', 'morning', 'afternoon', 'evening'], 'id // 21600')} as t_sub_shift,
       case when id // 3600 between 6 and 8 then 'breakfast'
            when id // 3600 between 11 and 13 then 'lunch'
            when id // 3600 between 17 and 20 then 'dinner' end as t_meal_time
from {d.series(86400)}
"""


def _item(d):
    k = "p_partkey"
    cents = f"({k} * 37 % 19000 + 99)"
    cat, cls = f"{k} % 10", f"{k} // 10 % 8"
    brand, manu = f"({k} // 80 + {k}) % 8", f"({k} // 3) % 40 + 1"
    return f"""
select {k} + 1 as i_item_sk, {_ident('ITEM', f'{k} // 2')} as i_item_id,
       case when {k} % 2 = 0 then date'1995-01-01' else date'1998-01-01' end as i_rec_start_date,
       case when {k} % 2 = 0 then date'1997-12-31' end as i_rec_end_date,
       concat('about the ', p_name, ' of kind ', cast({k} // 4 as string)) as i_item_desc,
       {_money(cents, 7)} as i_current_price,
       {_money(f'{cents} * (40 + {k} % 70) // 100', 7)} as i_wholesale_cost,
       {brand} + 1 as i_brand_id, {d.pick(BRANDS, brand)} as i_brand,
       {cls} + 1 as i_class_id, {d.pick(CLASSES, cls)} as i_class,
       {cat} + 1 as i_category_id, {d.pick(CATEGORIES, cat)} as i_category,
       {manu} as i_manufact_id, concat('manufact', cast({manu} as string)) as i_manufact,
       {d.pick(SIZES, f'{k} // 7 + {k} // 31')} as i_size,
       concat('formula', cast({k} % 97 as string)) as i_formulation,
       {d.pick(COLORS, f'{k} * 5 + {k} // 17')} as i_color,
       {d.pick(UNITS, f'{k} // 3 + {k} // 29')} as i_units, 'Unknown' as i_container,
       ({k} // 7) % 20 + 1 as i_manager_id,
       concat('product', cast({k} // 2 as string)) as i_product_name
from src_part
"""


def _customer(d):
    k = "c_custkey"
    return f"""
select {k} + 1 as c_customer_sk, {_ident('CUST', k)} as c_customer_id,
       case when {k} % 29 = 3 then null else {k} * 11 % 5600 + 1 end as c_current_cdemo_sk,
       {k} * 17 % 7200 + 1 as c_current_hdemo_sk, {k} + 1 as c_current_addr_sk,
       {EPOCH_SK} + 30 + {k} % 700 as c_first_shipto_date_sk,
       {EPOCH_SK} + {k} % 700 as c_first_sales_date_sk,
       {d.pick(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Sir', 'Miss'], k)} as c_salutation,
       {d.pick(FIRST_NAMES, k)} as c_first_name,
       case when {k} % 31 = 7 then null else {d.pick(LAST_NAMES, f'{k} // 8')} end as c_last_name,
       case when {k} % 23 = 5 then null when {k} % 3 = 0 then 'N' else 'Y' end
         as c_preferred_cust_flag,
       {k} % 28 + 1 as c_birth_day, {k} // 3 % 12 + 1 as c_birth_month,
       1930 + {k} * 7 % 60 as c_birth_year, {d.pick(COUNTRIES, k)} as c_birth_country,
       concat('login', cast({k} as string)) as c_login,
       concat('user', cast({k} as string), '@example.com') as c_email_address,
       {EPOCH_SK} + {k} % 2000 as c_last_review_date_sk,
       cast({EPOCH_SK} + {k} % 2000 as string) as c_last_review_date
from src_customer
"""


def _address(d, p, n):
    return f"""
       cast({n} % 900 + 1 as string) as {p}street_number,
       {d.pick(['Main', 'Oak', 'Park', 'Elm', 'Lake'], n)} as {p}street_name,
       {d.pick(['St', 'Ave', 'Blvd', 'Ln'], n)} as {p}street_type,
       concat('Suite ', cast({n} % 90 as string)) as {p}suite_number,
       {d.pick(CITIES, f'{n} // 3')} as {p}city, {d.pick(COUNTIES, n)} as {p}county,
       {d.pick(STATES, n)} as {p}state, {d.pick(ZIPS, f'{n} * 3 + {n} // 5')} as {p}zip,
       'United States' as {p}country,
       cast({d.pick(GMT, n)} as decimal(5,2)) as {p}gmt_offset"""


def _customer_address(d):
    return f"""
select c_custkey + 1 as ca_address_sk, {_ident('ADDR', 'c_custkey')} as ca_address_id,
       {_address(d, 'ca_', '(c_custkey + c_nationkey // 5)')},
       {d.pick(['apartment', 'condo', 'single family'], 'c_custkey')} as ca_location_type
from src_customer
"""


def _customer_demographics(d):
    return f"""
select id + 1 as cd_demo_sk, {d.pick(['M', 'F'], 'id')} as cd_gender,
       {d.pick(['M', 'S', 'D', 'W', 'U'], 'id // 2')} as cd_marital_status,
       {d.pick(EDUCATION, 'id // 10')} as cd_education_status,
       (id // 70 % 20 + 1) * 500 as cd_purchase_estimate,
       {d.pick(CREDIT, 'id // 70')} as cd_credit_rating, id // 70 % 7 as cd_dep_count,
       id // 490 % 7 as cd_dep_employed_count, id // 210 % 7 as cd_dep_college_count
from {d.series(5600)}
"""


def _household_demographics(d):
    return f"""
select id + 1 as hd_demo_sk, id % 20 + 1 as hd_income_band_sk,
       {d.pick(BUY_POTENTIAL, 'id // 20')} as hd_buy_potential,
       id // 120 % 10 as hd_dep_count, id // 1200 - 1 as hd_vehicle_count
from {d.series(7200)}
"""


def _income_band(d):
    return f"""
select id + 1 as ib_income_band_sk, case when id = 0 then 0 else id * 10000 + 1 end as ib_lower_bound,
       (id + 1) * 10000 as ib_upper_bound
from {d.series(20)}
"""


def _history(p, k):
    """Two keys share a business key; the older one is closed."""
    return f"""
       case when {k} % 2 = 0 then date'1995-01-01' else date'1998-01-01' end as {p}rec_start_date,
       case when {k} % 2 = 0 then date'1997-12-31' end as {p}rec_end_date"""


def _store(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as s_store_sk, {_ident('STOR', f'{k} // 2')} as s_store_id, {_history('s_', k)},
       case when {k} % 6 = 5 then {EPOCH_SK} + 1000 + {k} % 700 end as s_closed_date_sk,
       {d.pick(STORE_NAMES, k)} as s_store_name, 200 + {k} * 4 % 120 as s_number_employees,
       5000000 + {k} % 500 * 1000 as s_floor_space, '8AM-8PM' as s_hours,
       concat('Manager ', cast({k} as string)) as s_manager, {k} % 10 + 1 as s_market_id,
       'Unknown' as s_geography_class, 'general market' as s_market_desc,
       concat('Market manager ', cast({k} % 10 as string)) as s_market_manager,
       1 as s_division_id, 'Unknown' as s_division_name, 1 as s_company_id,
       'Unknown' as s_company_name, {_address(d, 's_', k)},
       cast({k} % 12 * 0.01 as decimal(5,2)) as s_tax_precentage
from src_supplier
"""


def _warehouse(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as w_warehouse_sk, {_ident('WARE', k)} as w_warehouse_id,
       concat('Warehouse number ', cast({k} as string)) as w_warehouse_name,
       50000 + {k} % 90 * 12345 as w_warehouse_sq_ft, {_address(d, 'w_', k)}
from src_supplier
"""


def _call_center(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as cc_call_center_sk, {_ident('CALL', f'{k} // 2')} as cc_call_center_id,
       {_history('cc_', k)},
       cast(null as bigint) as cc_closed_date_sk, {EPOCH_SK} + {k} % 700 as cc_open_date_sk,
       concat('Center ', cast({k} as string)) as cc_name, 'large' as cc_class,
       100 + {k} % 9 * 50 as cc_employees, 1000 + {k} % 9 * 700 as cc_sq_ft, '8AM-4PM' as cc_hours,
       concat('Boss ', cast({k} as string)) as cc_manager, {k} + 1 as cc_mkt_id,
       'general' as cc_mkt_class, 'calls' as cc_mkt_desc,
       concat('Market boss ', cast({k} as string)) as cc_market_manager, 1 as cc_division,
       'ought' as cc_division_name, 1 as cc_company, 'ought' as cc_company_name,
       {_address(d, 'cc_', k)}, cast({k} % 12 * 0.01 as decimal(5,2)) as cc_tax_percentage
from src_supplier
"""


def _web_site(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as web_site_sk, {_ident('SITE', f'{k} // 2')} as web_site_id, {_history('web_', k)},
       concat('site_', cast({k} // 6 % 5 as string)) as web_name, {EPOCH_SK} + {k} % 700 as web_open_date_sk,
       cast(null as bigint) as web_close_date_sk, 'Unknown' as web_class,
       concat('Webmaster ', cast({k} as string)) as web_manager, {k} % 6 + 1 as web_mkt_id,
       'general' as web_mkt_class, 'web' as web_mkt_desc,
       concat('Web market ', cast({k} % 6 as string)) as web_market_manager,
       {k} % 6 + 1 as web_company_id,
       {d.pick(['pri', 'able', 'ought', 'ese', 'anti', 'cally'], k)} as web_company_name,
       {_address(d, 'web_', k)}, cast({k} % 12 * 0.01 as decimal(5,2)) as web_tax_percentage
from src_supplier
"""


def _web_page(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as wp_web_page_sk, {_ident('PAGE', f'{k} // 2')} as wp_web_page_id,
       {_history('wp_', k)}, {EPOCH_SK} + {k} % 700 as wp_creation_date_sk,
       {EPOCH_SK} + 100 + {k} % 700 as wp_access_date_sk,
       {d.pick(['Y', 'N'], k)} as wp_autogen_flag, {k} + 1 as wp_customer_sk,
       'http://www.example.com' as wp_url,
       {d.pick(['general', 'order', 'welcome', 'ad', 'feedback'], k)} as wp_type,
       5000 + {k} % 25 * 20 as wp_char_count, {k} % 20 + 2 as wp_link_count,
       {k} % 7 as wp_image_count, {k} % 4 as wp_max_ad_count
from src_supplier
"""


def _promotion(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as p_promo_sk, {_ident('PROM', k)} as p_promo_id,
       {EPOCH_SK} + {k} % 700 as p_start_date_sk, {EPOCH_SK} + {k} % 700 + 60 as p_end_date_sk,
       {k} + 1 as p_item_sk, cast(1000 as decimal(15,2)) as p_cost, 1 as p_response_target,
       {d.pick(STORE_NAMES, k)} as p_promo_name, {d.pick(['Y', 'N'], k)} as p_channel_dmail,
       {d.pick(['N', 'N', 'Y'], k)} as p_channel_email, 'N' as p_channel_catalog,
       {d.pick(['N', 'N', 'N', 'Y'], k)} as p_channel_tv, 'N' as p_channel_radio,
       'N' as p_channel_press, {d.pick(['N', 'Y'], k)} as p_channel_event,
       'N' as p_channel_demo, concat('promo ', cast({k} as string)) as p_channel_details,
       'Unknown' as p_purpose, 'N' as p_discount_active
from src_supplier
"""


def _catalog_page(d):
    k = "s_suppkey"
    return f"""
select {k} + 1 as cp_catalog_page_sk, {_ident('CPAG', k)} as cp_catalog_page_id,
       {EPOCH_SK} + {k} % 700 as cp_start_date_sk, {EPOCH_SK} + {k} % 700 + 90 as cp_end_date_sk,
       'DEPARTMENT' as cp_department, {k} // 20 + 1 as cp_catalog_number,
       {k} % 20 + 1 as cp_catalog_page_number, concat('page of ', s_name) as cp_description,
       {d.pick(['bi-annual', 'quarterly', 'monthly'], k)} as cp_type
from src_supplier
"""


def _reason(d):
    return f"""
select n_nationkey + 1 as r_reason_sk, {_ident('REAS', 'n_nationkey')} as r_reason_id,
       concat('reason ', cast(n_nationkey + 1 as string)) as r_reason_desc
from src_nation
"""


def _ship_mode(d):
    k = "n_nationkey"
    return f"""
select {k} + 1 as sm_ship_mode_sk, {_ident('SHIP', k)} as sm_ship_mode_id,
       {d.pick(SHIP_TYPES, k)} as sm_type, {d.pick(['AIR', 'SURFACE', 'SEA'], k)} as sm_code,
       {d.pick(CARRIERS, k)} as sm_carrier, concat('contract', cast({k} as string)) as sm_contract
from src_nation
"""


NEW_ORDER = "(ok + last_order)"  # refresh orders continue after the star's own


def _day_text(d, days, gap):
    """Dates arrive as text; a date lost on export is written as a day before the calendar."""
    return f"case when {gap} then '-4713-11-2' else cast({d.plus_days(days)} as string) end"


def _clock(seconds):
    part = "lpad(cast({0} as string), 2, '0')"
    hms = [part.format(f"{seconds} // 3600"), part.format(f"{seconds} // 60 % 60"),
           part.format(f"{seconds} % 60")]
    return f"concat({hms[0]}, ':', {hms[1]}, ':', {hms[2]})"


def _s_purchase(d):
    return f"""
select {NEW_ORDER} as purc_purchase_id, {_ident('STOR', 'ok // 3 % outlets // 2')} as purc_store_id,
       {_ident('CUST', 'min(ck)')} as purc_customer_id,
       {_day_text(d, 'min(od)', 'ok % 41 = 0')} as purc_purchase_date,
       ok * 61 % 86400 as purc_purchase_time, ok % 9 + 1 as purc_register_id,
       ok % 31 + 1 as purc_clerk_id, 'Unknown' as purc_comment
from lines where {CHANNEL['store']} group by ok, outlets, last_order
"""


def _s_purchase_lineitem(d):
    return f"""
select {NEW_ORDER} as plin_purchase_id, pk + 1 as plin_line_number,
       {_ident('ITEM', 'pk // 2')} as plin_item_id, {_ident('PROM', 'ok % outlets')} as plin_promotion_id,
       qty as plin_quantity, {_money('sale', 7)} as plin_sale_price, {_money('coupon')} as plin_coupon_amt,
       'Unknown' as plin_comment
from lines where {CHANNEL['store']}
"""


def _s_order(p, channel, outlet):
    def table(d):
        return f"""
select {NEW_ORDER} as {p}_order_id, {_ident('CUST', 'min(ck)')} as {p}_bill_customer_id,
       {_ident('CUST', 'min(ck) // 2')} as {p}_ship_customer_id,
       {_day_text(d, 'min(od)', 'ok % 17 = 0')} as {p}_order_date, ok * 61 % 86400 as {p}_order_time,
       {_ident('SHIP', 'ok % 25')} as {p}_ship_mode_id, {outlet}, 'Unknown' as {p}_order_comments
from lines where {CHANNEL[channel]} group by ok, outlets, last_order
"""
    return table


def _s_order_lineitem(p, channel, extra):
    def table(d):
        return f"""
select {NEW_ORDER} as {p}_order_id, pk + 1 as {p}_line_number, {_ident('ITEM', 'pk // 2')} as {p}_item_id,
       {_ident('PROM', 'ok % outlets')} as {p}_promotion_id, qty as {p}_quantity,
       {_money('sale', 7)} as {p}_sales_price, {_money('coupon')} as {p}_coupon_amt,
       {_ident('WARE', 'pk % 5')} as {p}_warehouse_id,
       {_day_text(d, 'sd', 'pk % 19 = 0')} as {p}_ship_date, {extra},
       {_money('list * 5 // 100', 7)} as {p}_ship_cost
from lines where {CHANNEL[channel]}
"""
    return table


def _s_returns(p, channel, order, outlet, customers, credit, extra):
    def table(d):
        cash, rev = "(sale * rqty * 6 // 10)", "(sale * rqty * 3 // 10)"
        return f"""
select {outlet}, {NEW_ORDER} as {order}, pk + 1 as {p}_line_number,
       {_ident('ITEM', 'pk // 2')} as {p}_item_id, {customers},
       {_day_text(d, 'od + ok % 150', 'ok % 29 = 0')} as {p}_return_date,
       {_clock('(ok * 67 % 86400)')} as {p}_return_time, rqty as {p}_return_qty,
       {_money('sale * rqty')} as {p}_return_amt, {_money('sale * rqty * 8 // 100')} as {p}_return_tax,
       {_money('50 + pk % 100')} as {p}_return_fee,
       {_money('list * rqty * 5 // 100')} as {p}_return_ship_cost, {_money(cash)} as {p}_refunded_cash,
       {_money(rev)} as {p}_reversed_charge, {_money(f'sale * rqty - {cash} - {rev}')} as {p}_{credit},
       {_ident('REAS', 'pk % 25')} as {p}_reason_id{extra}
from lines where {CHANNEL[channel]} and flag = 'R'
"""
    return table


def _two_customers(p):
    return (f"{_ident('CUST', 'ck // 2')} as {p}_return_customer_id, "
            f"{_ident('CUST', 'ck')} as {p}_refund_customer_id")


REFRESH = {
    "s_purchase": _s_purchase, "s_purchase_lineitem": _s_purchase_lineitem,
    "s_catalog_order": _s_order("cord", "catalog", f"{_ident('CALL', 'ok % 5 // 2')} as cord_call_center_id"),
    "s_catalog_order_lineitem": _s_order_lineitem(
        "clin", "catalog", "sk // 20 + 1 as clin_catalog_number, sk % 20 + 1 as clin_catalog_page_number"),
    "s_web_order": _s_order("word", "web", f"{_ident('SITE', 'ok // 7 % outlets // 2')} as word_web_site_id"),
    "s_web_order_lineitem": _s_order_lineitem(
        "wlin", "web", f"{_ident('PAGE', 'sk // 2')} as wlin_web_page_id"),
    "s_store_returns": _s_returns(
        "sret", "store", "sret_ticket_number", f"{_ident('STOR', 'ok // 3 % outlets // 2')} as sret_store_id",
        f"{_ident('CUST', 'ck')} as sret_customer_id", "store_credit", ""),
    "s_catalog_returns": _s_returns(
        "cret", "catalog", "cret_order_id", f"{_ident('CALL', 'ok % 5 // 2')} as cret_call_center_id",
        _two_customers("cret"), "merchant_credit", ""),
    "s_web_returns": _s_returns(
        "wret", "web", "wret_order_id", f"{_ident('SITE', 'ok // 7 % outlets // 2')} as wret_web_site_id",
        _two_customers("wret"), "account_credit", f", {_ident('PAGE', 'sk // 2')} as wret_web_page_id"),
}

TABLES = {
    "lines": _lines,
    "store_sales": _store_sales, "catalog_sales": _catalog_sales, "web_sales": _web_sales,
    "store_returns": _store_returns, "catalog_returns": _catalog_returns,
    "web_returns": _web_returns, "inventory": _inventory,
    "date_dim": _date_dim, "time_dim": _time_dim, "item": _item, "customer": _customer,
    "customer_address": _customer_address, "customer_demographics": _customer_demographics,
    "household_demographics": _household_demographics, "income_band": _income_band,
    "store": _store, "warehouse": _warehouse, "call_center": _call_center,
    "web_site": _web_site, "web_page": _web_page, "promotion": _promotion,
    "catalog_page": _catalog_page, "reason": _reason, "ship_mode": _ship_mode, **REFRESH,
}
KEPT = {"order_lines": _order_lines}  # stored for tables that are derived from it
FROM_LINES = {"store_sales", "catalog_sales", "web_sales", "store_returns", "catalog_returns",
              "web_returns", "inventory", *REFRESH}
FACT_DATE = {"store_sales": "ss_sold_date_sk", "catalog_sales": "cs_sold_date_sk",
             "web_sales": "ws_sold_date_sk", "store_returns": "sr_returned_date_sk",
             "catalog_returns": "cr_returned_date_sk", "web_returns": "wr_returned_date_sk",
             "inventory": "inv_date_sk"}


def spark_sql(table: str) -> str:
    """Spark SQL of one star table, or of what is kept for some; sources appear as ``{src_<name>}`` placeholders."""
    d = Spark()
    sql = d.finish((TABLES | KEPT)[table](d))
    return re.sub(r"\bfrom lines\b", "from {lines}", sql)


def oracle_prefix(body: str) -> list[str]:
    """``WITH`` entries for the star tables named in an oracle query, in dependency order.

    The star's ``customer`` shadows the driver's view of that name, so the view is bound to a
    private name first.
    """
    d = Duck()
    used = {t for t in TABLES if re.search(rf"\b{t}\b", body)}
    if used & FROM_LINES:
        used.add("lines")
    entries = []
    if used & {"customer", "customer_address"}:
        entries.append("customer_source as (select * from customer)")
    for table in TABLES:
        if table in used:
            sql = TABLES[table](d).replace("src_customer", "src_customer_source")
            entries.append(f"{table} as ({d.finish(sql).strip()})")
    return entries
