-- name: q05a
with d as (select d_date_sk k from date_dim where d_date between date'1999-08-04' and date'1999-08-04' + 14),
x as (
  select 'store channel' channel, 'store' || s_store_id id, ss_ext_sales_price sales, 0 ret, ss_net_profit profit
  from store_sales join store on s_store_sk = ss_store_sk where ss_sold_date_sk in (from d)
  union all select 'store channel', 'store' || s_store_id, 0, sr_return_amt, -sr_net_loss
  from store_returns join store on s_store_sk = sr_store_sk where sr_returned_date_sk in (from d)
  union all select 'catalog channel', 'catalog_page' || cp_catalog_page_id, cs_ext_sales_price, 0, cs_net_profit
  from catalog_sales join catalog_page on cp_catalog_page_sk = cs_catalog_page_sk where cs_sold_date_sk in (from d)
  union all select 'catalog channel', 'catalog_page' || cp_catalog_page_id, 0, cr_return_amount, -cr_net_loss
  from catalog_returns join catalog_page on cp_catalog_page_sk = cr_catalog_page_sk where cr_returned_date_sk in (from d)
  union all select 'web channel', 'web_site' || web_site_id, ws_ext_sales_price, 0, ws_net_profit
  from web_sales join web_site on web_site_sk = ws_web_site_sk where ws_sold_date_sk in (from d)
  union all select 'web channel', 'web_site' || web_site_id, 0, wr_return_amt, -wr_net_loss
  from web_returns join web_sales on ws_item_sk = wr_item_sk and ws_order_number = wr_order_number
  join web_site on web_site_sk = ws_web_site_sk where wr_returned_date_sk in (from d)),
r as (select channel, id, sum(sales) sales, sum(ret) ret, sum(profit) profit from x group by channel, id)
select channel, id, sales, ret as returns, profit from r
union all select channel, null, sum(sales), sum(ret), sum(profit) from r group by channel
union all select null, null, sum(sales), sum(ret), sum(profit) from r
-- name: q80a
with d as (select d_date_sk from date_dim where d_date between date'1999-08-04' and date'1999-08-04' + 30),
i as (select i_item_sk from item where i_current_price > 50), p as (select p_promo_sk from promotion where p_channel_tv = 'N'),
x as (
  select 'store channel' channel, 'store' || s_store_id id, ss_ext_sales_price sales, coalesce(sr_return_amt, 0) ret, ss_net_profit - coalesce(sr_net_loss, 0) profit
  from store_sales left join store_returns on sr_item_sk = ss_item_sk and sr_ticket_number = ss_ticket_number join store on s_store_sk = ss_store_sk
  where ss_sold_date_sk in (from d) and ss_item_sk in (from i) and ss_promo_sk in (from p)
  union all
  select 'catalog channel', 'catalog_page' || cp_catalog_page_id, cs_ext_sales_price, coalesce(cr_return_amount, 0), cs_net_profit - coalesce(cr_net_loss, 0)
  from catalog_sales left join catalog_returns on cr_item_sk = cs_item_sk and cr_order_number = cs_order_number join catalog_page on cp_catalog_page_sk = cs_catalog_page_sk
  where cs_sold_date_sk in (from d) and cs_item_sk in (from i) and cs_promo_sk in (from p)
  union all
  select 'web channel', 'web_site' || web_site_id, ws_ext_sales_price, coalesce(wr_return_amt, 0), ws_net_profit - coalesce(wr_net_loss, 0)
  from web_sales left join web_returns on wr_item_sk = ws_item_sk and wr_order_number = ws_order_number join web_site on web_site_sk = ws_web_site_sk
  where ws_sold_date_sk in (from d) and ws_item_sk in (from i) and ws_promo_sk in (from p)),
r as (select channel, id, sum(sales) sales, sum(ret) ret, sum(profit) profit from x group by channel, id)
select channel, id, sales, ret as returns, profit from r
union all select channel, null, sum(sales), sum(ret), sum(profit) from r group by channel
union all select null, null, sum(sales), sum(ret), sum(profit) from r
-- name: q77a
with d as (select d_date_sk from date_dim where d_date between date'1999-08-04' and date'1999-08-04' + 30),
ss as (select ss_store_sk k, sum(ss_ext_sales_price) sales, sum(ss_net_profit) p from store_sales join store on s_store_sk = ss_store_sk where ss_sold_date_sk in (from d) group by 1),
sr as (select sr_store_sk k, sum(sr_return_amt) r, sum(sr_net_loss) l from store_returns join store on s_store_sk = sr_store_sk where sr_returned_date_sk in (from d) group by 1),
cs as (select cs_call_center_sk k, sum(cs_ext_sales_price) sales, sum(cs_net_profit) p from catalog_sales where cs_sold_date_sk in (from d) group by 1),
cr as (select cr_call_center_sk k, sum(cr_return_amount) r, sum(cr_net_loss) l from catalog_returns where cr_returned_date_sk in (from d) group by 1),
ws as (select ws_web_page_sk k, sum(ws_ext_sales_price) sales, sum(ws_net_profit) p from web_sales join web_page on wp_web_page_sk = ws_web_page_sk where ws_sold_date_sk in (from d) group by 1),
wr as (select wr_web_page_sk k, sum(wr_return_amt) r, sum(wr_net_loss) l from web_returns join web_page on wp_web_page_sk = wr_web_page_sk where wr_returned_date_sk in (from d) group by 1),
x as (
  select 'store channel' channel, k id, sales, coalesce(r, 0) r, p - coalesce(l, 0) p from ss left join sr using (k)
  union all select 'catalog channel', cs.k, sales, r, p - l from cs cross join cr
  union all select 'web channel', k, sales, coalesce(r, 0), p - coalesce(l, 0) from ws left join wr using (k)),
r as (select channel, id, sum(sales) sales, sum(r) ret, sum(p) profit from x group by channel, id)
select channel, id, sales, ret as returns, profit from r
union all select channel, null, sum(sales), sum(ret), sum(profit) from r group by channel
union all select null, null, sum(sales), sum(ret), sum(profit) from r
-- name: q14a
with s as (
  select 'store' channel, ss_item_sk it, ss_quantity * ss_list_price v, d_year, d_moy from store_sales join date_dim on d_date_sk = ss_sold_date_sk
  union all select 'catalog', cs_item_sk, cs_quantity * cs_list_price, d_year, d_moy from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk
  union all select 'web', ws_item_sk, ws_quantity * ws_list_price, d_year, d_moy from web_sales join date_dim on d_date_sk = ws_sold_date_sk),
three as (select s.*, i_brand_id, i_class_id, i_category_id from s join item on i_item_sk = it where d_year between 1998 and 2000),
good as (select i_brand_id, i_class_id, i_category_id from three group by all having count(distinct channel) = 3),
a as (select sum(v)::double / count(v) m from three),
y as (select channel, i_brand_id, i_class_id, i_category_id, sum(v) sales, count(*) number_sales
      from three join good using (i_brand_id, i_class_id, i_category_id)
      where d_year = 2000 and d_moy = 11 group by all having sum(v)::double > (select m from a))
select channel, i_brand_id, i_class_id, i_category_id, sum(sales) sum_sales, sum(number_sales) number_sales from y
group by rollup (channel, i_brand_id, i_class_id, i_category_id)
-- name: q18a
with rows_ as (select i_item_id, ca_country, ca_state, ca_county, cs_quantity, cs_list_price, cs_coupon_amt, cs_sales_price, cs_net_profit, c_birth_year, a.cd_dep_count dep
from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk join item on i_item_sk = cs_item_sk
join customer_demographics a on a.cd_demo_sk = cs_bill_cdemo_sk join customer on c_customer_sk = cs_bill_customer_sk
join customer_demographics b on b.cd_demo_sk = c_current_cdemo_sk join customer_address on ca_address_sk = c_current_addr_sk
where a.cd_gender = 'M' and a.cd_education_status = 'College' and c_birth_month in (1,3,5,7,9,11) and d_year = 1999
  and ca_state in ('TN','GA','CA','WA','TX','OH','IL'))
select i_item_id, ca_country, ca_state, ca_county, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2, sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4, sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6, sum(dep)::double / count(dep) agg7 from rows_ group by i_item_id, ca_country, ca_state, ca_county
union all select i_item_id, ca_country, ca_state, null as ca_county, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2, sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4, sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6, sum(dep)::double / count(dep) agg7 from rows_ group by i_item_id, ca_country, ca_state
union all select i_item_id, ca_country, null as ca_state, null as ca_county, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2, sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4, sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6, sum(dep)::double / count(dep) agg7 from rows_ group by i_item_id, ca_country
union all select i_item_id, null as ca_country, null as ca_state, null as ca_county, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2, sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4, sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6, sum(dep)::double / count(dep) agg7 from rows_ group by i_item_id
union all select null as i_item_id, null as ca_country, null as ca_state, null as ca_county, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2, sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4, sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6, sum(dep)::double / count(dep) agg7 from rows_
-- name: q22a
with rows_ as (select i_product_name, i_brand, i_class, i_category, inv_quantity_on_hand v
from inventory join date_dim on d_date_sk = inv_date_sk join warehouse on w_warehouse_sk = inv_warehouse_sk join item on i_item_sk = inv_item_sk
where d_month_seq between 1188 and 1199)
select i_product_name, i_brand, i_class, i_category, sum(v)::double / count(v) qoh from rows_ group by i_product_name, i_brand, i_class, i_category
union all select i_product_name, i_brand, i_class, null as i_category, sum(v)::double / count(v) qoh from rows_ group by i_product_name, i_brand, i_class
union all select i_product_name, i_brand, null as i_class, null as i_category, sum(v)::double / count(v) qoh from rows_ group by i_product_name, i_brand
union all select i_product_name, null as i_brand, null as i_class, null as i_category, sum(v)::double / count(v) qoh from rows_ group by i_product_name
union all select null as i_product_name, null as i_brand, null as i_class, null as i_category, sum(v)::double / count(v) qoh from rows_
-- name: q27a
with rows_ as (select i_item_id, s_state, ss_quantity, ss_list_price, ss_coupon_amt, ss_sales_price
from store_sales join customer_demographics on cd_demo_sk = ss_cdemo_sk join date_dim on d_date_sk = ss_sold_date_sk
join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
where cd_gender = 'M' and cd_marital_status = 'S' and cd_education_status = 'College' and d_year = 1999
  and s_state in ('TN','GA','CA','WA','TX','OH'))
select i_item_id, s_state, 0 g_state, sum(ss_quantity)::double / count(ss_quantity) agg1, sum(ss_list_price)::double / count(ss_list_price) agg2, sum(ss_coupon_amt)::double / count(ss_coupon_amt) agg3, sum(ss_sales_price)::double / count(ss_sales_price) agg4 from rows_ group by i_item_id, s_state
union all select i_item_id, null as s_state, 1 g_state, sum(ss_quantity)::double / count(ss_quantity) agg1, sum(ss_list_price)::double / count(ss_list_price) agg2, sum(ss_coupon_amt)::double / count(ss_coupon_amt) agg3, sum(ss_sales_price)::double / count(ss_sales_price) agg4 from rows_ group by i_item_id
union all select null as i_item_id, null as s_state, 1 g_state, sum(ss_quantity)::double / count(ss_quantity) agg1, sum(ss_list_price)::double / count(ss_list_price) agg2, sum(ss_coupon_amt)::double / count(ss_coupon_amt) agg3, sum(ss_sales_price)::double / count(ss_sales_price) agg4 from rows_
-- name: q36a
with rows_ as (
select i_category, i_class, ss_net_profit p, ss_ext_sales_price e from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk join store on s_store_sk = ss_store_sk
  where d_year = 1999 and s_state in ('TN','GA','CA','WA','TX','OH','IL','MI')),
g as (
select i_category, i_class, 0 lochierarchy, sum(p)::double / sum(e)::double gross_margin from rows_ group by i_category, i_class
union all select i_category, null as i_class, 1 lochierarchy, sum(p)::double / sum(e)::double gross_margin from rows_ group by i_category
union all select null as i_category, null as i_class, 2 lochierarchy, sum(p)::double / sum(e)::double gross_margin from rows_)
select *, if(lochierarchy = 0, i_category, null) _parent,
  rank() over (partition by lochierarchy, if(lochierarchy = 0, i_category, null) order by gross_margin nulls first) rank_within_parent from g
-- name: q86a
with rows_ as (
select i_category, i_class, ws_net_paid v from web_sales join date_dim on d_date_sk = ws_sold_date_sk join item on i_item_sk = ws_item_sk
           where d_month_seq between 1188 and 1199),
g as (
select i_category, i_class, 0 lochierarchy, sum(v) total_sum from rows_ group by i_category, i_class
union all select i_category, null as i_class, 1 lochierarchy, sum(v) total_sum from rows_ group by i_category
union all select null as i_category, null as i_class, 2 lochierarchy, sum(v) total_sum from rows_)
select *, if(lochierarchy = 0, i_category, null) _parent,
  rank() over (partition by lochierarchy, if(lochierarchy = 0, i_category, null) order by total_sum desc) rank_within_parent from g
-- name: q70a
with rows_ as (
select s_state, s_county, ss_net_profit v from store_sales join date_dim on d_date_sk = ss_sold_date_sk
  join store on s_store_sk = ss_store_sk where d_month_seq between 1188 and 1199 and s_state is not null),
g as (
select s_state, s_county, 0 lochierarchy, sum(v) total_sum from rows_ group by s_state, s_county
union all select s_state, null as s_county, 1 lochierarchy, sum(v) total_sum from rows_ group by s_state
union all select null as s_state, null as s_county, 2 lochierarchy, sum(v) total_sum from rows_)
select *, if(lochierarchy = 0, s_state, null) _parent,
  rank() over (partition by lochierarchy, if(lochierarchy = 0, s_state, null) order by total_sum desc) rank_within_parent from g
-- name: q67a
with days as (select d_date_sk, d_year, d_qoy, d_moy from date_dim where d_month_seq // 12 = 99),
sold as (
  select store_sales.ss_quantity * ss_sales_price as worth, i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy, s_store_id
  from store_sales join days on ss_sold_date_sk = d_date_sk join store on ss_store_sk = s_store_sk join item on ss_item_sk = i_item_sk),
sums as (select i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy, s_store_id, coalesce(sum(worth), 0) as sumsales from sold
  group by grouping sets ((i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy, s_store_id), (i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy), (i_category, i_class, i_brand, i_product_name, d_year, d_qoy), (i_category, i_class, i_brand, i_product_name, d_year), (i_category, i_class, i_brand, i_product_name), (i_category, i_class, i_brand), (i_category, i_class), (i_category), ()))
select *, 1 + count(*) over (partition by i_category order by sumsales desc groups between unbounded preceding and 1 preceding) as rk from sums qualify rk <= 100
-- name: q51a
with w as (select ws_item_sk item_sk, d_date, sum(ws_sales_price) v, row_number() over (partition by ws_item_sk order by d_date) rk
  from web_sales join date_dim on d_date_sk = ws_sold_date_sk where d_month_seq between 1188 and 1199 group by 1, 2),
s as (select ss_item_sk item_sk, d_date, sum(ss_sales_price) v, row_number() over (partition by ss_item_sk order by d_date) rk
  from store_sales join date_dim on d_date_sk = ss_sold_date_sk where d_month_seq between 1188 and 1199 group by 1, 2),
wc as (select x.item_sk, x.d_date, sum(y.v) cume from w x join w y on y.item_sk = x.item_sk and y.rk <= x.rk group by 1, 2),
sc as (select x.item_sk, x.d_date, sum(y.v) cume from s x join s y on y.item_sk = x.item_sk and y.rk <= x.rk group by 1, 2),
v as (select coalesce(wc.item_sk, sc.item_sk) item_sk, coalesce(wc.d_date, sc.d_date) d_date, wc.cume web_sales, sc.cume store_sales
  from wc full join sc on wc.item_sk = sc.item_sk and wc.d_date = sc.d_date)
select x.item_sk, x.d_date, x.web_sales, x.store_sales, max(y.web_sales) web_cumulative, max(y.store_sales) store_cumulative
from v x join v y on y.item_sk = x.item_sk and y.d_date <= x.d_date group by 1, 2, 3, 4 having max(y.web_sales) > max(y.store_sales)
-- name: q47_by_brand
{{q47}}
-- name: q47_by_store
{{q47}}
-- name: q57_by_center
{{q57}}
-- name: q78_by_customer
{{q78}}
-- name: q05_nulls_last
{{q05}}
