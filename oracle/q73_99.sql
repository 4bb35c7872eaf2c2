-- name: q73
select c_last_name, c_first_name, c_salutation, c_preferred_cust_flag, ss_ticket_number, cnt
from (select ss_ticket_number, ss_customer_sk, count(*) cnt from store_sales
      join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
      join household_demographics on hd_demo_sk = ss_hdemo_sk
      where d_dom in (1, 2) and hd_buy_potential in ('>10000', 'Unknown') and hd_vehicle_count > 0
        and hd_dep_count::double / nullif(hd_vehicle_count, 0) > 1 and d_year between 1999 and 2001
        and s_county in ('Williamson County','Walker County','Ziebach County','Daviess County') group by all)
join customer on c_customer_sk = ss_customer_sk where cnt between 1 and 5
-- name: q74
with y as (
  select c_customer_id id, c_first_name f, c_last_name l, tag, d_year yr, sum(v)::double total
  from (select 's' tag, ss_customer_sk cu, ss_sold_date_sk k, ss_net_paid v from store_sales
        union all select 'w', ws_bill_customer_sk, ws_sold_date_sk, ws_net_paid from web_sales)
  join customer on c_customer_sk = cu join date_dim on d_date_sk = k where d_year in (1998, 1999) group by all)
select s2.id customer_id, s2.f customer_first_name, s2.l customer_last_name
from y s1 join y s2 on s2.id = s1.id join y w1 on w1.id = s1.id join y w2 on w2.id = s1.id
where s1.tag = 's' and s2.tag = 's' and w1.tag = 'w' and w2.tag = 'w' and s1.yr = 1998 and w1.yr = 1998
  and s2.yr = 1999 and w2.yr = 1999 and s1.total > 0 and w1.total > 0 and w2.total / w1.total > s2.total / s1.total
-- name: q75
with d as (
  select d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, cs_quantity - coalesce(cr_return_quantity, 0) n, cs_ext_sales_price - coalesce(cr_return_amount, 0) v
  from catalog_sales join item on i_item_sk = cs_item_sk join date_dim on d_date_sk = cs_sold_date_sk
  left join catalog_returns on cr_order_number = cs_order_number and cr_item_sk = cs_item_sk where i_category = 'Books'
  union
  select d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, ss_quantity - coalesce(sr_return_quantity, 0), ss_ext_sales_price - coalesce(sr_return_amt, 0)
  from store_sales join item on i_item_sk = ss_item_sk join date_dim on d_date_sk = ss_sold_date_sk
  left join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk where i_category = 'Books'
  union
  select d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, ws_quantity - coalesce(wr_return_quantity, 0), ws_ext_sales_price - coalesce(wr_return_amt, 0)
  from web_sales join item on i_item_sk = ws_item_sk join date_dim on d_date_sk = ws_sold_date_sk
  left join web_returns on wr_order_number = ws_order_number and wr_item_sk = ws_item_sk where i_category = 'Books'),
s as (select d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, sum(n) n, sum(v) v from d group by all)
select p.d_year prev_year, q.d_year "year", i_brand_id, i_class_id, i_category_id, i_manufact_id,
  p.n prev_yr_cnt, q.n curr_yr_cnt, q.n - p.n sales_cnt_diff, q.v - p.v sales_amt_diff
from s q join s p using (i_brand_id, i_class_id, i_category_id, i_manufact_id)
where q.d_year = 1999 and p.d_year = 1998 and q.n::double / p.n::double < 0.9::double
-- name: q76
select channel, col_name, d_year, d_qoy, i_category, count(*) sales_cnt, sum(v) sales_amt from (
  select 'store' channel, 'ss_store_sk' col_name, ss_sold_date_sk k, ss_item_sk i, ss_ext_sales_price v from store_sales where ss_store_sk is null
  union all select 'web', 'ws_ship_customer_sk', ws_sold_date_sk, ws_item_sk, ws_ext_sales_price from web_sales where ws_ship_customer_sk is null
  union all select 'catalog', 'cs_ship_addr_sk', cs_sold_date_sk, cs_item_sk, cs_ext_sales_price from catalog_sales where cs_ship_addr_sk is null)
join item on i_item_sk = i join date_dim on d_date_sk = k group by all
-- name: q77
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
  union all select 'web channel', k, sales, coalesce(r, 0), p - coalesce(l, 0) from ws left join wr using (k))
select channel, id, sum(sales) sales, sum(r) as returns, sum(p) profit from x group by rollup (channel, id)
-- name: q78
with ss as (select ss_item_sk i, ss_customer_sk u, sum(ss_quantity) q, sum(ss_wholesale_cost) w, sum(ss_sales_price) p
            from store_sales join date_dim on d_date_sk = ss_sold_date_sk left join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk
            where sr_ticket_number is null and d_year = 1999 group by 1, 2),
ws as (select ws_item_sk i, ws_bill_customer_sk u, sum(ws_quantity) q, sum(ws_wholesale_cost) w, sum(ws_sales_price) p
       from web_sales join date_dim on d_date_sk = ws_sold_date_sk left join web_returns on wr_order_number = ws_order_number and wr_item_sk = ws_item_sk
       where wr_order_number is null and d_year = 1999 group by 1, 2),
cs as (select cs_item_sk i, cs_bill_customer_sk u, sum(cs_quantity) q, sum(cs_wholesale_cost) w, sum(cs_sales_price) p
       from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk left join catalog_returns on cr_order_number = cs_order_number and cr_item_sk = cs_item_sk
       where cr_order_number is null and d_year = 1999 group by 1, 2)
select 1999 ss_sold_year, ss.i ss_item_sk, ss.u ss_customer_sk, round(ss.q::double / coalesce(ws.q + cs.q, 1)::double, 2) ratio,
  ss.q store_qty, ss.w store_wholesale_cost, ss.p store_sales_price, coalesce(ws.q, 0) + coalesce(cs.q, 0) other_chan_qty,
  coalesce(ws.w, 0) + coalesce(cs.w, 0) other_chan_wholesale_cost, coalesce(ws.p, 0) + coalesce(cs.p, 0) other_chan_sales_price
from ss left join ws on ws.i = ss.i and ws.u = ss.u left join cs on cs.i = ss.i and cs.u = ss.u
where coalesce(ws.q, 0) > 0 and coalesce(cs.q, 0) > 0
-- name: q79
select c_last_name, c_first_name, s_city[1:30] city, ss_ticket_number, amt, profit
from (select ss_ticket_number, ss_customer_sk, s_city, sum(ss_coupon_amt) amt, sum(ss_net_profit) profit
      from store_sales join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
      join household_demographics on hd_demo_sk = ss_hdemo_sk
      where (hd_dep_count = 6 or hd_vehicle_count > 2) and d_dow = 1 and d_year in (1998, 1999, 2000) and s_number_employees between 200 and 295
      group by ss_ticket_number, ss_customer_sk, ss_addr_sk, s_city)
join customer on c_customer_sk = ss_customer_sk
-- name: q80
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
  where ws_sold_date_sk in (from d) and ws_item_sk in (from i) and ws_promo_sk in (from p))
select channel, id, sum(sales) sales, sum(ret) as returns, sum(profit) profit from x group by rollup (channel, id)
-- name: q81
with r as (select cr_returning_customer_sk cu, ca_state st, sum(cr_return_amt_inc_tax) total
           from catalog_returns join date_dim on d_date_sk = cr_returned_date_sk
           join customer_address on ca_address_sk = cr_returning_addr_sk where d_year = 1999 group by all),
a as (select st, sum(total)::double / count(total) * 1.2 bar from r group by st)
select c_customer_id, c_salutation, c_first_name, c_last_name, ca_street_number, ca_street_name, ca_street_type, ca_suite_number,
  ca_city, ca_county, ca_state, ca_zip, ca_country, ca_gmt_offset, ca_location_type, total ctr_total_return
from r join a using (st) join customer on c_customer_sk = cu join customer_address on ca_address_sk = c_current_addr_sk
where ca_state = 'CA' and total::double > bar
-- name: q82
select distinct i_item_id, i_item_desc, i_current_price from item
where i_current_price between 30 and 60 and i_manufact_id in (4, 9, 17, 28)
  and i_item_sk in (select inv_item_sk from inventory join date_dim on d_date_sk = inv_date_sk
                    where d_date between date'1999-05-25' and date'1999-05-25' + 60 and inv_quantity_on_hand between 100 and 500)
  and i_item_sk in (select ss_item_sk from store_sales)
-- name: q83
with d as (select d_date_sk from date_dim where d_week_seq in (select d_week_seq from date_dim where d_date in (date'1999-06-30', date'1999-09-27', date'1999-11-17'))),
a as (select i_item_id, sum(sr_return_quantity)::double v from store_returns join item on i_item_sk = sr_item_sk where sr_returned_date_sk in (from d) group by 1),
b as (select i_item_id, sum(cr_return_quantity)::double v from catalog_returns join item on i_item_sk = cr_item_sk where cr_returned_date_sk in (from d) group by 1),
w as (select i_item_id, sum(wr_return_quantity)::double v from web_returns join item on i_item_sk = wr_item_sk where wr_returned_date_sk in (from d) group by 1)
select i_item_id item_id, a.v sr_item_qty, a.v / (a.v + b.v + w.v) / 3 * 100 sr_dev, b.v cr_item_qty, b.v / (a.v + b.v + w.v) / 3 * 100 cr_dev,
  w.v wr_item_qty, w.v / (a.v + b.v + w.v) / 3 * 100 wr_dev, (a.v + b.v + w.v) / 3 average
from a join b using (i_item_id) join w using (i_item_id)
-- name: q84
select c_customer_id customer_id, ifnull(c_last_name, '') || ', ' || ifnull(c_first_name, '') customername
from customer join customer_address on ca_address_sk = c_current_addr_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk
join household_demographics on hd_demo_sk = c_current_hdemo_sk join income_band on ib_income_band_sk = hd_income_band_sk
join store_returns on sr_cdemo_sk = cd_demo_sk
where ca_city = 'Midway' and ib_lower_bound >= 38128 and ib_upper_bound <= 88128
-- name: q85
select r_reason_desc[1:20] reason, sum(ws_quantity)::double / count(ws_quantity) avg_quantity,
  sum(wr_refunded_cash)::double / count(wr_refunded_cash) avg_refunded_cash, sum(wr_fee)::double / count(wr_fee) avg_fee
from web_sales join web_returns on wr_item_sk = ws_item_sk and wr_order_number = ws_order_number
join web_page on wp_web_page_sk = ws_web_page_sk join date_dim on d_date_sk = ws_sold_date_sk
join customer_demographics a on a.cd_demo_sk = wr_refunded_cdemo_sk join customer_demographics b on b.cd_demo_sk = wr_returning_cdemo_sk
  and b.cd_marital_status = a.cd_marital_status and b.cd_education_status = a.cd_education_status
join customer_address on ca_address_sk = wr_refunded_addr_sk join reason on r_reason_sk = wr_reason_sk
where d_year = 1999 and ca_country = 'United States'
  and (a.cd_marital_status = 'M' and a.cd_education_status = 'Advanced Degree' and ws_sales_price between 100 and 150
    or a.cd_marital_status = 'S' and a.cd_education_status = 'College' and ws_sales_price between 50 and 100
    or a.cd_marital_status = 'W' and a.cd_education_status = '2 yr Degree' and ws_sales_price between 150 and 200)
  and (ca_state in ('TN','GA','CA') and ws_net_profit between 100 and 200
    or ca_state in ('WA','TX','OH') and ws_net_profit between 150 and 300
    or ca_state in ('IL','MI','NY') and ws_net_profit between 50 and 250)
group by r_reason_desc
-- name: q86
with g as (select sum(ws_net_paid) total_sum, i_category, i_class, grouping(i_category) + grouping(i_class) lochierarchy
           from web_sales join date_dim on d_date_sk = ws_sold_date_sk join item on i_item_sk = ws_item_sk
           where d_month_seq between 1188 and 1199 group by rollup (i_category, i_class))
select *, if(lochierarchy = 0, i_category, null) _parent,
  rank() over (partition by lochierarchy, if(lochierarchy = 0, i_category, null) order by total_sum desc) rank_within_parent from g
-- name: q87
with d as (select d_date_sk, d_date from date_dim where d_month_seq between 1188 and 1199)
select count(*) cnt from (
  (select c_last_name, c_first_name, d_date from store_sales join d on d_date_sk = ss_sold_date_sk join customer on c_customer_sk = ss_customer_sk
   except select c_last_name, c_first_name, d_date from catalog_sales join d on d_date_sk = cs_sold_date_sk join customer on c_customer_sk = cs_bill_customer_sk)
  except select c_last_name, c_first_name, d_date from web_sales join d on d_date_sk = ws_sold_date_sk join customer on c_customer_sk = ws_bill_customer_sk)
-- name: q88
with r as (select t_hour h, t_minute m from store_sales join time_dim on t_time_sk = ss_sold_time_sk
           join household_demographics on hd_demo_sk = ss_hdemo_sk join store on s_store_sk = ss_store_sk
           where s_store_name = 'ese' and (hd_dep_count = 3 and hd_vehicle_count <= 5 or hd_dep_count = 0 and hd_vehicle_count <= 2
             or hd_dep_count = 1 and hd_vehicle_count <= 3))
select count(*) filter (h = 8 and m >= 30) h8_30_to_9, count(*) filter (h = 9 and m < 30) h9_to_9_30,
  count(*) filter (h = 9 and m >= 30) h9_30_to_10, count(*) filter (h = 10 and m < 30) h10_to_10_30,
  count(*) filter (h = 10 and m >= 30) h10_30_to_11, count(*) filter (h = 11 and m < 30) h11_to_11_30,
  count(*) filter (h = 11 and m >= 30) h11_30_to_12, count(*) filter (h = 12 and m < 30) h12_to_12_30 from r
-- name: q89
with m as (
  select i_category, i_class, i_brand, s_store_name, s_company_name, d_moy, sum(ss_sales_price) sum_sales
  from store_sales join item on i_item_sk = ss_item_sk join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
  where d_year = 1999 and (i_category in ('Books','Electronics','Sports') and i_class in ('personal','portable','reference')
    or i_category in ('Men','Jewelry','Women') and i_class in ('accessories','classical','pants')) group by all),
a as (select *, sum(sum_sales) over w::double / count(*) over w avg_monthly_sales from m
      window w as (partition by i_category, i_brand, s_store_name, s_company_name))
select *, sum_sales::double - avg_monthly_sales _gap from a
where avg_monthly_sales <> 0 and abs(sum_sales::double - avg_monthly_sales) / avg_monthly_sales > 0.1::double
-- name: q90
select (count(*) filter (t_hour in (8, 9)))::double / nullif(count(*) filter (t_hour in (19, 20)), 0)::double am_pm_ratio
from web_sales join time_dim on t_time_sk = ws_sold_time_sk join household_demographics on hd_demo_sk = ws_ship_hdemo_sk
join web_page on wp_web_page_sk = ws_web_page_sk where hd_dep_count = 6 and wp_char_count between 5000 and 5200
-- name: q91
select cc_call_center_id call_center, cc_name call_center_name, cc_manager manager, sum(cr_net_loss) returns_loss
from catalog_returns join call_center on cc_call_center_sk = cr_call_center_sk join date_dim on d_date_sk = cr_returned_date_sk
join customer on c_customer_sk = cr_returning_customer_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk
join household_demographics on hd_demo_sk = c_current_hdemo_sk join customer_address on ca_address_sk = c_current_addr_sk
where d_year = 1999 and d_moy = 12 and (cd_marital_status, cd_education_status) in (('M','Unknown'), ('W','Advanced Degree'))
  and hd_buy_potential like '0-500%' and ca_gmt_offset = -7
group by cc_call_center_id, cc_name, cc_manager, cd_marital_status, cd_education_status
-- name: q92
with s as (select ws_item_sk it, ws_ext_discount_amt v from web_sales join date_dim on d_date_sk = ws_sold_date_sk
           where d_date between date'1999-01-07' and date'1999-01-07' + 90)
select sum(v) excess_discount_amount from s join item on i_item_sk = it
where i_manufact_id = 16 and v::double > (select sum(o.v)::double / count(o.v) * 1.3 from s o where o.it = s.it)
-- name: q93
select ss_customer_sk, sum(case when sr_return_quantity is not null then (ss_quantity - sr_return_quantity) * ss_sales_price
                                else ss_quantity * ss_sales_price end) sumsales
from store_sales left join store_returns on sr_item_sk = ss_item_sk and sr_ticket_number = ss_ticket_number
join reason on r_reason_sk = sr_reason_sk where r_reason_desc = 'reason 7' group by 1
-- name: q94
select count(distinct ws_order_number) order_count, sum(ws_ext_ship_cost) total_shipping_cost, sum(ws_net_profit) total_net_profit
from web_sales a join date_dim on d_date_sk = ws_ship_date_sk join customer_address on ca_address_sk = ws_ship_addr_sk
join web_site on web_site_sk = ws_web_site_sk
where d_date between date'1999-02-01' and date'1999-02-01' + 60 and ca_state = 'GA' and web_company_name = 'pri'
  and exists (select 1 from web_sales b where b.ws_order_number = a.ws_order_number and b.ws_warehouse_sk <> a.ws_warehouse_sk)
  and not exists (select 1 from web_returns where wr_order_number = a.ws_order_number)
-- name: q95
with multi as (select a.ws_order_number o from web_sales a join web_sales b on a.ws_order_number = b.ws_order_number and a.ws_warehouse_sk <> b.ws_warehouse_sk)
select count(distinct ws_order_number) order_count, sum(ws_ext_ship_cost) total_shipping_cost, sum(ws_net_profit) total_net_profit
from web_sales join date_dim on d_date_sk = ws_ship_date_sk join customer_address on ca_address_sk = ws_ship_addr_sk
join web_site on web_site_sk = ws_web_site_sk
where d_date between date'1999-02-01' and date'1999-02-01' + 60 and ca_state = 'GA' and web_company_name = 'pri'
  and ws_order_number in (select o from multi) and ws_order_number in (select wr_order_number from web_returns join multi on o = wr_order_number)
-- name: q96
select count(*) cnt from store_sales join time_dim on t_time_sk = ss_sold_time_sk join household_demographics on hd_demo_sk = ss_hdemo_sk
join store on s_store_sk = ss_store_sk where t_hour = 20 and t_minute >= 30 and hd_dep_count = 7 and s_store_name = 'ese'
-- name: q97
with s as (select distinct ss_customer_sk u, ss_item_sk i from store_sales join date_dim on d_date_sk = ss_sold_date_sk where d_month_seq between 1188 and 1199),
c as (select distinct cs_bill_customer_sk u, cs_item_sk i from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk where d_month_seq between 1188 and 1199)
select count(*) filter (s.u is not null and c.u is null) store_only, count(*) filter (s.u is null and c.u is not null) catalog_only,
  count(*) filter (s.u is not null and c.u is not null) store_and_catalog
from s full join c on s.u = c.u and s.i = c.i
-- name: q98
with r as (
  select i_item_id, i_item_desc, i_category, i_class, i_current_price, sum(ss_ext_sales_price) itemrevenue
  from store_sales join item on i_item_sk = ss_item_sk join date_dim on d_date_sk = ss_sold_date_sk
  where i_category in ('Sports','Books','Home') and d_date between date'1999-02-22' and date'1999-02-22' + 30 group by all)
select *, (itemrevenue * 100)::double / sum(itemrevenue) over (partition by i_class)::double revenueratio from r
-- name: q99
with r as (select *, cs_ship_date_sk - cs_sold_date_sk n from catalog_sales)
select w_warehouse_name[1:20] warehouse, sm_type, cc_name,
  count(*) filter (n <= 30) d30, count(*) filter (n > 30 and n <= 60) d60, count(*) filter (n > 60 and n <= 90) d90,
  count(*) filter (n > 90 and n <= 120) d120, count(*) filter (n > 120) more
from r join date_dim on d_date_sk = cs_ship_date_sk join warehouse on w_warehouse_sk = cs_warehouse_sk
join ship_mode on sm_ship_mode_sk = cs_ship_mode_sk join call_center on cc_call_center_sk = cs_call_center_sk
where d_month_seq between 1188 and 1199 group by all
