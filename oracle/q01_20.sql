-- name: q01
with per as (select sr_customer_sk cu, sr_store_sk st, sum(sr_return_amt) total
             from store_returns join date_dim on sr_returned_date_sk = d_date_sk and d_year = 1999
             group by all)
select c_customer_id from per
join store on s_store_sk = st and s_state = 'TN'
join customer on c_customer_sk = cu
where total::double > (select sum(o.total)::double / count(o.total) * 1.2 from per o where o.st = per.st)
-- name: q02
with wk as (
  select d_week_seq, sum(p) filter (d_dow = 0) sun, sum(p) filter (d_dow = 1) mon,
         sum(p) filter (d_dow = 2) tue, sum(p) filter (d_dow = 3) wed, sum(p) filter (d_dow = 4) thu,
         sum(p) filter (d_dow = 5) fri, sum(p) filter (d_dow = 6) sat
  from (select ws_sold_date_sk k, ws_ext_sales_price p from web_sales
        union all select cs_sold_date_sk, cs_ext_sales_price from catalog_sales)
  join date_dim on d_date_sk = k group by d_week_seq)
select a.d_week_seq d_week_seq1, round(a.sun::double / b.sun::double, 2) sun_ratio,
  round(a.mon::double / b.mon::double, 2) mon_ratio, round(a.tue::double / b.tue::double, 2) tue_ratio,
  round(a.wed::double / b.wed::double, 2) wed_ratio, round(a.thu::double / b.thu::double, 2) thu_ratio,
  round(a.fri::double / b.fri::double, 2) fri_ratio, round(a.sat::double / b.sat::double, 2) sat_ratio
from wk a join wk b on a.d_week_seq + 53 = b.d_week_seq
join date_dim da on da.d_week_seq = a.d_week_seq and da.d_year = 1999
join date_dim db on db.d_week_seq = b.d_week_seq and db.d_year = 2000
-- name: q03
select d_year, i_brand_id brand_id, i_brand brand, sum(ss_ext_sales_price) sum_agg
from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk
where i_manufact_id = 16 and d_moy = 11 group by all
-- name: q04
with y as (
  select c_customer_id id, c_first_name f, c_last_name l, c_preferred_cust_flag flag, tag, d_year yr,
         sum(v)::double / 2 total
  from (select 's' tag, ss_customer_sk cu, ss_sold_date_sk k, ss_ext_list_price - ss_ext_wholesale_cost - ss_ext_discount_amt + ss_ext_sales_price v from store_sales
        union all select 'c', cs_bill_customer_sk, cs_sold_date_sk, cs_ext_list_price - cs_ext_wholesale_cost - cs_ext_discount_amt + cs_ext_sales_price from catalog_sales
        union all select 'w', ws_bill_customer_sk, ws_sold_date_sk, ws_ext_list_price - ws_ext_wholesale_cost - ws_ext_discount_amt + ws_ext_sales_price from web_sales)
  join customer on c_customer_sk = cu join date_dim on d_date_sk = k
  group by all)
select s2.id customer_id, s2.f customer_first_name, s2.l customer_last_name, s2.flag choice
from y s1 join y s2 on s2.id = s1.id join y c1 on c1.id = s1.id join y c2 on c2.id = s1.id
join y w1 on w1.id = s1.id join y w2 on w2.id = s1.id
where s1.tag = 's' and s2.tag = 's' and c1.tag = 'c' and c2.tag = 'c' and w1.tag = 'w' and w2.tag = 'w'
  and s1.yr = 1998 and c1.yr = 1998 and w1.yr = 1998 and s2.yr = 1999 and c2.yr = 1999 and w2.yr = 1999
  and s1.total > 0 and c1.total > 0 and w1.total > 0
  and c2.total / c1.total > s2.total / s1.total and c2.total / c1.total > w2.total / w1.total
-- name: q05
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
  join web_site on web_site_sk = ws_web_site_sk where wr_returned_date_sk in (from d))
select channel, id, sum(sales) sales, sum(ret) as returns, sum(profit) profit from x group by rollup (channel, id)
-- name: q06
select ca_state state, count(*) cnt
from store_sales join customer on c_customer_sk = ss_customer_sk
join customer_address on ca_address_sk = c_current_addr_sk
join date_dim on d_date_sk = ss_sold_date_sk join item i on i_item_sk = ss_item_sk
where d_month_seq = (select distinct d_month_seq from date_dim where d_year = 1999 and d_moy = 3)
  and i_current_price::double > 1.2::double * (select sum(j.i_current_price)::double / count(*) from item j where j.i_category = i.i_category)
group by ca_state having count(*) >= 10
-- name: q07
select i_item_id, sum(ss_quantity)::double / count(ss_quantity) agg1, sum(ss_list_price)::double / count(ss_list_price) agg2,
  sum(ss_coupon_amt)::double / count(ss_coupon_amt) agg3, sum(ss_sales_price)::double / count(ss_sales_price) agg4
from store_sales join customer_demographics on cd_demo_sk = ss_cdemo_sk join date_dim on d_date_sk = ss_sold_date_sk
join item on i_item_sk = ss_item_sk join promotion on p_promo_sk = ss_promo_sk
where cd_gender = 'M' and cd_marital_status = 'S' and cd_education_status = 'College'
  and (p_channel_email = 'N' or p_channel_event = 'N') and d_year = 1999
group by i_item_id
-- name: q08
with z as (
  select ca_zip[1:5] z from customer_address where ca_zip[1:5] in ('85669','86197','88274','83405','86475','85392','85460','80348','81792','24128','24680','35709','38354','46081')
  intersect
  select ca_zip[1:5] from customer_address join customer on c_current_addr_sk = ca_address_sk
  where c_preferred_cust_flag = 'Y' group by 1 having count(*) > 10)
select s_store_name, sum(ss_net_profit) net_profit
from store_sales join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
join z on s_zip[1:2] = z.z[1:2]
where d_qoy = 2 and d_year = 1999 group by s_store_name
-- name: q09
with b as (select (ss_quantity - 1) // 20 g, count(*) n, sum(ss_ext_discount_amt)::double / count(ss_ext_discount_amt) a,
                  sum(ss_net_paid)::double / count(ss_net_paid) e from store_sales where ss_quantity between 1 and 100 group by 1)
select (select case when n > 9000 then a else e end from b where g = 0) bucket1,
  (select case when n > 10000 then a else e end from b where g = 1) bucket2,
  (select case when n > 9000 then a else e end from b where g = 2) bucket3,
  (select case when n > 10000 then a else e end from b where g = 3) bucket4,
  (select case when n > 9000 then a else e end from b where g = 4) bucket5
from reason where r_reason_sk = 1
-- name: q10
with d as (select d_date_sk k from date_dim where d_year = 1999 and d_moy between 1 and 4)
select cd_gender, cd_marital_status, cd_education_status, count(*) cnt1, cd_purchase_estimate, count(*) cnt2,
  cd_credit_rating, count(*) cnt3, cd_dep_count, count(*) cnt4, cd_dep_employed_count, count(*) cnt5,
  cd_dep_college_count, count(*) cnt6
from customer join customer_address on ca_address_sk = c_current_addr_sk
join customer_demographics on cd_demo_sk = c_current_cdemo_sk
where ca_county in ('Williamson County','Walker County','Ziebach County','Daviess County','Barrow County')
  and c_customer_sk in (select ss_customer_sk from store_sales where ss_sold_date_sk in (from d))
  and (exists (select 1 from web_sales where ws_bill_customer_sk = c_customer_sk and ws_sold_date_sk in (from d))
    or exists (select 1 from catalog_sales where cs_ship_customer_sk = c_customer_sk and cs_sold_date_sk in (from d)))
group by cd_gender, cd_marital_status, cd_education_status, cd_purchase_estimate, cd_credit_rating, cd_dep_count,
  cd_dep_employed_count, cd_dep_college_count
-- name: q11
with y as (
  select c_customer_id id, c_first_name f, c_last_name l, c_email_address e, tag, d_year yr, sum(v)::double total
  from (select 's' tag, ss_customer_sk cu, ss_sold_date_sk k, ss_ext_list_price - ss_ext_discount_amt v from store_sales
        union all select 'w', ws_bill_customer_sk, ws_sold_date_sk, ws_ext_list_price - ws_ext_discount_amt from web_sales)
  join customer on c_customer_sk = cu join date_dim on d_date_sk = k group by all)
select s2.id customer_id, s2.f customer_first_name, s2.l customer_last_name, s2.e choice
from y s1 join y s2 on s2.id = s1.id join y w1 on w1.id = s1.id join y w2 on w2.id = s1.id
where s1.tag = 's' and s2.tag = 's' and w1.tag = 'w' and w2.tag = 'w' and s1.yr = 1998 and w1.yr = 1998
  and s2.yr = 1999 and w2.yr = 1999 and s1.total > 0 and w1.total > 0 and w2.total / w1.total > s2.total / s1.total
-- name: q12
with r as (
  select i_item_id, i_item_desc, i_category, i_class, i_current_price, sum(ws_ext_sales_price) itemrevenue
  from web_sales join item on i_item_sk = ws_item_sk join date_dim on d_date_sk = ws_sold_date_sk
  where i_category in ('Sports','Books','Home') and d_date between date'1999-02-22' and date'1999-02-22' + 30
  group by all)
select *, (itemrevenue * 100)::double / sum(itemrevenue) over (partition by i_class)::double revenueratio from r
-- name: q13
select sum(ss_quantity)::double / count(ss_quantity) avg_quantity,
  sum(ss_ext_sales_price)::double / count(ss_ext_sales_price) avg_ext_sales_price,
  sum(ss_ext_wholesale_cost)::double / count(ss_ext_wholesale_cost) avg_ext_wholesale_cost,
  sum(ss_ext_wholesale_cost) sum_ext_wholesale_cost
from store_sales join store on s_store_sk = ss_store_sk join date_dim on d_date_sk = ss_sold_date_sk
join customer_demographics on cd_demo_sk = ss_cdemo_sk join household_demographics on hd_demo_sk = ss_hdemo_sk
join customer_address on ca_address_sk = ss_addr_sk
where d_year = 2001 and ca_country = 'United States'
  and (cd_marital_status, cd_education_status, hd_dep_count) in (('M','Advanced Degree',3),('S','College',1),('W','2 yr Degree',1))
  and ss_sales_price between case cd_marital_status when 'M' then 100 when 'S' then 50 else 150 end
                         and case cd_marital_status when 'M' then 150 when 'S' then 100 else 200 end
  and (ca_state in ('TN','GA','CA') and ss_net_profit between 100 and 200
    or ca_state in ('WA','TX','OH') and ss_net_profit between 150 and 300
    or ca_state in ('IL','MI','NY') and ss_net_profit between 50 and 250)
-- name: q14
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
select channel, i_brand_id, i_class_id, i_category_id, sum(sales) sales, sum(number_sales) number_sales
from y group by rollup (channel, i_brand_id, i_class_id, i_category_id)
-- name: q14_weeks
with s as (
  select 'store' channel, ss_item_sk it, ss_quantity * ss_list_price v, d_year, d_week_seq from store_sales join date_dim on d_date_sk = ss_sold_date_sk
  union all select 'catalog', cs_item_sk, cs_quantity * cs_list_price, d_year, d_week_seq from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk
  union all select 'web', ws_item_sk, ws_quantity * ws_list_price, d_year, d_week_seq from web_sales join date_dim on d_date_sk = ws_sold_date_sk),
three as (select s.*, i_brand_id, i_class_id, i_category_id from s join item on i_item_sk = it where d_year between 1998 and 2000),
good as (select i_brand_id, i_class_id, i_category_id from three group by all having count(distinct channel) = 3),
y as (select d_week_seq w, i_brand_id b, i_class_id c, i_category_id g, sum(v) sales, count(*) n
      from s join item on i_item_sk = it join good using (i_brand_id, i_class_id, i_category_id)
      where channel = 'store' group by all having sum(v)::double > (select sum(v)::double / count(v) from three))
select 'store' channel, t.b i_brand_id, t.c i_class_id, t.g i_category_id, t.sales, t.n number_sales, l.sales last_sales, l.n last_number_sales
from y t join y l on t.b = l.b and t.c = l.c and t.g = l.g
where t.w = (select d_week_seq from date_dim where d_date = date'1999-12-11')
  and l.w = (select d_week_seq from date_dim where d_date = date'1998-12-11')
-- name: q15
select ca_zip, sum(cs_sales_price) sum_sales_price
from catalog_sales join customer on c_customer_sk = cs_bill_customer_sk
join customer_address on ca_address_sk = c_current_addr_sk join date_dim on d_date_sk = cs_sold_date_sk
where (ca_zip[1:5] in ('85669','86197','88274','83405','86475','85392','85460','80348','81792')
       or ca_state in ('CA','WA','GA') or cs_sales_price > 500) and d_qoy = 2 and d_year = 1999
group by ca_zip
-- name: q16
select count(distinct cs_order_number) order_count, sum(cs_ext_ship_cost) total_shipping_cost, sum(cs_net_profit) total_net_profit
from catalog_sales a join date_dim on d_date_sk = cs_ship_date_sk join customer_address on ca_address_sk = cs_ship_addr_sk
join call_center on cc_call_center_sk = cs_call_center_sk
where d_date between date'1999-02-01' and date'1999-02-01' + 60 and ca_state = 'GA'
  and cc_county in ('Williamson County','Walker County','Ziebach County','Daviess County','Barrow County')
  and exists (select 1 from catalog_sales b where b.cs_order_number = a.cs_order_number and b.cs_warehouse_sk <> a.cs_warehouse_sk)
  and not exists (select 1 from catalog_returns where cr_order_number = a.cs_order_number)
-- name: q17
with m as (
  select i_item_id, i_item_desc, s_state, ss_quantity::double a, sr_return_quantity::double b, cs_quantity::double q
  from store_sales join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk and sr_customer_sk = ss_customer_sk
  join catalog_sales on cs_bill_customer_sk = sr_customer_sk and cs_item_sk = sr_item_sk
  join date_dim d1 on d1.d_date_sk = ss_sold_date_sk and d1.d_quarter_name = '1999Q1'
  join date_dim d2 on d2.d_date_sk = sr_returned_date_sk and d2.d_quarter_name in ('1999Q1','1999Q2','1999Q3')
  join date_dim d3 on d3.d_date_sk = cs_sold_date_sk and d3.d_quarter_name in ('1999Q1','1999Q2','1999Q3')
  join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk)
select i_item_id, i_item_desc, s_state,
  count(a) store_sales_count, avg(a) store_sales_ave, round(stddev_samp(a), 4) store_sales_stdev, round(stddev_samp(a) / avg(a), 4) store_sales_cov,
  count(b) store_returns_count, avg(b) store_returns_ave, round(stddev_samp(b), 4) store_returns_stdev, round(stddev_samp(b) / avg(b), 4) store_returns_cov,
  count(q) catalog_sales_count, avg(q) catalog_sales_ave, round(stddev_samp(q), 4) catalog_sales_stdev, round(stddev_samp(q) / avg(q), 4) catalog_sales_cov
from m group by all
-- name: q18
select i_item_id, ca_country, ca_state, ca_county,
  sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2,
  sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4,
  sum(cs_net_profit)::double / count(cs_net_profit) agg5, sum(c_birth_year)::double / count(c_birth_year) agg6,
  sum(a.cd_dep_count)::double / count(a.cd_dep_count) agg7
from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk join item on i_item_sk = cs_item_sk
join customer_demographics a on a.cd_demo_sk = cs_bill_cdemo_sk join customer on c_customer_sk = cs_bill_customer_sk
join customer_demographics b on b.cd_demo_sk = c_current_cdemo_sk join customer_address on ca_address_sk = c_current_addr_sk
where a.cd_gender = 'M' and a.cd_education_status = 'College' and c_birth_month in (1,3,5,7,9,11) and d_year = 1999
  and ca_state in ('TN','GA','CA','WA','TX','OH','IL')
group by rollup (i_item_id, ca_country, ca_state, ca_county)
-- name: q19
select i_brand_id brand_id, i_brand brand, i_manufact_id, i_manufact, sum(ss_ext_sales_price) ext_price
from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk
join customer on c_customer_sk = ss_customer_sk join customer_address on ca_address_sk = c_current_addr_sk
join store on s_store_sk = ss_store_sk
where i_manager_id = 8 and d_moy = 11 and d_year = 1999 and ca_zip[1:5] <> s_zip[1:5] group by all
-- name: q20
with r as (
  select i_item_id, i_item_desc, i_category, i_class, i_current_price, sum(cs_ext_sales_price) itemrevenue
  from catalog_sales join item on i_item_sk = cs_item_sk join date_dim on d_date_sk = cs_sold_date_sk
  where i_category in ('Sports','Books','Home') and d_date between date'1999-02-22' and date'1999-02-22' + 30
  group by all)
select *, (itemrevenue * 100)::double / sum(itemrevenue) over (partition by i_class)::double revenueratio from r
