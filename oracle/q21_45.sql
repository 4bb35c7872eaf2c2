-- name: q21
select * from (
  select w_warehouse_name, i_item_id,
    sum(if(d_date < date'2000-07-05', inv_quantity_on_hand, 0)) inv_before,
    sum(if(d_date >= date'2000-07-05', inv_quantity_on_hand, 0)) inv_after
  from inventory join warehouse on w_warehouse_sk = inv_warehouse_sk join item on i_item_sk = inv_item_sk
  join date_dim on d_date_sk = inv_date_sk
  where i_current_price between 0.99 and 1.49 and abs(d_date - date'2000-07-05') <= 30 group by all)
where inv_before > 0 and inv_after::double / inv_before::double between 2.0::double / 3.0::double and 1.5::double
-- name: q22
select i_product_name, i_brand, i_class, i_category, sum(inv_quantity_on_hand)::double / count(inv_quantity_on_hand) qoh
from inventory join date_dim on d_date_sk = inv_date_sk join item on i_item_sk = inv_item_sk
where d_month_seq between 1188 and 1199 group by rollup (i_product_name, i_brand, i_class, i_category)
-- name: q23
with f as (select i_item_sk from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk
           where d_year in (1998, 1999, 2000, 2001) group by i_item_desc[1:30], i_item_sk, d_date having count(*) > 1),
m as (select max(s) top from (select sum(ss_quantity * ss_sales_price) s from store_sales join customer on c_customer_sk = ss_customer_sk
      join date_dim on d_date_sk = ss_sold_date_sk where d_year between 1998 and 2001 group by c_customer_sk)),
b as (select c_customer_sk from store_sales join customer on c_customer_sk = ss_customer_sk group by 1
      having sum(ss_quantity * ss_sales_price)::double > 0.4::double * (select top::double from m))
select sum(v) sum_sales from (
  select cs_quantity * cs_list_price v, cs_sold_date_sk k, cs_item_sk i, cs_bill_customer_sk u from catalog_sales
  union all select ws_quantity * ws_list_price, ws_sold_date_sk, ws_item_sk, ws_bill_customer_sk from web_sales)
join date_dim on d_date_sk = k
where d_year = 1998 and d_moy = 3 and i in (from f) and u in (from b)
-- name: q23_customers
with f as (select i_item_sk from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk
           where d_year in (1998, 1999, 2000, 2001) group by i_item_desc[1:30], i_item_sk, d_date having count(*) > 1),
m as (select max(s) top from (select sum(ss_quantity * ss_sales_price) s from store_sales join customer on c_customer_sk = ss_customer_sk
      join date_dim on d_date_sk = ss_sold_date_sk where d_year between 1998 and 2001 group by c_customer_sk)),
b as (select c_customer_sk from store_sales join customer on c_customer_sk = ss_customer_sk group by 1
      having sum(ss_quantity * ss_sales_price)::double > 0.4::double * (select top::double from m))
select c_last_name, c_first_name, sum(v) sales from (
  select 1 ch, cs_quantity * cs_list_price v, cs_sold_date_sk k, cs_item_sk i, cs_bill_customer_sk u from catalog_sales
  union all select 2, ws_quantity * ws_list_price, ws_sold_date_sk, ws_item_sk, ws_bill_customer_sk from web_sales)
join date_dim on d_date_sk = k join customer on c_customer_sk = u
where d_year = 1998 and d_moy = 3 and i in (from f) and u in (from b) group by ch, c_last_name, c_first_name
-- name: q24
with s as (
  select c_last_name, c_first_name, s_store_name, i_color, sum(ss_net_paid) netpaid
  from store_sales join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk
  join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
  join customer on c_customer_sk = ss_customer_sk
  join customer_address on upper(ca_country) = c_birth_country and ca_zip = s_zip
  where s_market_id = 5
  group by c_last_name, c_first_name, s_store_name, ca_state, s_state, i_color, i_current_price, i_manager_id, i_units, i_size)
select c_last_name, c_first_name, s_store_name, sum(netpaid) paid from s where i_color = 'brown' group by all
having sum(netpaid)::double > (select sum(netpaid)::double / count(*) * 0.05 from s)
-- name: q24_second
with s as (
  select c_last_name, c_first_name, s_store_name, i_color, sum(ss_net_paid) netpaid
  from store_sales join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk
  join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
  join customer on c_customer_sk = ss_customer_sk
  join customer_address on upper(ca_country) = c_birth_country and ca_zip = s_zip
  where s_market_id = 5
  group by c_last_name, c_first_name, s_store_name, ca_state, s_state, i_color, i_current_price, i_manager_id, i_units, i_size)
select c_last_name, c_first_name, s_store_name, sum(netpaid) paid from s where i_color = 'snow' group by all
having sum(netpaid)::double > (select sum(netpaid)::double / count(*) * 0.05 from s)
-- name: q25
select i_item_id, i_item_desc, s_store_id, s_store_name, sum(ss_net_profit) store_sales_profit,
  sum(sr_net_loss) store_returns_loss, sum(cs_net_profit) catalog_sales_profit
from store_sales join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk and sr_customer_sk = ss_customer_sk
join catalog_sales on cs_bill_customer_sk = sr_customer_sk and cs_item_sk = sr_item_sk
join date_dim a on a.d_date_sk = ss_sold_date_sk join date_dim b on b.d_date_sk = sr_returned_date_sk
join date_dim c on c.d_date_sk = cs_sold_date_sk join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
where a.d_moy = 4 and a.d_year = 1999 and b.d_moy between 4 and 10 and b.d_year = 1999
  and c.d_moy between 4 and 10 and c.d_year = 1999 group by all
-- name: q26
select i_item_id, sum(cs_quantity)::double / count(cs_quantity) agg1, sum(cs_list_price)::double / count(cs_list_price) agg2,
  sum(cs_coupon_amt)::double / count(cs_coupon_amt) agg3, sum(cs_sales_price)::double / count(cs_sales_price) agg4
from catalog_sales join customer_demographics on cd_demo_sk = cs_bill_cdemo_sk join date_dim on d_date_sk = cs_sold_date_sk
join item on i_item_sk = cs_item_sk join promotion on p_promo_sk = cs_promo_sk
where cd_gender = 'F' and cd_marital_status = 'W' and cd_education_status = 'Primary'
  and 'N' in (p_channel_email, p_channel_event) and d_year = 1999
group by i_item_id
-- name: q27
select i_item_id, s_state, grouping(s_state) g_state, sum(ss_quantity)::double / count(ss_quantity) agg1,
  sum(ss_list_price)::double / count(ss_list_price) agg2, sum(ss_coupon_amt)::double / count(ss_coupon_amt) agg3,
  sum(ss_sales_price)::double / count(ss_sales_price) agg4
from store_sales join customer_demographics on cd_demo_sk = ss_cdemo_sk join date_dim on d_date_sk = ss_sold_date_sk
join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
where cd_gender = 'M' and cd_marital_status = 'S' and cd_education_status = 'College' and d_year = 1999
  and s_state in ('TN','GA','CA','WA','TX','OH') group by rollup (i_item_id, s_state)
-- name: q28
with b as (
  select case when ss_quantity between 0 and 5 then 1 else (ss_quantity + 4) // 5 end g, *
  from store_sales where ss_quantity between 0 and 30),
p(g, lp, cp, wc) as (values (1, 8, 459, 57), (2, 90, 2323, 31), (3, 142, 1214, 79), (4, 135, 607, 38), (5, 122, 836, 17), (6, 154, 732, 7)),
r as (
  select g, sum(ss_list_price)::double / count(ss_list_price) a, count(ss_list_price) n, count(distinct ss_list_price) u
  from b join p using (g)
  where ss_list_price between lp and lp + 10 or ss_coupon_amt between cp and cp + 1000 or ss_wholesale_cost between wc and wc + 20
  group by g)
select max(a) filter (g = 1) b1_lp, coalesce(max(n) filter (g = 1), 0) b1_cnt, coalesce(max(u) filter (g = 1), 0) b1_cntd,
  max(a) filter (g = 2) b2_lp, coalesce(max(n) filter (g = 2), 0) b2_cnt, coalesce(max(u) filter (g = 2), 0) b2_cntd,
  max(a) filter (g = 3) b3_lp, coalesce(max(n) filter (g = 3), 0) b3_cnt, coalesce(max(u) filter (g = 3), 0) b3_cntd,
  max(a) filter (g = 4) b4_lp, coalesce(max(n) filter (g = 4), 0) b4_cnt, coalesce(max(u) filter (g = 4), 0) b4_cntd,
  max(a) filter (g = 5) b5_lp, coalesce(max(n) filter (g = 5), 0) b5_cnt, coalesce(max(u) filter (g = 5), 0) b5_cntd,
  max(a) filter (g = 6) b6_lp, coalesce(max(n) filter (g = 6), 0) b6_cnt, coalesce(max(u) filter (g = 6), 0) b6_cntd
from r
-- name: q29
select i_item_id, i_item_desc, s_store_id, s_store_name, round(stddev_samp(ss_quantity), 4) store_sales_quantity,
  round(stddev_samp(sr_return_quantity), 4) store_returns_quantity, round(stddev_samp(cs_quantity), 4) catalog_sales_quantity
from store_sales join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk and sr_customer_sk = ss_customer_sk
join catalog_sales on cs_bill_customer_sk = sr_customer_sk and cs_item_sk = sr_item_sk
join date_dim a on a.d_date_sk = ss_sold_date_sk join date_dim b on b.d_date_sk = sr_returned_date_sk
join date_dim c on c.d_date_sk = cs_sold_date_sk join store on s_store_sk = ss_store_sk join item on i_item_sk = ss_item_sk
where a.d_moy = 4 and a.d_year = 1998 and b.d_moy between 4 and 7 and b.d_year = 1998 and c.d_year in (1998, 1999, 2000)
group by all
-- name: q30
with r as (select wr_returning_customer_sk cu, ca_state st, sum(wr_return_amt) total
           from web_returns join date_dim on d_date_sk = wr_returned_date_sk
           join customer_address on ca_address_sk = wr_returning_addr_sk where d_year = 1999 group by all),
a as (select st, sum(total)::double / count(total) * 1.2 bar from r group by st)
select c_customer_id, c_salutation, c_first_name, c_last_name, c_preferred_cust_flag, c_birth_day, c_birth_month,
  c_birth_year, c_birth_country, c_login, c_email_address, c_last_review_date, total ctr_total_return
from r join a using (st) join customer on c_customer_sk = cu join customer_address on ca_address_sk = c_current_addr_sk
where ca_state = 'GA' and total::double > bar
-- name: q31
with ss as (select ca_county co, d_qoy q, sum(ss_ext_sales_price)::double v from store_sales join date_dim on d_date_sk = ss_sold_date_sk
            join customer_address on ca_address_sk = ss_addr_sk where d_year = 1999 group by all),
ws as (select ca_county co, d_qoy q, sum(ws_ext_sales_price)::double v from web_sales join date_dim on d_date_sk = ws_sold_date_sk
       join customer_address on ca_address_sk = ws_bill_addr_sk where d_year = 1999 group by all)
select s1.co ca_county, 1999 d_year, w2.v / w1.v web_q1_q2_increase, s2.v / s1.v store_q1_q2_increase,
  w3.v / w2.v web_q2_q3_increase, s3.v / s2.v store_q2_q3_increase
from ss s1 join ss s2 using (co) join ss s3 using (co) join ws w1 using (co) join ws w2 using (co) join ws w3 using (co)
where s1.q = 1 and s2.q = 2 and s3.q = 3 and w1.q = 1 and w2.q = 2 and w3.q = 3
  and w1.v > 0 and s1.v > 0 and w2.v > 0 and s2.v > 0 and w2.v / w1.v > s2.v / s1.v and w3.v / w2.v > s3.v / s2.v
-- name: q32
with s as (select cs_item_sk it, cs_ext_discount_amt v from catalog_sales join date_dim on d_date_sk = cs_sold_date_sk
           where d_date between date'1999-01-07' and date'1999-01-07' + 90)
select sum(v) excess_discount_amount from s join item on i_item_sk = it
where i_manufact_id = 16 and v::double > (select sum(o.v)::double / count(o.v) * 1.3 from s o where o.it = s.it)
-- name: q33
select i_manufact_id, sum(v) total_sales from (
  select ss_item_sk it, ss_sold_date_sk k, ss_addr_sk ad, ss_ext_sales_price v from store_sales
  union all select cs_item_sk, cs_sold_date_sk, cs_bill_addr_sk, cs_ext_sales_price from catalog_sales
  union all select ws_item_sk, ws_sold_date_sk, ws_bill_addr_sk, ws_ext_sales_price from web_sales)
join item on i_item_sk = it join date_dim on d_date_sk = k join customer_address on ca_address_sk = ad
where d_year = 1999 and d_moy = 3 and ca_gmt_offset = -5
  and i_manufact_id in (select i_manufact_id from item where i_category = 'Books') group by i_manufact_id
-- name: q34
select c_last_name, c_first_name, c_salutation, c_preferred_cust_flag, ss_ticket_number, cnt
from (select ss_ticket_number, ss_customer_sk, count(*) cnt from store_sales
      join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
      join household_demographics on hd_demo_sk = ss_hdemo_sk
      where (d_dom <= 3 or d_dom between 25 and 28) and hd_buy_potential in ('>10000', 'Unknown') and hd_vehicle_count > 0
        and hd_dep_count::double / nullif(hd_vehicle_count, 0) > 1.2 and d_year between 1998 and 2000
        and s_county in ('Williamson County','Walker County','Ziebach County','Daviess County','Barrow County','Fairfield County','Luce County','Richland County')
      group by all) join customer on c_customer_sk = ss_customer_sk
where cnt between 3 and 20
-- name: q35
with d as (select d_date_sk from date_dim where d_year = 1999 and d_qoy < 4)
select ca_state, cd_gender, cd_marital_status, cd_dep_count, count(*) cnt1, sum(cd_dep_count) a1,
  sum(cd_dep_count)::double / count(cd_dep_count) a2, round(stddev_samp(cd_dep_count), 4) a3,
  cd_dep_employed_count, count(*) cnt2, sum(cd_dep_employed_count) b1, sum(cd_dep_employed_count)::double / count(*) b2,
  round(stddev_samp(cd_dep_employed_count), 4) b3, cd_dep_college_count, count(*) cnt3, sum(cd_dep_college_count) c1,
  sum(cd_dep_college_count)::double / count(*) c2, round(stddev_samp(cd_dep_college_count), 4) c3
from customer join customer_address on ca_address_sk = c_current_addr_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk
where c_customer_sk in (select ss_customer_sk from store_sales where ss_sold_date_sk in (from d))
  and (exists (select 1 from web_sales where ws_bill_customer_sk = c_customer_sk and ws_sold_date_sk in (from d))
    or exists (select 1 from catalog_sales where cs_ship_customer_sk = c_customer_sk and cs_sold_date_sk in (from d)))
group by ca_state, cd_gender, cd_marital_status, cd_dep_count, cd_dep_employed_count, cd_dep_college_count
-- name: q36
with g as (
  select sum(ss_net_profit)::double / sum(ss_ext_sales_price)::double gross_margin, i_category, i_class,
    grouping(i_category) + grouping(i_class) lochierarchy
  from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk join store on s_store_sk = ss_store_sk
  where d_year = 1999 and s_state in ('TN','GA','CA','WA','TX','OH','IL','MI') group by rollup (i_category, i_class))
select *, if(lochierarchy = 0, i_category, null) _parent,
  rank() over (partition by lochierarchy, if(lochierarchy = 0, i_category, null) order by gross_margin nulls first) rank_within_parent
from g
-- name: q37
select distinct i_item_id, i_item_desc, i_current_price from item
where i_current_price between 20 and 50 and i_manufact_id in (6, 13, 20, 35)
  and i_item_sk in (select inv_item_sk from inventory join date_dim on d_date_sk = inv_date_sk
                    where d_date between date'1999-02-01' and date'1999-02-01' + 60 and inv_quantity_on_hand between 100 and 500)
  and i_item_sk in (select cs_item_sk from catalog_sales)
-- name: q38
with d as (select d_date_sk, d_date from date_dim where d_month_seq between 1188 and 1199)
select count(*) cnt from (
  select c_last_name, c_first_name, d_date from store_sales join d on d_date_sk = ss_sold_date_sk join customer on c_customer_sk = ss_customer_sk
  intersect select c_last_name, c_first_name, d_date from catalog_sales join d on d_date_sk = cs_sold_date_sk join customer on c_customer_sk = cs_bill_customer_sk
  intersect select c_last_name, c_first_name, d_date from web_sales join d on d_date_sk = ws_sold_date_sk join customer on c_customer_sk = ws_bill_customer_sk)
-- name: q39
with v as (
  select w_warehouse_sk w, i_item_sk i, d_moy moy, sum(inv_quantity_on_hand)::double / count(inv_quantity_on_hand) mean,
    stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) cov
  from inventory join item on i_item_sk = inv_item_sk join warehouse on w_warehouse_sk = inv_warehouse_sk
  join date_dim on d_date_sk = inv_date_sk where d_year = 1999 group by all
  having avg(inv_quantity_on_hand) <> 0 and stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) > 1)
select a.w w1, a.i i1, a.moy moy1, a.mean mean1, round(a.cov, 4) cov1, b.w w2, b.i i2, b.moy moy2, b.mean mean2, round(b.cov, 4) cov2
from v a join v b on a.w = b.w and a.i = b.i where a.moy = 2 and b.moy = 3
-- name: q39_high
with v as (
  select w_warehouse_sk w, i_item_sk i, d_moy moy, sum(inv_quantity_on_hand)::double / count(inv_quantity_on_hand) mean,
    stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) cov
  from inventory join item on i_item_sk = inv_item_sk join warehouse on w_warehouse_sk = inv_warehouse_sk
  join date_dim on d_date_sk = inv_date_sk where d_year = 1999 group by all
  having avg(inv_quantity_on_hand) <> 0 and stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) > 1)
select a.w w1, a.i i1, a.moy moy1, a.mean mean1, round(a.cov, 4) cov1, b.w w2, b.i i2, b.moy moy2, b.mean mean2, round(b.cov, 4) cov2
from v a join v b on a.w = b.w and a.i = b.i where a.moy = 2 and b.moy = 3 and a.cov > 1.5
-- name: q40
select w_state, i_item_id,
  sum(case when d_date < date'1999-03-11' then cs_sales_price - coalesce(cr_refunded_cash, 0) else 0 end) sales_before,
  sum(case when d_date >= date'1999-03-11' then cs_sales_price - coalesce(cr_refunded_cash, 0) else 0 end) sales_after
from catalog_sales left join catalog_returns on cr_order_number = cs_order_number and cr_item_sk = cs_item_sk
join warehouse on w_warehouse_sk = cs_warehouse_sk join item on i_item_sk = cs_item_sk join date_dim on d_date_sk = cs_sold_date_sk
where i_current_price between 0.99 and 1.49 and abs(d_date - date'1999-03-11') <= 30 group by all
-- name: q41
select distinct i_product_name from item o where i_manufact_id between 1 and 41
and exists (select 1 from item x where x.i_manufact = o.i_manufact and (
  x.i_category = 'Women' and (
       x.i_color in ('powder','khaki') and x.i_units in ('Ounce','Oz') and x.i_size in ('medium','extra large')
    or x.i_color in ('brown','honeydew') and x.i_units in ('Bunch','Ton') and x.i_size in ('N/A','small')
    or x.i_color in ('midnight','snow') and x.i_units in ('Oz','Bunch') and x.i_size in ('medium','extra large')
    or x.i_color in ('cyan','papaya') and x.i_units in ('N/A','Ounce') and x.i_size in ('N/A','small'))
  or x.i_category = 'Men' and (
       x.i_color in ('floral','deep') and x.i_units in ('N/A','Dozen') and x.i_size in ('petite','large')
    or x.i_color in ('light','cornflower') and x.i_units in ('Ounce','Ton') and x.i_size in ('medium','extra large')
    or x.i_color in ('powder','brown') and x.i_units in ('Dozen','Oz') and x.i_size in ('petite','large')
    or x.i_color in ('khaki','snow') and x.i_units in ('Bunch','N/A') and x.i_size in ('medium','extra large'))))
-- name: q42
select d_year, i_category_id, i_category, sum(ss_ext_sales_price) sum_ext_sales_price
from store_sales join date_dim on d_date_sk = ss_sold_date_sk join item on i_item_sk = ss_item_sk
where i_manager_id = 1 and d_moy = 11 and d_year = 1999 group by all
-- name: q43
select s_store_name, s_store_id, sum(ss_sales_price) filter (d_dow = 0) sun_sales, sum(ss_sales_price) filter (d_dow = 1) mon_sales,
  sum(ss_sales_price) filter (d_dow = 2) tue_sales, sum(ss_sales_price) filter (d_dow = 3) wed_sales,
  sum(ss_sales_price) filter (d_dow = 4) thu_sales, sum(ss_sales_price) filter (d_dow = 5) fri_sales,
  sum(ss_sales_price) filter (d_dow = 6) sat_sales
from store_sales join date_dim on d_date_sk = ss_sold_date_sk join store on s_store_sk = ss_store_sk
where s_gmt_offset = -5 and d_year = 1999 group by all
-- name: q44
with p as (
  select ss_item_sk it, sum(ss_net_profit)::double / count(ss_net_profit) v from store_sales where ss_store_sk = 4 group by 1
  having v > (select sum(ss_net_profit)::double / count(ss_net_profit) * 0.9 from store_sales where ss_store_sk = 4 and ss_addr_sk is null)),
r as (select it, rank() over (order by v) up, rank() over (order by v desc) down from p)
select a.up rnk, i.i_product_name best_performing, j.i_product_name worst_performing
from r a join r b on a.up = b.down join item i on i.i_item_sk = a.it join item j on j.i_item_sk = b.it where a.up <= 10
-- name: q45
select ca_zip, ca_city place, sum(ws_sales_price) sum_sales_price
from web_sales join customer on c_customer_sk = ws_bill_customer_sk join customer_address on ca_address_sk = c_current_addr_sk
join item on i_item_sk = ws_item_sk join date_dim on d_date_sk = ws_sold_date_sk
where d_qoy = 2 and d_year = 1999 and (ca_zip[1:5] in ('85669','86197','88274','83405','86475','85392','85460','80348','81792')
  or i_item_id in (select i_item_id from item where i_item_sk in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29))) group by all
