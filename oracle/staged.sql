-- name: staged_intersect_np
with d as (select d_date_sk from date_dim where d_year = 1999 and d_dom <= 4)
select count(*) cnt from (select cs_sold_date_sk, cs_bill_customer_sk, cs_item_sk from catalog_sales where cs_sold_date_sk in (from d)
  intersect select ss_sold_date_sk, ss_customer_sk, ss_item_sk from store_sales where ss_sold_date_sk in (from d))
-- name: staged_intersect_pp
with d as (select d_date_sk from date_dim where d_year = 1999 and d_dom <= 4)
select count(*) cnt from (select cs_sold_date_sk, cs_bill_customer_sk, cs_item_sk from catalog_sales where cs_sold_date_sk in (from d)
  intersect select ss_sold_date_sk, ss_customer_sk, ss_item_sk from store_sales where ss_sold_date_sk in (from d))
-- name: staged_intersect_fp
with d as (select d_date_sk from date_dim where d_year = 1999 and d_dom <= 4)
select count(*) cnt from (select cs_sold_date_sk, cs_bill_customer_sk, cs_item_sk from catalog_sales where cs_sold_date_sk in (from d)
  intersect select ss_sold_date_sk, ss_customer_sk, ss_item_sk from store_sales where ss_sold_date_sk in (from d))
-- name: staged_left_join_np
select count(*) cnt from store_sales join date_dim on d_date_sk = ss_sold_date_sk
left join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk where d_year = 1999 and ss_sales_price >= 10
-- name: staged_left_join_pp
select count(*) cnt from store_sales join date_dim on d_date_sk = ss_sold_date_sk
left join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk where d_year = 1999 and ss_sales_price >= 10
-- name: staged_left_join_fp
select count(*) cnt from store_sales join date_dim on d_date_sk = ss_sold_date_sk
left join store_returns on sr_ticket_number = ss_ticket_number and sr_item_sk = ss_item_sk where d_year = 1999 and ss_sales_price >= 10
-- name: staged_merge_join_np
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk::float = w_warehouse_sk::float where d_year = 2000
-- name: staged_merge_join_pp
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk::float = w_warehouse_sk::float where d_year = 2000
-- name: staged_merge_join_fp
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk::float = w_warehouse_sk::float where d_year = 2000
-- name: staged_theta_join_np
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk >= w_warehouse_sk where d_year in (2000, 2001)
-- name: staged_theta_join_pp
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk >= w_warehouse_sk where d_year in (2000, 2001)
-- name: staged_theta_join_fp
select count(*) cnt from web_sales join date_dim on d_date_sk = ws_sold_date_sk
join warehouse on ws_warehouse_sk >= w_warehouse_sk where d_year in (2000, 2001)
-- name: staged_wide_aggregate_np
select min(cs_wholesale_cost) min_cs_wholesale_cost, max(cs_wholesale_cost) max_cs_wholesale_cost, sum(cs_wholesale_cost)::double / count(cs_wholesale_cost) avg_cs_wholesale_cost, sum(cs_wholesale_cost) sum_cs_wholesale_cost, count(cs_wholesale_cost) count_cs_wholesale_cost,
  min(cs_list_price) min_cs_list_price, max(cs_list_price) max_cs_list_price, sum(cs_list_price)::double / count(cs_list_price) avg_cs_list_price, sum(cs_list_price) sum_cs_list_price, count(cs_list_price) count_cs_list_price,
  min(cs_sales_price) min_cs_sales_price, max(cs_sales_price) max_cs_sales_price, sum(cs_sales_price)::double / count(cs_sales_price) avg_cs_sales_price, sum(cs_sales_price) sum_cs_sales_price, count(cs_sales_price) count_cs_sales_price,
  min(cs_ext_discount_amt) min_cs_ext_discount_amt, max(cs_ext_discount_amt) max_cs_ext_discount_amt, sum(cs_ext_discount_amt)::double / count(cs_ext_discount_amt) avg_cs_ext_discount_amt, sum(cs_ext_discount_amt) sum_cs_ext_discount_amt, count(cs_ext_discount_amt) count_cs_ext_discount_amt,
  min(cs_ext_sales_price) min_cs_ext_sales_price, max(cs_ext_sales_price) max_cs_ext_sales_price, sum(cs_ext_sales_price)::double / count(cs_ext_sales_price) avg_cs_ext_sales_price, sum(cs_ext_sales_price) sum_cs_ext_sales_price, count(cs_ext_sales_price) count_cs_ext_sales_price,
  min(cs_ext_wholesale_cost) min_cs_ext_wholesale_cost, max(cs_ext_wholesale_cost) max_cs_ext_wholesale_cost, sum(cs_ext_wholesale_cost)::double / count(cs_ext_wholesale_cost) avg_cs_ext_wholesale_cost, sum(cs_ext_wholesale_cost) sum_cs_ext_wholesale_cost, count(cs_ext_wholesale_cost) count_cs_ext_wholesale_cost,
  min(cs_ext_list_price) min_cs_ext_list_price, max(cs_ext_list_price) max_cs_ext_list_price, sum(cs_ext_list_price)::double / count(cs_ext_list_price) avg_cs_ext_list_price, sum(cs_ext_list_price) sum_cs_ext_list_price, count(cs_ext_list_price) count_cs_ext_list_price,
  min(cs_ext_tax) min_cs_ext_tax, max(cs_ext_tax) max_cs_ext_tax, sum(cs_ext_tax)::double / count(cs_ext_tax) avg_cs_ext_tax, sum(cs_ext_tax) sum_cs_ext_tax, count(cs_ext_tax) count_cs_ext_tax,
  min(cs_coupon_amt) min_cs_coupon_amt, max(cs_coupon_amt) max_cs_coupon_amt, sum(cs_coupon_amt)::double / count(cs_coupon_amt) avg_cs_coupon_amt, sum(cs_coupon_amt) sum_cs_coupon_amt, count(cs_coupon_amt) count_cs_coupon_amt,
  min(cs_ext_ship_cost) min_cs_ext_ship_cost, max(cs_ext_ship_cost) max_cs_ext_ship_cost, sum(cs_ext_ship_cost)::double / count(cs_ext_ship_cost) avg_cs_ext_ship_cost, sum(cs_ext_ship_cost) sum_cs_ext_ship_cost, count(cs_ext_ship_cost) count_cs_ext_ship_cost,
  min(cs_net_paid) min_cs_net_paid, max(cs_net_paid) max_cs_net_paid, sum(cs_net_paid)::double / count(cs_net_paid) avg_cs_net_paid, sum(cs_net_paid) sum_cs_net_paid, count(cs_net_paid) count_cs_net_paid,
  min(cs_net_paid_inc_tax) min_cs_net_paid_inc_tax, max(cs_net_paid_inc_tax) max_cs_net_paid_inc_tax, sum(cs_net_paid_inc_tax)::double / count(cs_net_paid_inc_tax) avg_cs_net_paid_inc_tax, sum(cs_net_paid_inc_tax) sum_cs_net_paid_inc_tax, count(cs_net_paid_inc_tax) count_cs_net_paid_inc_tax,
  min(cs_net_paid_inc_ship) min_cs_net_paid_inc_ship, max(cs_net_paid_inc_ship) max_cs_net_paid_inc_ship, sum(cs_net_paid_inc_ship)::double / count(cs_net_paid_inc_ship) avg_cs_net_paid_inc_ship, sum(cs_net_paid_inc_ship) sum_cs_net_paid_inc_ship, count(cs_net_paid_inc_ship) count_cs_net_paid_inc_ship,
  min(cs_net_paid_inc_ship_tax) min_cs_net_paid_inc_ship_tax, max(cs_net_paid_inc_ship_tax) max_cs_net_paid_inc_ship_tax, sum(cs_net_paid_inc_ship_tax)::double / count(cs_net_paid_inc_ship_tax) avg_cs_net_paid_inc_ship_tax, sum(cs_net_paid_inc_ship_tax) sum_cs_net_paid_inc_ship_tax, count(cs_net_paid_inc_ship_tax) count_cs_net_paid_inc_ship_tax,
  min(cs_net_profit) min_cs_net_profit, max(cs_net_profit) max_cs_net_profit, sum(cs_net_profit)::double / count(cs_net_profit) avg_cs_net_profit, sum(cs_net_profit) sum_cs_net_profit, count(cs_net_profit) count_cs_net_profit
from catalog_sales
-- name: staged_wide_aggregate_fp
select min(cs_wholesale_cost) min_cs_wholesale_cost, max(cs_wholesale_cost) max_cs_wholesale_cost, sum(cs_wholesale_cost)::double / count(cs_wholesale_cost) avg_cs_wholesale_cost, sum(cs_wholesale_cost) sum_cs_wholesale_cost, count(cs_wholesale_cost) count_cs_wholesale_cost,
  min(cs_list_price) min_cs_list_price, max(cs_list_price) max_cs_list_price, sum(cs_list_price)::double / count(cs_list_price) avg_cs_list_price, sum(cs_list_price) sum_cs_list_price, count(cs_list_price) count_cs_list_price,
  min(cs_sales_price) min_cs_sales_price, max(cs_sales_price) max_cs_sales_price, sum(cs_sales_price)::double / count(cs_sales_price) avg_cs_sales_price, sum(cs_sales_price) sum_cs_sales_price, count(cs_sales_price) count_cs_sales_price,
  min(cs_ext_discount_amt) min_cs_ext_discount_amt, max(cs_ext_discount_amt) max_cs_ext_discount_amt, sum(cs_ext_discount_amt)::double / count(cs_ext_discount_amt) avg_cs_ext_discount_amt, sum(cs_ext_discount_amt) sum_cs_ext_discount_amt, count(cs_ext_discount_amt) count_cs_ext_discount_amt,
  min(cs_ext_sales_price) min_cs_ext_sales_price, max(cs_ext_sales_price) max_cs_ext_sales_price, sum(cs_ext_sales_price)::double / count(cs_ext_sales_price) avg_cs_ext_sales_price, sum(cs_ext_sales_price) sum_cs_ext_sales_price, count(cs_ext_sales_price) count_cs_ext_sales_price,
  min(cs_ext_wholesale_cost) min_cs_ext_wholesale_cost, max(cs_ext_wholesale_cost) max_cs_ext_wholesale_cost, sum(cs_ext_wholesale_cost)::double / count(cs_ext_wholesale_cost) avg_cs_ext_wholesale_cost, sum(cs_ext_wholesale_cost) sum_cs_ext_wholesale_cost, count(cs_ext_wholesale_cost) count_cs_ext_wholesale_cost,
  min(cs_ext_list_price) min_cs_ext_list_price, max(cs_ext_list_price) max_cs_ext_list_price, sum(cs_ext_list_price)::double / count(cs_ext_list_price) avg_cs_ext_list_price, sum(cs_ext_list_price) sum_cs_ext_list_price, count(cs_ext_list_price) count_cs_ext_list_price,
  min(cs_ext_tax) min_cs_ext_tax, max(cs_ext_tax) max_cs_ext_tax, sum(cs_ext_tax)::double / count(cs_ext_tax) avg_cs_ext_tax, sum(cs_ext_tax) sum_cs_ext_tax, count(cs_ext_tax) count_cs_ext_tax,
  min(cs_coupon_amt) min_cs_coupon_amt, max(cs_coupon_amt) max_cs_coupon_amt, sum(cs_coupon_amt)::double / count(cs_coupon_amt) avg_cs_coupon_amt, sum(cs_coupon_amt) sum_cs_coupon_amt, count(cs_coupon_amt) count_cs_coupon_amt,
  min(cs_ext_ship_cost) min_cs_ext_ship_cost, max(cs_ext_ship_cost) max_cs_ext_ship_cost, sum(cs_ext_ship_cost)::double / count(cs_ext_ship_cost) avg_cs_ext_ship_cost, sum(cs_ext_ship_cost) sum_cs_ext_ship_cost, count(cs_ext_ship_cost) count_cs_ext_ship_cost,
  min(cs_net_paid) min_cs_net_paid, max(cs_net_paid) max_cs_net_paid, sum(cs_net_paid)::double / count(cs_net_paid) avg_cs_net_paid, sum(cs_net_paid) sum_cs_net_paid, count(cs_net_paid) count_cs_net_paid,
  min(cs_net_paid_inc_tax) min_cs_net_paid_inc_tax, max(cs_net_paid_inc_tax) max_cs_net_paid_inc_tax, sum(cs_net_paid_inc_tax)::double / count(cs_net_paid_inc_tax) avg_cs_net_paid_inc_tax, sum(cs_net_paid_inc_tax) sum_cs_net_paid_inc_tax, count(cs_net_paid_inc_tax) count_cs_net_paid_inc_tax,
  min(cs_net_paid_inc_ship) min_cs_net_paid_inc_ship, max(cs_net_paid_inc_ship) max_cs_net_paid_inc_ship, sum(cs_net_paid_inc_ship)::double / count(cs_net_paid_inc_ship) avg_cs_net_paid_inc_ship, sum(cs_net_paid_inc_ship) sum_cs_net_paid_inc_ship, count(cs_net_paid_inc_ship) count_cs_net_paid_inc_ship,
  min(cs_net_paid_inc_ship_tax) min_cs_net_paid_inc_ship_tax, max(cs_net_paid_inc_ship_tax) max_cs_net_paid_inc_ship_tax, sum(cs_net_paid_inc_ship_tax)::double / count(cs_net_paid_inc_ship_tax) avg_cs_net_paid_inc_ship_tax, sum(cs_net_paid_inc_ship_tax) sum_cs_net_paid_inc_ship_tax, count(cs_net_paid_inc_ship_tax) count_cs_net_paid_inc_ship_tax,
  min(cs_net_profit) min_cs_net_profit, max(cs_net_profit) max_cs_net_profit, sum(cs_net_profit)::double / count(cs_net_profit) avg_cs_net_profit, sum(cs_net_profit) sum_cs_net_profit, count(cs_net_profit) count_cs_net_profit
from catalog_sales
