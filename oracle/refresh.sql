-- name: refresh_store_sales
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
good as (select i_item_id as id, i_item_sk, i_wholesale_cost as cost, i_current_price as listed from item where i_rec_end_date is null),
place as (select s_store_id as id, s_store_sk, s_tax_precentage as tax from store where s_rec_end_date is null),
head as (
  select purc_purchase_id as doc, d_date_sk, t_time_sk, c_customer_sk, c_current_cdemo_sk, c_current_hdemo_sk, c_current_addr_sk, s_store_sk, tax
  from s_purchase left join place on place.id = purc_store_id left join customer on c_customer_id = purc_customer_id
  left join day on written = purc_purchase_date left join time_dim on t_time = purc_purchase_time
  where place.id is not null or purc_store_id not in (select s_store_id from store)),
line as (
  select plin_purchase_id as doc, i_item_sk, cost, listed, p_promo_sk, plin_quantity as qty, plin_sale_price as price, plin_coupon_amt as coupon
  from s_purchase_lineitem left join good on good.id = plin_item_id left join promotion on p_promo_id = plin_promotion_id
  where good.id is not null or plin_item_id not in (select i_item_id from item)),
worked as (select *, price * qty as gross, cost * qty as spent, listed * qty as worth, gross - coupon as paid, listed * tax as due from line join head using (doc))
select doc as ss_ticket_number, i_item_sk as ss_item_sk, s_store_sk as ss_store_sk, p_promo_sk as ss_promo_sk, d_date_sk as ss_sold_date_sk, t_time_sk as ss_sold_time_sk,
  c_customer_sk as ss_customer_sk, c_current_cdemo_sk as ss_cdemo_sk, c_current_hdemo_sk as ss_hdemo_sk, c_current_addr_sk as ss_addr_sk,
  qty as ss_quantity, price as ss_sales_price, listed as ss_list_price, cost as ss_wholesale_cost, coupon as ss_coupon_amt,
  gross as ss_ext_sales_price, worth as ss_ext_list_price, spent as ss_ext_wholesale_cost, worth - gross as ss_ext_discount_amt, due as ss_ext_tax,
  paid as ss_net_paid, paid * (1 + tax) as ss_net_paid_inc_tax, paid - spent as ss_net_profit
from worked
-- name: refresh_catalog_sales
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
buyer as (select c_customer_id as id, c_customer_sk as who, c_current_cdemo_sk as cd, c_current_hdemo_sk as hd, c_current_addr_sk as ad from customer),
place as (select cc_call_center_id as id, cc_call_center_sk, cc_tax_percentage as tax from call_center where cc_rec_end_date is null),
placed as (select cc_call_center_id as id from call_center),
head as (
  select cord_order_id as doc, sold.d_date_sk as sold_day, t_time_sk, payer, taker, mode, cc_call_center_sk, tax
  from (select *, b as payer, h as taker from (select o.*, b, h from s_catalog_order o
        left join buyer b on b.id = cord_bill_customer_id left join buyer h on h.id = cord_ship_customer_id))
  left join day sold on sold.written = cord_order_date
  left join time_dim on t_time = cord_order_time
  left join (select sm_ship_mode_id as mode_id, sm_ship_mode_sk as mode from ship_mode) on mode_id = cord_ship_mode_id
  left join place on place.id = cord_call_center_id
  where place.id is not null or cord_call_center_id not in (select id from placed)),
good as (select i_item_id as id, i_item_sk, i_wholesale_cost as cost, i_current_price as listed from item where i_rec_end_date is null),
line as (
  select clin.*, clin_order_id as doc, i_item_sk, cost, listed, d_date_sk as ship_day, w_warehouse_sk, p_promo_sk, clin_quantity as qty, clin_sales_price as price, clin_coupon_amt as coupon
  from s_catalog_order_lineitem clin
  left join good on good.id = clin_item_id left join day on written = clin_ship_date
  left join warehouse on w_warehouse_id = clin_warehouse_id left join promotion on p_promo_id = clin_promotion_id
  where good.id is not null or clin_item_id not in (select i_item_id from item)),
worked as (
  select *, price * qty as gross, cost * qty as spent, listed * qty as worth, clin_ship_cost * qty as freight, gross - coupon as paid, listed * tax as due
  from line join head using (doc))
select doc as cs_order_number, i_item_sk as cs_item_sk, payer.who as cs_bill_customer_sk, payer.cd as cs_bill_cdemo_sk, payer.hd as cs_bill_hdemo_sk, payer.ad as cs_bill_addr_sk, taker.who as cs_ship_customer_sk, taker.cd as cs_ship_cdemo_sk, taker.hd as cs_ship_hdemo_sk, taker.ad as cs_ship_addr_sk,
  sold_day as cs_sold_date_sk, t_time_sk as cs_sold_time_sk, ship_day as cs_ship_date_sk, mode as cs_ship_mode_sk, w_warehouse_sk as cs_warehouse_sk, p_promo_sk as cs_promo_sk,
  qty as cs_quantity, price as cs_sales_price, listed as cs_list_price, cost as cs_wholesale_cost, coupon as cs_coupon_amt,
  gross as cs_ext_sales_price, worth as cs_ext_list_price, spent as cs_ext_wholesale_cost, worth - gross as cs_ext_discount_amt, due as cs_ext_tax,
  paid as cs_net_paid, paid * (1 + tax) as cs_net_paid_inc_tax, paid - spent as cs_net_profit,
  cc_call_center_sk as cs_call_center_sk, cp_catalog_page_sk as cs_catalog_page_sk,
  freight as cs_ext_ship_cost, paid + freight as cs_net_paid_inc_ship, paid + freight + due as cs_net_paid_inc_ship_tax
from worked left join catalog_page on (cp_catalog_number, cp_catalog_page_number) = (clin_catalog_number, clin_catalog_page_number)
-- name: refresh_web_sales
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
buyer as (select c_customer_id as id, c_customer_sk as who, c_current_cdemo_sk as cd, c_current_hdemo_sk as hd, c_current_addr_sk as ad from customer),
place as (select web_site_id as id, web_site_sk, web_tax_percentage as tax from web_site where web_rec_end_date is null),
placed as (select web_site_id as id from web_site),
head as (
  select word_order_id as doc, sold.d_date_sk as sold_day, t_time_sk, payer, taker, mode, web_site_sk, tax
  from (select *, b as payer, h as taker from (select o.*, b, h from s_web_order o
        left join buyer b on b.id = word_bill_customer_id left join buyer h on h.id = word_ship_customer_id))
  left join day sold on sold.written = word_order_date
  left join time_dim on t_time = word_order_time
  left join (select sm_ship_mode_id as mode_id, sm_ship_mode_sk as mode from ship_mode) on mode_id = word_ship_mode_id
  left join place on place.id = word_web_site_id
  where place.id is not null or word_web_site_id not in (select id from placed)),
good as (select i_item_id as id, i_item_sk, i_wholesale_cost as cost, i_current_price as listed from item where i_rec_end_date is null),
line as (
  select wlin.*, wlin_order_id as doc, i_item_sk, cost, listed, d_date_sk as ship_day, w_warehouse_sk, p_promo_sk, wlin_quantity as qty, wlin_sales_price as price, wlin_coupon_amt as coupon
  from s_web_order_lineitem wlin
  left join good on good.id = wlin_item_id left join day on written = wlin_ship_date
  left join warehouse on w_warehouse_id = wlin_warehouse_id left join promotion on p_promo_id = wlin_promotion_id
  where good.id is not null or wlin_item_id not in (select i_item_id from item)),
worked as (
  select *, price * qty as gross, cost * qty as spent, listed * qty as worth, wlin_ship_cost * qty as freight, gross - coupon as paid, listed * tax as due
  from line join head using (doc)),
page as (select wp_web_page_id as id, wp_web_page_sk from web_page where wp_rec_end_date is null)
select doc as ws_order_number, i_item_sk as ws_item_sk, payer.who as ws_bill_customer_sk, payer.cd as ws_bill_cdemo_sk, payer.hd as ws_bill_hdemo_sk, payer.ad as ws_bill_addr_sk, taker.who as ws_ship_customer_sk, taker.cd as ws_ship_cdemo_sk, taker.hd as ws_ship_hdemo_sk, taker.ad as ws_ship_addr_sk,
  sold_day as ws_sold_date_sk, t_time_sk as ws_sold_time_sk, ship_day as ws_ship_date_sk, mode as ws_ship_mode_sk, w_warehouse_sk as ws_warehouse_sk, p_promo_sk as ws_promo_sk,
  qty as ws_quantity, price as ws_sales_price, listed as ws_list_price, cost as ws_wholesale_cost, coupon as ws_coupon_amt,
  gross as ws_ext_sales_price, worth as ws_ext_list_price, spent as ws_ext_wholesale_cost, worth - gross as ws_ext_discount_amt, due as ws_ext_tax,
  paid as ws_net_paid, paid * (1 + tax) as ws_net_paid_inc_tax, paid - spent as ws_net_profit,
  wp_web_page_sk as ws_web_page_sk, web_site_sk as ws_web_site_sk,
  0 as ws_ext_ship_cost, paid - spent as ws_net_paid_inc_ship, paid + freight + due as ws_net_paid_inc_ship_tax
from worked left join page on page.id = wlin_web_page_id
where page.id is not null or wlin_web_page_id not in (select wp_web_page_id from web_page)
-- name: refresh_store_returns
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
buyer as (select c_customer_id as id, c_customer_sk as who, c_current_cdemo_sk as cd, c_current_hdemo_sk as hd, c_current_addr_sk as ad from customer),
open_item as (select i_item_id as id, i_item_sk from item where i_rec_end_date is null),
open_place as (select s_store_id as id, s_store_sk from store where s_rec_end_date is null),
brought as (select *, sret_return_amt as amt, sret_return_tax as tax, sret_return_fee as fee, sret_refunded_cash as cash, sret_reversed_charge as charge, sret_store_credit as credit,
  date_part('epoch', cast(sret_return_time as time)) as clock from s_store_returns)
select sret_ticket_number as sr_ticket_number, i_item_sk as sr_item_sk, d_date_sk as sr_returned_date_sk, t_time_sk as sr_return_time_sk, r_reason_sk as sr_reason_sk, s_store_sk as sr_store_sk, buyer.who as sr_customer_sk, buyer.cd as sr_cdemo_sk, buyer.hd as sr_hdemo_sk, buyer.ad as sr_addr_sk,
  sret_return_qty as sr_return_quantity, amt as sr_return_amt, tax as sr_return_tax, fee as sr_fee, sret_return_ship_cost as sr_return_ship_cost, cash as sr_refunded_cash,
  charge as sr_reversed_charge, credit as sr_store_credit, amt + tax as sr_return_amt_inc_tax, amt + tax + fee - (cash + charge + credit) as sr_net_loss
from brought left join buyer on buyer.id = sret_customer_id
left join open_item on open_item.id = sret_item_id left join open_place on open_place.id = sret_store_id
left join day on written = sret_return_date left join time_dim on t_time = clock left join reason on r_reason_id = sret_reason_id
where (open_item.id is not null or sret_item_id not in (select i_item_id from item))
  and (open_place.id is not null or sret_store_id not in (select s_store_id from store))
-- name: refresh_catalog_returns
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
buyer as (select c_customer_id as id, c_customer_sk as who, c_current_cdemo_sk as cd, c_current_hdemo_sk as hd, c_current_addr_sk as ad from customer),
open_item as (select i_item_id as id, i_item_sk from item where i_rec_end_date is null),
open_place as (select cc_call_center_id as id, cc_call_center_sk from call_center where cc_rec_end_date is null),
brought as (select *, cret_return_amt as amt, cret_return_tax as tax, cret_return_fee as fee, cret_refunded_cash as cash, cret_reversed_charge as charge, cret_merchant_credit as credit,
  date_part('epoch', cast(cret_return_time as time)) as clock from s_catalog_returns)
select cret_order_id as cr_order_number, i_item_sk as cr_item_sk, d_date_sk as cr_returned_date_sk, t_time_sk as cr_returned_time_sk, r_reason_sk as cr_reason_sk, cc_call_center_sk as cr_call_center_sk, refunded.who as cr_refunded_customer_sk, refunded.cd as cr_refunded_cdemo_sk, refunded.hd as cr_refunded_hdemo_sk, refunded.ad as cr_refunded_addr_sk, returning_.who as cr_returning_customer_sk, returning_.cd as cr_returning_cdemo_sk, returning_.hd as cr_returning_hdemo_sk, returning_.ad as cr_returning_addr_sk,
  cret_return_qty as cr_return_quantity, amt as cr_return_amount, tax as cr_return_tax, fee as cr_fee, cret_return_ship_cost as cr_return_ship_cost, cash as cr_refunded_cash,
  charge as cr_reversed_charge, credit as cr_store_credit, amt + tax as cr_return_amt_inc_tax, amt + tax + fee - (cash + charge + credit) as cr_net_loss
from brought left join buyer refunded on refunded.id = cret_return_customer_id left join buyer returning_ on returning_.id = cret_refund_customer_id
left join open_item on open_item.id = cret_item_id left join open_place on open_place.id = cret_call_center_id
left join day on written = cret_return_date left join time_dim on t_time = clock left join reason on r_reason_id = cret_reason_id
where (open_item.id is not null or cret_item_id not in (select i_item_id from item))
  and (open_place.id is not null or cret_call_center_id not in (select cc_call_center_id from call_center))
-- name: refresh_web_returns
with day as (select d_date_sk, cast(d_date as varchar) as written from date_dim),
buyer as (select c_customer_id as id, c_customer_sk as who, c_current_cdemo_sk as cd, c_current_hdemo_sk as hd, c_current_addr_sk as ad from customer),
open_item as (select i_item_id as id, i_item_sk from item where i_rec_end_date is null),
open_place as (select wp_web_page_id as id, wp_web_page_sk from web_page where wp_rec_end_date is null),
brought as (select *, wret_return_amt as amt, wret_return_tax as tax, wret_return_fee as fee, wret_refunded_cash as cash, wret_reversed_charge as charge, wret_account_credit as credit,
  date_part('epoch', cast(wret_return_time as time)) as clock from s_web_returns)
select wret_order_id as wr_order_number, i_item_sk as wr_item_sk, d_date_sk as wr_returned_date_sk, t_time_sk as wr_returned_time_sk, r_reason_sk as wr_reason_sk, wp_web_page_sk as wr_web_page_sk, refunded.who as wr_refunded_customer_sk, refunded.cd as wr_refunded_cdemo_sk, refunded.hd as wr_refunded_hdemo_sk, refunded.ad as wr_refunded_addr_sk, returning_.who as wr_returning_customer_sk, returning_.cd as wr_returning_cdemo_sk, returning_.hd as wr_returning_hdemo_sk, returning_.ad as wr_returning_addr_sk,
  wret_return_qty as wr_return_quantity, amt as wr_return_amt, tax as wr_return_tax, fee as wr_fee, wret_return_ship_cost as wr_return_ship_cost, cash as wr_refunded_cash,
  charge as wr_reversed_charge, credit as wr_account_credit, amt + tax as wr_return_amt_inc_tax, amt + tax + fee - (cash + charge + credit) as wr_net_loss
from brought left join buyer refunded on refunded.id = wret_return_customer_id left join buyer returning_ on returning_.id = wret_refund_customer_id
left join open_item on open_item.id = wret_item_id left join open_place on open_place.id = wret_web_page_id
left join day on written = wret_return_date left join time_dim on t_time = clock left join reason on r_reason_id = wret_reason_id
where (open_item.id is not null or wret_item_id not in (select i_item_id from item))
  and (open_place.id is not null or wret_web_page_id not in (select wp_web_page_id from web_page))
-- name: refresh_append_refused
select 'store_sales' as fact, (select count(*) from store_sales) + count(*) as rows_stored, count(*) filter (ss_item_sk is not null and ss_ticket_number is not null) as rows_refused
from ({{refresh_store_sales}})
union all
select 'catalog_sales' as fact, (select count(*) from catalog_sales) + count(*) as rows_stored, count(*) filter (cs_item_sk is not null and cs_order_number is not null) as rows_refused
from ({{refresh_catalog_sales}})
union all
select 'web_sales' as fact, (select count(*) from web_sales) + count(*) as rows_stored, count(*) filter (ws_item_sk is not null and ws_order_number is not null) as rows_refused
from ({{refresh_web_sales}})
union all
select 'store_returns' as fact, (select count(*) from store_returns) + count(*) as rows_stored, count(*) filter (sr_item_sk is not null and sr_ticket_number is not null) as rows_refused
from ({{refresh_store_returns}})
union all
select 'catalog_returns' as fact, (select count(*) from catalog_returns) + count(*) as rows_stored, count(*) filter (cr_item_sk is not null and cr_order_number is not null) as rows_refused
from ({{refresh_catalog_returns}})
union all
select 'web_returns' as fact, (select count(*) from web_returns) + count(*) as rows_stored, count(*) filter (wr_item_sk is not null and wr_order_number is not null) as rows_refused
from ({{refresh_web_returns}})

-- name: refresh_append
with stored as (
select 'store_sales' as fact, 0 as added, ss_item_sk as item, ss_ticket_number as document from store_sales
union all
select 'store_sales', 1, ss_item_sk, ss_ticket_number from ({{refresh_store_sales}})
union all
select 'catalog_sales' as fact, 0 as added, cs_item_sk as item, cs_order_number as document from catalog_sales
union all
select 'catalog_sales', 1, cs_item_sk, cs_order_number from ({{refresh_catalog_sales}})
union all
select 'web_sales' as fact, 0 as added, ws_item_sk as item, ws_order_number as document from web_sales
union all
select 'web_sales', 1, ws_item_sk, ws_order_number from ({{refresh_web_sales}})
union all
select 'store_returns' as fact, 0 as added, sr_item_sk as item, sr_ticket_number as document from store_returns
union all
select 'store_returns', 1, sr_item_sk, sr_ticket_number from ({{refresh_store_returns}})
union all
select 'catalog_returns' as fact, 0 as added, cr_item_sk as item, cr_order_number as document from catalog_returns
union all
select 'catalog_returns', 1, cr_item_sk, cr_order_number from ({{refresh_catalog_returns}})
union all
select 'web_returns' as fact, 0 as added, wr_item_sk as item, wr_order_number as document from web_returns
union all
select 'web_returns', 1, wr_item_sk, wr_order_number from ({{refresh_web_returns}}))
select fact, sum(n - added) as rows_before, sum(added) as rows_added, sum(n) as rows_after, sum(n - 1) as repeated_keys
from (select fact, item, document, count(*) as n, sum(added) as added from stored group by all) group by fact
-- name: extract_customer
with day as (select d_date_sk, d_date, (year(d_date), month(d_date), day(d_date)) as parts from date_dim),
home as (select hd_demo_sk, hd_buy_potential, hd_dep_count, hd_vehicle_count, ib_lower_bound + 800 as income
         from household_demographics join income_band on hd_income_band_sk = ib_income_band_sk),
person as (select *, (c_birth_year, c_birth_month, c_birth_day) as born from customer),
dated as (select person.*, b.d_date as birth, s.d_date as shipped, p.d_date as bought
          from person join day b on b.parts = born join day s on s.d_date_sk = c_first_shipto_date_sk join day p on p.d_date_sk = c_first_sales_date_sk),
who as (select cd_demo_sk, cd_gender as cust_gender, cd_marital_status as cust_marital_status, cd_education_status as cust_educ_status,
          cd_credit_rating as cust_credit_rating, cd_purchase_estimate as cust_purch_est, cd_dep_employed_count as cust_depend_emp_cnt,
          cd_dep_college_count as cust_depend_college_cnt from customer_demographics),
lives as (select ca_address_sk, ca_street_number as cust_street_number, ca_suite_number as cust_suite_number, ca_street_name as cust_street_name1,
          ca_street_name as cust_street_name2, ca_street_type as cust_street_type, ca_city as cust_city, ca_zip as cust_zip, ca_county as cust_county,
          ca_state as cust_state, ca_country as cust_country, ca_location_type as cust_loc_type from customer_address)
select who.* exclude (cd_demo_sk), lives.* exclude (ca_address_sk),
  hd_buy_potential as cust_buy_potential, hd_dep_count as cust_depend_cnt, hd_vehicle_count as cust_vehicle_cnt, income as cust_annual_income,
  c_customer_id as cust_customer_id, c_salutation as cust_salutation, c_first_name as cust_first_name, c_last_name as cust_last_name,
  c_preferred_cust_flag as cust_preffered_flag, c_birth_country as cust_birth_country, c_login as cust_login_id, c_email_address as cust_email_address,
  c_last_review_date as cust_last_review_date, birth as cust_birth_date, shipped as cust_first_shipto_date, bought as cust_first_purchase_date
from dated join who on cd_demo_sk = c_current_cdemo_sk join home on hd_demo_sk = c_current_hdemo_sk join lives on ca_address_sk = c_current_addr_sk
-- name: extract_item
select i_item_id item_item_id, i_item_desc item_item_description, i_current_price item_list_price, i_wholesale_cost item_wholesale_cost,
  i_manager_id item_manager_id, i_size item_size, i_formulation item_formulation, i_color item_color, i_units item_units, i_container item_container
from item where i_rec_end_date is null qualify count(*) over (partition by i_item_id) = 1
-- name: extract_inventory
select w_warehouse_id invn_warehouse_id, i_item_id invn_item_id, d_date invn_date, inv_quantity_on_hand invn_qty_on_hand
from inventory join warehouse on w_warehouse_sk = inv_warehouse_sk join item on i_item_sk = inv_item_sk join date_dim on d_date_sk = inv_date_sk
where i_rec_end_date is null and d_year = 2001 and d_dom between 10 and 15
qualify count(*) over (partition by w_warehouse_id, i_item_id, d_date) = 1
-- name: extract_catalog_page
with day as (select d_date_sk, d_date from date_dim)
select cp_catalog_page_id as cpag_id, (select d_date from day where d_date_sk = cp_start_date_sk) as cpag_start_date,
  (select d_date from day where d_date_sk = cp_end_date_sk) as cpag_end_date, cp_department as cpag_department,
  cp_catalog_number as cpag_catalog_number, cp_description as cpag_description, cp_type as cpag_type
from catalog_page
-- name: extract_promotion
select p_promo_id prom_promotion_id, p_promo_name prom_promotion_name, a.d_date prom_start_date, b.d_date prom_end_date, p_cost prom_cost, p_response_target prom_response_target, p_channel_dmail prom_channel_dmail, p_channel_email prom_channel_email, p_channel_catalog prom_channel_catalog, p_channel_tv prom_channel_tv, p_channel_radio prom_channel_radio, p_channel_press prom_channel_press, p_channel_event prom_channel_event, p_channel_demo prom_channel_demo, p_channel_details prom_channel_details, p_purpose prom_purpose, p_discount_active prom_discount_active
from promotion left join date_dim a on a.d_date_sk = p_start_date_sk left join date_dim b on b.d_date_sk = p_end_date_sk
-- name: extract_store
select s_store_id stor_store_id, d_date stor_closed_date, s_store_name stor_name, s_number_employees stor_employees,
  s_floor_space stor_floor_space, s_hours stor_hours, s_manager stor_store_manager, s_market_id stor_market_id,
  s_geography_class stor_geography_class, s_market_manager stor_market_manager, s_tax_precentage stor_tax_percentage
from store join date_dim on d_date_sk = s_closed_date_sk where s_rec_end_date is null
-- name: extract_web_site
select web_site_id wsit_web_site_id, a.d_date wsit_open_date, b.d_date wsit_closed_date, web_name wsit_site_name,
  web_class wsit_site_class, web_manager wsit_site_manager, web_tax_percentage wsit_tax_percentage
from web_site join date_dim a on a.d_date_sk = web_open_date_sk left join date_dim b on b.d_date_sk = web_close_date_sk where web_rec_end_date is null
-- name: extract_web_page
select wp_web_page_id wpag_web_page_id, a.d_date wpag_create_date, b.d_date wpag_access_date, wp_autogen_flag wpag_autogen_flag,
  wp_url wpag_url, wp_type wpag_type, wp_char_count wpag_char_cnt, wp_link_count wpag_link_cnt, wp_image_count wpag_image_cnt, wp_max_ad_count wpag_max_ad_cnt
from web_page left join date_dim a on a.d_date_sk = wp_creation_date_sk left join date_dim b on b.d_date_sk = wp_access_date_sk where wp_rec_end_date is null
-- name: extract_warehouse
select w_warehouse_id wrhs_warehouse_id, w_warehouse_name wrhs_warehouse_desc, w_warehouse_sq_ft wrhs_warehouse_sq_ft from warehouse
-- name: extract_call_center
select cc_call_center_id call_center_id, a.d_date call_open_date, b.d_date call_closed_date, cc_name call_center_name,
  cc_class call_center_class, cc_employees call_center_employees, cc_sq_ft call_center_sq_ft, cc_hours call_center_hours,
  cc_manager call_center_manager, cc_tax_percentage call_center_tax_percentage
from call_center left join date_dim a on a.d_date_sk = cc_open_date_sk left join date_dim b on b.d_date_sk = cc_closed_date_sk where cc_rec_end_date is null
-- name: refresh_customer
with src as (select c_customer_id cust_customer_id, c_salutation cust_salutation, c_last_name cust_last_name, c_first_name cust_first_name,
  c_preferred_cust_flag cust_preffered_flag, b.d_date cust_birth_date, c_birth_country cust_birth_country, c_login cust_login_id,
  c_email_address cust_email_address, s.d_date cust_first_shipto_date, p.d_date cust_first_purchase_date,
  c_last_review_date cust_last_review_date, ca_street_number cust_street_number, ca_suite_number cust_suite_number,
  ca_street_name cust_street_name1, ca_street_name cust_street_name2, ca_street_type cust_street_type, ca_city cust_city, ca_zip cust_zip, ca_county cust_county,
  ca_state cust_state, ca_country cust_country, ca_location_type cust_loc_type, cd_gender cust_gender, cd_marital_status cust_marital_status,
  cd_education_status cust_educ_status, cd_credit_rating cust_credit_rating, cd_purchase_estimate cust_purch_est,
  hd_buy_potential cust_buy_potential, hd_dep_count cust_depend_cnt, cd_dep_employed_count cust_depend_emp_cnt,
  cd_dep_college_count cust_depend_college_cnt, hd_vehicle_count cust_vehicle_cnt, ib_lower_bound + 800 cust_annual_income
from customer join customer_address on ca_address_sk = c_current_addr_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk
join household_demographics on hd_demo_sk = c_current_hdemo_sk join income_band on ib_income_band_sk = hd_income_band_sk
join date_dim s on s.d_date_sk = c_first_shipto_date_sk join date_dim p on p.d_date_sk = c_first_sales_date_sk
join date_dim b on day(b.d_date) = c_birth_day and month(b.d_date) = c_birth_month and year(b.d_date) = c_birth_year),
u as (
  select cust_customer_id k, cd_demo_sk, hd_demo_sk, h.c_current_addr_sk addr, a.d_date_sk shipto, b.d_date_sk sale, src.*
  from src left join customer h on h.c_customer_id = cust_customer_id
  join customer_demographics on (cd_gender, cd_marital_status, cd_education_status, cd_purchase_estimate, cd_credit_rating, cd_dep_count, cd_dep_employed_count, cd_dep_college_count)
    = (cust_gender, cust_marital_status, cust_educ_status, cust_purch_est, cust_credit_rating, cust_depend_cnt, cust_depend_emp_cnt, cust_depend_college_cnt)
  join income_band on round(cust_annual_income, 0) between ib_lower_bound and ib_upper_bound
  join household_demographics on hd_income_band_sk = ib_income_band_sk and hd_buy_potential = cust_buy_potential
    and hd_dep_count = cust_depend_cnt and hd_vehicle_count = cust_vehicle_cnt
  join date_dim a on a.d_date = cust_first_purchase_date join date_dim b on b.d_date = cust_first_shipto_date)
select c_customer_sk, c_customer_id, if(k is null, c_current_cdemo_sk, cd_demo_sk) c_current_cdemo_sk, if(k is null, c_current_hdemo_sk, hd_demo_sk) c_current_hdemo_sk,
  if(k is null, c_current_addr_sk, addr) c_current_addr_sk, if(k is null, c_first_shipto_date_sk, shipto) c_first_shipto_date_sk,
  if(k is null, c_first_sales_date_sk, sale) c_first_sales_date_sk, c_salutation, c_first_name, if(k is null, c_last_name, upper(cust_last_name)) c_last_name,
  c_preferred_cust_flag, c_birth_day, c_birth_month, c_birth_year, c_birth_country, c_login, c_email_address, c_last_review_date
from customer left join u on k = c_customer_id
-- name: refresh_customer_address
with src as (select c_customer_id cust_customer_id, c_salutation cust_salutation, c_last_name cust_last_name, c_first_name cust_first_name,
  c_preferred_cust_flag cust_preffered_flag, b.d_date cust_birth_date, c_birth_country cust_birth_country, c_login cust_login_id,
  c_email_address cust_email_address, s.d_date cust_first_shipto_date, p.d_date cust_first_purchase_date,
  c_last_review_date cust_last_review_date, ca_street_number cust_street_number, ca_suite_number cust_suite_number,
  ca_street_name cust_street_name1, ca_street_name cust_street_name2, ca_street_type cust_street_type, ca_city cust_city, ca_zip cust_zip, ca_county cust_county,
  ca_state cust_state, ca_country cust_country, ca_location_type cust_loc_type, cd_gender cust_gender, cd_marital_status cust_marital_status,
  cd_education_status cust_educ_status, cd_credit_rating cust_credit_rating, cd_purchase_estimate cust_purch_est,
  hd_buy_potential cust_buy_potential, hd_dep_count cust_depend_cnt, cd_dep_employed_count cust_depend_emp_cnt,
  cd_dep_college_count cust_depend_college_cnt, hd_vehicle_count cust_vehicle_cnt, ib_lower_bound + 800 cust_annual_income
from customer join customer_address on ca_address_sk = c_current_addr_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk
join household_demographics on hd_demo_sk = c_current_hdemo_sk join income_band on ib_income_band_sk = hd_income_band_sk
join date_dim s on s.d_date_sk = c_first_shipto_date_sk join date_dim p on p.d_date_sk = c_first_sales_date_sk
join date_dim b on day(b.d_date) = c_birth_day and month(b.d_date) = c_birth_month and year(b.d_date) = c_birth_year), z as (select ca_zip zip, min(ca_gmt_offset) off from customer_address group by 1),
u as (select x.ca_address_id k, src.*, off from src join z on zip = cust_zip join customer on c_customer_id = cust_customer_id join customer_address x on x.ca_address_sk = c_current_addr_sk)
select ca_address_sk, ca_address_id, if(k is null, ca_street_number, cust_street_number) ca_street_number,
  if(k is null, ca_street_name, rtrim(cust_street_name1) || ' ' || rtrim(cust_street_name2)) ca_street_name, ca_street_type, ca_suite_number,
  if(k is null, ca_city, upper(cust_city)) ca_city, ca_county, ca_state, ca_zip, ca_country, if(k is null, ca_gmt_offset, off) ca_gmt_offset, ca_location_type
from customer_address left join u on k = ca_address_id
-- name: refresh_catalog_page
select cp_catalog_page_sk, cp_catalog_page_id, cp_start_date_sk, cp_end_date_sk, cp_department, cp_catalog_number,
  cp_catalog_page_number, cp_description, upper(cp_type) cp_type from catalog_page
-- name: refresh_promotion
select p_promo_sk, p_promo_id, p_start_date_sk, p_end_date_sk, p_item_sk, p_promo_name, p_cost + 10 p_cost, p_response_target, p_channel_dmail, p_channel_email, p_channel_catalog, p_channel_tv, p_channel_radio, p_channel_press, p_channel_event, p_channel_demo, p_channel_details, p_purpose, p_discount_active from promotion
-- name: refresh_warehouse
select * replace (w_warehouse_sq_ft + 5 as w_warehouse_sq_ft) from warehouse
-- name: refresh_item
with k as (select i_item_id from item where i_rec_end_date is null),
old as (select * replace (if(i_item_id in (from k) and i_rec_end_date is null, date'2002-06-30', i_rec_end_date) as i_rec_end_date) from item),
new as (select * replace ((select max(i_item_sk) from item) + row_number() over (order by i_item_id) as i_item_sk, date'2002-06-30' as i_rec_start_date, null::date as i_rec_end_date, i_current_price + 1 as i_current_price) from (from item where i_rec_end_date is null))
select * from old union all select * from new
-- name: refresh_store
with k as (select s_store_id from store where s_rec_end_date is null and s_closed_date_sk is not null),
old as (select * replace (if(s_store_id in (from k) and s_rec_end_date is null, date'2002-06-30', s_rec_end_date) as s_rec_end_date) from store),
new as (select * replace ((select max(s_store_sk) from store) + row_number() over (order by s_store_id) as s_store_sk, date'2002-06-30' as s_rec_start_date, null::date as s_rec_end_date, s_number_employees + 7 as s_number_employees) from (from store where s_rec_end_date is null and s_closed_date_sk is not null))
select * from old union all select * from new
-- name: refresh_web_site
with k as (select web_site_id from web_site where web_rec_end_date is null),
old as (select * replace (if(web_site_id in (from k) and web_rec_end_date is null, date'2002-06-30', web_rec_end_date) as web_rec_end_date) from web_site),
new as (select * replace ((select max(web_site_sk) from web_site) + row_number() over (order by web_site_id) as web_site_sk, date'2002-06-30' as web_rec_start_date, null::date as web_rec_end_date, 'Renewed' as web_class) from (from web_site where web_rec_end_date is null))
select * from old union all select * from new
-- name: refresh_web_page
with k as (select wp_web_page_id from web_page where wp_rec_end_date is null),
old as (select * replace (if(wp_web_page_id in (from k) and wp_rec_end_date is null, date'2002-06-30', wp_rec_end_date) as wp_rec_end_date) from web_page),
new as (select * replace ((select max(wp_web_page_sk) from web_page) + row_number() over (order by wp_web_page_id) as wp_web_page_sk, date'2002-06-30' as wp_rec_start_date, null::date as wp_rec_end_date, wp_link_count + 1 as wp_link_count, null::bigint as wp_customer_sk) from (from web_page where wp_rec_end_date is null))
select * from old union all select * from new
-- name: refresh_call_center
with k as (select cc_call_center_id from call_center where cc_rec_end_date is null),
old as (select * replace (if(cc_call_center_id in (from k) and cc_rec_end_date is null, date'2002-06-30', cc_rec_end_date) as cc_rec_end_date) from call_center),
new as (select * replace ((select max(cc_call_center_sk) from call_center) + row_number() over (order by cc_call_center_id) as cc_call_center_sk, date'2002-06-30' as cc_rec_start_date, null::date as cc_rec_end_date, cc_employees + 3 as cc_employees, cc_open_date_sk as cc_closed_date_sk, cc_closed_date_sk as cc_open_date_sk) from (from call_center where cc_rec_end_date is null))
select * from old union all select * from new
