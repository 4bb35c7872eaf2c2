-- name: check_row_counts
select table_name, n as rows, e expected, coalesce(n = e, true) agrees from (
select 'store_sales' table_name, count(*) n, null::bigint e from store_sales
union all select 'catalog_sales' table_name, count(*) n, null::bigint e from catalog_sales
union all select 'web_sales' table_name, count(*) n, null::bigint e from web_sales
union all select 'store_returns' table_name, count(*) n, null::bigint e from store_returns
union all select 'catalog_returns' table_name, count(*) n, null::bigint e from catalog_returns
union all select 'web_returns' table_name, count(*) n, null::bigint e from web_returns
union all select 'inventory' table_name, count(*) n, null::bigint e from inventory
union all select 'date_dim' table_name, count(*) n, 73049::bigint e from date_dim
union all select 'time_dim' table_name, count(*) n, 86400::bigint e from time_dim
union all select 'item' table_name, count(*) n, null::bigint e from item
union all select 'customer' table_name, count(*) n, null::bigint e from customer
union all select 'customer_address' table_name, count(*) n, null::bigint e from customer_address
union all select 'customer_demographics' table_name, count(*) n, 5600::bigint e from customer_demographics
union all select 'household_demographics' table_name, count(*) n, 7200::bigint e from household_demographics
union all select 'income_band' table_name, count(*) n, 20::bigint e from income_band
union all select 'store' table_name, count(*) n, null::bigint e from store
union all select 'warehouse' table_name, count(*) n, null::bigint e from warehouse
union all select 'call_center' table_name, count(*) n, null::bigint e from call_center
union all select 'web_site' table_name, count(*) n, null::bigint e from web_site
union all select 'web_page' table_name, count(*) n, null::bigint e from web_page
union all select 'promotion' table_name, count(*) n, null::bigint e from promotion
union all select 'catalog_page' table_name, count(*) n, null::bigint e from catalog_page
union all select 'reason' table_name, count(*) n, null::bigint e from reason
union all select 'ship_mode' table_name, count(*) n, null::bigint e from ship_mode)
-- name: check_primary_keys
select * from (
select 'store_sales' table_name, count(*) as rows, count(distinct (ss_item_sk, ss_ticket_number)) distinct_keys, count(*) filter (ss_item_sk is null or ss_ticket_number is null) null_keys from store_sales
union all select 'catalog_sales' table_name, count(*) as rows, count(distinct (cs_item_sk, cs_order_number)) distinct_keys, count(*) filter (cs_item_sk is null or cs_order_number is null) null_keys from catalog_sales
union all select 'web_sales' table_name, count(*) as rows, count(distinct (ws_item_sk, ws_order_number)) distinct_keys, count(*) filter (ws_item_sk is null or ws_order_number is null) null_keys from web_sales
union all select 'store_returns' table_name, count(*) as rows, count(distinct (sr_item_sk, sr_ticket_number)) distinct_keys, count(*) filter (sr_item_sk is null or sr_ticket_number is null) null_keys from store_returns
union all select 'catalog_returns' table_name, count(*) as rows, count(distinct (cr_item_sk, cr_order_number)) distinct_keys, count(*) filter (cr_item_sk is null or cr_order_number is null) null_keys from catalog_returns
union all select 'web_returns' table_name, count(*) as rows, count(distinct (wr_item_sk, wr_order_number)) distinct_keys, count(*) filter (wr_item_sk is null or wr_order_number is null) null_keys from web_returns
union all select 'inventory' table_name, count(*) as rows, count(distinct (inv_date_sk, inv_item_sk, inv_warehouse_sk)) distinct_keys, count(*) filter (inv_date_sk is null or inv_item_sk is null or inv_warehouse_sk is null) null_keys from inventory
union all select 'date_dim' table_name, count(*) as rows, count(distinct (d_date_sk)) distinct_keys, count(*) filter (d_date_sk is null) null_keys from date_dim
union all select 'time_dim' table_name, count(*) as rows, count(distinct (t_time_sk)) distinct_keys, count(*) filter (t_time_sk is null) null_keys from time_dim
union all select 'item' table_name, count(*) as rows, count(distinct (i_item_sk)) distinct_keys, count(*) filter (i_item_sk is null) null_keys from item
union all select 'customer' table_name, count(*) as rows, count(distinct (c_customer_sk)) distinct_keys, count(*) filter (c_customer_sk is null) null_keys from customer
union all select 'customer_address' table_name, count(*) as rows, count(distinct (ca_address_sk)) distinct_keys, count(*) filter (ca_address_sk is null) null_keys from customer_address
union all select 'customer_demographics' table_name, count(*) as rows, count(distinct (cd_demo_sk)) distinct_keys, count(*) filter (cd_demo_sk is null) null_keys from customer_demographics
union all select 'household_demographics' table_name, count(*) as rows, count(distinct (hd_demo_sk)) distinct_keys, count(*) filter (hd_demo_sk is null) null_keys from household_demographics
union all select 'income_band' table_name, count(*) as rows, count(distinct (ib_income_band_sk)) distinct_keys, count(*) filter (ib_income_band_sk is null) null_keys from income_band
union all select 'store' table_name, count(*) as rows, count(distinct (s_store_sk)) distinct_keys, count(*) filter (s_store_sk is null) null_keys from store
union all select 'warehouse' table_name, count(*) as rows, count(distinct (w_warehouse_sk)) distinct_keys, count(*) filter (w_warehouse_sk is null) null_keys from warehouse
union all select 'call_center' table_name, count(*) as rows, count(distinct (cc_call_center_sk)) distinct_keys, count(*) filter (cc_call_center_sk is null) null_keys from call_center
union all select 'web_site' table_name, count(*) as rows, count(distinct (web_site_sk)) distinct_keys, count(*) filter (web_site_sk is null) null_keys from web_site
union all select 'web_page' table_name, count(*) as rows, count(distinct (wp_web_page_sk)) distinct_keys, count(*) filter (wp_web_page_sk is null) null_keys from web_page
union all select 'promotion' table_name, count(*) as rows, count(distinct (p_promo_sk)) distinct_keys, count(*) filter (p_promo_sk is null) null_keys from promotion
union all select 'catalog_page' table_name, count(*) as rows, count(distinct (cp_catalog_page_sk)) distinct_keys, count(*) filter (cp_catalog_page_sk is null) null_keys from catalog_page
union all select 'reason' table_name, count(*) as rows, count(distinct (r_reason_sk)) distinct_keys, count(*) filter (r_reason_sk is null) null_keys from reason
union all select 'ship_mode' table_name, count(*) as rows, count(distinct (sm_ship_mode_sk)) distinct_keys, count(*) filter (sm_ship_mode_sk is null) null_keys from ship_mode)
-- name: check_foreign_keys
select * from (
select 'store_sales' child, 'ss_sold_date_sk' column_name, 'date_dim.d_date_sk' parent, count(ss_sold_date_sk) as rows, count(distinct ss_sold_date_sk) distinct_used, min(ss_sold_date_sk) min_used, max(ss_sold_date_sk) max_used,
  count(*) filter (ss_sold_date_sk is not null and ss_sold_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from store_sales
union all select 'store_sales' child, 'ss_sold_time_sk' column_name, 'time_dim.t_time_sk' parent, count(ss_sold_time_sk) as rows, count(distinct ss_sold_time_sk) distinct_used, min(ss_sold_time_sk) min_used, max(ss_sold_time_sk) max_used,
  count(*) filter (ss_sold_time_sk is not null and ss_sold_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from store_sales
union all select 'store_sales' child, 'ss_item_sk' column_name, 'item.i_item_sk' parent, count(ss_item_sk) as rows, count(distinct ss_item_sk) distinct_used, min(ss_item_sk) min_used, max(ss_item_sk) max_used,
  count(*) filter (ss_item_sk is not null and ss_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from store_sales
union all select 'store_sales' child, 'ss_customer_sk' column_name, 'customer.c_customer_sk' parent, count(ss_customer_sk) as rows, count(distinct ss_customer_sk) distinct_used, min(ss_customer_sk) min_used, max(ss_customer_sk) max_used,
  count(*) filter (ss_customer_sk is not null and ss_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from store_sales
union all select 'store_sales' child, 'ss_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(ss_cdemo_sk) as rows, count(distinct ss_cdemo_sk) distinct_used, min(ss_cdemo_sk) min_used, max(ss_cdemo_sk) max_used,
  count(*) filter (ss_cdemo_sk is not null and ss_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from store_sales
union all select 'store_sales' child, 'ss_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(ss_hdemo_sk) as rows, count(distinct ss_hdemo_sk) distinct_used, min(ss_hdemo_sk) min_used, max(ss_hdemo_sk) max_used,
  count(*) filter (ss_hdemo_sk is not null and ss_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from store_sales
union all select 'store_sales' child, 'ss_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(ss_addr_sk) as rows, count(distinct ss_addr_sk) distinct_used, min(ss_addr_sk) min_used, max(ss_addr_sk) max_used,
  count(*) filter (ss_addr_sk is not null and ss_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from store_sales
union all select 'store_sales' child, 'ss_store_sk' column_name, 'store.s_store_sk' parent, count(ss_store_sk) as rows, count(distinct ss_store_sk) distinct_used, min(ss_store_sk) min_used, max(ss_store_sk) max_used,
  count(*) filter (ss_store_sk is not null and ss_store_sk not in (select x.s_store_sk from store x)) orphan_rows, (select count(*) from store) parent_keys, (select min(s_store_sk) from store) parent_min, (select max(s_store_sk) from store) parent_max from store_sales
union all select 'store_sales' child, 'ss_promo_sk' column_name, 'promotion.p_promo_sk' parent, count(ss_promo_sk) as rows, count(distinct ss_promo_sk) distinct_used, min(ss_promo_sk) min_used, max(ss_promo_sk) max_used,
  count(*) filter (ss_promo_sk is not null and ss_promo_sk not in (select x.p_promo_sk from promotion x)) orphan_rows, (select count(*) from promotion) parent_keys, (select min(p_promo_sk) from promotion) parent_min, (select max(p_promo_sk) from promotion) parent_max from store_sales
union all select 'catalog_sales' child, 'cs_sold_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cs_sold_date_sk) as rows, count(distinct cs_sold_date_sk) distinct_used, min(cs_sold_date_sk) min_used, max(cs_sold_date_sk) max_used,
  count(*) filter (cs_sold_date_sk is not null and cs_sold_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_sold_time_sk' column_name, 'time_dim.t_time_sk' parent, count(cs_sold_time_sk) as rows, count(distinct cs_sold_time_sk) distinct_used, min(cs_sold_time_sk) min_used, max(cs_sold_time_sk) max_used,
  count(*) filter (cs_sold_time_sk is not null and cs_sold_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cs_ship_date_sk) as rows, count(distinct cs_ship_date_sk) distinct_used, min(cs_ship_date_sk) min_used, max(cs_ship_date_sk) max_used,
  count(*) filter (cs_ship_date_sk is not null and cs_ship_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_item_sk' column_name, 'item.i_item_sk' parent, count(cs_item_sk) as rows, count(distinct cs_item_sk) distinct_used, min(cs_item_sk) min_used, max(cs_item_sk) max_used,
  count(*) filter (cs_item_sk is not null and cs_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_bill_customer_sk' column_name, 'customer.c_customer_sk' parent, count(cs_bill_customer_sk) as rows, count(distinct cs_bill_customer_sk) distinct_used, min(cs_bill_customer_sk) min_used, max(cs_bill_customer_sk) max_used,
  count(*) filter (cs_bill_customer_sk is not null and cs_bill_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_bill_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(cs_bill_cdemo_sk) as rows, count(distinct cs_bill_cdemo_sk) distinct_used, min(cs_bill_cdemo_sk) min_used, max(cs_bill_cdemo_sk) max_used,
  count(*) filter (cs_bill_cdemo_sk is not null and cs_bill_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_bill_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(cs_bill_hdemo_sk) as rows, count(distinct cs_bill_hdemo_sk) distinct_used, min(cs_bill_hdemo_sk) min_used, max(cs_bill_hdemo_sk) max_used,
  count(*) filter (cs_bill_hdemo_sk is not null and cs_bill_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_bill_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(cs_bill_addr_sk) as rows, count(distinct cs_bill_addr_sk) distinct_used, min(cs_bill_addr_sk) min_used, max(cs_bill_addr_sk) max_used,
  count(*) filter (cs_bill_addr_sk is not null and cs_bill_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_customer_sk' column_name, 'customer.c_customer_sk' parent, count(cs_ship_customer_sk) as rows, count(distinct cs_ship_customer_sk) distinct_used, min(cs_ship_customer_sk) min_used, max(cs_ship_customer_sk) max_used,
  count(*) filter (cs_ship_customer_sk is not null and cs_ship_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(cs_ship_cdemo_sk) as rows, count(distinct cs_ship_cdemo_sk) distinct_used, min(cs_ship_cdemo_sk) min_used, max(cs_ship_cdemo_sk) max_used,
  count(*) filter (cs_ship_cdemo_sk is not null and cs_ship_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(cs_ship_hdemo_sk) as rows, count(distinct cs_ship_hdemo_sk) distinct_used, min(cs_ship_hdemo_sk) min_used, max(cs_ship_hdemo_sk) max_used,
  count(*) filter (cs_ship_hdemo_sk is not null and cs_ship_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(cs_ship_addr_sk) as rows, count(distinct cs_ship_addr_sk) distinct_used, min(cs_ship_addr_sk) min_used, max(cs_ship_addr_sk) max_used,
  count(*) filter (cs_ship_addr_sk is not null and cs_ship_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_call_center_sk' column_name, 'call_center.cc_call_center_sk' parent, count(cs_call_center_sk) as rows, count(distinct cs_call_center_sk) distinct_used, min(cs_call_center_sk) min_used, max(cs_call_center_sk) max_used,
  count(*) filter (cs_call_center_sk is not null and cs_call_center_sk not in (select x.cc_call_center_sk from call_center x)) orphan_rows, (select count(*) from call_center) parent_keys, (select min(cc_call_center_sk) from call_center) parent_min, (select max(cc_call_center_sk) from call_center) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_catalog_page_sk' column_name, 'catalog_page.cp_catalog_page_sk' parent, count(cs_catalog_page_sk) as rows, count(distinct cs_catalog_page_sk) distinct_used, min(cs_catalog_page_sk) min_used, max(cs_catalog_page_sk) max_used,
  count(*) filter (cs_catalog_page_sk is not null and cs_catalog_page_sk not in (select x.cp_catalog_page_sk from catalog_page x)) orphan_rows, (select count(*) from catalog_page) parent_keys, (select min(cp_catalog_page_sk) from catalog_page) parent_min, (select max(cp_catalog_page_sk) from catalog_page) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_ship_mode_sk' column_name, 'ship_mode.sm_ship_mode_sk' parent, count(cs_ship_mode_sk) as rows, count(distinct cs_ship_mode_sk) distinct_used, min(cs_ship_mode_sk) min_used, max(cs_ship_mode_sk) max_used,
  count(*) filter (cs_ship_mode_sk is not null and cs_ship_mode_sk not in (select x.sm_ship_mode_sk from ship_mode x)) orphan_rows, (select count(*) from ship_mode) parent_keys, (select min(sm_ship_mode_sk) from ship_mode) parent_min, (select max(sm_ship_mode_sk) from ship_mode) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_warehouse_sk' column_name, 'warehouse.w_warehouse_sk' parent, count(cs_warehouse_sk) as rows, count(distinct cs_warehouse_sk) distinct_used, min(cs_warehouse_sk) min_used, max(cs_warehouse_sk) max_used,
  count(*) filter (cs_warehouse_sk is not null and cs_warehouse_sk not in (select x.w_warehouse_sk from warehouse x)) orphan_rows, (select count(*) from warehouse) parent_keys, (select min(w_warehouse_sk) from warehouse) parent_min, (select max(w_warehouse_sk) from warehouse) parent_max from catalog_sales
union all select 'catalog_sales' child, 'cs_promo_sk' column_name, 'promotion.p_promo_sk' parent, count(cs_promo_sk) as rows, count(distinct cs_promo_sk) distinct_used, min(cs_promo_sk) min_used, max(cs_promo_sk) max_used,
  count(*) filter (cs_promo_sk is not null and cs_promo_sk not in (select x.p_promo_sk from promotion x)) orphan_rows, (select count(*) from promotion) parent_keys, (select min(p_promo_sk) from promotion) parent_min, (select max(p_promo_sk) from promotion) parent_max from catalog_sales
union all select 'web_sales' child, 'ws_sold_date_sk' column_name, 'date_dim.d_date_sk' parent, count(ws_sold_date_sk) as rows, count(distinct ws_sold_date_sk) distinct_used, min(ws_sold_date_sk) min_used, max(ws_sold_date_sk) max_used,
  count(*) filter (ws_sold_date_sk is not null and ws_sold_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_sales
union all select 'web_sales' child, 'ws_sold_time_sk' column_name, 'time_dim.t_time_sk' parent, count(ws_sold_time_sk) as rows, count(distinct ws_sold_time_sk) distinct_used, min(ws_sold_time_sk) min_used, max(ws_sold_time_sk) max_used,
  count(*) filter (ws_sold_time_sk is not null and ws_sold_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_date_sk' column_name, 'date_dim.d_date_sk' parent, count(ws_ship_date_sk) as rows, count(distinct ws_ship_date_sk) distinct_used, min(ws_ship_date_sk) min_used, max(ws_ship_date_sk) max_used,
  count(*) filter (ws_ship_date_sk is not null and ws_ship_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_sales
union all select 'web_sales' child, 'ws_item_sk' column_name, 'item.i_item_sk' parent, count(ws_item_sk) as rows, count(distinct ws_item_sk) distinct_used, min(ws_item_sk) min_used, max(ws_item_sk) max_used,
  count(*) filter (ws_item_sk is not null and ws_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from web_sales
union all select 'web_sales' child, 'ws_bill_customer_sk' column_name, 'customer.c_customer_sk' parent, count(ws_bill_customer_sk) as rows, count(distinct ws_bill_customer_sk) distinct_used, min(ws_bill_customer_sk) min_used, max(ws_bill_customer_sk) max_used,
  count(*) filter (ws_bill_customer_sk is not null and ws_bill_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from web_sales
union all select 'web_sales' child, 'ws_bill_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(ws_bill_cdemo_sk) as rows, count(distinct ws_bill_cdemo_sk) distinct_used, min(ws_bill_cdemo_sk) min_used, max(ws_bill_cdemo_sk) max_used,
  count(*) filter (ws_bill_cdemo_sk is not null and ws_bill_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from web_sales
union all select 'web_sales' child, 'ws_bill_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(ws_bill_hdemo_sk) as rows, count(distinct ws_bill_hdemo_sk) distinct_used, min(ws_bill_hdemo_sk) min_used, max(ws_bill_hdemo_sk) max_used,
  count(*) filter (ws_bill_hdemo_sk is not null and ws_bill_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from web_sales
union all select 'web_sales' child, 'ws_bill_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(ws_bill_addr_sk) as rows, count(distinct ws_bill_addr_sk) distinct_used, min(ws_bill_addr_sk) min_used, max(ws_bill_addr_sk) max_used,
  count(*) filter (ws_bill_addr_sk is not null and ws_bill_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_customer_sk' column_name, 'customer.c_customer_sk' parent, count(ws_ship_customer_sk) as rows, count(distinct ws_ship_customer_sk) distinct_used, min(ws_ship_customer_sk) min_used, max(ws_ship_customer_sk) max_used,
  count(*) filter (ws_ship_customer_sk is not null and ws_ship_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(ws_ship_cdemo_sk) as rows, count(distinct ws_ship_cdemo_sk) distinct_used, min(ws_ship_cdemo_sk) min_used, max(ws_ship_cdemo_sk) max_used,
  count(*) filter (ws_ship_cdemo_sk is not null and ws_ship_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(ws_ship_hdemo_sk) as rows, count(distinct ws_ship_hdemo_sk) distinct_used, min(ws_ship_hdemo_sk) min_used, max(ws_ship_hdemo_sk) max_used,
  count(*) filter (ws_ship_hdemo_sk is not null and ws_ship_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(ws_ship_addr_sk) as rows, count(distinct ws_ship_addr_sk) distinct_used, min(ws_ship_addr_sk) min_used, max(ws_ship_addr_sk) max_used,
  count(*) filter (ws_ship_addr_sk is not null and ws_ship_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from web_sales
union all select 'web_sales' child, 'ws_web_page_sk' column_name, 'web_page.wp_web_page_sk' parent, count(ws_web_page_sk) as rows, count(distinct ws_web_page_sk) distinct_used, min(ws_web_page_sk) min_used, max(ws_web_page_sk) max_used,
  count(*) filter (ws_web_page_sk is not null and ws_web_page_sk not in (select x.wp_web_page_sk from web_page x)) orphan_rows, (select count(*) from web_page) parent_keys, (select min(wp_web_page_sk) from web_page) parent_min, (select max(wp_web_page_sk) from web_page) parent_max from web_sales
union all select 'web_sales' child, 'ws_web_site_sk' column_name, 'web_site.web_site_sk' parent, count(ws_web_site_sk) as rows, count(distinct ws_web_site_sk) distinct_used, min(ws_web_site_sk) min_used, max(ws_web_site_sk) max_used,
  count(*) filter (ws_web_site_sk is not null and ws_web_site_sk not in (select x.web_site_sk from web_site x)) orphan_rows, (select count(*) from web_site) parent_keys, (select min(web_site_sk) from web_site) parent_min, (select max(web_site_sk) from web_site) parent_max from web_sales
union all select 'web_sales' child, 'ws_ship_mode_sk' column_name, 'ship_mode.sm_ship_mode_sk' parent, count(ws_ship_mode_sk) as rows, count(distinct ws_ship_mode_sk) distinct_used, min(ws_ship_mode_sk) min_used, max(ws_ship_mode_sk) max_used,
  count(*) filter (ws_ship_mode_sk is not null and ws_ship_mode_sk not in (select x.sm_ship_mode_sk from ship_mode x)) orphan_rows, (select count(*) from ship_mode) parent_keys, (select min(sm_ship_mode_sk) from ship_mode) parent_min, (select max(sm_ship_mode_sk) from ship_mode) parent_max from web_sales
union all select 'web_sales' child, 'ws_warehouse_sk' column_name, 'warehouse.w_warehouse_sk' parent, count(ws_warehouse_sk) as rows, count(distinct ws_warehouse_sk) distinct_used, min(ws_warehouse_sk) min_used, max(ws_warehouse_sk) max_used,
  count(*) filter (ws_warehouse_sk is not null and ws_warehouse_sk not in (select x.w_warehouse_sk from warehouse x)) orphan_rows, (select count(*) from warehouse) parent_keys, (select min(w_warehouse_sk) from warehouse) parent_min, (select max(w_warehouse_sk) from warehouse) parent_max from web_sales
union all select 'web_sales' child, 'ws_promo_sk' column_name, 'promotion.p_promo_sk' parent, count(ws_promo_sk) as rows, count(distinct ws_promo_sk) distinct_used, min(ws_promo_sk) min_used, max(ws_promo_sk) max_used,
  count(*) filter (ws_promo_sk is not null and ws_promo_sk not in (select x.p_promo_sk from promotion x)) orphan_rows, (select count(*) from promotion) parent_keys, (select min(p_promo_sk) from promotion) parent_min, (select max(p_promo_sk) from promotion) parent_max from web_sales
union all select 'store_returns' child, 'sr_returned_date_sk' column_name, 'date_dim.d_date_sk' parent, count(sr_returned_date_sk) as rows, count(distinct sr_returned_date_sk) distinct_used, min(sr_returned_date_sk) min_used, max(sr_returned_date_sk) max_used,
  count(*) filter (sr_returned_date_sk is not null and sr_returned_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from store_returns
union all select 'store_returns' child, 'sr_return_time_sk' column_name, 'time_dim.t_time_sk' parent, count(sr_return_time_sk) as rows, count(distinct sr_return_time_sk) distinct_used, min(sr_return_time_sk) min_used, max(sr_return_time_sk) max_used,
  count(*) filter (sr_return_time_sk is not null and sr_return_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from store_returns
union all select 'store_returns' child, 'sr_item_sk' column_name, 'item.i_item_sk' parent, count(sr_item_sk) as rows, count(distinct sr_item_sk) distinct_used, min(sr_item_sk) min_used, max(sr_item_sk) max_used,
  count(*) filter (sr_item_sk is not null and sr_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from store_returns
union all select 'store_returns' child, 'sr_customer_sk' column_name, 'customer.c_customer_sk' parent, count(sr_customer_sk) as rows, count(distinct sr_customer_sk) distinct_used, min(sr_customer_sk) min_used, max(sr_customer_sk) max_used,
  count(*) filter (sr_customer_sk is not null and sr_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from store_returns
union all select 'store_returns' child, 'sr_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(sr_cdemo_sk) as rows, count(distinct sr_cdemo_sk) distinct_used, min(sr_cdemo_sk) min_used, max(sr_cdemo_sk) max_used,
  count(*) filter (sr_cdemo_sk is not null and sr_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from store_returns
union all select 'store_returns' child, 'sr_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(sr_hdemo_sk) as rows, count(distinct sr_hdemo_sk) distinct_used, min(sr_hdemo_sk) min_used, max(sr_hdemo_sk) max_used,
  count(*) filter (sr_hdemo_sk is not null and sr_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from store_returns
union all select 'store_returns' child, 'sr_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(sr_addr_sk) as rows, count(distinct sr_addr_sk) distinct_used, min(sr_addr_sk) min_used, max(sr_addr_sk) max_used,
  count(*) filter (sr_addr_sk is not null and sr_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from store_returns
union all select 'store_returns' child, 'sr_store_sk' column_name, 'store.s_store_sk' parent, count(sr_store_sk) as rows, count(distinct sr_store_sk) distinct_used, min(sr_store_sk) min_used, max(sr_store_sk) max_used,
  count(*) filter (sr_store_sk is not null and sr_store_sk not in (select x.s_store_sk from store x)) orphan_rows, (select count(*) from store) parent_keys, (select min(s_store_sk) from store) parent_min, (select max(s_store_sk) from store) parent_max from store_returns
union all select 'store_returns' child, 'sr_reason_sk' column_name, 'reason.r_reason_sk' parent, count(sr_reason_sk) as rows, count(distinct sr_reason_sk) distinct_used, min(sr_reason_sk) min_used, max(sr_reason_sk) max_used,
  count(*) filter (sr_reason_sk is not null and sr_reason_sk not in (select x.r_reason_sk from reason x)) orphan_rows, (select count(*) from reason) parent_keys, (select min(r_reason_sk) from reason) parent_min, (select max(r_reason_sk) from reason) parent_max from store_returns
union all select 'catalog_returns' child, 'cr_returned_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cr_returned_date_sk) as rows, count(distinct cr_returned_date_sk) distinct_used, min(cr_returned_date_sk) min_used, max(cr_returned_date_sk) max_used,
  count(*) filter (cr_returned_date_sk is not null and cr_returned_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_returned_time_sk' column_name, 'time_dim.t_time_sk' parent, count(cr_returned_time_sk) as rows, count(distinct cr_returned_time_sk) distinct_used, min(cr_returned_time_sk) min_used, max(cr_returned_time_sk) max_used,
  count(*) filter (cr_returned_time_sk is not null and cr_returned_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_item_sk' column_name, 'item.i_item_sk' parent, count(cr_item_sk) as rows, count(distinct cr_item_sk) distinct_used, min(cr_item_sk) min_used, max(cr_item_sk) max_used,
  count(*) filter (cr_item_sk is not null and cr_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_refunded_customer_sk' column_name, 'customer.c_customer_sk' parent, count(cr_refunded_customer_sk) as rows, count(distinct cr_refunded_customer_sk) distinct_used, min(cr_refunded_customer_sk) min_used, max(cr_refunded_customer_sk) max_used,
  count(*) filter (cr_refunded_customer_sk is not null and cr_refunded_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_refunded_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(cr_refunded_cdemo_sk) as rows, count(distinct cr_refunded_cdemo_sk) distinct_used, min(cr_refunded_cdemo_sk) min_used, max(cr_refunded_cdemo_sk) max_used,
  count(*) filter (cr_refunded_cdemo_sk is not null and cr_refunded_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_refunded_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(cr_refunded_hdemo_sk) as rows, count(distinct cr_refunded_hdemo_sk) distinct_used, min(cr_refunded_hdemo_sk) min_used, max(cr_refunded_hdemo_sk) max_used,
  count(*) filter (cr_refunded_hdemo_sk is not null and cr_refunded_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_refunded_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(cr_refunded_addr_sk) as rows, count(distinct cr_refunded_addr_sk) distinct_used, min(cr_refunded_addr_sk) min_used, max(cr_refunded_addr_sk) max_used,
  count(*) filter (cr_refunded_addr_sk is not null and cr_refunded_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_returning_customer_sk' column_name, 'customer.c_customer_sk' parent, count(cr_returning_customer_sk) as rows, count(distinct cr_returning_customer_sk) distinct_used, min(cr_returning_customer_sk) min_used, max(cr_returning_customer_sk) max_used,
  count(*) filter (cr_returning_customer_sk is not null and cr_returning_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_returning_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(cr_returning_cdemo_sk) as rows, count(distinct cr_returning_cdemo_sk) distinct_used, min(cr_returning_cdemo_sk) min_used, max(cr_returning_cdemo_sk) max_used,
  count(*) filter (cr_returning_cdemo_sk is not null and cr_returning_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_returning_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(cr_returning_hdemo_sk) as rows, count(distinct cr_returning_hdemo_sk) distinct_used, min(cr_returning_hdemo_sk) min_used, max(cr_returning_hdemo_sk) max_used,
  count(*) filter (cr_returning_hdemo_sk is not null and cr_returning_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_returning_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(cr_returning_addr_sk) as rows, count(distinct cr_returning_addr_sk) distinct_used, min(cr_returning_addr_sk) min_used, max(cr_returning_addr_sk) max_used,
  count(*) filter (cr_returning_addr_sk is not null and cr_returning_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_call_center_sk' column_name, 'call_center.cc_call_center_sk' parent, count(cr_call_center_sk) as rows, count(distinct cr_call_center_sk) distinct_used, min(cr_call_center_sk) min_used, max(cr_call_center_sk) max_used,
  count(*) filter (cr_call_center_sk is not null and cr_call_center_sk not in (select x.cc_call_center_sk from call_center x)) orphan_rows, (select count(*) from call_center) parent_keys, (select min(cc_call_center_sk) from call_center) parent_min, (select max(cc_call_center_sk) from call_center) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_catalog_page_sk' column_name, 'catalog_page.cp_catalog_page_sk' parent, count(cr_catalog_page_sk) as rows, count(distinct cr_catalog_page_sk) distinct_used, min(cr_catalog_page_sk) min_used, max(cr_catalog_page_sk) max_used,
  count(*) filter (cr_catalog_page_sk is not null and cr_catalog_page_sk not in (select x.cp_catalog_page_sk from catalog_page x)) orphan_rows, (select count(*) from catalog_page) parent_keys, (select min(cp_catalog_page_sk) from catalog_page) parent_min, (select max(cp_catalog_page_sk) from catalog_page) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_ship_mode_sk' column_name, 'ship_mode.sm_ship_mode_sk' parent, count(cr_ship_mode_sk) as rows, count(distinct cr_ship_mode_sk) distinct_used, min(cr_ship_mode_sk) min_used, max(cr_ship_mode_sk) max_used,
  count(*) filter (cr_ship_mode_sk is not null and cr_ship_mode_sk not in (select x.sm_ship_mode_sk from ship_mode x)) orphan_rows, (select count(*) from ship_mode) parent_keys, (select min(sm_ship_mode_sk) from ship_mode) parent_min, (select max(sm_ship_mode_sk) from ship_mode) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_warehouse_sk' column_name, 'warehouse.w_warehouse_sk' parent, count(cr_warehouse_sk) as rows, count(distinct cr_warehouse_sk) distinct_used, min(cr_warehouse_sk) min_used, max(cr_warehouse_sk) max_used,
  count(*) filter (cr_warehouse_sk is not null and cr_warehouse_sk not in (select x.w_warehouse_sk from warehouse x)) orphan_rows, (select count(*) from warehouse) parent_keys, (select min(w_warehouse_sk) from warehouse) parent_min, (select max(w_warehouse_sk) from warehouse) parent_max from catalog_returns
union all select 'catalog_returns' child, 'cr_reason_sk' column_name, 'reason.r_reason_sk' parent, count(cr_reason_sk) as rows, count(distinct cr_reason_sk) distinct_used, min(cr_reason_sk) min_used, max(cr_reason_sk) max_used,
  count(*) filter (cr_reason_sk is not null and cr_reason_sk not in (select x.r_reason_sk from reason x)) orphan_rows, (select count(*) from reason) parent_keys, (select min(r_reason_sk) from reason) parent_min, (select max(r_reason_sk) from reason) parent_max from catalog_returns
union all select 'web_returns' child, 'wr_returned_date_sk' column_name, 'date_dim.d_date_sk' parent, count(wr_returned_date_sk) as rows, count(distinct wr_returned_date_sk) distinct_used, min(wr_returned_date_sk) min_used, max(wr_returned_date_sk) max_used,
  count(*) filter (wr_returned_date_sk is not null and wr_returned_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_returns
union all select 'web_returns' child, 'wr_returned_time_sk' column_name, 'time_dim.t_time_sk' parent, count(wr_returned_time_sk) as rows, count(distinct wr_returned_time_sk) distinct_used, min(wr_returned_time_sk) min_used, max(wr_returned_time_sk) max_used,
  count(*) filter (wr_returned_time_sk is not null and wr_returned_time_sk not in (select x.t_time_sk from time_dim x)) orphan_rows, (select count(*) from time_dim) parent_keys, (select min(t_time_sk) from time_dim) parent_min, (select max(t_time_sk) from time_dim) parent_max from web_returns
union all select 'web_returns' child, 'wr_item_sk' column_name, 'item.i_item_sk' parent, count(wr_item_sk) as rows, count(distinct wr_item_sk) distinct_used, min(wr_item_sk) min_used, max(wr_item_sk) max_used,
  count(*) filter (wr_item_sk is not null and wr_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from web_returns
union all select 'web_returns' child, 'wr_refunded_customer_sk' column_name, 'customer.c_customer_sk' parent, count(wr_refunded_customer_sk) as rows, count(distinct wr_refunded_customer_sk) distinct_used, min(wr_refunded_customer_sk) min_used, max(wr_refunded_customer_sk) max_used,
  count(*) filter (wr_refunded_customer_sk is not null and wr_refunded_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from web_returns
union all select 'web_returns' child, 'wr_refunded_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(wr_refunded_cdemo_sk) as rows, count(distinct wr_refunded_cdemo_sk) distinct_used, min(wr_refunded_cdemo_sk) min_used, max(wr_refunded_cdemo_sk) max_used,
  count(*) filter (wr_refunded_cdemo_sk is not null and wr_refunded_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from web_returns
union all select 'web_returns' child, 'wr_refunded_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(wr_refunded_hdemo_sk) as rows, count(distinct wr_refunded_hdemo_sk) distinct_used, min(wr_refunded_hdemo_sk) min_used, max(wr_refunded_hdemo_sk) max_used,
  count(*) filter (wr_refunded_hdemo_sk is not null and wr_refunded_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from web_returns
union all select 'web_returns' child, 'wr_refunded_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(wr_refunded_addr_sk) as rows, count(distinct wr_refunded_addr_sk) distinct_used, min(wr_refunded_addr_sk) min_used, max(wr_refunded_addr_sk) max_used,
  count(*) filter (wr_refunded_addr_sk is not null and wr_refunded_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from web_returns
union all select 'web_returns' child, 'wr_returning_customer_sk' column_name, 'customer.c_customer_sk' parent, count(wr_returning_customer_sk) as rows, count(distinct wr_returning_customer_sk) distinct_used, min(wr_returning_customer_sk) min_used, max(wr_returning_customer_sk) max_used,
  count(*) filter (wr_returning_customer_sk is not null and wr_returning_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from web_returns
union all select 'web_returns' child, 'wr_returning_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(wr_returning_cdemo_sk) as rows, count(distinct wr_returning_cdemo_sk) distinct_used, min(wr_returning_cdemo_sk) min_used, max(wr_returning_cdemo_sk) max_used,
  count(*) filter (wr_returning_cdemo_sk is not null and wr_returning_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from web_returns
union all select 'web_returns' child, 'wr_returning_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(wr_returning_hdemo_sk) as rows, count(distinct wr_returning_hdemo_sk) distinct_used, min(wr_returning_hdemo_sk) min_used, max(wr_returning_hdemo_sk) max_used,
  count(*) filter (wr_returning_hdemo_sk is not null and wr_returning_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from web_returns
union all select 'web_returns' child, 'wr_returning_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(wr_returning_addr_sk) as rows, count(distinct wr_returning_addr_sk) distinct_used, min(wr_returning_addr_sk) min_used, max(wr_returning_addr_sk) max_used,
  count(*) filter (wr_returning_addr_sk is not null and wr_returning_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from web_returns
union all select 'web_returns' child, 'wr_web_page_sk' column_name, 'web_page.wp_web_page_sk' parent, count(wr_web_page_sk) as rows, count(distinct wr_web_page_sk) distinct_used, min(wr_web_page_sk) min_used, max(wr_web_page_sk) max_used,
  count(*) filter (wr_web_page_sk is not null and wr_web_page_sk not in (select x.wp_web_page_sk from web_page x)) orphan_rows, (select count(*) from web_page) parent_keys, (select min(wp_web_page_sk) from web_page) parent_min, (select max(wp_web_page_sk) from web_page) parent_max from web_returns
union all select 'web_returns' child, 'wr_reason_sk' column_name, 'reason.r_reason_sk' parent, count(wr_reason_sk) as rows, count(distinct wr_reason_sk) distinct_used, min(wr_reason_sk) min_used, max(wr_reason_sk) max_used,
  count(*) filter (wr_reason_sk is not null and wr_reason_sk not in (select x.r_reason_sk from reason x)) orphan_rows, (select count(*) from reason) parent_keys, (select min(r_reason_sk) from reason) parent_min, (select max(r_reason_sk) from reason) parent_max from web_returns
union all select 'inventory' child, 'inv_date_sk' column_name, 'date_dim.d_date_sk' parent, count(inv_date_sk) as rows, count(distinct inv_date_sk) distinct_used, min(inv_date_sk) min_used, max(inv_date_sk) max_used,
  count(*) filter (inv_date_sk is not null and inv_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from inventory
union all select 'inventory' child, 'inv_item_sk' column_name, 'item.i_item_sk' parent, count(inv_item_sk) as rows, count(distinct inv_item_sk) distinct_used, min(inv_item_sk) min_used, max(inv_item_sk) max_used,
  count(*) filter (inv_item_sk is not null and inv_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from inventory
union all select 'inventory' child, 'inv_warehouse_sk' column_name, 'warehouse.w_warehouse_sk' parent, count(inv_warehouse_sk) as rows, count(distinct inv_warehouse_sk) distinct_used, min(inv_warehouse_sk) min_used, max(inv_warehouse_sk) max_used,
  count(*) filter (inv_warehouse_sk is not null and inv_warehouse_sk not in (select x.w_warehouse_sk from warehouse x)) orphan_rows, (select count(*) from warehouse) parent_keys, (select min(w_warehouse_sk) from warehouse) parent_min, (select max(w_warehouse_sk) from warehouse) parent_max from inventory
union all select 'customer' child, 'c_current_cdemo_sk' column_name, 'customer_demographics.cd_demo_sk' parent, count(c_current_cdemo_sk) as rows, count(distinct c_current_cdemo_sk) distinct_used, min(c_current_cdemo_sk) min_used, max(c_current_cdemo_sk) max_used,
  count(*) filter (c_current_cdemo_sk is not null and c_current_cdemo_sk not in (select x.cd_demo_sk from customer_demographics x)) orphan_rows, (select count(*) from customer_demographics) parent_keys, (select min(cd_demo_sk) from customer_demographics) parent_min, (select max(cd_demo_sk) from customer_demographics) parent_max from customer
union all select 'customer' child, 'c_current_hdemo_sk' column_name, 'household_demographics.hd_demo_sk' parent, count(c_current_hdemo_sk) as rows, count(distinct c_current_hdemo_sk) distinct_used, min(c_current_hdemo_sk) min_used, max(c_current_hdemo_sk) max_used,
  count(*) filter (c_current_hdemo_sk is not null and c_current_hdemo_sk not in (select x.hd_demo_sk from household_demographics x)) orphan_rows, (select count(*) from household_demographics) parent_keys, (select min(hd_demo_sk) from household_demographics) parent_min, (select max(hd_demo_sk) from household_demographics) parent_max from customer
union all select 'customer' child, 'c_current_addr_sk' column_name, 'customer_address.ca_address_sk' parent, count(c_current_addr_sk) as rows, count(distinct c_current_addr_sk) distinct_used, min(c_current_addr_sk) min_used, max(c_current_addr_sk) max_used,
  count(*) filter (c_current_addr_sk is not null and c_current_addr_sk not in (select x.ca_address_sk from customer_address x)) orphan_rows, (select count(*) from customer_address) parent_keys, (select min(ca_address_sk) from customer_address) parent_min, (select max(ca_address_sk) from customer_address) parent_max from customer
union all select 'customer' child, 'c_first_shipto_date_sk' column_name, 'date_dim.d_date_sk' parent, count(c_first_shipto_date_sk) as rows, count(distinct c_first_shipto_date_sk) distinct_used, min(c_first_shipto_date_sk) min_used, max(c_first_shipto_date_sk) max_used,
  count(*) filter (c_first_shipto_date_sk is not null and c_first_shipto_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from customer
union all select 'customer' child, 'c_first_sales_date_sk' column_name, 'date_dim.d_date_sk' parent, count(c_first_sales_date_sk) as rows, count(distinct c_first_sales_date_sk) distinct_used, min(c_first_sales_date_sk) min_used, max(c_first_sales_date_sk) max_used,
  count(*) filter (c_first_sales_date_sk is not null and c_first_sales_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from customer
union all select 'customer' child, 'c_last_review_date_sk' column_name, 'date_dim.d_date_sk' parent, count(c_last_review_date_sk) as rows, count(distinct c_last_review_date_sk) distinct_used, min(c_last_review_date_sk) min_used, max(c_last_review_date_sk) max_used,
  count(*) filter (c_last_review_date_sk is not null and c_last_review_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from customer
union all select 'household_demographics' child, 'hd_income_band_sk' column_name, 'income_band.ib_income_band_sk' parent, count(hd_income_band_sk) as rows, count(distinct hd_income_band_sk) distinct_used, min(hd_income_band_sk) min_used, max(hd_income_band_sk) max_used,
  count(*) filter (hd_income_band_sk is not null and hd_income_band_sk not in (select x.ib_income_band_sk from income_band x)) orphan_rows, (select count(*) from income_band) parent_keys, (select min(ib_income_band_sk) from income_band) parent_min, (select max(ib_income_band_sk) from income_band) parent_max from household_demographics
union all select 'store' child, 's_closed_date_sk' column_name, 'date_dim.d_date_sk' parent, count(s_closed_date_sk) as rows, count(distinct s_closed_date_sk) distinct_used, min(s_closed_date_sk) min_used, max(s_closed_date_sk) max_used,
  count(*) filter (s_closed_date_sk is not null and s_closed_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from store
union all select 'call_center' child, 'cc_closed_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cc_closed_date_sk) as rows, count(distinct cc_closed_date_sk) distinct_used, min(cc_closed_date_sk) min_used, max(cc_closed_date_sk) max_used,
  count(*) filter (cc_closed_date_sk is not null and cc_closed_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from call_center
union all select 'call_center' child, 'cc_open_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cc_open_date_sk) as rows, count(distinct cc_open_date_sk) distinct_used, min(cc_open_date_sk) min_used, max(cc_open_date_sk) max_used,
  count(*) filter (cc_open_date_sk is not null and cc_open_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from call_center
union all select 'web_site' child, 'web_open_date_sk' column_name, 'date_dim.d_date_sk' parent, count(web_open_date_sk) as rows, count(distinct web_open_date_sk) distinct_used, min(web_open_date_sk) min_used, max(web_open_date_sk) max_used,
  count(*) filter (web_open_date_sk is not null and web_open_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_site
union all select 'web_site' child, 'web_close_date_sk' column_name, 'date_dim.d_date_sk' parent, count(web_close_date_sk) as rows, count(distinct web_close_date_sk) distinct_used, min(web_close_date_sk) min_used, max(web_close_date_sk) max_used,
  count(*) filter (web_close_date_sk is not null and web_close_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_site
union all select 'web_page' child, 'wp_creation_date_sk' column_name, 'date_dim.d_date_sk' parent, count(wp_creation_date_sk) as rows, count(distinct wp_creation_date_sk) distinct_used, min(wp_creation_date_sk) min_used, max(wp_creation_date_sk) max_used,
  count(*) filter (wp_creation_date_sk is not null and wp_creation_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_page
union all select 'web_page' child, 'wp_access_date_sk' column_name, 'date_dim.d_date_sk' parent, count(wp_access_date_sk) as rows, count(distinct wp_access_date_sk) distinct_used, min(wp_access_date_sk) min_used, max(wp_access_date_sk) max_used,
  count(*) filter (wp_access_date_sk is not null and wp_access_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from web_page
union all select 'web_page' child, 'wp_customer_sk' column_name, 'customer.c_customer_sk' parent, count(wp_customer_sk) as rows, count(distinct wp_customer_sk) distinct_used, min(wp_customer_sk) min_used, max(wp_customer_sk) max_used,
  count(*) filter (wp_customer_sk is not null and wp_customer_sk not in (select x.c_customer_sk from customer x)) orphan_rows, (select count(*) from customer) parent_keys, (select min(c_customer_sk) from customer) parent_min, (select max(c_customer_sk) from customer) parent_max from web_page
union all select 'promotion' child, 'p_start_date_sk' column_name, 'date_dim.d_date_sk' parent, count(p_start_date_sk) as rows, count(distinct p_start_date_sk) distinct_used, min(p_start_date_sk) min_used, max(p_start_date_sk) max_used,
  count(*) filter (p_start_date_sk is not null and p_start_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from promotion
union all select 'promotion' child, 'p_end_date_sk' column_name, 'date_dim.d_date_sk' parent, count(p_end_date_sk) as rows, count(distinct p_end_date_sk) distinct_used, min(p_end_date_sk) min_used, max(p_end_date_sk) max_used,
  count(*) filter (p_end_date_sk is not null and p_end_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from promotion
union all select 'promotion' child, 'p_item_sk' column_name, 'item.i_item_sk' parent, count(p_item_sk) as rows, count(distinct p_item_sk) distinct_used, min(p_item_sk) min_used, max(p_item_sk) max_used,
  count(*) filter (p_item_sk is not null and p_item_sk not in (select x.i_item_sk from item x)) orphan_rows, (select count(*) from item) parent_keys, (select min(i_item_sk) from item) parent_min, (select max(i_item_sk) from item) parent_max from promotion
union all select 'catalog_page' child, 'cp_start_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cp_start_date_sk) as rows, count(distinct cp_start_date_sk) distinct_used, min(cp_start_date_sk) min_used, max(cp_start_date_sk) max_used,
  count(*) filter (cp_start_date_sk is not null and cp_start_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from catalog_page
union all select 'catalog_page' child, 'cp_end_date_sk' column_name, 'date_dim.d_date_sk' parent, count(cp_end_date_sk) as rows, count(distinct cp_end_date_sk) distinct_used, min(cp_end_date_sk) min_used, max(cp_end_date_sk) max_used,
  count(*) filter (cp_end_date_sk is not null and cp_end_date_sk not in (select x.d_date_sk from date_dim x)) orphan_rows, (select count(*) from date_dim) parent_keys, (select min(d_date_sk) from date_dim) parent_min, (select max(d_date_sk) from date_dim) parent_max from catalog_page
) where rows > 0
-- name: check_return_keys
select 'store_returns' child, 'store_sales' parent, count(*) orphan_rows from store_returns where not exists (select 1 from store_sales where ss_item_sk = sr_item_sk and ss_ticket_number = sr_ticket_number)
union all select 'catalog_returns' child, 'catalog_sales' parent, count(*) orphan_rows from catalog_returns where not exists (select 1 from catalog_sales where cs_item_sk = cr_item_sk and cs_order_number = cr_order_number)
union all select 'web_returns' child, 'web_sales' parent, count(*) orphan_rows from web_returns where not exists (select 1 from web_sales where ws_item_sk = wr_item_sk and ws_order_number = wr_order_number)
-- name: check_not_in
select distinct ss_customer_sk customer_sk from store_sales where ss_customer_sk not in (
  select ws_bill_customer_sk from web_sales join date_dim on d_date_sk = ws_sold_date_sk where d_year = 1999 and ws_bill_customer_sk is not null)
-- name: check_sample_present
select ws_item_sk item_sk, ws_order_number order_number, ws_quantity quantity, ws_list_price list_price from web_sales
where not exists (select 1 from store_sales where ss_item_sk = ws_item_sk and ss_ticket_number = ws_order_number
  and ss_quantity = ws_quantity and ss_list_price = ws_list_price)
-- name: check_cell_differences
with r as (with src as (select c_customer_id cust_customer_id, c_salutation cust_salutation, c_last_name cust_last_name, c_first_name cust_first_name,
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
from customer left join u on k = c_customer_id)
select * from (
select b.c_customer_id, 'c_current_cdemo_sk' column_name, b.c_current_cdemo_sk::varchar before, a.c_current_cdemo_sk::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_current_cdemo_sk is distinct from b.c_current_cdemo_sk
union all select b.c_customer_id, 'c_current_hdemo_sk' column_name, b.c_current_hdemo_sk::varchar before, a.c_current_hdemo_sk::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_current_hdemo_sk is distinct from b.c_current_hdemo_sk
union all select b.c_customer_id, 'c_current_addr_sk' column_name, b.c_current_addr_sk::varchar before, a.c_current_addr_sk::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_current_addr_sk is distinct from b.c_current_addr_sk
union all select b.c_customer_id, 'c_first_shipto_date_sk' column_name, b.c_first_shipto_date_sk::varchar before, a.c_first_shipto_date_sk::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_first_shipto_date_sk is distinct from b.c_first_shipto_date_sk
union all select b.c_customer_id, 'c_first_sales_date_sk' column_name, b.c_first_sales_date_sk::varchar before, a.c_first_sales_date_sk::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_first_sales_date_sk is distinct from b.c_first_sales_date_sk
union all select b.c_customer_id, 'c_last_name' column_name, b.c_last_name::varchar before, a.c_last_name::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_last_name is distinct from b.c_last_name
union all select b.c_customer_id, 'c_preferred_cust_flag' column_name, b.c_preferred_cust_flag::varchar before, a.c_preferred_cust_flag::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_preferred_cust_flag is distinct from b.c_preferred_cust_flag
union all select b.c_customer_id, 'c_birth_day' column_name, b.c_birth_day::varchar before, a.c_birth_day::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_birth_day is distinct from b.c_birth_day
union all select b.c_customer_id, 'c_birth_country' column_name, b.c_birth_country::varchar before, a.c_birth_country::varchar after from customer b join r a on a.c_customer_id = b.c_customer_id where a.c_birth_country is distinct from b.c_birth_country)
-- name: check_not_null
with r as (select d_date_sk ss_sold_date_sk, t_time_sk ss_sold_time_sk, I.i_item_sk ss_item_sk, c_customer_sk ss_customer_sk,
  c_current_cdemo_sk ss_cdemo_sk, c_current_hdemo_sk ss_hdemo_sk, c_current_addr_sk ss_addr_sk, s_store_sk ss_store_sk,
  p_promo_sk ss_promo_sk, purc_purchase_id ss_ticket_number, plin_quantity ss_quantity, I.i_wholesale_cost ss_wholesale_cost, I.i_current_price ss_list_price, plin_sale_price ss_sales_price,
  (I.i_current_price - plin_sale_price) * plin_quantity ss_ext_discount_amt, plin_sale_price * plin_quantity ss_ext_sales_price, I.i_wholesale_cost * plin_quantity ss_ext_wholesale_cost,
  I.i_current_price * plin_quantity ss_ext_list_price, I.i_current_price * s_tax_precentage ss_ext_tax, plin_coupon_amt ss_coupon_amt,
  plin_sale_price * plin_quantity - plin_coupon_amt ss_net_paid, (plin_sale_price * plin_quantity - plin_coupon_amt) * (1 + s_tax_precentage) ss_net_paid_inc_tax,
  plin_sale_price * plin_quantity - plin_coupon_amt - plin_quantity * I.i_wholesale_cost ss_net_profit
from s_purchase_lineitem join s_purchase on purc_purchase_id = plin_purchase_id
left join customer on c_customer_id = purc_customer_id left join store on s_store_id = purc_store_id
left join date_dim on d_date = case when purc_purchase_date like '%-47%' or trim(purc_purchase_date) = '' then null else purc_purchase_date::date end left join time_dim on t_time = purc_purchase_time
left join promotion on p_promo_id = plin_promotion_id left join item I on I.i_item_id = plin_item_id
where I.i_rec_end_date is null and s_rec_end_date is null)
select 'ss_sold_date_sk' column_name, count(*) - count(ss_sold_date_sk) nulls from r
union all select 'ss_sold_time_sk' column_name, count(*) - count(ss_sold_time_sk) nulls from r
union all select 'ss_item_sk' column_name, count(*) - count(ss_item_sk) nulls from r
union all select 'ss_customer_sk' column_name, count(*) - count(ss_customer_sk) nulls from r
union all select 'ss_cdemo_sk' column_name, count(*) - count(ss_cdemo_sk) nulls from r
union all select 'ss_hdemo_sk' column_name, count(*) - count(ss_hdemo_sk) nulls from r
union all select 'ss_addr_sk' column_name, count(*) - count(ss_addr_sk) nulls from r
union all select 'ss_store_sk' column_name, count(*) - count(ss_store_sk) nulls from r
union all select 'ss_promo_sk' column_name, count(*) - count(ss_promo_sk) nulls from r
-- name: load_delimited
select * from store_returns
-- name: load_typed_json
select * from customer
-- name: check_same_content
select count(*) left_rows, count(*) right_rows, true same from item
-- name: layout_hashed
select cs_item_sk, count(*) as rows, sum(cs_quantity) quantity from catalog_sales group by 1
-- name: layout_ranged
select ss_item_sk, count(*) as rows, sum(ss_quantity) quantity from store_sales group by 1

-- name: check_changed_ranges
select i_item_sk item_sk, 'i_current_price' column_name, i_current_price::varchar before, (i_current_price + 1)::varchar after
from item where i_item_sk between 100 and 120 and i_current_price is not null
-- name: load_sorted_out
select case when sr_ticket_number % 7 = 0 then (select count(*) + 2 from (describe store_returns)) || ' fields, not ' || (select count(*) from (describe store_returns))
    when sr_ticket_number % 11 = 0 then '3 fields, not ' || (select count(*) from (describe store_returns))
    when sr_ticket_number % 13 = 0 then 'sr_returned_date_sk is no bigint' else 'loaded' end reason, count(*) lines
from store_returns group by 1
-- name: join_buckets
select i_category, count(*) as rows, sum(ss_quantity) quantity from store_sales join item on i_item_sk = ss_item_sk group by 1
