-- name: computed_columns
select p_partkey, p_retailprice::decimal(12,2) * 2 + 1 double_price, 50 - p_size size_left, p_brand || '/' || p_type as label from part
-- name: filter_ranges
select o_orderkey, o_totalprice, o_orderstatus from orders
where o_orderstatus = 'F' and o_totalprice >= 100000 and o_totalprice <= 120000 and o_orderpriority in ('1-URGENT', '5-LOW')
-- name: filter_days
select o_orderkey, o_custkey from orders where o_orderdate::date between date'1998-03-01' and date'1998-03-31'
-- name: filter_between_scalars
with b as (select (select sum(p_retailprice::decimal(12,2))::double / count(*) from part where p_size <= 10) x,
                  (select sum(p_retailprice::decimal(12,2))::double / count(*) from part where p_size > 40) y)
select p_partkey, p_retailprice from part, b where p_retailprice between least(x, y) and greatest(x, y)
-- name: filter_or_across_tables
select count(*) n, sum(o_totalprice::decimal(12,2)) total from orders join customer on c_custkey = o_custkey
where c_mktsegment = 'BUILDING' and o_totalprice > 200000 or c_mktsegment = 'MACHINERY' and o_orderpriority = '1-URGENT'
-- name: filter_prefix
select p_partkey, p_name from part where p_name like 'red%'
-- name: distinct_tags
select distinct 'brand' kind, p_brand as name from part union all select distinct 'type', p_type from part
-- name: join_star
select r_name, c_mktsegment, count(*) orders, sum(o_totalprice::decimal(12,2)) total
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all
-- name: join_composite_keys
select count(*) n, sum(l_quantity) quantity from lineitem
where (l_orderkey, l_partkey) in (select (l_orderkey, l_partkey) from lineitem group by l_orderkey, l_partkey having count(*) > 1)
-- name: join_cast_keys
select n_name, count(*) suppliers from supplier join nation on s_nationkey::float = n_nationkey::float group by 1
-- name: join_theta
select r_name, count(*) customers from customer join region on c_nationkey >= r_regionkey group by 1
-- name: join_residual
select count(*) n from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey
where l_shipdate::date - o_orderdate::date > 60 and s_nationkey <> c_nationkey
-- name: join_bands
select r_regionkey band, count(*) customers from customer join region on round(c_acctbal, 0) between r_regionkey * 2000 and r_regionkey * 2000 + 1999 group by 1
-- name: join_left
select c_custkey, count(o_orderkey) orders from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1
-- name: join_unmatched
select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey where l_orderkey is null
-- name: join_full
select coalesce(c_nationkey, s_nationkey) nation, customers, suppliers
from (select c_nationkey, count(*) customers from customer where c_acctbal > 9000 group by 1)
full join (select s_nationkey, count(*) suppliers from supplier where s_acctbal > 5000 group by 1) on c_nationkey = s_nationkey
-- name: semi_join
select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)
-- name: semi_join_other_value
select l_orderkey, count(*) lines from lineitem a
where exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey) group by 1
-- name: anti_join
select s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity = 50)
-- name: exists_either
select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 400000)
  or c_custkey in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice < 5000)
-- name: one_pass_counts
select m urgent, s small, b urgent_small, m::double / s::double ratio from (select count(*) m from orders where o_orderpriority = '1-URGENT')
cross join (select count(*) s from orders where o_totalprice < 100000)
cross join (select count(*) b from orders where o_orderpriority = '1-URGENT' and o_totalprice < 100000)
-- name: join_next_month
with x as (select year(o_orderdate) * 12 + month(o_orderdate) m, o_orderstatus, sum(o_totalprice::decimal(12,2)) total from orders group by all)
select o_orderstatus, a.m, a.total, b.total next_total from x a join x b using (o_orderstatus) where b.m = a.m + 1
-- name: pivot_years
with x as (select c_mktsegment, year(o_orderdate) y, sum(o_totalprice::decimal(12,2)) v from orders join customer on c_custkey = o_custkey group by all)
select c_mktsegment, a.v y1997, b.v y1998, b.v::double / a.v::double growth from x a join x b using (c_mktsegment) where a.y = 1997 and b.y = 1998
-- name: join_two_roles
select a.n_name customer_nation, b.n_name supplier_nation, count(*) lines
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey group by all
-- name: join_on_function
select replace(upper(n_name), 'NATION_', '')::int nation, count(*) pairs
from part join nation on replace(p_brand, 'Brand#', '') = replace(upper(n_name), 'NATION_', '') group by 1
-- name: aggregate_groups
select o_orderpriority, count(*) n, sum(v) total, sum(v)::double / count(v) mean, min(v) least, max(v) most,
  count(distinct o_custkey) buyers, round(stddev_samp(o_totalprice), 2) dev
from (select *, o_totalprice::decimal(12,2) v from orders) group by 1
-- name: pivot_weekdays
select o_orderstatus, count(*) filter (d = 0) sun, count(*) filter (d = 1) mon, count(*) filter (d = 2) tue, count(*) filter (d = 3) wed,
  count(*) filter (d = 4) thu, count(*) filter (d = 5) fri, count(*) filter (d = 6) sat
from (select o_orderstatus, dayofweek(o_orderdate) d from orders) group by 1
-- name: delay_histogram
select l_returnflag, count(*) filter (n <= 30) d30, count(*) filter (n > 30 and n <= 60) d60, count(*) filter (n > 60) more,
  count(*) filter (o_orderdate < date'2000-01-01') before_2000, count(*) filter (o_orderdate >= date'2000-01-01') since_2000
from (select *, l_shipdate::date - o_orderdate::date n from lineitem join orders on o_orderkey = l_orderkey) group by 1
-- name: having_above_mean
select l_partkey, sum(l_quantity) quantity from lineitem group by 1
having sum(l_quantity) > 1.5::double * (select sum(l_quantity) / count(distinct l_partkey) from lineitem)
-- name: above_group_mean
select p_partkey, p_type, p_retailprice from part o
where p_retailprice > (select sum(i.p_retailprice::decimal(12,2))::double / count(*) from part i where i.p_type = o.p_type) * 1.05::double
-- name: rollup_flags
select r_name region, n_name nation, count(*) orders, grouping(r_name) + grouping(n_name) lochierarchy
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
group by rollup (r_name, n_name)
-- name: group_by_expression
select o_orderpriority[1:3] prefix, year(o_orderdate) as "year", count(*) n from orders group by all
-- name: keys_once_only
select l_orderkey, l_linenumber, l_partkey from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1
-- name: rank_whole_table
select c_custkey, rank() over (order by c_acctbal desc) richest, rank() over (order by c_acctbal) poorest from customer
-- name: top_per_group
select o_orderstatus, o_orderkey, o_totalprice, rank() over (partition by o_orderstatus order by o_totalprice desc) rnk from orders qualify rnk <= 10
-- name: running_totals
with x as (select year(o_orderdate) * 12 + month(o_orderdate) m, o_orderstatus, sum(o_totalprice::decimal(12,2)) total from orders group by all)
select o_orderstatus, m, total, sum(total) over (w rows unbounded preceding) running, max(total) over (w rows unbounded preceding) highest,
  lag(total) over w previous, lead(total) over w as following, row_number() over w n
from x window w as (partition by o_orderstatus order by m)
-- name: share_of_group
with x as (select p_type, p_brand, sum(p_retailprice::decimal(12,2)) v from part group by all)
select p_type, p_brand, v as value, (v * 100)::double / sum(v) over (partition by p_type)::double share from x
-- name: key_sequence
select s_name as name, (select max(c_custkey) from customer) + row_number() over (order by s_name) as key from supplier
-- name: top_hundred
select o_orderpriority, o_totalprice, o_orderkey from orders
-- name: set_operations
with a as (select o_custkey from orders where year(o_orderdate) = 1996), b as (select o_custkey from orders where year(o_orderdate) = 1997)
select (select count(*) from (from a intersect from b)) common, (select count(*) from (from a except from b)) first_only,
  (select count(*) from (from a union from b)) either
-- name: scalar_functions
select p_partkey, upper(p_name) shout, rtrim(p_name || '  ') || '|' as trimmed, substr(p_name, 2, 3) piece, lpad(p_size::varchar, 4, '0') padded,
  round(p_retailprice::decimal(12,2) * 0.5::decimal(3,2), 1) rounded, abs(p_retailprice::decimal(12,2) - 950) distance,
  floor(p_retailprice) whole, case when p_size < 10 then 'small' when p_size < 30 then 'middle' end kind,
  coalesce(case when p_size > 45 then p_type end, p_brand) first_known from part
-- name: date_functions
select o_orderkey, year(o_orderdate) y, month(o_orderdate) m, day(o_orderdate) d, o_orderdate::date + 7 week_on,
  o_orderdate::date - date'1995-01-01' gap, hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) second_of_day,
  case when o_orderkey >= 10 then o_orderdate::date end cleaned from orders
-- name: guarded_ratios
select p_brand, sum(p_size)::double / count(*) plain, count(*)::double / nullif(count(*) filter (p_size <= 2), 0) guarded from part group by 1
-- name: case_of_scalars
select case when (select count(*) from part where p_size <= 25) > 100
  then (select sum(p_retailprice::decimal(12,2))::double / count(*) from part where p_size <= 25)
  else (select sum(p_size)::double / count(*) from part where p_size <= 25) end cheap,
  (select sum(p_size)::double / count(*) from part where p_size > 25) dear
-- name: nested_subqueries
select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation
  where n_regionkey in (select n_regionkey from supplier join nation on n_nationkey = s_nationkey where s_acctbal = (select max(s_acctbal) from supplier))))

-- name: join_theta_orders
with o as (select o_totalprice::decimal(12,2) price from orders),
ranks as (select price, count(*) over (order by price desc range between unbounded preceding and current row) n from o)
select l_orderkey, l_linenumber, n later from (select l_orderkey, l_linenumber, l_extendedprice::decimal(12,2) worth from lineitem where l_quantity >= 45) l
asof join (select distinct price, n from ranks) r on r.price >= l.worth
-- name: join_replicated
select r_name, n_name, count(*) orders, sum(o_totalprice::decimal(12,2)) total
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2
-- name: join_bands_of_parts
with b as (select p_partkey, p_retailprice::decimal(12,2) * 100 as middle, p_size * 10 as half from part)
select p_partkey, count(*) orders from b join orders on o_totalprice::decimal(12,2) between middle - half and middle + half group by 1
-- name: top_ranks
select * from (select o_orderkey, rank() over (partition by o_orderstatus order by o_totalprice::decimal(12,2) desc) dearest,
    rank() over (partition by o_orderstatus order by o_orderdate::date) oldest from orders) where dearest <= 25 or oldest <= 25
-- name: running_total_of_all
select o_orderkey, sum(o_totalprice::decimal(12,2)) over (order by o_orderdate::date) running from orders
