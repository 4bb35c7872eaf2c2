"""One small query per relational shape of the corpus, straight on the order tables.

The corpus uses these shapes together; here each stands alone, on whole source tables.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from starling.functions.exact import avg, count_if, ratio, stddev_samp, sum_if
from starling.operators.ordered import in_bands, totals_at_least
from starling.operators.ranking import global_ranks, running_sums, surrogate_keys, top_ranks
from starling.operators.relational import (lowest, matching, pick, rollup_of, role, star, union_all,
                                           with_group, with_scalar)
from starling.operators.replicated import if_small
from starling.plans import base

c = F.col


def query(name, cols, order="", limit=None):
    return base.query(name, cols, order, limit, on_star=False)


def cents(name):
    """Money as an exact decimal."""
    return c(name).cast("decimal(12,2)")


def day(name):
    return c(name).cast("date")


# ---- projection, filter, predicate -------------------------------------------------------------

@query("computed_columns", "p_partkey:i double_price:n size_left:i label")
def computed_columns(t):
    return t.source("part").select("p_partkey", (cents("p_retailprice") * 2 + 1).alias("double_price"),
                                   (F.lit(50) - c("p_size")).alias("size_left"), F.concat("p_brand", F.lit("/"), "p_type").alias("label"))


@query("filter_ranges", "o_orderkey:i o_totalprice:n o_orderstatus")
def filter_ranges(t):
    return t.source("orders").filter((c("o_orderstatus") == "F") & c("o_totalprice").between(100000, 120000)
                                     & c("o_orderpriority").isin("1-URGENT", "5-LOW"))


@query("filter_days", "o_orderkey:i o_custkey:i")
def filter_days(t, start="1998-03-01", days=30):
    first = F.to_date(F.lit(start))
    return t.source("orders").filter(day("o_orderdate").between(first, F.date_add(first, days)))


@query("filter_between_scalars", "p_partkey:i p_retailprice:n")
def filter_between_scalars(t):
    """Parts priced between the mean of small parts and the mean of large parts."""
    part = t.source("part")
    bounds = part.agg(ratio(sum_if(c("p_size") <= 10, cents("p_retailprice")), F.count_if(c("p_size") <= 10)).alias("a"),
                      ratio(sum_if(c("p_size") > 40, cents("p_retailprice")), F.count_if(c("p_size") > 40)).alias("b"))
    return with_scalar(part, bounds).filter(c("p_retailprice").between(F.least("a", "b"), F.greatest("a", "b")))


@query("filter_or_across_tables", "n:i total:n")
def filter_or_across_tables(t):
    rows = star(t.source("orders"), (t.source("customer"), "o_custkey", "c_custkey"))
    either = (((c("c_mktsegment") == "BUILDING") & (c("o_totalprice") > 200000))
              | ((c("c_mktsegment") == "MACHINERY") & (c("o_orderpriority") == "1-URGENT")))
    return rows.filter(either).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("total"))


@query("filter_prefix", "p_partkey:i p_name")
def filter_prefix(t):
    return t.source("part").filter(c("p_name").startswith("red"))


@query("distinct_tags", "kind name", "kind name")
def distinct_tags(t):
    return union_all(pick(t.source("part"), name="p_brand").withColumn("kind", F.lit("brand")),
                     pick(t.source("part"), name="p_type").withColumn("kind", F.lit("type"))).distinct()


# ---- joins ---------------------------------------------------------------------------------------

@query("join_star", "r_name c_mktsegment orders:i total:n")
def join_star(t):
    return (star(t.source("orders"), (t.source("customer"), "o_custkey", "c_custkey"),
                 (t.source("nation"), "c_nationkey", "n_nationkey"), (t.source("region"), "n_regionkey", "r_regionkey"))
            .groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("total")))


@query("join_composite_keys", "n:i quantity:n")
def join_composite_keys(t):
    """Lines of an order and part that occur more than once together."""
    line = t.source("lineitem")
    often = (line.groupBy(c("l_orderkey").alias("o"), c("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    return (line.join(often, (c("l_orderkey") == c("o")) & (c("l_partkey") == c("p")))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(c("l_quantity").cast("bigint")).alias("quantity")))


@query("join_cast_keys", "n_name suppliers:i")
def join_cast_keys(t):
    """Equality of cast keys, joined by sorting and merging the counts per key."""
    counts = t.source("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return counts.hint("merge").join(t.source("nation"), c("s_nationkey").cast("float") == c("n_nationkey").cast("float"))


@query("join_theta", "r_name customers:i")
def join_theta(t):
    """Customers of nations numbered at least as high as the region: summed over the nations in order."""
    counts = t.source("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return (totals_at_least(counts, "c_nationkey", "n", t.source("region"), "r_regionkey", "customers")
            .groupBy("r_name").agg(F.sum("customers").alias("customers")))


@query("join_theta_orders", "l_orderkey:i l_linenumber:i later:i")
def join_theta_orders(t):
    """Per line with a large quantity the orders of at least its price: two large sides and no pairs."""
    orders = t.source("orders").select(cents("o_totalprice").alias("price"), F.lit(1).alias("one"))
    lines = t.source("lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("worth"))
    return totals_at_least(orders, "price", "one", lines, "worth", "later")


@query("join_replicated", "r_name n_name orders:i total:n")
def join_replicated(t):
    """Orders by region and nation, the reference tables in every task where their files prove them small."""
    orders = t.source("orders").join(t.source("customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
    rows = star(orders, (if_small(t.source("nation")), "c_nationkey", "n_nationkey"), (if_small(t.source("region")), "n_regionkey", "r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("total"))


@query("join_residual", "n:i")
def join_residual(t):
    """Lines shipped more than 60 days after their order by a supplier abroad."""
    orders = star(t.source("orders"), (t.source("customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"))
    lines = star(t.source("lineitem"), (t.source("supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey"))
    return lines.join(orders, (c("l_orderkey") == c("o_orderkey")) & (day("l_shipdate") > F.date_add(day("o_orderdate"), 60))
                      & (c("s_nationkey") != c("c_nationkey"))).agg(F.count(F.lit(1)).alias("n"))


@query("join_bands", "band:i customers:i")
def join_bands(t):
    """Account balances into bands of two thousand, one per region."""
    bands = t.source("region").select(c("r_regionkey").alias("band"), (c("r_regionkey") * 2000).alias("lo"), (c("r_regionkey") * 2000 + 1999).alias("hi"))
    balances = t.source("customer").select(F.round("c_acctbal", 0).alias("balance"))
    return in_bands(balances, "balance", bands, "lo", "hi", 1000).groupBy("band").agg(F.count(F.lit(1)).alias("customers"))


@query("join_bands_of_parts", "p_partkey:i orders:i")
def join_bands_of_parts(t):
    """Orders whose price is a hundred times a part's, give or take its size: a band for each part, many overlapping."""
    middle = cents("p_retailprice") * 100
    bands = t.source("part").select("p_partkey", (middle - c("p_size") * 10).alias("lo"), (middle + c("p_size") * 10).alias("hi"))
    return in_bands(t.source("orders").select(cents("o_totalprice").alias("price")), "price", bands, "lo", "hi", 100, "n").groupBy("p_partkey").agg(F.sum("n").alias("orders"))


@query("join_left", "c_custkey:i orders:i")
def join_left(t):
    sums = t.source("orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return (t.source("customer").join(sums, c("c_custkey") == c("o_custkey"), "left")
            .select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders")))


@query("join_unmatched", "o_orderkey:i")
def join_unmatched(t):
    return matching(t.source("orders"), t.source("lineitem"), ("o_orderkey", "l_orderkey"), how="left_anti")


@query("join_full", "nation:i customers:i suppliers:i")
def join_full(t):
    a = t.source("customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    b = t.source("supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return (a.join(b, c("c_nationkey") == c("s_nationkey"), "full")
            .select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers"))


@query("semi_join", "c_custkey:i")
def semi_join(t):
    return matching(t.source("customer"), t.source("orders").filter("o_totalprice > 450000"), ("c_custkey", "o_custkey"))


@query("semi_join_other_value", "l_orderkey:i lines:i")
def semi_join_other_value(t):
    """Lines whose order also has a line of another supplier: smallest and largest supplier differ."""
    line = t.source("lineitem")
    mixed = (line.groupBy(c("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).filter("a < b"))
    return matching(line, mixed, ("l_orderkey", "k")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("anti_join", "s_suppkey:i")
def anti_join(t):
    return matching(t.source("supplier"), t.source("lineitem").filter("l_returnflag = 'R' and l_quantity = 50"), ("s_suppkey", "l_suppkey"), how="left_anti")


@query("exists_either", "c_custkey:i")
def exists_either(t):
    orders = t.source("orders")
    keys = union_all(orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("o_custkey"),
                     orders.filter("o_orderstatus = 'P' and o_totalprice < 5000").select("o_custkey"))
    return matching(t.source("customer"), keys, ("c_custkey", "o_custkey"))


@query("one_pass_counts", "urgent:i small:i urgent_small:i ratio:n")
def one_pass_counts(t):
    """Aggregates that the corpus writes as cross-joined one-row queries."""
    a, b = c("o_orderpriority") == "1-URGENT", c("o_totalprice") < 100000
    return t.source("orders").agg(F.count_if(a).alias("urgent"), F.count_if(b).alias("small"), F.count_if(a & b).alias("urgent_small"),
                                  ratio(F.count_if(a), F.count_if(b)).alias("ratio"))


def months(t):
    return (t.source("orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), "o_orderstatus")
            .agg(F.sum(cents("o_totalprice")).alias("total")))


@query("join_next_month", "o_orderstatus m:i total:n next_total:n")
def join_next_month(t):
    now = months(t)
    return now.join(role(now, "n_"), (c("o_orderstatus") == c("n_o_orderstatus")) & (c("m") == c("n_m") - 1)).select(
        "o_orderstatus", "m", "total", c("n_total").alias("next_total"))


@query("pivot_years", "c_mktsegment y1997:n y1998:n growth:n")
def pivot_years(t):
    """Yearly totals side by side, in place of one self join per year."""
    rows = star(t.source("orders"), (t.source("customer"), "o_custkey", "c_custkey"))
    y = F.year("o_orderdate")
    return (rows.groupBy("c_mktsegment").agg(sum_if(y == 1997, cents("o_totalprice")).alias("y1997"), sum_if(y == 1998, cents("o_totalprice")).alias("y1998"))
            .withColumn("growth", ratio("y1998", "y1997")))


@query("join_two_roles", "customer_nation supplier_nation lines:i")
def join_two_roles(t):
    orders = star(t.source("orders"), (t.source("customer"), "o_custkey", "c_custkey"))
    counts = (star(t.source("lineitem"), (t.source("supplier"), "l_suppkey", "s_suppkey"), (orders, "l_orderkey", "o_orderkey"))
              .groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("lines")))
    return star(counts, (role(t.source("nation"), "a_"), "c_nationkey", "a_n_nationkey"),
                (role(t.source("nation"), "b_"), "s_nationkey", "b_n_nationkey")).select(
        c("a_n_name").alias("customer_nation"), c("b_n_name").alias("supplier_nation"), "lines")


@query("join_on_function", "nation:i pairs:i")
def join_on_function(t):
    """Brands matched to nations by the number in their names."""
    brands = t.source("part").groupBy(F.substring_index("p_brand", "#", -1).cast("int").alias("no")).agg(F.count(F.lit(1)).alias("pairs"))
    nations = t.source("nation").select(F.substring_index(F.upper("n_name"), "NATION_", -1).cast("int").alias("nation"))
    return brands.join(nations, c("no") == c("nation"))


# ---- aggregation ---------------------------------------------------------------------------------

@query("aggregate_groups", "o_orderpriority n:i total:n mean:n least:n most:n buyers:i dev:n")
def aggregate_groups(t):
    x = cents("o_totalprice")
    return t.source("orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.countDistinct("o_custkey").alias("buyers"), stddev_samp("o_totalprice", 2).alias("dev"))


@query("pivot_weekdays", "o_orderstatus sun:i mon:i tue:i wed:i thu:i fri:i sat:i")
def pivot_weekdays(t):
    d = F.dayofweek("o_orderdate")
    return t.source("orders").groupBy("o_orderstatus").agg(
        *[count_if(d == i + 1).alias(x) for i, x in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))])


@query("delay_histogram", "l_returnflag d30:i d60:i more:i before_2000:i since_2000:i")
def delay_histogram(t):
    rows = star(t.source("lineitem"), (t.source("orders"), "l_orderkey", "o_orderkey"))
    n, cut = F.datediff("l_shipdate", "o_orderdate"), F.to_date(F.lit("2000-01-01"))
    return rows.groupBy("l_returnflag").agg(count_if(n <= 30).alias("d30"), count_if((n > 30) & (n <= 60)).alias("d60"), count_if(n > 60).alias("more"),
                                            count_if(day("o_orderdate") < cut).alias("before_2000"), count_if(day("o_orderdate") >= cut).alias("since_2000"))


@query("having_above_mean", "l_partkey:i quantity:i")
def having_above_mean(t):
    """Parts selling more than one and a half times the mean part."""
    sums = t.source("lineitem").groupBy("l_partkey").agg(F.sum(c("l_quantity").cast("bigint")).alias("quantity"))
    return with_scalar(sums, sums.agg(avg("quantity").alias("mean"))).filter(c("quantity") > c("mean") * 1.5)


@query("above_group_mean", "p_partkey:i p_type p_retailprice:n")
def above_group_mean(t):
    """Parts priced more than a twentieth above their type's mean."""
    rows = with_group(t.source("part"), ["p_type"], mean=avg(cents("p_retailprice")))
    return rows.filter(c("p_retailprice") > c("mean") * 1.05)


@query("rollup_flags", "region nation orders:i lochierarchy:i")
def rollup_flags(t):
    rows = star(t.source("orders"), (t.source("customer"), "o_custkey", "c_custkey"),
                (t.source("nation"), "c_nationkey", "n_nationkey"), (t.source("region"), "n_regionkey", "r_regionkey"))
    return rollup_of(rows.select(c("r_name").alias("region"), c("n_name").alias("nation")), ["region", "nation"], {"orders": F.lit(1)})


@query("group_by_expression", "prefix year:i n:i")
def group_by_expression(t):
    return t.source("orders").groupBy(F.substring("o_orderpriority", 1, 3).alias("prefix"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("keys_once_only", "l_orderkey:i l_linenumber:i l_partkey:i")
def keys_once_only(t):
    """Lines whose order and number occur once; every copy of a repeated key is dropped."""
    return (t.source("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("l_partkey")).filter("n = 1"))


# ---- windows ---------------------------------------------------------------------------------------

@query("rank_whole_table", "c_custkey:i richest:i poorest:i")
def rank_whole_table(t):
    """Ranks of all customers by balance, both ways, without one task seeing them all."""
    rows = t.source("customer").select(F.lit("all").alias("p"), "c_custkey", c("c_acctbal").alias("up"), (-c("c_acctbal")).alias("down"))
    return global_ranks(rows, "p", poorest=("up", F.floor(c("up") / 100)), richest=("down", F.floor(c("down") / 100)))


@query("top_per_group", "o_orderstatus o_orderkey:i o_totalprice:n rnk:i")
def top_per_group(t):
    return lowest(t.source("orders"), "o_totalprice", 10, "o_orderstatus", descending=True)


@query("running_totals", "o_orderstatus m:i total:n running:n highest:n previous:n following:n n:i")
def running_totals(t):
    """Running sum and maximum, neighbours and numbers of at most a few hundred months a status."""
    w = Window.partitionBy("o_orderstatus").orderBy("m")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return months(t).select("o_orderstatus", "m", "total", F.sum("total").over(run).alias("running"), F.max("total").over(run).alias("highest"),
                            F.lag("total").over(w).alias("previous"), F.lead("total").over(w).alias("following"), F.row_number().over(w).alias("n"))


@query("top_ranks", "o_orderkey:i dearest:i oldest:i")
def top_ranks_of_orders(t):
    """Orders among the 25 dearest or the 25 oldest of their status, with both ranks; all others are only counted."""
    rows = t.source("orders").select("o_orderkey", "o_orderstatus", (-cents("o_totalprice")).alias("price"), F.unix_date(day("o_orderdate")).alias("day"))
    return top_ranks(rows, "o_orderstatus", 25, dearest=("price", F.floor(c("price") / 1000)), oldest=("day", F.floor(c("day") / 7)))


@query("running_total_of_all", "o_orderkey:i running:n")
def running_total_of_all(t):
    """Money ordered up to each order's day, over all orders as one partition."""
    rows = t.source("orders").select("o_orderkey", F.lit("all").alias("p"), F.unix_date(day("o_orderdate")).alias("day"), cents("o_totalprice").alias("price"))
    return running_sums(rows, "p", "day", F.floor(c("day") / 30), "price", "running")


@query("share_of_group", "p_type p_brand value:n share:n")
def share_of_group(t):
    sums = t.source("part").groupBy("p_type", "p_brand").agg(F.sum(cents("p_retailprice")).alias("value"))
    return with_group(sums, ["p_type"], whole=F.sum("value")).withColumn("share", ratio(c("value") * 100, "whole"))


@query("key_sequence", "name key:i")
def key_sequence(t):
    """Surrogate keys continued from the largest key, in order of the names."""
    last = t.source("customer").agg(F.max("c_custkey").alias("last"))
    names = pick(t.source("supplier"), name="s_name").crossJoin(F.broadcast(last))
    return surrogate_keys(names, "name", c("last"), "key")


# ---- sort, limit, sets ------------------------------------------------------------------------------

@query("top_hundred", "o_orderpriority o_totalprice:n o_orderkey:i", "o_orderpriority -o_totalprice", 100)
def top_hundred(t):
    return t.source("orders")


@query("set_operations", "common:i first_only:i either:i")
def set_operations(t):
    """Customers ordering in 1996 and 1997, in 1996 only, and in either year."""
    def of(y):
        return t.source("orders").filter(F.year("o_orderdate") == y).select("o_custkey")
    a, b, n = of(1996), of(1997), F.count(F.lit(1))
    parts = (("common", a.intersect(b)), ("first_only", a.subtract(b)), ("either", a.union(b).distinct()))
    return union_all(*[df.agg(n.alias("n")).withColumn("which", F.lit(k)) for k, df in parts]).agg(
        *[F.max(F.when(c("which") == k, c("n"))).alias(k) for k, _ in parts])


# ---- functions and subqueries ------------------------------------------------------------------------

@query("scalar_functions", "p_partkey:i shout trimmed piece padded rounded:n distance:n whole:i kind first_known")
def scalar_functions(t):
    price = cents("p_retailprice")
    return t.source("part").select(
        "p_partkey", F.upper("p_name").alias("shout"), F.concat(F.rtrim(F.concat("p_name", F.lit("  "))), F.lit("|")).alias("trimmed"),
        F.substring("p_name", 2, 3).alias("piece"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"),
        F.round(price * F.lit(0.5).cast("decimal(3,2)"), 1).alias("rounded"), F.abs(price - 950).alias("distance"), price.cast("int").alias("whole"),
        F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "middle").alias("kind"),
        F.coalesce(F.when(c("p_size") > 45, c("p_type")), c("p_brand")).alias("first_known"))


@query("date_functions", "o_orderkey:i y:i m:i d:i week_on:d gap:i second_of_day:i cleaned:d")
def date_functions(t):
    clock = F.date_format("o_orderdate", "HH:mm:ss")
    text = F.when(c("o_orderkey") < 10, "-4713-11-2").otherwise(day("o_orderdate").cast("string"))
    return t.source("orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"),
        F.date_add(day("o_orderdate"), 7).alias("week_on"), F.datediff(day("o_orderdate"), F.to_date(F.lit("1995-01-01"))).alias("gap"),
        (F.substring(clock, 1, 2).cast("int") * 3600 + F.substring(clock, 4, 2).cast("int") * 60 + F.substring(clock, 7, 2).cast("int")).alias("second_of_day"),
        F.to_date(F.when(~text.contains("-47"), text)).alias("cleaned"))


@query("guarded_ratios", "p_brand plain:n guarded:n", "p_brand")
def guarded_ratios(t):
    small = count_if(c("p_size") <= 2)
    return t.source("part").groupBy("p_brand").agg(ratio(F.sum("p_size"), F.count(F.lit(1))).alias("plain"), ratio(F.count(F.lit(1)), small).alias("guarded"))


@query("case_of_scalars", "cheap:n dear:n")
def case_of_scalars(t):
    """Either of two averages, chosen by a count, in one pass."""
    x = cents("p_retailprice")
    low = c("p_size") <= 25
    return t.source("part").agg(
        F.when(F.count_if(low) > 100, avg(F.when(low, x))).otherwise(avg(F.when(low, c("p_size")))).alias("cheap"),
        F.when(F.count_if(~low) > 1000000000, avg(F.when(~low, x))).otherwise(avg(F.when(~low, c("p_size")))).alias("dear"))


@query("nested_subqueries", "o_orderkey:i")
def nested_subqueries(t):
    """Orders of customers in the nations of the richest supplier's region."""
    suppliers = star(t.source("supplier"), (t.source("nation"), "s_nationkey", "n_nationkey"))
    best = with_scalar(suppliers, t.source("supplier").agg(F.max("s_acctbal").alias("most"))).filter("s_acctbal = most")
    nations = matching(t.source("nation"), best, ("n_regionkey", "n_regionkey"))
    people = matching(t.source("customer"), nations, ("c_nationkey", "n_nationkey"))
    return matching(t.source("orders"), people, ("o_custkey", "c_custkey"))
