"""Ranks and sequences over a whole table without gathering it in one task.

Rows are counted per coarse bucket of the ordering value, the bucket counts are summed up in
order (one row per bucket), and positions inside a bucket are found bucket by bucket.  A bucket
is a plain function of the value, so a recomputed task finds the same buckets again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, a null key equal to a null key."""
    other = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])).drop(*[f"_r{k}" for k in keys])


def _before(counts: DataFrame, coarse: Column, *partition: str) -> DataFrame:
    """Rows in all lower buckets, from ``(bucket, n)`` rows.

    ``coarse`` maps buckets to ranges of buckets in the same order.  Ranges are summed up first,
    buckets inside their range next: only one row per range meets in a task.
    """
    buckets = counts.groupBy(*partition, "_bucket").agg(F.sum("n").alias("n")).withColumn("_range", coarse)
    ranges = buckets.groupBy(*partition, "_range").agg(F.sum("n").alias("n"))
    above = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*partition, "_range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_lower"))
    inside = Window.partitionBy(*partition, "_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return _same(buckets, ranges, [*partition, "_range"]).select(*partition, "_bucket", (F.col("_lower") + F.col("_inside")).alias("_before"))


def global_ranks(df: DataFrame, partition: str, **orders: tuple[str, Column]) -> DataFrame:
    """Add ``name = rank() over (partition by partition order by value)`` for each
    ``name=(value, bucket)``, for partitions too large for one task.

    ``bucket`` must never decrease as ``value`` grows.  All orders unfold into one column of
    values; equal values collapse to one counted row first, so a value shared by a third of the
    rows is a single row of the window.  Null values rank first and null partitions are one
    partition, as in a window.  Rows of ``df`` must be distinct.
    """
    lowest = F.lit(float("-inf"))
    cells = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(value).cast("double").alias("_value"),
                               F.coalesce(F.when(F.col(value).isNotNull(), bucket.cast("double")), lowest).alias("_bucket"))
                      for name, (value, bucket) in orders.items()])
    rows = df.withColumn("_cell", F.explode(cells)).select(*df.columns, "_cell.*")
    counts = rows.groupBy(partition, "_name", "_bucket", "_value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(partition, "_name", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_within", F.coalesce(F.sum("n").over(w), F.lit(0)))
    ranks = (_same(within, _before(counts, F.floor(F.col("_bucket") / 1000), partition, "_name"), [partition, "_name", "_bucket"])
             .select(partition, "_name", "_value", (F.col("_before") + F.col("_within") + 1).alias("_rank")))
    return _same(rows, ranks, [partition, "_name", "_value"]).groupBy(*df.columns).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_rank"))).alias(name) for name in orders])


def top_ranks(df: DataFrame, partition: str, k: int, **orders: tuple[str, Column]) -> DataFrame:
    """The rows that rank among the first ``k`` by at least one order, with their rank by every order.

    Ranks, nulls, ties and ``bucket`` as in ``global_ranks``, but only counted where needed: bucket counts
    show which buckets can hold such a rank; their rows are the candidates, and values are ranked
    only inside the buckets that a candidate lies in.  All other rows are a number in a bucket count.
    """
    lowest = F.lit(float("-inf"))
    cells = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(value).cast("double").alias("_value"),
                               F.coalesce(F.when(F.col(value).isNotNull(), bucket.cast("double")), lowest).alias("_bucket"))
                      for name, (value, bucket) in orders.items()])
    rows = df.withColumn("_cells", cells)
    every = rows.select(partition, F.explode("_cells").alias("_cell")).select(partition, "_cell.*")
    counts = every.groupBy(partition, "_name", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = _before(counts, F.floor(F.col("_bucket") / 1000), partition, "_name")
    # Per partition the last bucket of each order that can hold a rank up to k: few rows.
    last = before.where(F.col("_before") < k).groupBy(partition).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_bucket"))).alias(f"_last_{name}") for name in orders])
    chosen = _same(rows, last, [partition])
    chosen = chosen.where(reduce(Column.__or__, [F.col("_cells")[i]["_bucket"] <= F.col(f"_last_{name}") for i, name in enumerate(orders)]))
    looked = chosen.select(*df.columns, F.explode("_cells").alias("_cell")).select(*df.columns, "_cell.*")
    wanted = looked.select(partition, "_name", "_bucket").distinct()
    values = _same(every, wanted, [partition, "_name", "_bucket"]).groupBy(partition, "_name", "_bucket", "_value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(partition, "_name", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = _same(values.withColumn("_within", F.coalesce(F.sum("n").over(w), F.lit(0))), before, [partition, "_name", "_bucket"])
    ranks = ranks.select(partition, "_name", "_value", (F.col("_before") + F.col("_within") + 1).alias("_rank"))
    out = _same(looked, ranks, [partition, "_name", "_value"]).groupBy(*df.columns).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_rank"))).alias(name) for name in orders])
    return out.where(reduce(Column.__or__, [F.col(name) <= k for name in orders]))


def running_sums(df: DataFrame, partition: str, order: str, bucket: Column, value: str, name: str) -> DataFrame:
    """Add ``name = sum(value) over (partition by partition order by order)`` for partitions too large for one task.

    As in the window, rows that are equal in order share their sum, null orders come first, null
    values add nothing, and a sum of nulls alone is null.  Values are summed per order value
    first, buckets (never decreasing as ``order`` grows) are summed up next.
    """
    at = F.coalesce(F.when(F.col(order).isNotNull(), bucket.cast("double")), F.lit(float("-inf")))
    sums = df.groupBy(partition, at.alias("_bucket"), F.col(order).alias("_order")).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    coarse = F.floor(F.col("_bucket") / 1000)
    lower = {c: _before(sums.select(partition, "_bucket", F.coalesce(c, F.lit(0)).alias("n")), coarse, partition).withColumnRenamed("_before", f"_lower{c}")
             for c in ("_sum", "_count")}
    w = Window.partitionBy(partition, "_bucket").orderBy(F.asc_nulls_first("_order")).rowsBetween(Window.unboundedPreceding, 0)
    inside = sums.select(partition, "_bucket", "_order", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_in_sum"), F.sum("_count").over(w).alias("_in_count"))
    for part in lower.values():
        inside = _same(inside, part, [partition, "_bucket"])
    total = F.when(F.col("_in_count") + F.col("_lower_count") > 0, F.col("_in_sum") + F.col("_lower_sum"))
    found = inside.select(F.col(partition).alias("_p"), "_order", total.alias(name))
    return df.join(found, F.col(partition).eqNullSafe(F.col("_p")) & F.col(order).eqNullSafe(F.col("_order"))).drop("_p", "_order")


def surrogate_keys(df: DataFrame, business_key: str, start: Column, name: str, prefix: int = 12) -> DataFrame:
    """``start + 1, start + 2, ..`` in order of a text key, null first.

    The first ``prefix`` characters of a key name its bucket, which keeps the order of any texts,
    whatever their lengths; with the star's keys of 16 characters a bucket holds ten thousand.
    """
    rows = df.withColumn("_bucket", F.coalesce(F.substring(business_key, 1, prefix), F.lit("")))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_bucket").orderBy(F.asc_nulls_first(business_key))
    return (rows.join(_before(counts, F.substring("_bucket", 1, max(1, prefix - 4))), "_bucket")
            .withColumn(name, start + F.col("_before") + F.row_number().over(w))
            .drop("_bucket", "_before"))
