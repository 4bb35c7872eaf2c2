"""Joins by order instead of equality: sums over all larger keys, and values in bands.

Neither compares all with all.  Sums over larger keys come from one pass over keys in order, range by
range, and so do the numbers of rows in bands; where the rows themselves are wanted, bands meet
values through cells, as an equality join with an exact test after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def edges_of(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` keys that cut the rows into ranges of about equal size."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, 10 * parts)).first()[0] if shares else None
    return sorted(set(found or []))


def totals_at_least(weights: DataFrame, key: str, value: str, asks: DataFrame, ask: str, name: str, parts: int = 200) -> DataFrame:
    """``asks`` with ``name``, the sum of ``value`` over the rows of ``weights`` whose ``key`` is at least ``ask``.

    The result of joining on ``key >= ask`` and summing per row of ``asks``: rows that match nothing
    are left out, null keys match nothing.  Values are summed per key, keys fall into ranges at
    quantiles, ranges are summed up from the top (one row a range), and inside a range a running
    sum goes through its keys.  Keys are numbers.
    """
    sums = weights.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("_w"), F.count("*").alias("_n"))
    wanted = asks.where(F.col(ask).isNotNull()).select(F.col(ask).alias("_k")).distinct()
    cuts = edges_of(sums, "_k", parts)
    both = sums.unionByName(wanted.withColumns({"_w": F.lit(None).cast(sums.schema["_w"].dataType), "_n": F.lit(0).cast("long")}))
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in cuts]), lambda e: e <= F.col("_k"))) if cuts else F.lit(0)
    both = both.groupBy(bucket.alias("_bucket"), "_k").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = both.groupBy("_bucket").agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")).select(
        "_bucket", F.sum("w").over(above).alias("_above_w"), F.sum("n").over(above).alias("_above_n"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    totals = both.select("_bucket", "_k", F.sum("_w").over(inside).alias("_in_w"), F.sum("_n").over(inside).alias("_in_n")).join(ranges, "_bucket")
    totals = totals.where(F.col("_in_n") + F.coalesce("_above_n", F.lit(0)) > 0).select(
        "_k", F.coalesce(F.col("_in_w") + F.col("_above_w"), "_in_w", "_above_w").alias(name))
    return asks.join(totals, F.col(ask) == F.col("_k")).drop("_k")


def counted_in_bands(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """``bands`` with ``name``, how many rows of ``df`` each holds, as joining and counting would give; without rows a band is left out.

    A band holds the values up to its upper end less those below its lower end.  Values and ends are
    put in order once, dealt in ranges of equal size; a range sums its own values, and what lies before it is
    known from one count a range.  Work grows with rows and bands, not with the pairs of both.
    """
    points = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_k"), F.lit(1).cast("long").alias("_n"))
    for end in (low, high):
        points = points.union(bands.where(F.col(end).isNotNull()).select(F.col(end), F.lit(0).cast("long")))
    points = points.groupBy("_k").agg(F.sum("_n").alias("_n"))
    # Ranges are stored: whoever reads them again must not cut them anew.
    points = points.repartitionByRange("_k").withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = points.groupBy("_range").agg(F.sum("_n").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    upto = points.withColumn("_in", F.sum("_n").over(inside)).join(F.broadcast(ranges), "_range").select(
        F.col("_k"), (F.col("_before") + F.col("_in")).alias("_upto"), (F.col("_before") + F.col("_in") - F.col("_n")).alias("_below"))
    every = points.agg(F.sum("_n")).first()[0] or 0
    found = bands.join(upto.select(F.col("_k").alias("_lk"), "_below"), F.col(low) == F.col("_lk"), "left")
    found = found.join(upto.select(F.col("_k").alias("_hk"), "_upto"), F.col(high) == F.col("_hk"), "left")
    held = F.coalesce("_upto", F.lit(every)) - F.coalesce("_below", F.lit(0))
    return found.withColumn("_held", held).where("_held > 0").select(*[F.col(f"`{c}`") for c in bands.columns], F.col("_held").alias(name))


def in_bands(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float, count: str | None = None) -> DataFrame:
    """Rows joined with the bands that hold their value, both ends included; a null end is open.

    With ``count`` the bands that hold rows, each once, and how many under that name (``counted_in_bands``): no
    pairs are formed, and ``width`` plays no part.

    A band lies in at most two cells of its own level, whose cells are ``width`` times a power of
    two wide; a row looks into one cell of each level that occurs.  Open ends stop at the
    extreme values.  Overlapping bands each match; null values match none.
    """
    if count:
        return counted_in_bands(df, value, bands, low, high, count)
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v), F.max(v)).first()
    if ends[0] is None:
        ends = (0.0, 0.0)
    lo, hi = F.coalesce(F.col(low).cast("double"), F.lit(ends[0])), F.coalesce(F.col(high).cast("double"), F.lit(ends[1]))
    lo, hi = F.greatest(lo, F.lit(ends[0])), F.least(hi, F.lit(ends[1]))  # outside are no values
    level = F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / width))).cast("int")
    dealt = bands.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_level", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(level))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    dealt = dealt.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    levels = sorted(r[0] for r in dealt.select("_level").distinct().collect())  # as many as widths have binary orders of magnitude
    looks = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(v / (width * 2.0 ** n)).alias("_cell")) for n in levels])
    if not levels:
        return df.limit(0).join(bands, F.lit(True))
    rows = df.where(F.col(value).isNotNull()).withColumn("_look", F.explode(looks)).select(*df.columns, "_look.*")
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    return rows.join(dealt, ["_level", "_cell"]).where(inside).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in bands.columns])
