"""Join and aggregation shapes shared by the query library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def star(fact: DataFrame, *links) -> DataFrame:
    """Inner joins of a fact to ``(dimension, foreign key, key)`` triples, in the given order."""
    for dim, fk, pk in links:
        fact = fact.join(dim, F.col(fk) == F.col(pk))
    return fact


def role(df: DataFrame, prefix: str) -> DataFrame:
    """The same table in another role: every column gets a prefix."""
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def pick(df: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """Select columns, ``new="old"`` renaming."""
    return df.select(*columns, *[F.col(old).alias(new) for new, old in renamed.items()])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def matching(df: DataFrame, keys: DataFrame, *pairs: tuple[str, str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join against a de-duplicated key set.

    The distinct runs map-side first, so a key that fills a third of the other table reaches the
    join once.
    """
    keys = keys.select(*[F.col(k).alias(f"_k{i}") for i, (_, k) in enumerate(pairs)]).distinct()
    cond = reduce(Column.__and__, [F.col(c) == F.col(f"_k{i}") for i, (c, _) in enumerate(pairs)])
    return df.join(keys, cond, how)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (an ungrouped aggregate) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row, as ``agg(..) over (partition by keys)`` would.

    An aggregate joined back keeps large groups spread over many tasks: the totals combine
    map-side, and a window would sort each group in one task.  Null keys form a group.
    """
    totals = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(
        *[a.alias(n) for n, a in aggs.items()])
    cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(totals, cond).drop(*[f"_g_{k}" for k in keys])


def rollup_of(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rollup of additive aggregates with the grouping level as ``lochierarchy``.

    Rows are summed at the finest level first, so the rollup expands groups and not facts.  The
    grand total is an ungrouped aggregate: it has its row even when nothing was selected.
    """
    fine = df.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    level = reduce(Column.__add__, [F.grouping(k).cast("int") for k in keys]).alias("lochierarchy")
    rolled = fine.groupingSets([keys[:n] for n in range(len(keys), 0, -1)], *keys).agg(
        *[F.sum(n).alias(n) for n in sums], level)
    total = fine.agg(*[F.sum(n).alias(n) for n in sums])
    return rolled.unionByName(total.select(
        *[F.lit(None).cast(fine.schema[k].dataType).alias(k) for k in keys], *sums, F.lit(len(keys)).alias("lochierarchy")))


def rollup_avg(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Rollup of averages: sums and counts roll up, the quotient is taken at each level."""
    parts = {}
    for name, expr in values.items():
        parts[f"_s_{name}"] = expr
        parts[f"_n_{name}"] = F.when(expr.isNotNull(), 1).otherwise(0)
    rolled = rollup_of(df, keys, parts)
    return rolled.select(*keys, "lochierarchy", *[
        F.try_divide(F.col(f"_s_{n}").cast("double"), F.col(f"_n_{n}").cast("double")).alias(n)
        for n in values])


def lowest(df: DataFrame, value: str, k: int, *partition: str, descending: bool = False,
           name: str = "rnk") -> DataFrame:
    """Rows of rank ``<= k``.  Spark limits each task's rows before the ranking shuffle."""
    key = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    return (df.withColumn(name, F.rank().over(Window.partitionBy(*partition).orderBy(key)))
            .filter(F.col(name) <= k))
