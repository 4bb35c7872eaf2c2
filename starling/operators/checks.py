"""Integrity and validation checks.  Each returns findings as a DataFrame; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from starling.operators.relational import matching, role, union_all, with_scalar

c = F.col


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Rows per table, the expected rows where known, and whether they agree."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), "rows", F.lit(expected.get(name)).cast("bigint").alias("expected"))
        for name, df in tables.items()]
    return union_all(*parts).withColumn("agrees", F.coalesce(c("rows") == c("expected"), F.lit(True)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def key_uniqueness(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Rows, distinct keys and rows with a null key part, per table."""
    parts = []
    for name, key in keys.items():
        missing = reduce(Column.__or__, [c(k).isNull() for k in key])
        counted = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                                 F.coalesce(F.sum(F.when(missing, c("n"))), F.lit(0)).alias("null_keys"))
                     .withColumn("table_name", F.lit(name)))
    return union_all(*parts)


def orphans(child: DataFrame, parent: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Child rows whose complete foreign key has no parent row."""
    known = reduce(Column.__and__, [c(fk).isNotNull() for fk, _ in pairs])
    return matching(child.filter(known), parent, *pairs, how="left_anti")


def foreign_key_profile(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """Per ``(child, column, parent, key)``: rows and distinct keys used, their range, the orphan
    rows, and the size and range of the parent's keys.

    All foreign keys of a child unfold into (number of the link, key) pairs that are counted map-side,
    so each child is read and shuffled once, and a key used by a third of the rows is one pair.
    Used and known keys then meet as bitmaps of 32,768 keys: a union with more keys than the
    parent's bitmap holds orphans, and only the keys of such bitmaps are joined.
    """
    numbers = {pair: i for i, pair in enumerate(dict.fromkeys((link[2], link[3]) for link in links))}
    used = []
    for child in dict.fromkeys(link[0] for link in links):
        cells = F.array(*[F.struct(F.lit(i).alias("link"), F.lit(numbers[link[2:]]).alias("to"), c(link[1]).cast("bigint").alias("key"))
                          for i, link in enumerate(links) if link[0] == child])
        used.append(tables[child].select(F.inline(cells)).where("key is not null").groupBy("link", "to", "key").agg(F.count(F.lit(1)).alias("n")))
    used = union_all(*used).checkpoint()  # distinct keys; read by each step below
    known = union_all(*[tables[p].select(F.lit(i).alias("to"), c(k).cast("bigint").alias("key")) for (p, k), i in numbers.items()])
    known = known.where("key is not null").distinct().checkpoint()
    block, bits = F.bitmap_bucket_number("key").alias("block"), F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits")
    mine = used.groupBy("link", "to", block).agg(bits, F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))
    theirs = known.groupBy("to", block).agg(bits, F.count(F.lit(1)).alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))
    met = mine.select("link", "to", "block", "bits").unionByName(mine.select("link", "to", "block").join(theirs.select("to", "block", "bits"), ["to", "block"]))
    held = theirs.select("to", "block", c("keys").alias("held"))
    union = met.groupBy("link", "to", "block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("either")).join(held, ["to", "block"], "left")
    holed = union.where(c("either") > F.coalesce("held", F.lit(0))).select("link", "block")
    loose = (used.withColumn("block", F.bitmap_bucket_number("key")).join(holed, ["link", "block"], "left_semi")
             .join(known, ["to", "key"], "left_anti").groupBy("link").agg(F.sum("n").alias("orphan_rows")))
    sides = mine.groupBy("link", "to").agg(F.sum("rows").alias("rows"), F.sum("keys").alias("distinct_used"), F.min("low").alias("min_used"), F.max("high").alias("max_used"))
    ranges = theirs.groupBy("to").agg(F.sum("keys").alias("parent_keys"), F.min("low").alias("parent_min"), F.max("high").alias("parent_max"))
    names = F.array(*[F.struct(F.lit(child).alias("child"), F.lit(col).alias("column"), F.lit(f"{parent}.{key}").alias("parent")) for child, col, parent, key in links])
    return (sides.join(loose, "link", "left").join(ranges, "to").withColumn("orphan_rows", F.coalesce("orphan_rows", F.lit(0)))
            .select(names[c("link")].alias("_name"), "*").select("_name.*", "rows", "distinct_used", "min_used", "max_used", "orphan_rows",
                                                                "parent_keys", "parent_min", "parent_max"))


def not_in(df: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """``col NOT IN (keys)`` with SQL's rules for nulls: nothing passes once a key is null, and a
    null ``col`` passes only an empty list.

    An ordinary anti join does the work; the two exceptions come from one row about the list, so
    no side needs to fit in memory as a null-aware join would require.
    """
    facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.count(key).alias("_m"))
    rest = with_scalar(matching(df, keys, (col, key), how="left_anti"), facts)
    return rest.filter((c("_n") == 0) | ((c("_n") == c("_m")) & c(col).isNotNull())).drop("_n", "_m")


def missing_rows(sample: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a sample that the table does not hold, comparing nulls as equal."""
    names = sample.columns
    held = role(table.select(*names).distinct(), "_t_")
    return sample.join(held, reduce(Column.__and__, [c(n).eqNullSafe(c(f"_t_{n}")) for n in names]), "left_anti")


def cell_differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing cell of rows present on both sides."""
    cols = [x for x in before.columns if x not in keys]
    joined = before.join(role(after.select(*before.columns), "_a_"),
                         reduce(Column.__and__, [c(k) == c(f"_a_{k}") for k in keys]))
    cells = F.array(*[F.when(~c(x).eqNullSafe(c(f"_a_{x}")), F.struct(
        F.lit(x).alias("column"), c(x).cast("string").alias("before"), c(f"_a_{x}").cast("string").alias("after")))
        for x in cols])
    return joined.select(*keys, F.explode(F.array_compact(cells)).alias("x")).select(*keys, "x.*")


def differing_ranges(before: DataFrame, after: DataFrame, key: str, fan_out: int = 256, most: int = 512) -> list[tuple[int, int]]:
    """Ranges (first, last) of a numeric key outside of which both tables hold the same rows, at most ``most``.

    A digest tree from the root down: the key's whole range is cut in ``fan_out`` parts, each with row
    count, hash sum and hash xor; only parts that differ are cut again, one level in one pass over
    both tables, until another level would give more than ``most`` ranges or a range is one key.
    Rows with a null key are in no range.
    """
    names = before.columns
    sides = [before, after.select(*names)]
    ends = [df.agg(F.min(key), F.max(key)).first() for df in sides]
    known = [e for e in ends if e[0] is not None]
    if not known:
        return []
    first, last = min(e[0] for e in known), max(e[1] for e in known)
    size, open_ = last - first + 1, [(first, last)]
    while size > 1:
        size = -(-size // fan_out)

        def digests(df, side):
            h = F.xxhash64(*names)
            part = F.floor((c(key) - first) / size)
            return within(df, key, open_).groupBy(part.alias("part")).agg(
                F.count(F.lit(1)).alias(f"n{side}"), F.sum(h.cast("decimal(38,0)")).alias(f"s{side}"), F.bit_xor(h).alias(f"x{side}"))
        both = digests(sides[0], "0").join(digests(sides[1], "1"), "part", "full")
        same = reduce(Column.__and__, [c(f"{x}0").eqNullSafe(c(f"{x}1")) for x in "nsx"])
        found = [r[0] for r in both.where(~same).select("part").orderBy("part").limit(most + 1).collect()]
        if len(found) > most:
            break
        open_ = []
        for part in found:
            low, high = first + part * size, min(last, first + (part + 1) * size - 1)
            open_ = open_[:-1] + [(open_[-1][0], high)] if open_ and open_[-1][1] == low - 1 else open_ + [(low, high)]
        if not open_:
            break
    return open_


def within(df: DataFrame, key: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose key lies in one of the ranges; the bounds reach the scan."""
    if not ranges:
        return df.limit(0)
    return df.where(reduce(Column.__or__, [c(key).between(low, high) for low, high in ranges]))


def cell_differences_in_ranges(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``cell_differences`` by one numeric key, joining only the key ranges whose digests differ."""
    ranges = differing_ranges(before, after, key)
    return cell_differences(within(before, key, ranges), within(after, key, ranges), [key])


def digest(df: DataFrame) -> DataFrame:
    """Content digest that ignores row order: row count, sum and xor of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two extracts hold the same rows, by digest."""
    a, b = role(digest(left), "left_"), role(digest(right.select(*left.columns)), "right_")
    same = reduce(Column.__and__, [c(f"left_{x}").eqNullSafe(c(f"right_{x}")) for x in ("rows", "hash_sum", "hash_xor")])
    return with_scalar(a, b).withColumn("same", same)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, one row each."""
    counts = df.agg(*[F.count_if(c(x).isNull()).alias(x) for x in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), c(x).alias("nulls")) for x in columns])).alias("x")).select("x.*")


# ---- golden answers ----------------------------------------------------------------------------

def read_answer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an answer file, pipe-separated under a header or aligned under a rule of dashes.

    Aligned columns are cut where the rule has its blanks; the rule line is one bounded row.
    """
    lines = spark.read.text(path).withColumn("value", F.rtrim("value"))
    rule = lines.filter(F.col("value").rlike("^ *-+( +-+)* *$")).select("value").first()
    if rule is None:
        header = lines.filter("value like '%|%'").select("value").first()["value"]
        parts = F.split("value", r"\|")
        rows = lines.filter((c("value") != header) & (F.size(parts) == len(schema)))
        cells = [parts[i] for i in range(len(schema))]
    else:
        spans, start = [], 0
        for run in rule["value"].split(" "):
            if run:
                spans.append((start + 1, len(run)))
            start += len(run) + 1
        head = lines.filter(c("value") != rule["value"]).filter("value <> ''").select("value").first()["value"]
        rows = lines.filter((c("value") != rule["value"]) & (c("value") != head) & (c("value") != ""))
        cells = [F.substring("value", at, width) for at, width in spans]
    typed = [F.nullif(F.trim(x), F.lit("")).cast(f.dataType).alias(f.name) for x, f in zip(cells, schema)]
    return rows.select(*typed)


def compare_answer(result: DataFrame, golden: DataFrame, digits: int = 2) -> DataFrame:
    """Rows found on one side only, numbers rounded and text trimmed; null order plays no part."""
    def normal(df):
        return df.select(*[F.round(c(f.name).cast("double"), digits).alias(f.name) if isinstance(f.dataType, T.NumericType)
                           else F.rtrim(c(f.name).cast("string")).alias(f.name) for f in golden.schema])
    a, b = normal(result), normal(golden)
    return union_all(a.exceptAll(b).withColumn("side", F.lit("result")), b.exceptAll(a).withColumn("side", F.lit("golden")))
