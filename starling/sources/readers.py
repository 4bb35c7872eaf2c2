"""Where a staged job's extracts come from.

A reader is ``(spark, table, query) -> DataFrame``: it scans ``table`` and applies the extract
query, or hands the query to the database.  Connectors other than JDBC need their own jar; the
reader only names the format and its options.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Reader = Callable[[SparkSession, str, str], DataFrame]
FETCH_SIZE = 10000


def jdbc_options(url: str, query: str, user: str = "", password: str = "", driver: str | None = None,
                 partition: Mapping[str, object] | None = None) -> dict[str, str]:
    """Options of one JDBC extract.

    ``partition`` (``column``, ``lower``, ``upper``, ``count``) reads the query in parallel slices
    of a numeric or date column; without it one connection streams the whole result.
    """
    options = {"url": url, "fetchsize": str(FETCH_SIZE), "user": user, "password": password}
    if driver:
        options["driver"] = driver
    if partition is None:
        return {**options, "query": query}
    return {**options, "dbtable": f"({query}) extract", "partitionColumn": str(partition["column"]),
            "lowerBound": str(partition["lower"]), "upperBound": str(partition["upper"]),
            "numPartitions": str(partition["count"])}


def bounds_query(query: str, column: str) -> str:
    """The query that finds the slicing bounds of an extract."""
    return f"select min({column}) as lower_bound, max({column}) as upper_bound from ({query}) extract"


def quantiles_query(query: str, column: str, count: int) -> str:
    """The query that finds the largest key of each of ``count`` slices with equally many rows."""
    return (f"select max({column}) as bound from (select {column}, ntile({int(count)}) over (order by {column}) as slice from ({query}) extract "
            f"where {column} is not null) slices group by slice order by 1")


def equal_slices(column: str, bounds: list) -> list[str]:
    """Predicates that part the rows by the bounds, each row meeting exactly one; null keys are a slice of their own.

    A key that fills several slices is their common bound: it is named once and lies in one slice.
    """
    def literal(x):
        return str(x) if isinstance(x, (int, float, Decimal)) else "'" + str(x).replace("'", "''") + "'"
    cuts = [literal(x) for x in sorted(set(bounds))][:-1]  # the last slice is open
    if not cuts:
        return [f"{column} is not null", f"{column} is null"]
    between = [f"{column} > {low} and {column} <= {high}" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} <= {cuts[0]}", *between, f"{column} > {cuts[-1]}", f"{column} is null"]


def whole_table(query: str) -> bool:
    """Whether an extract query copies a table as it is."""
    return bool(re.fullmatch(r"\s*select\s+\*\s+from\s+[\w.\"]+\s*;?\s*", query, re.I))


def jdbc(url: str, partitions: Mapping[str, Mapping[str, object]] | None = None, **login) -> Reader:
    """Extract by query; ``partitions`` names each table's slicing column and number of slices.

    Bounds that are not given are asked of the database first.  With ``equal`` the slices hold equally many
    rows, whatever the keys' distribution: their bounds are the quantiles.  A whole table without a slicing
    column would go through one connection and is refused.
    """
    def read(spark, table, query):
        slicing = (partitions or {}).get(table)
        if slicing is None and whole_table(query):
            raise ValueError(f"name a partition column for {table}: a whole table is not read through one connection")
        if slicing and slicing.get("equal"):
            column = str(slicing["column"])
            asked = jdbc_options(url, quantiles_query(query, column, int(slicing["count"])), **login)
            bounds = [r[0] for r in spark.read.format("jdbc").options(**asked).load().collect()]  # one row a slice
            properties = {k: v for k, v in jdbc_options(url, query, **login).items() if k not in ("url", "query")}
            return spark.read.jdbc(url, f"({query}) extract", predicates=equal_slices(column, bounds), properties=properties)
        if slicing and "lower" not in slicing:
            asked = jdbc_options(url, bounds_query(query, str(slicing["column"])), **login)
            low, high = spark.read.format("jdbc").options(**asked).load().first()
            slicing = {**slicing, "lower": low, "upper": high} if low is not None else None
        return spark.read.format("jdbc").options(**jdbc_options(url, query, partition=slicing, **login)).load()
    return read


def scan(format_name: str, options: Callable[[str], Mapping[str, str]], schemas: Mapping[str, StructType | str] | None = None) -> Reader:
    """Scan a table through a connector and let Spark apply the extract query.

    ``schemas`` gives tables their columns, for stores that hold no schema and would be sampled.
    """
    def read(spark, table, query):
        reader = spark.read.format(format_name).options(**options(table))
        if schemas and table in schemas:
            reader = reader.schema(schemas[table])
        reader.load().createOrReplaceTempView(table)
        return spark.sql(query)
    return read


def cassandra(keyspace: str) -> Reader:
    return scan("org.apache.spark.sql.cassandra", lambda table: {"keyspace": keyspace, "table": table})


def mongodb(uri: str, database: str, schemas: Mapping[str, StructType | str] | None = None) -> Reader:
    return scan("mongodb", lambda table: {"connection.uri": uri, "database": database, "collection": table}, schemas)


def tables(source: Mapping[str, DataFrame]) -> Reader:
    """Extract from DataFrames; a table named by no source lets the query name its own."""
    def read(spark, table, query):
        return spark.sql(query)
    read.source = source
    return read
