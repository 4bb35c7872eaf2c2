"""Stored tables that grow by increments, each taken whole or not at all.

Every increment is a folder of its own with one folder per table; a list names the increments that
were taken.  Readers follow the list, so rows of an increment that failed, was refused, or whose
writer died are never seen: a failing increment over several facts leaves all of them as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from starling.plans.warehouse import _file_system, shuffles_dropped


COPIES = "zstd"  # codec of stored copies, about a fifth smaller than with snappy


class Refused(ValueError):
    """An increment with unfit rows; ``counts`` holds them by table."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(f"unfit rows: {counts}")
        self.counts = counts


class Increments:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def taken(self) -> dict[str, list[str]]:
        """The increments that readers see, with their tables, in the order of taking; one line each, whatever they hold."""
        path, fs = _file_system(self.spark, f"{self.root}/taken")
        if not fs.exists(path):
            return {}
        lines = sorted(r["value"].split() for r in self.spark.read.text(f"{self.root}/taken").collect())
        return {name: tables for name, *tables in lines}

    def read(self, table: str) -> DataFrame | None:
        """The table over all increments taken so far, None before the first.

        Columns stand as in the first increment, later ones behind them by name; one that an
        increment lacks is null there.
        """
        paths = [f"{self.root}/{name}/{table}" for name, tables in self.taken().items() if table in tables]
        if not paths:
            return None
        merged = self.spark.read.option("mergeSchema", True).parquet(*paths)
        place = {x: i for i, x in enumerate(self.spark.read.parquet(paths[0]).columns)}
        return merged.to(StructType(sorted(merged.schema, key=lambda f: (place.get(f.name, len(place)), f.name))))

    def add(self, tables: dict[str, DataFrame], unfit: Callable[[str, DataFrame, DataFrame], DataFrame] | None = None) -> str:
        """Takes an increment over several tables and gives its name.

        ``unfit(table, stored, new)`` selects new rows that must not be taken; any such row, in any
        table with stored rows, refuses the increment.  After a refusal or a failure its files are deleted;
        once a table has refused it, those of each further table as soon as its unfit rows are counted.
        """
        name = f"{len(self.taken()):08d}-{uuid.uuid4().hex}"
        own = f"{self.root}/{name}"
        path, fs = _file_system(self.spark, own)
        counts = {}
        try:
            with shuffles_dropped(self.spark):
                for table, rows in tables.items():
                    rows.write.option("compression", COPIES).parquet(f"{own}/{table}")
                    stored = self.read(table) if unfit else None
                    if stored is not None:
                        counts[table] = unfit(table, stored, self.spark.read.parquet(f"{own}/{table}")).count()
                    if any(counts.values()):
                        fs.delete(path, True)
            if any(counts.values()):
                raise Refused(counts)
            line = self.spark.createDataFrame([(" ".join([name, *tables]),)], "value string")
            line.coalesce(1).write.mode("append").text(f"{self.root}/taken")
        except BaseException:
            if name not in self.taken():
                fs.delete(path, True)
            raise
        return name
