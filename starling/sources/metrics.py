"""Run metrics of staged jobs, one row per run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions.exact import avg

SCHEMA = ("idx int, id string, name string, cluster_size int, scale int, cache string, "
          "acquisition double, processing double, overall double")


class Phases:
    """Seconds of the named phases around actions, and of the whole run."""

    def __init__(self):
        self.start = time.perf_counter()
        self.seconds: dict[str, float] = {}

    def timed(self, name, action):
        began = time.perf_counter()
        result = action()
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
        self.seconds["overall"] = time.perf_counter() - self.start
        return result


def record(spark: SparkSession, path: str, idx: int, run_id: str, name: str, cluster_size: int, scale: int,
           cache: str, seconds: dict[str, float]) -> None:
    row = (idx, run_id, name, cluster_size, scale, cache, seconds.get("acquisition"),
           seconds.get("processing"), seconds.get("overall"))
    spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(path)


def summary(runs: DataFrame, measure: str = "overall") -> DataFrame:
    """Average, extremes and spread per job, cluster size, scale and cache setting."""
    return runs.groupBy("name", "cluster_size", "scale", "cache").agg(
        F.count(F.lit(1)).alias("runs"), avg(measure).alias("avg"), F.min(measure).alias("min"),
        F.max(measure).alias("max"), F.stddev_samp(measure).alias("stddev"))
