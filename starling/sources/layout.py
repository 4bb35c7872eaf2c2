"""Physical layout of loaded tables: hash or range placement by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Distribution column of each distributed table.
HASH_KEYS = {"date_dim": "d_date_sk", "warehouse": "w_warehouse_sk", "customer_address": "ca_address_sk",
             "customer": "c_customer_sk", "catalog_sales": "cs_item_sk", "store_sales": "ss_item_sk",
             "catalog_returns": "cr_item_sk", "store_returns": "sr_item_sk", "web_sales": "ws_item_sk"}
# Shard key of each range-sharded table.
RANGE_KEYS = {"catalog_returns": ["cr_item_sk", "cr_order_number"], "catalog_sales": ["cs_item_sk", "cs_order_number"],
              "customer": ["c_customer_sk"], "date_dim": ["d_date_sk"],
              "store_sales": ["ss_item_sk", "ss_ticket_number"], "store_returns": ["sr_item_sk", "sr_ticket_number"],
              "warehouse": ["w_warehouse_sk"], "web_sales": ["ws_item_sk", "ws_order_number"],
              "customer_address": ["ca_address_sk"]}


MOST_BUCKETS = 1 << 16  # the largest power of two that Spark allows; beyond it buckets hold more files
SALT = "_salt"


def spread(big: DataFrame, key: str, small: DataFrame, small_key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a salt, so that no (key, salt) has much more than ``rows`` rows of ``big``.

    A key with more is dealt over as many salts as it needs, and its rows of ``small``, which holds a
    key once or a few times, are there for each of them.  All other keys have salt 0.  Joining on
    key and salt gives the rows of the join on the key.  Hot keys number at most the rows of
    ``big`` over ``rows``.
    """
    hot = big.groupBy(F.col(key).alias("_hot")).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")).where("_parts > 1 and _hot is not null")
    one = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_parts")).cast("int"), F.lit(0)))
    two = small.join(hot, F.col(small_key) == F.col("_hot"), "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return one.drop("_hot", "_parts"), two.drop("_hot", "_parts")


def join_hashed(big: DataFrame, key: str, small: DataFrame, small_key: str) -> DataFrame:
    """Inner join of two tables that ``spread`` salted and ``save_hashed`` laid out alike: bucket meets bucket, nothing is shuffled."""
    other = small.withColumnRenamed(SALT, "_other")
    return big.join(other.hint("merge"), (F.col(key) == F.col(small_key)) & (F.col(SALT) == F.col("_other"))).drop(SALT, "_other")


def save_hashed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None, *more: str) -> None:
    """Bucketed table: joins and groupings on ``key`` (and ``more``) need no shuffle.

    A rebalance brings a key's rows together first, so a bucket has few files, and splits a key
    that holds very many rows over several tasks, each adding a file to that bucket.  With a
    ``path`` only the files stay, to be opened by ``open_hashed`` in any application.
    """
    writer = df.hint("rebalance", key, *more).write.mode("overwrite").bucketBy(buckets, key, *more).sortBy(key, *more)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    if path:
        df.sparkSession.sql(f"drop table {table}")


def open_hashed(spark: SparkSession, table: str, schema: StructType, key: str, buckets: int, path: str, *more: str) -> DataFrame:
    """A bucketed table over files that ``save_hashed`` wrote, listed anew: they may have been written again."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"create table if not exists {table} ({columns}) using parquet "
              f"clustered by ({', '.join((key, *more))}) sorted by ({', '.join((key, *more))}) into {buckets} buckets location '{path}'")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def bucket_count(stored: int, bucket_bytes: int = 128 << 20, least: int = 8) -> int:
    """Buckets of about ``bucket_bytes`` each, a power of two so that tables of different size still join bucket by bucket.

    From 8 TiB on (65,536 buckets of 128 MiB) their number stays and their files grow in number: 100 TB
    are 1.5 GB a bucket, read as several splits where nothing is joined, and sorted file by file.
    """
    return min(MOST_BUCKETS, max(least, 1 << max(0, (stored // bucket_bytes)).bit_length()))


def save_ranged(df: DataFrame, path: str, keys: list[str], parts: int | None = None) -> None:
    """Files of disjoint key ranges, sorted inside, so that readers skip by file statistics.

    A composite key splits a value that is hot in its first column.
    """
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
