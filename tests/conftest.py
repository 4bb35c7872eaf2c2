import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("starling-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def duck(sf_dir, tables=DRIVER_TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def oracle():
    return duck(f"{DATA}/sf0.01")


@pytest.fixture(scope="session")
def tiny(spark):
    """The star of the smallest data set."""
    from starling.plans import catalog  # noqa: F401
    from starling.plans.warehouse import Star
    return Star.of(spark, f"{DATA}/sf0.001")


class Tables(dict):
    """A hand-made set of star tables with attribute access."""

    __getattr__ = dict.__getitem__


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_rows(spark_df, con, sql):
    """Both results as sorted rows, columns ordered by name."""
    cols = sorted(spark_df.columns)
    mine = sorted((tuple(repr(r[c]) for c in cols) for r in spark_df.collect()))
    cur = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    return mine, sorted(tuple(repr(r[at[c]]) for c in cols) for r in cur.fetchall())
