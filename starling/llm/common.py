"""Helpers shared by the operators: staging, words, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starling.operators.replicated import if_small

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of the session's checkpoints; one of them must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage: what follows re-reads files when an executor is lost, and values drawn per
    row (row numbers) stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a narrow key that stays the same whenever they are read again, and the key's name.

    The key is the row's place: its file and its number there.  Rows that come from no file, or
    from one row of a file several times, are staged first.
    """
    name = "place"
    while name in docs.columns:
        name += "_"
    try:
        place = docs.metadataColumn("_metadata")
        out = docs.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name))
        if out.groupBy(name).count().where("count > 1").isEmpty():
            return out, name
    except AnalysisException:
        pass
    return placed(staged(docs, "rows"))


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the dropped ones, without the key; few dropped keys are broadcast."""
    return rows.join(if_small(staged(dropped, "dropped")), key, "left_anti").drop(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unsigned_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body loops over it.

    Projections that the optimizer merges would repeat an expression inside a lambda for every
    element; a bound lambda variable is never repeated.
    """
    return F.transform(F.array(value), body)[0]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join with ``right``, unique by ``key``; ``weight`` counts the rows of ``left`` that a key has.

    Keys above ``total / parts`` rows number fewer than ``parts``, so they are broadcast and their
    rows stay where they are; all other keys are shuffled, none of them large.
    """
    heavy = F.col(weight) > max(1, total // parts)
    return left.join(F.broadcast(right.where(heavy)), key).unionByName(left.join(right.where(~heavy), key))


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """The same rows, once this package's modules are on the executors' Python path.

    Functions of ``mapInArrow`` and ``mapInPandas`` refer to their modules, which keep vocabularies
    and encoded words between tasks; on a cluster the modules travel as a file of the application.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        import pathlib
        import zipfile
        root = pathlib.Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix=f"{root.name}-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(out.name)
        _shipped.add(context.applicationId)
    return df
