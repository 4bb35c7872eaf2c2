"""Exact duplicates by a tree merge of digest runs.

Every input partition is a run of (digest, smallest id, count), sorted by digest.  Runs meet in
rounds: the runs ``f*k .. f*k+f-1`` of one round are merged into run ``k`` of the next, for a fan-in
``f``, until one run is left.  A run lies in pieces, one for each range of digests, and a merge
brings the pieces of one range from ``f`` runs together in order of digest and id, walks over them,
and keeps the first row of each digest with the sum of all.  A digest that a third of all rows
share arrives as one row per run, never as a pile of rows, and no task holds a run whole.  The
answer goes back the same way: final groups to the first runs, first runs to rows.

Every level carries the smallest id, the row that has it, the count, and the bounds of the text
length and of a second, independent hash.  Should two different texts ever share a digest, the
bounds differ and the job fails instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from starling.llm.common import SPACE, placed, staged, text_of, without

FAN_IN = 8
PIECE_DIGITS = 4  # leading hex digits of a digest that name its range: 65,536 pieces a run at most


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """One narrow row per document: its number, run, id, digest and the second hash, and columns of ``more``."""
    norm = F.regexp_replace(text_of(), SPACE, " ")
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.spark_partition_id().alias("run"), "doc_id",
        F.sha2(norm, 256).alias("digest"), F.octet_length(norm).alias("n_bytes"), F.xxhash64(norm).alias("check"), *more)


def first_runs(rows: DataFrame) -> DataFrame:
    """One run per input partition: equal digests combined where they are read, then sorted.

    Of rows with a digest one with the smallest id is kept; a null id is larger than any other.
    """
    out = rows.groupBy("run", "digest").agg(
        F.min_by("row_id", "doc_id").alias("low_row"), F.min("row_id").alias("any_row"), F.min("doc_id").alias("keep_id"), F.count("*").alias("n"),
        F.min("n_bytes").alias("b0"), F.max("n_bytes").alias("b1"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    return in_order(out.select("run", "digest", F.coalesce("low_row", "any_row").alias("keep_row"), "keep_id", *verified()))


def in_order(runs: DataFrame) -> DataFrame:
    """The runs in pieces, each sorted by digest, then id."""
    pieces = runs.withColumn("piece", F.substring("digest", 1, PIECE_DIGITS)).repartition("run", "piece")
    return pieces.sortWithinPartitions("run", "piece", "digest", F.asc_nulls_last("keep_id"), "keep_row")


def verified() -> list:
    """Count and bounds of a digest's rows, once the bounds show that they are one text."""
    same = (F.col("b0") == F.col("b1")) & (F.col("c0") == F.col("c1"))
    n = F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("long"))
    return [n.alias("n"), "b0", "b1", "c0", "c1"]


def merged(runs: DataFrame) -> DataFrame:
    """Sorted runs with equal number merged into one sorted run, the smallest id of each digest kept.

    A digest has one row in each run that meets here, so what is walked over at a time is at most the fan-in.
    """
    digest = Window.partitionBy("run", "piece", "digest").orderBy(F.asc_nulls_last("keep_id"), "keep_row")
    whole = digest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = in_order(runs).select(
        "run", "piece", "digest", "keep_row", "keep_id", F.row_number().over(digest).alias("at"), F.sum("n").over(whole).alias("n"),
        *[bound(x).over(whole).alias(x) for bound, x in ((F.min, "b0"), (F.max, "b1"), (F.min, "c0"), (F.max, "c1"))])
    return walked.where("at = 1").select("run", "piece", "digest", "keep_row", "keep_id", *verified())


def find_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Adds nothing to the text: one row per input row with its group.

    Columns: ``row_id``, ``doc_id``, ``keep_id`` (smallest id among equal texts), ``group_size``,
    ``kept`` (true for exactly one row of each group), ``text_sha256``.  Null text counts as
    empty; a null id is larger than any other and is kept only where no other id is in the group;
    of repeated rows with the smallest id one is kept.  An empty table gives an empty result.
    """
    return _groups(staged(digests(docs), "digests"), fan_in)


def _groups(rows: DataFrame, fan_in: int, *more: str) -> DataFrame:
    last = rows.agg(F.max("run")).first()[0] or 0
    level = first = staged(first_runs(rows), "runs")
    while last > 0:
        level = merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
        last //= fan_in
    groups = level.select("digest", "keep_row", "keep_id", F.col("n").alias("group_size"))
    down = first.select("run", "digest").join(groups, "digest")
    return rows.select("row_id", "run", "doc_id", "digest", *more).join(down, ["run", "digest"]).select(
        *more, "row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The input rows that stay, with all their columns, whatever these are called."""
    rows, key = placed(docs)
    groups = _groups(staged(digests(rows, key), "digests"), fan_in, key)
    return without(rows, groups.where(~F.col("kept")).select(key), key)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, h as text_sha256
from t window w as (partition by h)"""
