"""Joins with tables small enough to be in every task, where their size is proven.

A table qualifies by the bytes of the files it is read from, which are known before anything runs;
a filter or projection of one table can only make it smaller.  What has no files, or more than the
limit, is joined by a shuffle.  Row sizes in memory are larger than in files, so the limit applies
to the files' bytes times ``GROWTH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LIMIT = 64 << 20   # bytes in memory that a task may hold of a replicated table
GROWTH = 8         # bytes in memory per byte of a compressed columnar file
FILES = 1000       # files of a small table at most
_known: dict[tuple, int] = {}  # files are written once: a table that is staged again has other names


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of all files that the rows come from; None where there are none, or too many to be a small table."""
    files = tuple(sorted(set(df.inputFiles())))
    if not files or len(files) > FILES:
        return None
    key = (df.sparkSession.sparkContext.applicationId, files)
    if key not in _known:
        _known[key] = df.sparkSession.read.format("binaryFile").load(list(files)).agg(F.sum("length")).first()[0] or 0
    return _known[key]


def is_small(df: DataFrame, limit: int = LIMIT) -> bool:
    size = file_bytes(df)
    return size is not None and size * GROWTH <= limit


def if_small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The table, marked for broadcast where its files prove it small; unmarked otherwise."""
    return F.broadcast(df) if is_small(df, limit) else df
