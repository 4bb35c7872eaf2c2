"""Rows with vectors: packed into bytes of one width, dealt to blocks, searched block against block.

What the searches share.  A block never depends on a key of the data: rows are dealt by their own
number, so a vector, label or leaf that a third of all rows have is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.llm.common import shipped


def finite(column: str) -> Column:
    """True where the array is not null and all of its components are finite numbers."""
    values = F.col(column)
    return F.coalesce(values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def packed(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """``values`` (array of double) as bytes ``v`` of numpy type ``kind``; short ones are filled up with zeros."""
    others = [c for c in rows.columns if c != "values"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            sizes = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten(), float)
            whole = np.zeros((batch.num_rows, width))
            whole[np.arange(width)[None, :] < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array([r.tobytes() for r in whole.astype(kind)], pa.binary())], names=[*others, "v"])

    fields = [f for f in rows.schema.fields if f.name != "values"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", v binary"
    return shipped(rows.select(*others, "values")).mapInArrow(pack, schema)


def stacked(blobs, kind: str, width: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, width).astype(float)


def blocks_for(rows: int, most: int, least: int, spread: int = 24) -> int:
    """Blocks of at most about ``most`` rows; of fewer, down to ``least``, while there are under ``spread``."""
    return max(1, -(-rows // most), min(spread, -(-rows // least)))


def dealt(key: str, parts: Column) -> Column:
    """The block of a row, from its number."""
    return F.pmod(F.xxhash64(key), parts).cast("int")


def first_of(order: np.ndarray, nameless: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by ``order``, then id (missing ones last), then row number."""
    place = np.arange(len(order))
    if len(order) > 4 * k:
        place = np.flatnonzero(order <= np.partition(order, k - 1)[k - 1])
    return place[np.lexsort((keys[place], ids[place], nameless[place], order[place]))[:k]]


def ranked(found: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``; every task limits its own rows first."""
    within = Window.partitionBy(*keys).orderBy(order, "nameless", "id", "row")
    return found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
