"""Shards of near equal bytes by a minimax contiguous partition.

Equal texts form one atomic group.  Groups stand in the order of a 63-bit hash of the text; groups
larger than an equal share come first and take a shard each, so that one hot text does not set the
capacity of all others.  For the rest the smallest capacity is found for which a greedy sweep over
the ordered groups needs no more than the shards that are left.  Under it the cuts go as near to equal
shares as the capacity lets them, so no shard is left short: a cut may not be earlier than what a
sweep from the end needs, nor later than a full shard behind the cut before it.

The sweep never sees all groups at once.  Groups are summed over ranges of the hash; a range that
no cut can fall into stays a sum, one that may hold a cut is opened into smaller ranges until its
groups are known singly.  Two sweeps bound every cut: with ranges taken whole and with ranges taken
as liquid.  Opened ranges number at most shards^2 / 2 in a round, so what reaches the driver is
bounded whatever the table's size, and the result equals that over the full list of groups.  The
places of the final cuts are opened in the same way.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from starling.llm.common import staged, text_of, unsigned_bucket

SHARDS = 40
FIRST_BITS = 14
STEP_BITS = 6
ROW_BYTES = 16
BLOCK_ROWS = 4096


@dataclass
class Span:
    """A range of hashes: its sum of sizes, its last hash, whether it is one group, its number and bits."""
    size: int
    last: int
    single: bool
    number: int
    bits: int


def greedy(spans: list[Span], capacity: int, shards: int, liquid: bool) -> tuple[list[tuple[int, int]], bool]:
    """Ends of the shards as (span, bytes before it + taken of it) and whether all bytes fit.

    ``liquid``: spans that are not single groups may be cut anywhere, which reaches at least as far
    as their unknown groups would.  Otherwise a span goes whole or not at all.
    """
    ends, at, used, room = [], 0, 0, capacity
    before = 0
    while at < len(spans):
        span = spans[at]
        need = span.size - used
        if need <= room:
            room -= need
            before += need
            at, used = at + 1, 0
            continue
        if liquid and not span.single:
            used += room
            before += room
        ends.append((at, before))
        if len(ends) == shards:
            return ends, False
        if room == capacity and not (liquid and not span.single):
            return ends, False  # larger than a shard
        room = capacity
    return ends, True


def smallest(spans: list[Span], shards: int, liquid: bool) -> int:
    """The smallest capacity under which the greedy sweep fits."""
    total = sum(s.size for s in spans)
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if greedy(spans, mid, shards, liquid)[1]:
            high = mid
        else:
            low = mid + 1
    return low


def _spans(rows: DataFrame, bits: int) -> list[Span]:
    """Sums over the ranges of ``bits`` leading bits, in order."""
    found = rows.groupBy(F.shiftright("pos", 63 - bits).alias("number")).agg(
        F.sum("size").cast("long").alias("size"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()
    return sorted((Span(r["size"], r["high"], r["low"] == r["high"], r["number"], bits) for r in found), key=lambda s: s.last)


def cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """Last hash of every shard but the final one, and the capacity, for rows (``pos``, ``size``)."""
    spans = _spans(rows, FIRST_BITS)
    while spans:
        high = smallest(spans, shards, False)
        low = smallest(spans, shards, True)
        # A cut of the true partition lies between the whole sweep at the low and the liquid one at the high capacity.
        opened = _between(spans, low, high, shards)
        if not opened:
            break
        spans = _opened(rows, spans, opened)
    while spans:  # the capacity is known; where sweeps from the end and the even cuts fall is opened next
        last = len(spans) - 1
        ends, near = even(spans, high, shards)
        opened = {last - at for at in _between(spans[::-1], high, high, shards)} | near
        if not opened:
            return [spans[at - 1].last for at in ends if at], high
        spans = _opened(rows, spans, opened)
    return [], 0


def even(spans: list[Span], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Spans that start a new shard, as near to equal shares as the capacity lets them, and those that
    must be known more closely, as such a place lies inside them."""
    edges = [0, *accumulate(s.size for s in spans)]
    total = edges[-1]
    least = [total - before for _, before in greedy(spans[::-1], capacity, shards, False)[0]][::-1]
    least = [0] * (shards - 1 - len(least)) + least
    ends, near, cut = [], set(), 0
    for i, needed in enumerate(least, 1):
        low, high = max(needed, edges[cut]), edges[cut] + capacity
        wanted = min(max(-(-i * total // shards), low), high)
        after = bisect_left(edges, wanted)
        if edges[after] != wanted and not spans[after - 1].single:
            near.add(after - 1)
        allowed = [at for at in (after - 1, after) if at >= 0 and low <= edges[at] <= high]
        cut = min(allowed, key=lambda at: abs(edges[at] - wanted))
        ends.append(cut)
    return ends, near


def _between(spans: list[Span], low: int, high: int, shards: int) -> set[int]:
    """Spans of several groups that lie between the whole sweep at the low and the liquid one at the high capacity."""
    near, far = _reached(spans, low, shards, False), _reached(spans, high, shards, True)
    return {at for a, b in zip(near, far) for at in range(a, min(b, len(spans) - 1) + 1) if not spans[at].single}


def _opened(rows: DataFrame, spans: list[Span], opened: set[int]) -> list[Span]:
    """The spans with those of the widest kind among ``opened`` replaced by what they hold."""
    bits = min(spans[i].bits for i in opened)
    opened = {i for i in opened if spans[i].bits == bits}
    keys = rows.sparkSession.createDataFrame([(spans[i].number,) for i in sorted(opened)], StructType([StructField("number", LongType())]))
    inside = rows.join(F.broadcast(keys), F.shiftright("pos", 63 - bits) == F.col("number"), "left_semi")
    return sorted([s for i, s in enumerate(spans) if i not in opened] + _spans(inside, min(63, bits + STEP_BITS)), key=lambda s: s.last)


def _reached(spans: list[Span], capacity: int, shards: int, liquid: bool) -> list[int]:
    """Span at which each of the ``shards - 1`` cuts falls, a sweep that is stuck staying where it is."""
    ends = [at for at, _ in greedy(spans, capacity, shards, liquid)[0]][: shards - 1]
    rest = len(spans) if greedy(spans, capacity, shards, liquid)[1] else (ends[-1] if ends else 0)
    return ends + [rest] * (shards - 1 - len(ends))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    A null text has no bytes and stands with the empty texts; null ids and repeated rows get slots
    of their own; an empty table gives an empty result.  Slots follow blocks of the id's hash, then
    the id: a shard is numbered block by block, so no task sees a shard whole.
    """
    text = text_of()
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("pos")), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    top = rows.groupBy("pos").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "pos").limit(shards - 1).collect()
    heavy: list[int] = []
    for r in top:  # largest first; each takes a shard while it exceeds the share of what is left
        if r["size"] * (shards - len(heavy)) <= total:
            break
        heavy.append(r["pos"])
        total -= r["size"]
    light = rows.where(~F.col("pos").isin(heavy)) if heavy else rows
    ends, _ = cuts(light, shards - len(heavy))
    number = F.lit(len(heavy))
    if ends:
        number = number + F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("pos")))
    for i, pos in enumerate(heavy):
        number = F.when(F.col("pos") == pos, F.lit(i)).otherwise(number)
    blocks = max(16, count // (shards * BLOCK_ROWS) + 1)
    placed = rows.select("*", number.cast("int").alias("shard"), unsigned_bucket(F.struct("doc_id", "row_id"), blocks).alias("block"))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", "block", F.expr("sum(n) over (partition by shard order by block) - n").alias("start"))
    inner = placed.select("*", F.expr("row_number() over (partition by shard, block order by doc_id, row_id) - 1").cast("long").alias("within"))
    return inner.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
