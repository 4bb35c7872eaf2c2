"""Sequence packing, shortest pack first over the length histogram.

A document's ids fill whole sequences as far as they go; what is left over, its tail, is shorter
than a sequence.  The histogram of tail lengths is all the planner sees, so its work and its plan
depend on the sequence length, not on the number of documents.  Lengths are placed longest first,
each into the pack with the most room (shortest pack first), in bulk: a group of equal packs and
its count is one pattern.  Packs that stay short are then emptied, the shortest first, and their
tails are cut to fill the room in the others, so that hardly a sequence is padded.

The plan names, for every length, which ranks of its tails go where.  Documents meet it by rank:
numbered within their partition where their ids are made, the partitions' counts summed, so no length,
however common, is numbered in one task, and the ids stay where they were written while the counts are few.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from starling.llm import tokenizers_public
from starling.llm.common import shipped, staged, text_of

FILE = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
MIN_FILL = 4
CACHE_WORDS = 800_000
CHUNK_BYTES = 4 << 20  # of text encoded together
CHUNK_ROWS = 500
FEW_STARTS = 5_000_000  # first ranks of partitions, 12 bytes each, that every task may hold


# ---- the plan -------------------------------------------------------------------------------


@dataclass
class Pack:
    """``count`` equal packs: their items as (length, first rank) and the ids they hold."""
    count: int
    filled: int
    items: list[tuple[int, int]]

    def split(self, count: int) -> "Pack":
        """Takes the first ``count`` packs off."""
        first = Pack(count, self.filled, list(self.items))
        self.items = [(length, rank + count) for length, rank in self.items]
        self.count -= count
        return first


def shortest_first(histogram: dict[int, int], size: int) -> list[Pack]:
    """Patterns of packs that hold every tail whole."""
    by_room: dict[int, list[Pack]] = {}
    closed: list[Pack] = []
    rooms = np.zeros(size + 1, np.int64)  # patterns by room

    def put(pack):
        if pack.filled == size:
            closed.append(pack)
        else:
            by_room.setdefault(size - pack.filled, []).append(pack)
            rooms[size - pack.filled] += 1

    for length in sorted((n for n in histogram if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            wide = np.flatnonzero(rooms[length:])
            if not len(wide):
                put(Pack(left, length, [(length, rank)]))
                break
            room = length + int(wide[-1])
            pack = by_room[room][-1]
            if pack.count <= left:
                by_room[room].pop()
                rooms[room] -= 1
            else:
                pack = pack.split(left)
            pack.items.append((length, rank))
            pack.filled += length
            rank, left = rank + pack.count, left - pack.count
            put(pack)
    return closed + [p for room in sorted(by_room) for p in by_room[room]]


@dataclass
class Cut:
    """Tails of one length with consecutive ranks, some of it placed: pieces as (start, length, first sequence, offset)."""
    count: int
    length: int
    rank: int
    start: int
    pieces: list[tuple[int, int, int, int]]


def plan(histogram: dict[int, int], size: int = LENGTH, min_fill: int = MIN_FILL) -> tuple[list[tuple[int, int, int, list]], int]:
    """Where the tails go, and the number of sequences.

    Entries are (length, first rank, count, pieces); a piece is (start in the tail, length, sequence
    of the first rank, offset).  The k-th rank of an entry goes to the sequence k further on.
    """
    packs = sorted(shortest_first(histogram, size), key=lambda p: -p.filled)
    # The shortest packs are emptied while the room in the others takes what they hold.
    room = sum(p.count * _usable(size - p.filled, min_fill) for p in packs)
    donors: list[Pack] = []
    held = 0
    while packs:
        last = packs[-1]
        gap = _usable(size - last.filled, min_fill)
        fit = min(last.count, (room - held) // (gap + last.filled)) if gap + last.filled else 0
        if fit <= 0 or not gap:
            break
        held += fit * last.filled
        room -= fit * gap
        donors.append(last.split(fit) if fit < last.count else packs.pop())
        if donors[-1] is not last:
            break
    entries, sequences = [], 0
    gaps: list[tuple[int, int, int, int]] = []  # count, room, first sequence, filled
    for pack in packs:
        offset = 0
        for length, rank in pack.items:
            entries.append((length, rank, pack.count, [(0, length, sequences, offset)]))
            offset += length
        if _usable(size - pack.filled, min_fill):
            gaps.append((pack.count, size - pack.filled, sequences, pack.filled))
        sequences += pack.count
    cuts = [Cut(p.count, length, rank, 0, []) for p in donors for length, rank in p.items]
    cuts.sort(key=lambda c: c.length)  # the longest are placed first, from the end
    gaps.sort(key=lambda g: g[1])
    while cuts:
        cut = cuts.pop()
        if not gaps:  # a last sequence for what the rounding of the gaps left over
            gaps.append((cut.count, size, sequences, 0))
            sequences += cut.count
        count, space, first, filled = gaps.pop()
        n = min(count, cut.count)
        if n < cut.count:
            cuts.append(Cut(cut.count - n, cut.length, cut.rank + n, cut.start, [(s, k, q + n, o) for s, k, q, o in cut.pieces]))
        if n < count:
            gaps.append((count - n, space, first + n, filled))
        take = min(space, cut.length - cut.start)
        pieces = cut.pieces + [(cut.start, take, first, filled)]
        if cut.start + take == cut.length:
            entries.append((cut.length, cut.rank, n, pieces))
        else:
            cuts.append(Cut(n, cut.length, cut.rank, cut.start + take, pieces))
        if _usable(space - take, min_fill):
            gaps.append((n, space - take, first, filled + take))
    return entries, sequences


def _usable(room: int, least: int) -> int:
    return room if room >= least else 0


# ---- ids ------------------------------------------------------------------------------------


TRAILING = ".,;:!?*#$%&|"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")  # one letter run to the pre-tokenizer, composed, each lowered by itself


class Words:
    """Ids of words between white space, encoded once per worker while the store has room.

    The pre-tokenizer splits at white space and drops it, so a text's ids are those of its words
    one after another; it also splits between a letter or digit and punctuation, so a word with
    punctuation after it is put together from the two, and A-Z are lowered before the look-up as
    the tokenizer would.  Words of plain letters are encoded by the vocabulary's ranks, all others by
    the library.  Texts with a special string, or with control characters that Python takes
    for white space and the tokenizer does not, go through the library whole.
    """

    def __init__(self, file: str):
        self.library = tokenizers_public.library(file)
        self.ranks = tokenizers_public.word_ranks(file)
        self.store: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word as the library gives them, words of plain letters by their ranks."""
        letters = [bool(LETTERS.fullmatch(word)) for word in words]
        plain = iter(self.ranks.encode([w.lower() for w, k in zip(words, letters) if k]))
        other = [w for w, k in zip(words, letters) if not k]
        rest = iter([found.ids for found in self.library.encode_batch_fast(other, add_special_tokens=False)])
        for known in letters:
            yield next(plain) if known else _packed(next(rest))

    def learn(self, words: list[str]) -> None:
        """Adds the ids of words to the store, a core known from another word not encoded again."""
        parts = {}
        for word in words:
            low = word.lower() if word.isascii() else word
            core = low.rstrip(TRAILING)
            parts[word] = (core, low[len(core):]) if core and core[-1].isalnum() else (low, "")
        fresh = list(dict.fromkeys(p for pair in parts.values() for p in pair if p and p not in self.store))
        for begin in range(0, len(fresh), 4096):
            part = fresh[begin:begin + 4096]
            self.store.update(zip(part, self.encode(part)))
        for word, (core, rest) in parts.items():
            self.store[word] = self.store[core] + self.store[rest] if rest else self.store[core]

    def ids(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian 16-bit ids of every text, the end id after them."""
        if len(self.store) > CACHE_WORDS:
            self.store.clear()
        plain = ["<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f") for text in texts]
        # Arrow splits where Python does, for all characters but those four, with empty words at the ends.
        split = pc.utf8_split_whitespace(pa.array([(text.lower() if text.isascii() else text) if k else "" for text, k in zip(texts, plain)], pa.large_string()))
        each = split.values.dictionary_encode()
        words = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.store[""] = b""
        found = list(map(self.store.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        self.learn([words[i] for i in new])
        for i in new:
            found[i] = self.store[words[i]]
        # The ids of the different words one after another, then picked for every word of every text.
        flat = np.frombuffer(b"".join(found), "<u2")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 2
        which = each.indices.to_numpy()
        n = length[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        picked = flat[np.repeat((np.cumsum(length) - length)[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (2 * ends[split.offsets.to_numpy()]).tolist()
        end = _packed([end_id])
        return [(picked[a:b] if k else _packed(self.library.encode(text, add_special_tokens=False).ids)) + end
                for text, k, a, b in zip(texts, plain, cuts, cuts[1:])]


def _packed(ids: list[int]) -> bytes:
    """Little-endian 16-bit ids."""
    packed = array("H", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


_WORDS: dict[str, Words] = {}


class Numbers:
    """Numbers the documents of one partition in order: ranks of tails by their length, whole sequences."""

    def __init__(self, size: int):
        self.size, self.ranks, self.whole = size, [0] * size, 0

    def number(self, n: int) -> tuple[int, int, int]:
        """Length of the tail, its rank among tails of that length, and the whole sequences before it."""
        whole, tail = divmod(n, self.size)
        found = tail, self.ranks[tail], self.whole
        self.ranks[tail] += 1
        self.whole += whole
        return found


def tokens(docs: DataFrame, size: int = LENGTH, file_name: str = FILE, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``n`` and ``ids`` (16-bit, packed in a binary) of every whole text, numbered within its partition.

    ``part`` is the partition, ``tail`` what is over after whole sequences, ``rank`` and
    ``whole_before`` count the tails of that length and the whole sequences before it there.
    """
    file = tokenizers_public.path(file_name)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.setdefault(file, Words(file))
        numbers = Numbers(size)
        for batch in batches:
            reached = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(reached)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.slice(begin, end - begin)
                ids = words.ids(part.column("text").to_pylist(), end_id)
                counts = [len(b) // 2 for b in ids]
                tail, rank, before = zip(*map(numbers.number, counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(tail, pa.int32()),
                     pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "n", "tail", "rank", "whole_before", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", text_of().alias("text"))
    return shipped(rows).mapInArrow(encoded, f"part int, doc_id {id_type}, n long, tail int, rank long, whole_before long, ids binary")


# ---- packing --------------------------------------------------------------------------------


def starts(groups: DataFrame) -> DataFrame:
    """Where the numbers of a partition begin: by ``part`` and ``tail`` the first rank, and the whole sequences before the part.

    ``groups`` has, by ``part`` and ``tail``, the documents as ``n`` and their sequences as ``whole``.
    """
    # Sums over partitions: by length for the ranks, over all for the whole sequences.
    tails = groups.select("part", "tail", F.expr("sum(n) over (partition by tail order by part) - n").alias("rank_start"))
    per_part = groups.groupBy("part").agg(F.sum("whole").alias("whole")).withColumn("group", F.floor(F.col("part") / 1024))
    wide = per_part.groupBy("group").agg(F.sum("whole").alias("whole"))
    wide = wide.select("group", F.expr("sum(whole) over (order by group) - whole").alias("group_start"))
    per_part = per_part.withColumn("start", F.expr("sum(whole) over (partition by group order by part) - whole"))
    wholes = per_part.join(wide, "group").select("part", (F.col("start") + F.col("group_start")).alias("whole_start"))
    return tails.join(wholes, "part")


def pack(docs: DataFrame, size: int = LENGTH, file_name: str = FILE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence.

    Columns: ``doc_id``, ``start`` (the document's ids before it), ``length``, ``ids_crc32`` and
    ``ids`` (of the piece, 32-bit little-endian), ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset``.  Null text counts as empty and is one end id; repeated rows and null ids are packed
    row by row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = staged(tokens(docs, size, file_name, end_id), "ids", "zstd")
    groups = rows.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.expr(f"n div {size}")).alias("whole"))
    counted = groups.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    entries, sequences = plan({r["tail"]: r["n"] for r in counted}, size)
    # Bounded by the sequence length: a few thousand entries, whatever the number of documents.
    entries.sort(key=lambda e: (e[0], e[1]))
    key = np.array([e[0] << 44 | e[1] for e in entries] or [0], np.int64)
    shared = spark.sparkContext.broadcast((key, entries))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, found = shared.value
        for batch in (batch[at:at + CHUNK_ROWS] for batch in batches for at in range(0, len(batch), CHUNK_ROWS)):
            out = []
            for doc_id, n, ids, rank, before in zip(batch["doc_id"], batch["n"], batch["ids"], batch["rank"], batch["whole_before"]):
                values = np.frombuffer(ids, "<u2").astype("<u4")
                whole, tail = divmod(n, size)
                parts = [(k * size, size, sequences + before + k, 0) for k in range(whole)]
                if tail:
                    length, first, _, places = found[np.searchsorted(keys, tail << 44 | rank, "right") - 1]
                    parts += [(whole * size + s, k, q + rank - first, o) for s, k, q, o in places]
                for start, length, sequence, offset in parts:
                    raw = values[start:start + length].tobytes()
                    out.append((doc_id, start, length, zlib.crc32(raw), n, sequence, offset, raw))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    # At most the sequence length times the partitions; where that is much, the ids are shuffled to it.
    first = starts(groups)
    if sum(r["parts"] for r in counted) <= FEW_STARTS:
        by_tail = F.map_from_entries(F.collect_list(F.struct("tail", "rank_start"))).alias("rank_starts")
        first = first.groupBy("part").agg(by_tail, F.max("whole_start").alias("whole_start"))
        placed = rows.join(F.broadcast(first), "part").withColumn("rank_start", F.element_at("rank_starts", F.col("tail")))
    else:
        placed = rows.join(first, ["part", "tail"])
    placed = placed.select("doc_id", "n", "ids", (F.col("rank") + F.col("rank_start")).alias("rank"),
                           (F.col("whole_before") + F.col("whole_start")).alias("whole_before"))
    return shipped(placed).mapInPandas(
        pieces, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
