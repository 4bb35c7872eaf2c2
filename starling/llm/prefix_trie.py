"""Prefixes that conversations share, as nodes of adaptive radix trees.

A turn (role, text) has an id of fixed width, 16 bytes of its digest read big-endian; a conversation's
key is its turns' ids in a row, and equal keys are one entry with a weight before anything else.
Entries are ordered by key and dealt to parts as ranges, so a first turn that a third of all
conversations share is split like any other range.  Each part builds one radix tree over the bytes
of its keys: inner nodes hold 4, 16, 48 or 256 children and grow from one layout to the next, and
a run of bytes without a branch is kept as the path of one node.  A conversation prefix is a node
of the result only where its last byte ends a turn.

Parts overlap in nothing but the prefixes that two neighbouring keys share across a border.  These
few nodes come from several parts and are added up; how deep a border's keys agree is known
beforehand, so every child, childless node and word of a prefix is counted in one part only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from starling.llm.common import SPACE, WORD, shipped, staged

WIDTH = 16  # bytes of a turn's id
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Layout:
    keys: int = 20_000   # keys of a part, about
    chunk: int = 20_000  # ids of a chunk of a digest's text
    salts: int = 32      # copies of the few shared nodes, for children looking up their parent


# ---- the tree -------------------------------------------------------------------------------


class Leaf:
    """One whole key with what it carries."""
    __slots__ = ("key", "entry")

    def __init__(self, key: bytes, entry):
        self.key, self.entry = key, entry


class Inner:
    """A branch: the bytes before it since its parent (``path``), an entry that ends here, the children by byte.

    Up to 4 and up to 16 children are two sorted lists of bytes and children, up to 48 a table of
    256 places in a list of children, more a table of 256 children.
    """
    __slots__ = ("path", "entry", "size", "bytes", "children", "layout")

    def __init__(self, path: bytes):
        self.path, self.entry, self.layout = path, None, 4
        self.bytes, self.children, self.size = bytearray(), [], 0

    def child(self, byte: int):
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node) -> None:
        """Sets a child, after growing into the next layout where this one is full."""
        if self.child(byte) is not None:
            if self.layout <= 16:
                self.children[self.bytes.find(byte)] = node
            else:
                self.children[self.bytes[byte] - 1 if self.layout == 48 else byte] = node
            return
        if self.size == self.layout:
            self.grow()
        if self.layout <= 16:
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == 48:
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node
        self.size += 1

    def grow(self) -> None:
        held = list(self)
        self.layout = {4: 16, 16: 48, 48: 256}[self.layout]
        if self.layout == 48:
            self.bytes, self.children = bytearray(256), [n for _, n in held]
            for place, (byte, _) in enumerate(held, 1):
                self.bytes[byte] = place
        elif self.layout == 256:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, node in held:
                self.children[byte] = node

    def __iter__(self):
        """(byte, child) in order."""
        if self.layout <= 16:
            yield from zip(self.bytes, self.children)
        elif self.layout == 48:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at)
        else:
            yield from ((b, n) for b, n in enumerate(self.children) if n is not None)


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # they agree up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Keys to entries; no key is put in twice."""

    def __init__(self):
        self.root = Inner(b"")

    def put(self, key: bytes, entry) -> None:
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            if isinstance(node, Leaf):
                path = node.key[at:]
            else:
                path = node.path
            same = agreeing(path, key[at:at + len(path)])
            if same < len(path) or isinstance(node, Leaf):
                split = Inner(path[:same])
                if isinstance(node, Leaf):
                    if same == len(path):
                        split.entry = node.entry
                    else:
                        split.put(path[same], node)
                else:
                    node.path = path[same:]
                    split.put(path[same], node)
                parent.put(byte, split)
                node = split
            at += same
            if at == len(key):
                node.entry = entry
                return
            following = node.child(key[at])
            if following is None:
                node.put(key[at], Leaf(key, entry))
                return
            parent, byte, node = node, key[at], following


@dataclass
class Entry:
    """A distinct key: its conversations' smallest id and number, the digest of their ids, words of its turns."""
    conv: int
    n: int
    ends: str
    words: list


class Sums:
    """A subtree from below: smallest id, members, children, childless nodes, member words less node words, rows that wait for their parent."""
    __slots__ = ("conv", "n", "children", "leaves", "saved", "waiting", "inner", "key", "words")

    def __init__(self, entry: Entry | None, key: bytes, parts: list["Sums"]):
        convs = [p.conv for p in parts] + ([entry.conv] if entry else [])
        self.conv = min(convs)
        self.n = sum(p.n for p in parts) + (entry.n if entry else 0)
        self.children, self.leaves, self.saved = sum(p.children for p in parts), sum(p.leaves for p in parts), sum(p.saved for p in parts)
        self.waiting, self.inner = [row for p in parts for row in p.waiting], bool(parts)
        self.key, self.words = (parts[0].key, parts[0].words) if parts else (key, entry.words)


COLUMNS = ("node", "parent_node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
SCHEMA = "node binary, parent_node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def name_of(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def nodes_of(tree: RadixTree, before: int, after: int) -> Iterator[tuple]:
    """The turn-aligned prefixes of a tree as rows of ``COLUMNS``, subtrees first.

    ``before`` and ``after`` are the depths to which the first and the last key agree with the
    neighbouring parts' keys, -1 without a neighbour.  A prefix that a neighbour has too carries its
    name; what an earlier part counts (a child, its words) or a later one (whether it is childless) is
    left out here, so the rows of a name add up.
    """
    def emitted(below: Sums, depth: int, first: bool, last: bool, ends: str | None) -> Iterator[tuple]:
        words = below.words[depth - 1] if depth else 0
        seen, follows = first and depth <= before, last and depth <= after
        if not below.inner and not follows:
            below.leaves = 1
        below.saved += below.n * words - (0 if seen else words)
        name = name_of(below.key[:depth * WIDTH]) if seen or follows else None
        for row in below.waiting:
            row[1], row[4] = name, below.conv
            yield tuple(row)
        above = name_of(below.key[:(depth - 1) * WIDTH]) if name and depth else None
        below.waiting = [[name, above, below.conv, depth, None, below.n, below.children, below.leaves, below.saved, ends]]
        below.children, below.inner = 0 if seen else 1, True

    def frame(node, top: int, first: bool, last: bool) -> list:
        if isinstance(node, Leaf):
            return [node, top, len(node.key), first, last, iter(()), []]
        below = [child for _, child in node]
        marked = ((c, first and i == 0 and node.entry is None, last and i == len(below) - 1) for i, c in enumerate(below))
        return [node, top, max(top, 0) + len(node.path), first, last, marked, []]

    stack = [frame(tree.root, -1, True, True)]
    while stack:
        node, top, end, first, last, below, parts = stack[-1]
        following = next(below, None)
        if following is not None:
            stack.append(frame(following[0], end, *following[1:]))
            continue
        stack.pop()
        sums = Sums(node.entry, node.key if isinstance(node, Leaf) else b"", parts)
        for depth in range(end // WIDTH, top // WIDTH, -1):
            here = node.entry is not None and depth * WIDTH == end
            yield from emitted(sums, depth, first, last, node.entry.ends if here else None)
        if stack:
            stack[-1][6].append(sums)
        else:
            yield from map(tuple, sums.waiting)


# ---- the job --------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` and ``words`` of every conversation after its first turns are another's."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    filled = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.length(F.trim(F.regexp_replace(F.regexp_replace("text", WORD, "w"), SPACE, ""))).cast("long")
    turns = staged(filled.withColumn("at", F.row_number().over(order)).select("conv_id", "at", F.substring(named, 1, 2 * WIDTH).alias("id"), words.alias("words")), "turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    own = turns.join(convs, "conv_id").where("at > h").select("conv_id", F.lit(1).alias("own"), "at", "id", "words")
    lent = turns.where("at <= 3").withColumnRenamed("conv_id", "base")
    heads = convs.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(lent, "base").where("at <= h").select(
        "conv_id", F.lit(0).alias("own"), "at", "id", "words")
    listed = own.unionByName(heads).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("own", "at", "id", "words"))).alias("turns"))
    none = F.array().cast("array<struct<own:int,at:int,id:string,words:bigint>>")
    rows = convs.select("conv_id").join(listed, "conv_id", "left").withColumn("turns", F.coalesce("turns", none))
    return rows.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.words").alias("words"))


def digests(rows: DataFrame, layout: Layout) -> DataFrame:
    """``digest`` and ``ends``: SHA-256 of the ascending ids of each digest, joined by commas.

    A digest's ids are sorted in parts and joined into chunks there; what meets in one task is the
    stream of its chunks.
    """
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = batch.groupby(["digest", (batch.groupby("digest").cumcount() // layout.chunk).rename("part")], sort=False)["conv_id"]
            yield pd.DataFrame([(d, int(ids.iloc[0]), ",".join(map(str, ids))) for (d, _), ids in runs], columns=["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, out = None, None, []
        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest == current:
                    sha.update(b"," + ids.encode())
                    continue
                if current is not None:
                    out.append((current, sha.hexdigest()))
                current, sha = digest, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["digest", "ends"])
            out = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([sha.hexdigest()])], names=["digest", "ends"])

    parts = shipped(rows).select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInPandas(
        chunks, "digest string, first long, ids string")
    return parts.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest string, ends string")


def trie(conversations: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The nodes of all rebuilt conversations, columns of ``op12``.

    Turns are ordered by ``turn``, null first, then by role and text; null role or text is empty.
    Rows without a conv_id take no part.  Repeated rows are turns of their own.  An empty text has no words; an
    empty table has no nodes, not even the root.  A conversation's key, 16 bytes a turn, is one value.
    """
    rows = staged(rebuilt(conversations).withColumn("digest", F.sha2("key", 256)), "rebuilt")
    groups = rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    entries = rows.select("conv_id", "key", "words").join(groups, "conv_id").join(digests(rows, layout), "digest").select("key", "words", "conv_id", "n", "ends")
    entries = staged(entries, "entries")
    parts = max(1, -(-entries.count() // layout.keys))
    dealt = entries.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "parts")
    borders = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    next_to = Window.orderBy("part")  # one row a part
    borders = borders.withColumn("left", F.lag("high").over(next_to)).withColumn("right", F.lead("low").over(next_to))

    def agreed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            def depth(x, y):
                return -1 if x is None or y is None else agreeing(bytes(x), bytes(y)) // WIDTH
            yield pd.DataFrame({"part": b["part"], "before": [depth(x, y) for x, y in zip(b["low"], b["left"])], "after": [depth(x, y) for x, y in zip(b["high"], b["right"])]})
    depths = shipped(borders).mapInPandas(agreed, "part int, before int, after int")

    def built(part: pd.DataFrame) -> pd.DataFrame:
        tree = RadixTree()
        for key, words, conv, n, ends in zip(part["key"], part["words"], part["conv_id"], part["n"], part["ends"]):
            tree.put(bytes(key), Entry(int(conv), int(n), ends, [int(w) for w in words]))
        out = pd.DataFrame(nodes_of(tree, int(part["before"].iloc[0]), int(part["after"].iloc[0])), columns=COLUMNS)
        return out.astype({"parent_conv_id": "Int64"})
    nodes = staged(dealt.join(depths, "part").groupBy("part").applyInPandas(built, SCHEMA), "nodes")

    shared = staged(nodes.where("node is not null").groupBy("node").agg(
        F.min("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends")), "shared")
    salt = F.explode(F.sequence(F.lit(0), F.lit(layout.salts - 1))).alias("salt")
    parents = shared.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("top"), salt)
    open_ = nodes.where("node is null").drop("node").unionByName(shared.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(layout.salts)).cast("int"))
    return salted.join(parents, ["parent_node", "salt"], "left").select(
        "conv_id", "depth", F.coalesce("top", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
with crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
    from (select cast(range as bigint) as i from range(256))),
r as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(list_concat([cast(4294967295 as bigint)],
            list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 as h
    from (select distinct conv_id from r), crc),
b as (select c.conv_id, 0 as own, pos, role, text from c join r on r.conv_id = base and pos <= h
    union all select c.conv_id, 1, pos, role, text from c join r on r.conv_id = c.conv_id and pos > h),
d as (select *, row_number() over (partition by conv_id order by own, pos) as depth from b),
p as (select conv_id, depth, string_agg(octet_length(encode(role)) || ':' || octet_length(encode(text)) || ':' || role || text, '')
        over (partition by conv_id order by depth) as path, len(regexp_extract_all(text, '[^ 	-
]+')) as words from d
    union all select conv_id, 0, '', 0 from c),
m as (select *, row_number() over (partition by conv_id order by depth desc) = 1 as ends,
        lag(path) over (partition by conv_id order by depth) as above from p),
n as (select depth, path, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from m group by depth, path),
k as (select depth - 1 as depth, above as path, count(*) as n_children from n where depth > 0 group by depth, above),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (depth, path)),
g as (select p.conv_id, p.depth, sum(case when f.n_children = 0 then 1 else 0 end) over w as leaves, sum((f.n_convs - 1) * f.words) over w as saved
    from p join f using (depth, path) where f.conv_id = p.conv_id
    window w as (partition by p.conv_id order by p.depth desc)),
o as (select p.depth, p.path, sum(g.leaves) as n_leaves, sum(g.saved) as saved_tokens
    from p join (select conv_id, min(depth) as own from g group by conv_id) s using (conv_id)
        join g on g.conv_id = p.conv_id and g.depth = greatest(p.depth, s.own) group by p.depth, p.path)
select f.conv_id, cast(f.depth as bigint) as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children,
    cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, f.ends_sha256
from f join o using (depth, path) left join f u on u.depth = f.depth - 1 and u.path = f.above"""
