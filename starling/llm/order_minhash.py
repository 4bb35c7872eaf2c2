"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its lower-cased words; its k-mers are five words in a row, each labelled
with its occurrence number, so repeats count.  A sketch holds, for each of several hash functions,
the few labelled k-mers with the smallest hashes in the order of the text: two texts agree in a
sketch only where they share these k-mers in the same order, which follows edit similarity and not
just shared content.  Texts with an equal sketch entry meet in its bucket.

Two texts are linked where the labelled five-word shingles have a Jaccard similarity of at least
0.8, and an alignment of their words within a band has an edit similarity of at least 0.8.  For
such a pair with c common k-mers among u, in the same order, the four that an entry chooses from
the union are all common with probability C(c,4)/C(u,4): about 0.8^4 for long texts, so one of 24
entries agrees with more than 0.99999.  With few k-mers it is less, down to 0.2 for 4 of 5, so
short texts have more entries (``FEW``), and the bound holds at every length.

Equal word sequences are one text from the start, told by 128 bits of a digest.  First every bucket's members are compared with
its pivot, the member that meets most texts; what is linked becomes one class, and most buckets
are done.  Where a bucket still holds several classes, every member outside its largest class is
compared with all members of other classes: in small buckets as pairs, in larger ones block
against block, where one task holds two blocks and counts the k-mers in common through an index,
so no pairs are emitted.  After that any two members of a bucket have been compared or are of one
class.  No link that joins classes is lost, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import join_spread, placed, shipped, staged, text_of, without
from starling.operators.replicated import if_small


@dataclass(frozen=True)
class Sketch:
    words: int = 5
    entries: int = 24
    chosen: int = 4
    similarity: float = 0.8
    few: int = 12
    block: int = 256


LAYOUT = Sketch()
# Least entries of texts with at most so many k-mers.  A pair's union has at least as many as either, so both have these entries.
FEW = ((5, 52), (20, 30))
_MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; of a text without any, its non-space runs."""
    import re
    return re.findall(r"\w+", text.lower()) or text.split()


_HASHES: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """32-bit hashes, the same in every process."""
    import xxhash
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    out = []
    for word in words:
        value = _HASHES.get(word)
        if value is None:
            value = _HASHES[word] = xxhash.xxh32_intdigest(word)
        out.append(value)
    return np.array(out, np.uint64)


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of occurrence-labelled k-mers in text order; a shorter text is one k-mer."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    rolled = np.full(n, k, np.uint64)
    for i in range(k):
        rolled = mixed(rolled * _MIX + hashes[i:i + n])
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), place, 0))
    label = np.empty(n, np.uint64)
    label[order] = (place - first).astype(np.uint64)
    return mixed(rolled + label * _MIX)


def sketch(grams: np.ndarray, layout: Sketch = LAYOUT) -> np.ndarray:
    """One hash per entry: the smallest k-mers under its hash function, in text order."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    take = min(layout.chosen, n)
    entries = max([layout.entries] + [least for most, least in FEW if n <= most])
    seeds = mixed(np.arange(1, entries + 1, dtype=np.uint64) * _MIX)[:, None]
    best_value = best_place = None
    for begin in range(0, n, BLOCK):  # a very long text is looked at in blocks
        value = mixed(grams[None, begin:begin + BLOCK] ^ seeds)
        place = np.broadcast_to(np.arange(begin, begin + value.shape[1]), value.shape)
        if best_value is not None:
            value, place = np.concatenate((best_value, value), 1), np.concatenate((best_place, place), 1)
        if value.shape[1] > take:
            at = np.argpartition(value, take - 1, axis=1)[:, :take]
            value, place = np.take_along_axis(value, at, 1), np.take_along_axis(place, at, 1)
        best_value, best_place = value, place
    picked = grams[np.sort(best_place, axis=1)]
    out = seeds[:, 0].copy()
    for i in range(picked.shape[1]):
        out = mixed(out * _MIX + picked[:, i])
    return out


def similar(left: np.ndarray, right: np.ndarray, layout: Sketch = LAYOUT) -> bool:
    """The verdict on two texts given as word hashes."""
    n, m = len(left), len(right)
    longest = max(n, m)
    if min(n, m) < layout.similarity * longest:
        return False
    a, b = kmers(left, layout.words), kmers(right, layout.words)
    common = len(np.intersect1d(a, b, assume_unique=True))
    if common < layout.similarity * (len(a) + len(b) - common):
        return False
    return edits_within(left, right, int((1 - layout.similarity) * longest + 1e-9))


def edits_within(left: np.ndarray, right: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``, by alignment in a band that doubles up to it."""
    same = min(len(left), len(right))
    head = int(np.argmin(np.append(left[:same] == right[:same], False)))
    left, right = left[head:], right[head:]
    same = min(len(left), len(right))
    tail = int(np.argmin(np.append(left[::-1][:same] == right[::-1][:same], False)))
    left, right = left[:len(left) - tail], right[:len(right) - tail]
    if not len(left) or not len(right):
        return max(len(left), len(right)) <= most
    band = max(8, abs(len(left) - len(right)))
    while True:
        band = min(band, most)
        if band < abs(len(left) - len(right)):
            return False
        distance = banded(left, right, band)
        if distance <= band or band == most:
            return distance <= most
        band *= 2


def banded(left: np.ndarray, right: np.ndarray, band: int) -> int:
    """Edit distance along paths within ``band`` of the diagonal; an upper bound, exact up to ``band``."""
    n, m = len(left), len(right)
    far = n + m + 1
    offsets = np.arange(-band, band + 1)
    padded = np.concatenate((np.zeros(band + 1, np.uint64), right, np.zeros(band + 1 + max(0, n - m), np.uint64)))
    row = np.where(offsets >= 0, offsets, far)
    row[offsets > m] = far
    width = 2 * band + 1
    for i in range(1, n + 1):
        # Cell x of the row stands for j = i + offset; the cell above it is x + 1, the diagonal one x.
        differ = padded[i:i + width] != left[i - 1]
        new = row + differ
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if i <= band:
            new[band - i] = i
            new[:band - i] = far
        if i + band > m:
            new[m - i + band + 1:] = far
        row = np.minimum.accumulate(new - offsets) + offsets
    return int(row[m - n + band])


# ---- the job --------------------------------------------------------------------------------


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Per row: ``row_id``, ``doc_id``, the key of its word sequence, 64 more bits of the same digest (``check``), its k-mers' number, sketch and word hashes, and columns of ``more``."""
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, checks, sizes, entries, hashes = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    found = word_hashes(words)
                    grams = kmers(found, LAYOUT.words)
                    digest = hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest()
                    keys.append(int.from_bytes(digest[:8], "little", signed=True))
                    checks.append(int.from_bytes(digest[8:], "little", signed=True))
                    sizes.append(len(grams))
                    entries.append(sketch(grams).view(np.int64))
                    hashes.append(found.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(entries, pa.list_(pa.int64())), pa.array(hashes, pa.binary()), *[part.column(c) for c in more]],
                    names=["row_id", "doc_id", "text_key", "check", "n", "sketch", "hashes", *more])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return shipped(docs.select("row_id", "doc_id", "text", *more)).mapInArrow(
        sketched, f"row_id long, doc_id {id_type}, text_key long, check long, n long, sketch array<long>, hashes binary{kinds}")


def told_apart(rows: DataFrame) -> DataFrame:
    """The rows with keys that stand for one text each.

    Among some 10^10 texts a few share a 64-bit key by chance.  Where the 64 bits of ``check`` show
    it, all but the texts with the smallest of them get another key, until no key is shared.
    """
    while True:
        keys = rows.groupBy("text_key").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        shared = staged(keys.where("low != high").select("text_key", "low"), "shared")
        if shared.isEmpty():
            return rows.drop("check")
        key = F.when(F.col("check") != F.col("low"), F.xxhash64("text_key", "check")).otherwise(F.col("text_key"))
        rows = staged(rows.join(if_small(shared), "text_key", "left").withColumn("text_key", key).drop("low"), "texts")


def verified(pairs: DataFrame, words: DataFrame, layout: Sketch = LAYOUT) -> DataFrame:
    """The pairs (``a``, ``b`` of text keys) that are linked; ``words`` has each text once."""
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(np.frombuffer(s, "<u4").astype(np.uint64), np.frombuffer(t, "<u4").astype(np.uint64), layout)
                    for s, t in zip(batch["left"], batch["right"])]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    both = pairs.join(words.select(F.col("text_key").alias("a"), F.col("hashes").alias("left")), "a").join(
        words.select(F.col("text_key").alias("b"), F.col("hashes").alias("right")), "b")
    return shipped(both.select("a", "b", "left", "right")).mapInPandas(kept, "a long, b long")


def linked(rows: DataFrame, layout: Sketch = LAYOUT) -> DataFrame:
    """Classes (``text_key``, ``class``) of the texts that have a link; ``rows`` as ``texts`` gives them."""
    entries = rows.groupBy("text_key").agg(F.min("row_id").alias("row_id"))
    first = staged(rows.select("row_id", "n", "sketch").join(entries, "row_id"), "sketches")
    count = first.count()
    exploded = first.select("text_key", "n", F.explode("sketch").alias("bucket"))
    sizes = staged(exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = staged(join_spread(exploded, sizes, "bucket", "size", count), "met")
    # A text's degree: how many others it meets; a center of copies meets most.
    degrees = met.groupBy("text_key").agg(F.sum("size").alias("degree"))
    members = staged(met.join(degrees, "text_key"), "members")
    ids = degrees.select("text_key").join(first.select("text_key", "row_id"), "text_key").select("row_id")
    words = staged(rows.select("row_id", "text_key", "hashes").join(ids, "row_id").select("text_key", "hashes"), "words")
    labels = words.select("text_key", F.col("text_key").alias("class"))

    def close(n, m):
        return F.least(n, m) >= layout.similarity * F.greatest(n, m)

    def pairs_of(left, right):
        return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")

    pivots = members.groupBy("bucket").agg(F.max_by("text_key", "degree").alias("pivot"), F.max_by("n", "degree").alias("len"), F.max("size").alias("size"))
    pairs = (join_spread(members.select("bucket", "text_key", "n"), pivots, "bucket", "size", count)
             .where((F.col("text_key") != F.col("pivot")) & close(F.col("n"), F.col("len"))).select(*pairs_of("text_key", "pivot")).distinct())
    tested = staged(pairs, "pairs")
    labels = joined_classes(labels, staged(verified(tested, words, layout), "found"))

    named = staged(members.drop("size").join(labels, "text_key"), "named")
    by_class = named.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    buckets = staged(by_class.groupBy("bucket").agg(F.max_by("class", "size").alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"), F.count("*").alias("parts"))
                     .where("parts > 1").select("bucket", "main", "size", (F.col("size") - F.col("most")).alias("outside")), "buckets")
    open_ = staged(join_spread(named, buckets, "bucket", "size", count), "open")
    listed = (open_.where(F.col("size") <= layout.few).groupBy("bucket")
              .agg(F.collect_list(F.struct("text_key", "class", "n")).alias("all")))  # at most ``few``
    pairs = listed.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where(
        (F.col("x.text_key") < F.col("y.text_key")) & (F.col("x.class") != F.col("y.class")) & close(F.col("x.n"), F.col("y.n")))
    pairs = staged(pairs.select(*pairs_of("x.text_key", "y.text_key")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    found = verified(pairs, words, layout).unionByName(compared_in_blocks(open_.where(F.col("size") > layout.few), words, layout))
    return joined_classes(labels, staged(found, "found"))


def compared_in_blocks(members: DataFrame, words: DataFrame, layout: Sketch) -> DataFrame:
    """Links (``a``, ``b``) between members outside their bucket's main class and members of other classes.

    Both are dealt to blocks; a unit is one block of each, so a task's share is bounded however
    many members a bucket has.
    """
    block = layout.block
    rows = members.select("bucket", "text_key", "class", "main", F.ceil(F.col("outside") / block).cast("int").alias("outer"), F.ceil(F.col("size") / block).cast("int").alias("inner"))
    def dealt(part):
        return F.pmod(F.xxhash64("text_key"), F.col(part)).cast("int")
    outside = rows.where("class != main").select("bucket", "text_key", "class", F.lit(True).alias("asks"), dealt("outer").alias("i"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("j"))
    inside = rows.select("bucket", "text_key", "class", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), dealt("inner").alias("j"))
    units = outside.unionByName(inside).join(words, "text_key")
    return shipped(units).groupBy("bucket", "i", "j").applyInPandas(lambda unit: links_in(unit, layout), "a long, b long")


def links_in(unit: pd.DataFrame, layout: Sketch = LAYOUT) -> pd.DataFrame:
    """Links of one unit; two texts whose classes a link has joined already are not aligned again."""
    texts_ = {k: np.frombuffer(h, "<u4").astype(np.uint64) for k, h in zip(unit["text_key"], unit["hashes"])}
    grams = {k: kmers(h, layout.words) for k, h in texts_.items()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    others = unit[~unit["asks"]]
    keys, kinds = others["text_key"].tolist(), others["class"].tolist()
    sizes = np.array([len(grams[k]) for k in keys], np.int64)
    flat = np.concatenate([grams[k] for k in keys]) if keys else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(keys)), sizes)[order]
    found = []
    asking = unit[unit["asks"]]
    for key, kind in zip(asking["text_key"].tolist(), asking["class"].tolist()):
        mine = grams[key]
        low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        width = high - low
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        common = np.bincount(owner[at], minlength=len(keys))
        for i in np.flatnonzero(common >= layout.similarity * (len(mine) + sizes - common)).tolist():
            if root(kind) != root(kinds[i]) and similar(texts_[key], texts_[keys[i]], layout):
                found.append((min(key, keys[i]), max(key, keys[i])))
                parent[root(kind)] = root(kinds[i])
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``text_key``, ``class``) after the classes that the links (``a``, ``b``) connect are one."""
    of = lambda end: labels.select(F.col("text_key").alias(end), F.col("class").alias(f"{end}_class"))
    edges = staged(links.join(of("a"), "a").join(of("b"), "b").where("a_class != b_class")
                   .select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    moved = components(edges).select(F.col("node").alias("class"), F.col("label").alias("moved"))
    return staged(labels.join(moved, "class", "left").select("text_key", F.coalesce("moved", "class").alias("class")), "labels")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) for every node of the edges (``a``, ``b``).

    Every node takes the smallest label next to it, then its label's label, until nothing moves.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "both")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = staged(stepped.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        labels = stepped.select("node", "label")
        if stepped.where("old != label").isEmpty():
            return labels


def find_near(docs: DataFrame, layout: Sketch = LAYOUT) -> DataFrame:
    """One row per input row: ``row_id``, ``doc_id``, ``class_id``, ``class_size``, ``kept``.

    ``class_id`` is the smallest id among the documents that links connect, the document's own
    where it has none; ``kept`` is true for one row of each class, that with the smallest id.
    Texts with the same words are one class, null and empty texts with it.  Null ids come after
    all others; of repeated rows one is kept; an empty table gives an empty result.
    """
    return _near(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_of().alias("text")), layout)


def _near(numbered: DataFrame, layout: Sketch, *more: str) -> DataFrame:
    rows = told_apart(staged(texts(numbered, *more), "texts"))
    total = rows.count()
    if not total:
        return rows.select(*more, "row_id", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    labels = linked(rows, layout)
    by_text = rows.groupBy("text_key").agg(F.min_by("row_id", "doc_id").alias("low"), F.min("row_id").alias("any"), F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    by_text = by_text.join(labels, "text_key", "left").withColumn("class", F.coalesce("class", "text_key"))
    by_text = staged(by_text, "by_text")
    by_class = by_text.groupBy("class").agg(F.min_by("low", "doc_id").alias("low"), F.min("any").alias("any"), F.min("doc_id").alias("class_id"),
                                            F.sum("weight").alias("class_size"), F.count("*").alias("texts"))
    by_class = by_class.select("class", F.coalesce("low", "any").alias("keep_row"), "class_id", "class_size", "texts")
    named = join_spread(by_text.select("text_key", "weight", "class"), by_class, "class", "texts", total)
    out = join_spread(rows.select(*more, "row_id", "doc_id", "text_key"), staged(named, "classes"), "text_key", "weight", total)
    return out.select(*more, "row_id", "doc_id", "class_id", "class_size", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def drop_near(docs: DataFrame, layout: Sketch = LAYOUT) -> DataFrame:
    """The input rows that stay, one of each class, with all their columns, whatever these are called."""
    rows, key = placed(docs)
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_of().alias("text"), key)
    return without(rows, _near(numbered, layout, key).where(~F.col("kept")).select(key), key)


def op10(spark, sf_dir: str) -> DataFrame:
    return find_near(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
