"""Approximate nearest neighbours over a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is then led down to its leaf.  A query goes
through the tree with a priority queue of nodes by the distance to their centers: the nearest node
is taken out, an inner node puts its children in, a leaf is visited.  How many leaves a query
visits is found by calibration: the exact neighbours of some queries are searched block against
block, and the visits are widened until the leaves hold the wanted share of them.  A query whose
leaves hold too few rows goes on to the next ones.

Queries then meet the rows of their leaves.  A leaf is dealt to blocks by row number, so a leaf
with a third of all rows is many units, and each unit gives at most ``k`` rows a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import shipped, staged
from starling.llm.vectors import blocks_for, dealt, finite, first_of, packed, ranked, stacked


@dataclass(frozen=True)
class Search:
    k: int = 10
    recall: float = 0.97
    probes: int = 256       # calibration queries at most
    sample: int = 32768     # rows that the tree is fitted on at most
    branches: int = 16
    leaf_rows: int = 256    # a node with fewer rows (by the sample's share) is a leaf
    least: int = 8          # so is one with fewer sampled rows
    sweeps: int = 8
    rows: int = 8192        # rows of a unit at most, and queries
    seed: int = 11


class Tree:
    """Centers of all nodes, the children of each as a range, and the leaf number of each (-1: inner)."""

    def __init__(self, sample: np.ndarray, total: int, how: Search):
        draw = np.random.default_rng(how.seed)
        share = total / max(1, len(sample))
        centers, self.first, self.last, self.leaf = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [0], [0], [-1]
        todo, self.leaves = [(0, np.arange(len(sample)))], 0
        while todo:
            node, members = todo.pop()
            groups = [] if len(members) * share <= how.leaf_rows or len(members) < 2 * how.least else means(sample[members], min(how.branches, len(members) // how.least), how.sweeps, draw)
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.first[node], self.last[node] = len(centers), len(centers) + len(groups)
            for center, part in groups:
                todo.append((len(centers), members[part]))
                centers.append(center)
                self.first.append(0), self.last.append(0), self.leaf.append(-1)
        self.centers = np.array(centers)

    def distances(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the node's children."""
        c = self.centers[self.first[node]:self.last[node]]
        return (x * x).sum(-1)[..., None] - 2 * (x @ c.T) + (c * c).sum(1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row is led down to."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = self.distances(node, x[rows]).argmin(1)
            todo += [(self.first[node] + c, rows[nearest == c]) for c in np.unique(nearest)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            for c, d in enumerate(self.distances(node, q).tolist(), self.first[node]):
                heapq.heappush(queue, (d, c))


def means(x: np.ndarray, k: int, sweeps: int, draw: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lloyd's k-means from distinct starting rows: (center, positions) of every cluster that has rows."""
    starts = np.unique(x[draw.permutation(len(x))[:4 * k]], axis=0)
    c = starts[draw.permutation(len(starts))[:k]]
    for sweep in range(sweeps + 1):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        used = np.unique(near)
        if sweep == sweeps:
            break
        c = np.array([x[near == i].mean(0) for i in used])
    return [(c[i], np.flatnonzero(near == i)) for i in used]


def nearest(unit: pd.DataFrame, kind: str, width: int, k: int) -> pd.DataFrame:
    """Per query of a unit its ``k`` nearest rows, then smallest ids; its own row is left out.

    Squared distances by products leave out what is clearly too far; the others are computed from
    differences in double precision.
    """
    rows, asks = unit[~unit["asks"]], unit[unit["asks"]]
    x, keys, ids, nameless = stacked(rows["v"], kind, width), rows["row"].to_numpy(), rows["id"].to_numpy(), rows["nameless"].to_numpy()
    q, found = stacked(asks["v"], kind, width), []
    squares, own = (x * x).sum(1), (q * q).sum(1)
    for at in range(0, len(q) if len(x) else 0, 256):
        about = squares - 2 * (q[at:at + 256] @ x.T)
        for i, key in enumerate(asks["row"].to_numpy()[at:at + 256]):
            near = np.arange(len(x))
            if len(x) > k + 1:
                slack = 1e-9 * (own[at + i] + squares.max())
                near = np.flatnonzero(about[i] <= np.partition(about[i], k)[k] + slack)
            near = near[keys[near] != key]
            score = np.sqrt(((x[near] - q[at + i]) ** 2).sum(1))
            for p in first_of(score, nameless[near], ids[near], keys[near], k):
                found.append((key, keys[near[p]], ids[near[p]], nameless[near[p]], score[p]))
    return pd.DataFrame(found, columns=["q", "row", "id", "nameless", "score"])


def met(rows: DataFrame, asks: DataFrame, sizes: DataFrame, kind: str, width: int, how: Search) -> DataFrame:
    """``q``, ``rank``, ``row``, ``id``, ``nameless``, ``score``: asks against the rows of their leaves, in blocks.

    ``sizes`` has for each leaf that is asked for the number of blocks of its rows (``inner``) and queries (``outer``).
    """
    sizes = F.broadcast(sizes)  # one row a leaf; the tree's sample bounds the leaves
    one = rows.join(sizes, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), dealt("row", F.col("inner")).alias("j"), F.lit(False).alias("asks"), "row", "id", "nameless", "v")
    two = asks.join(sizes, "leaf").select(
        "leaf", dealt("row", F.col("outer")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("j"), F.lit(True).alias("asks"), "row", "id", "nameless", "v")
    found = shipped(one.unionByName(two)).groupBy("leaf", "i", "j").applyInPandas(
        lambda unit: nearest(unit, kind, width, how.k), "q long, row long, id long, nameless boolean, score double")
    return ranked(found, ["q"], F.asc("score"), how.k)


def block_counts(counts: list, how: Search):
    """(leaf, inner, outer) of (leaf, rows, queries)."""
    return [(leaf, blocks_for(rows, how.rows, 1024), max(1, -(-queries // how.rows))) for leaf, rows, queries in counts]


def led(rows: DataFrame, tree, column: str) -> DataFrame:
    """The rows with ``tree`` (packed vectors) as a list of integers ``column``."""
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree(batch.column("v").to_pylist()), pa.list_(pa.int32()))], names=[*batch.schema.names, column])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return shipped(rows).mapInArrow(lead, f"{schema}, {column} array<int>")


def neighbours(vectors: DataFrame, how: Search = Search(), measure: dict | None = None) -> DataFrame:
    """The nearest rows found of every row marked ``asks``; columns ``vec_id``, ``values``, ``asks``.

    Result: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance in double precision), nearest
    first, then by id.  ``measure`` takes the leaves visited and the calibrated recall.

    Rows with null values, a null or non-finite component, or only zeros take no part.  A missing
    component of a shorter vector counts as zero.  A null id comes after all others at the same
    distance; repeated rows are rows of their own, so a copy of a query's row is a candidate.  A
    query with fewer candidates than ``k`` gets all of them; an empty table gives an empty result.
    """
    kept = vectors.where(finite("values")).where(F.exists("values", lambda x: x != 0))
    single = "array<float>" in vectors.schema["values"].dataType.simpleString()
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("nameless"),
                       F.coalesce("asks", F.lit(False)).alias("asks"), F.col("values").cast("array<double>").alias("values"))
    width = kept.agg(F.max(F.size("values"))).first()[0] or 1
    kind = "<f4" if single else "<f8"
    rows = staged(packed(rows, kind, width), "vectors")
    total, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    sample = rows.orderBy(F.xxhash64("row")).limit(how.sample).select("v").collect()
    tree = rows.sparkSession.sparkContext.broadcast(Tree(stacked([r["v"] for r in sample], kind, width), total, how))

    def leaves(blobs):
        return [[leaf] for leaf in tree.value.leaf_of(stacked(blobs, kind, width)).tolist()]
    located = staged(led(rows, leaves, "at").select("row", "id", "nameless", "asks", "v", F.col("at")[0].alias("leaf")), "located")
    held = dict(located.groupBy("leaf").agg(F.count("*")).collect())
    spark = rows.sparkSession

    # Calibration: where the exact neighbours of some queries lie in these queries' orders of visits.
    probes = staged(located.where("asks").orderBy(F.xxhash64("row", F.lit(1))).limit(how.probes), "probes")
    whole = spark.createDataFrame(block_counts([(0, total, how.probes)], how), "leaf int, inner int, outer int")
    truth = met(located.withColumn("leaf", F.lit(0)), probes.withColumn("leaf", F.lit(0)), whole, kind, width, how).select("q", "row")

    def all_visits(blobs):
        return [list(tree.value.visits(v)) for v in stacked(blobs, kind, width)]
    order = led(probes.select("row", "v"), all_visits, "visits").select(F.col("row").alias("q"), "visits")
    at = truth.join(located.select("row", "leaf"), "row").join(order, "q").select((F.array_position("visits", F.col("leaf")) - 1).alias("at"))
    places = np.array([r["at"] for r in at.collect()])  # at most ``probes * k``
    most = 1
    while most < tree.value.leaves and len(places) and (places < most).mean() < how.recall:
        most = min(tree.value.leaves, most + max(1, most // 4))
    if measure is not None:
        measure |= {"leaves": tree.value.leaves, "visited": most, "recall": float((places < most).mean()) if len(places) else 1.0}

    def visits(blobs):
        out = []
        for v in stacked(blobs, kind, width):
            seen, rows_seen = [], 0
            for leaf in tree.value.visits(v):
                if len(seen) >= most and rows_seen > how.k:
                    break
                seen.append(leaf)
                rows_seen += held.get(leaf, 0)
            out.append(seen)
        return out
    asks = located.where("asks").drop("leaf")
    asks = staged(led(asks, visits, "visits").select("row", "id", "nameless", "v", F.explode("visits").alias("leaf")), "asks")
    asked = asks.groupBy("leaf").agg(F.count("*")).collect()
    counts = block_counts([(leaf, held[leaf], queries) for leaf, queries in asked if leaf in held], how)
    found = met(located, asks, spark.createDataFrame(counts, "leaf int, inner int, outer int"), kind, width, how)
    names = located.where("asks").select(F.col("row").alias("q"), F.when(~F.col("nameless"), F.col("id")).alias("query_id"))
    return found.join(names, "q").select("query_id", "rank", F.when(~F.col("nameless"), F.col("id")).alias("vec_id"), "score")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows.select("vec_id", F.col("embedding").alias("values"), (F.col("vec_id") % 100 == 0).alias("asks")))
