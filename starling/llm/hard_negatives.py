"""Hard negatives by L2AP-style threshold joins.

Vectors are integers and a score is their inner product.  All dimensions stand in one global order,
largest energy first.  A block of rows is an inverted index: the list of a dimension holds the rows
whose remaining norm from there on, times the largest remaining norm of a query over its threshold,
can still matter; later dimensions of a row are not in the index.  Queries walk through the lists,
add up partial scores, and after every few dimensions drop the rows that even the remaining norms
cannot lift to any query's threshold.  What passes at the end gets its exact score.

Thresholds start high and are lowered for the queries whose windows have not been filled; a filled
window needs nothing below its threshold, so its result is exact, and the last threshold is the
window's lower end.  Positives are searched in the same way, with a window open to both sides.

Queries meet rows block against block: both are dealt to blocks by row number, a unit is one block
of each, and its output is at most ``k`` rows a window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import shipped, staged
from starling.llm.vectors import blocks_for, dealt, finite, first_of, packed, ranked, stacked

EXACT = 1 << 53  # up to here a double is an exact integer


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    low: int = 30        # percent of the positive's score
    high: int = 90
    rows: int = 16384    # rows of a block at most, and windows of a block
    tile: int = 256      # queries that walk through the lists together
    stride: int = 16     # dimensions between two prunings


# Shares of a window that a threshold lies below its upper end, one round after the other.
POSITIVE_STEPS = (0.2, 0.325, 0.425, 1.0)
NEGATIVE_STEPS = (0.125, 0.5, 1.0)


def tails(x: np.ndarray) -> np.ndarray:
    """Norm of what remains of each row from every dimension on; one column more than ``x``."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(x), 1))), axis=1))


def indexed(row_tails: np.ndarray, query_tails: np.ndarray, least: np.ndarray, stride: int) -> np.ndarray:
    """How many leading dimensions of each row are in the index, in multiples of ``stride``.

    The others are covered: with them alone no query reaches its threshold ``least``.
    """
    width = row_tails.shape[1] - 1
    if (least <= 0).any():
        return np.full(len(row_tails), width)
    reach = (query_tails / least[:, None]).max(0) * (1 + 1e-9)
    needed = (row_tails * reach >= 1).sum(1)
    return np.minimum(width, -(-needed // stride) * stride)


def candidates(x: np.ndarray, q: np.ndarray, least: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that some query may reach its threshold with, and a matrix of (query, such row) that says which.

    No pair with a score of at least the query's threshold is left out.
    """
    row_tails, query_tails = tails(x), tails(q)
    depth = indexed(row_tails, query_tails, least, stride)
    order = np.argsort(-depth, kind="stable")
    order = order[depth[order] > 0]
    x, row_tails, depth = x[order], row_tails[order], depth[order]
    total = np.zeros((len(q), len(order)))
    bound = np.zeros_like(total)
    for begin in range(0, x.shape[1], stride):
        listed = int((depth > begin).sum())  # the lists of these dimensions hold the first rows
        if not listed:
            break
        end = min(begin + stride, x.shape[1])
        total[:, :listed] += q[:, begin:end] @ x[:listed, begin:end].T
        rest = query_tails[:, end, None] * row_tails[None, :listed, end]
        bound[:, :listed] = total[:, :listed] + rest * (1 + 1e-9) + 1e-6
        alive = (bound >= least[:, None]).any(0)
        if alive.mean() < 0.8 or end == x.shape[1]:
            order, x, row_tails, depth, total, bound = order[alive], x[alive], row_tails[alive], depth[alive], total[:, alive], bound[:, alive]
    return order, bound >= least[:, None]


def matches(unit: pd.DataFrame, kind: str, width: int, how: Mining, k: int, same: bool) -> pd.DataFrame:
    """Per window of a unit the first ``k`` rows in [t, hi] with the label wanted, by score, then id."""
    rows, asks = unit[~unit["asks"]], unit[unit["asks"]]
    x, keys, ids, nameless, labels = stacked(rows["v"], kind, width), rows["row"].to_numpy(), rows["id"].to_numpy(), rows["nameless"].to_numpy(), rows["label"].to_numpy()
    asks = asks.sort_values(["row", "w"])
    heads = asks.drop_duplicates("row")
    q, spans = stacked(heads["v"], kind, width), asks.groupby("row", sort=True)
    least = spans["t"].min().to_numpy().astype(float)
    found = []
    windows = [g[["w", "t", "hi"]].to_numpy().tolist() for _, g in spans]
    for at in range(0, len(heads), how.tile):
        part = slice(at, at + how.tile)
        near, may = candidates(x, q[part], least[part], how.stride)
        for i, (key, label) in enumerate(zip(heads["row"].to_numpy()[part], heads["label"].to_numpy()[part])):
            place = near[may[i]]
            place = place[((labels[place] == label) == same) & (keys[place] != key)]
            score = x[place] @ q[at + i]
            for w, t, hi in windows[at + i]:
                inside = np.flatnonzero((score >= t) & (score <= hi))
                hit = place[inside]
                best = first_of(-score[inside], nameless[hit], ids[hit], keys[hit], k)
                for p, s in zip(hit[best].tolist(), score[inside][best].tolist()):
                    found.append((key, w, keys[p], ids[p], nameless[p], int(s)))
    return pd.DataFrame(found, columns=["q", "w", "row", "id", "nameless", "score"])


def filled(rows: DataFrame, asks: DataFrame, kind: str, width: int, total: int, k: int, same: bool, steps: tuple, how: Mining) -> DataFrame:
    """The first ``k`` rows of every window (``row``, ``w``, ``label``, ``v``, ``lo``, ``hi``): thresholds fall until it is filled.

    Result: ``q``, ``w``, ``rank``, ``row``, ``id``, ``nameless``, ``score``.
    """
    done = None
    inner = blocks_for(total, how.rows, 1024)
    empty = [F.lit(0).cast(t).alias(c) for c, t in (("w", "int"), ("t", "long"), ("hi", "long"))]
    for step in steps:
        asks = staged(asks.withColumn("t", F.greatest("lo", F.col("hi") - F.ceil((F.col("hi") - F.col("lo")) * step))), "asks")
        outer = max(1, -(-asks.count() // how.rows))
        one = rows.select(F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("i"), dealt("row", F.lit(inner)).alias("j"), F.lit(False).alias("asks"),
                          "row", "id", "nameless", "label", "v", *empty)
        two = asks.select(dealt("row", F.lit(outer)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("j"), F.lit(True).alias("asks"),
                          "row", F.lit(0).cast("long").alias("id"), F.lit(False).alias("nameless"), "label", "v", "w", "t", "hi")
        found = shipped(one.unionByName(two)).groupBy("i", "j").applyInPandas(
            lambda unit: matches(unit, kind, width, how, k, same), "q long, w int, row long, id long, nameless boolean, score long")
        found = staged(ranked(found, ["q", "w"], F.desc("score"), k), "found")
        full = found.groupBy("q", "w").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("q").alias("row"), "w")
        left = staged(asks.where("t > lo").join(full, ["row", "w"], "left_anti"), "left")
        closed = found.join(left.select(F.col("row").alias("q"), "w"), ["q", "w"], "left_anti")
        done = closed if done is None else done.unionByName(closed)
        if left.isEmpty():
            break
        asks = left.drop("t")
    return done


def mine(vectors: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Hard negatives of the rows that are anchors; columns ``vec_id``, ``label``, ``values``, ``anchor``.

    ``values`` are integers as doubles.  Result: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``, one group of ranks per anchor row and positive row.

    Rows with a null label, null values, or a null or non-finite component take no part.  A missing
    component of a shorter vector counts as zero, so an empty vector scores zero.  A null id comes after
    all others among equal scores; repeated rows are rows of their own, as positives, negatives and
    anchors.  Integers whose products may pass 2^53 are refused.  An empty table gives an empty result.
    """
    rows = vectors.where(F.col("label").isNotNull() & finite("values")).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("nameless"),
        F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("values").cast("array<double>").alias("values"))
    rows = staged(rows.withColumn("norm", F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    found = rows.agg(F.count("*"), F.max(F.size("values")), F.max("norm")).first()
    total, width, longest = found[0], max(1, found[1] or 0), math.ceil(found[2] or 0)
    if longest ** 2 >= EXACT:
        raise ValueError("inner products of these vectors are not exact")
    energy = dict(rows.select(F.posexplode("values").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x") ** 2)).collect())
    order = sorted(range(width), key=lambda d: (-energy.get(d, 0.0), d))
    kind = "<i2" if longest < 1 << 15 else "<f8"
    padded = F.array(*[F.coalesce(F.get("values", F.lit(d)), F.lit(0.0)) for d in order])
    rows = staged(packed(rows.withColumn("values", padded), kind, width), "packed")
    anchors = rows.where("anchor")
    open_ = anchors.select("row", F.lit(0).alias("w"), "label", "v", F.ceil(F.col("norm") * longest).alias("hi")).withColumn("lo", -F.col("hi"))
    positives = filled(rows, open_, kind, width, total, how.positives, True, POSITIVE_STEPS, how)
    positives = staged(positives.select("q", F.col("rank").alias("w"), F.col("score").alias("positive_score"), F.when(~F.col("nameless"), F.col("id")).alias("positive_id")), "positives")
    asks = anchors.select("row", "id", "label", "v").join(positives.withColumnRenamed("q", "row"), "row").select(
        "row", "w", "label", "v", F.expr(f"cast(-floor(-({how.low} * positive_score) / 100d) as long)").alias("lo"),
        F.expr(f"cast(floor({how.high} * positive_score / 100d) as long)").alias("hi")).where("lo <= hi")
    negatives = filled(rows, asks, kind, width, total, how.negatives, False, NEGATIVE_STEPS, how)
    named = positives.join(anchors.select(F.col("row").alias("q"), F.col("id").alias("anchor_id"), F.col("nameless").alias("no_anchor_id")), "q")
    return negatives.join(named, ["q", "w"]).select(
        F.when(~F.col("no_anchor_id"), F.col("anchor_id")).alias("anchor_id"), "positive_id", "rank", F.when(~F.col("nameless"), F.col("id")).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(256 * x).cast("double")))
    return mine(rows.select("vec_id", label.alias("label"), values.alias("values"), (F.col("vec_id") % 100 == 0).alias("anchor")))


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
    from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.anchor_id, positive_id, positive_score, other_id as negative_id, score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank
    from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
