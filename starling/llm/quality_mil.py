"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; only the bag has a label.  Every passage is encoded
by a learned layer over its features: pairs of character classes, hashed words, and a few shares
(distinct words, lengths).  Gated attention weighs the passages, ``a_i ~ exp(w . (tanh(V h_i) *
sigmoid(U h_i)))``, and the weighted passage representation is scored by a logistic unit.

Training reads a bounded sample of the input's labelled documents: ``Training.documents`` of them,
the smallest hashes of the id, with ``Training.passages`` evenly spread passages each.  Features of the sample
are computed in the tasks; the driver fits the weights.  Scoring reads every passage of every
document, features a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import crc_mod, placed, shipped, staged, text_of, without

PASSAGE_WORDS = 64
HASHED = 256
BLOCK = 1024
THRESHOLD = 0.7
# Punctuation by kind, each a character class of its own.
MARKS = [".,", ";:!?", "'\"()[]-", "#*$%&", "|<>{}\\/=_"]
KINDS = 6 + len(MARKS)
SHARES = 5
WIDTH = KINDS * KINDS + HASHED + SHARES


@dataclass(frozen=True)
class Training:
    documents: int = 4096
    passages: int = 24
    hidden: int = 32
    gate: int = 16
    epochs: int = 14
    steps: int = 400
    batch: int = 64
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 7


# ---- features -------------------------------------------------------------------------------


def _kinds() -> np.ndarray:
    """Class of each code point of the basic plane; all others are class 5."""
    table = np.full(0x10000, 5, np.uint8)
    for point in range(0x10000):
        c = chr(point)
        table[point] = 0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isalpha() else 5
    for kind, marks in enumerate(MARKS):
        table[[ord(c) for c in marks]] = 6 + kind
    return table


_STATE: dict = {}


def _table() -> np.ndarray:
    if "kinds" not in _STATE:
        _STATE["kinds"] = _kinds()
    return _STATE["kinds"]


def passages_of(text: str) -> list[list[str]]:
    """Words in runs of a passage's length; an empty text is one empty passage."""
    words = text.split()
    return [words[i:i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]


def features(passages: list[list[str]]) -> np.ndarray:
    """One row per passage."""
    import zlib
    n = len(passages)
    out = np.zeros((n, WIDTH), np.float32)
    joined = [" ".join(words) + "\n" for words in passages]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(points < 0x10000, _table()[np.minimum(points, 0xFFFF)], 5).astype(np.int64)
    sizes = np.array([len(s) for s in joined], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    pair = owner[:-1] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:]
    pair = pair[owner[:-1] == owner[1:]]
    grid = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, :KINDS * KINDS] = np.sqrt(grid / np.maximum(1, sizes - 1)[:, None])
    known = _STATE.setdefault("words", {})
    if len(known) > 300_000:
        known.clear()
    hashes, counts = [], np.array([len(words) for words in passages], np.int64)
    for words in passages:
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED
            hashes.append(value)
    if hashes:
        grid = np.bincount(np.repeat(np.arange(n), counts) * HASHED + np.array(hashes, np.int64), minlength=n * HASHED).reshape(n, -1)
        out[:, KINDS * KINDS:-SHARES] = np.sqrt(grid / np.maximum(1, counts)[:, None])
    distinct = np.array([len(set(words)) for words in passages])
    some = np.maximum(1, counts)
    out[:, -5] = distinct / some
    out[:, -4] = np.log1p(counts)
    out[:, -3] = np.log1p((sizes - 1) / some)
    out[:, -2] = counts == 0
    out[:, -1] = np.array([sum(a == b for a, b in zip(words, words[1:])) for words in passages]) / some
    return out


# ---- the model ------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights; ``prior`` alone where the labels hold one class or none."""
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    prior: float | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representations and attention logits of passages."""
        h = np.tanh(((x - self.mean) / self.scale) @ self.w["E"] + self.w["e"])
        gated = np.tanh(h @ self.w["V"]) / (1 + np.exp(-(h @ self.w["U"])))
        return h, gated @ self.w["a"]

    def score(self, h: np.ndarray, s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention weight of each passage."""
        sizes = np.diff(np.append(starts, len(s)))
        weight = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return 1 / (1 + np.exp(-(z @ self.w["u"] + self.w["c"]))), weight


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, how: Training = Training()) -> Model:
    """Adam on the bags' log loss; ``starts`` are the first passages of the bags.

    Few bags are gone through more often, so that there are at least ``how.steps`` steps.
    """
    mean, scale = x.mean(0), x.std(0) + 0.05
    if len(set(y.tolist())) < 2:
        return Model(mean, scale, {}, float(y[0]) if len(y) else 0.5)
    draw = np.random.default_rng(how.seed)
    def init(*shape):
        return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"E": init(x.shape[1], how.hidden), "e": np.zeros(how.hidden, np.float32), "V": init(how.hidden, how.gate), "U": init(how.hidden, how.gate),
         "a": init(how.gate), "u": init(how.hidden), "c": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    model, step = Model(mean, scale, w), 0
    ends = np.append(starts[1:], len(x))
    epochs = max(how.epochs, -(-how.steps // -(-len(y) // how.batch)))
    for epoch in range(epochs):
        rate = how.rate * (1 - epoch / epochs)
        order = draw.permutation(len(y))
        for at in range(0, len(order), how.batch):
            bags = order[at:at + how.batch]
            sizes = ends[bags] - starts[bags]
            rows = np.concatenate([np.arange(starts[b], ends[b]) for b in bags])
            begin = np.cumsum(sizes) - sizes
            xs = (x[rows] - mean) / scale
            h = np.tanh(xs @ w["E"] + w["e"])
            t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
            p, weight = model.score(h, (t * g) @ w["a"], begin)
            z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
            error = ((p - y[bags]) / len(bags)).astype(np.float32)
            dz = np.repeat(error[:, None] * w["u"], sizes, axis=0)
            da = (dz * h).sum(1)
            ds = weight * (da - np.repeat(np.add.reduceat(weight * da, begin), sizes))
            dgate = ds[:, None] * w["a"]
            dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
            dh = weight[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T
            pre = dh * (1 - h * h)
            grads = {"E": xs.T @ pre, "e": pre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "u": z.T @ error, "c": error.sum(keepdims=True)}
            step += 1
            for k, grad in grads.items():
                grad = grad + how.decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


# ---- the job --------------------------------------------------------------------------------


def held_out(column: str = "doc_id"):
    return crc_mod(column, 4) == 2


def sampled(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """``doc_id``, ``quality`` and ``text`` of at most ``how.documents`` labelled documents that are not held out.

    Only labels of ids among ``docs`` take up places.  Labels of null are no labels; of several labels
    for an id the smallest counts.  Equal texts of an id are one; of different ones each counts, the
    first of every id before the others.
    """
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.documents))
    named = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(staged(sample, "labelled")), "doc_id").select(
        "doc_id", "quality", "text", F.xxhash64("text").alias("h"))
    keys = staged(named.select("doc_id", "h").distinct(), "keys")
    first = keys.groupBy("doc_id").agg(F.min("h").alias("h")).withColumn("later", F.lit(0))
    chosen = (keys.join(F.broadcast(first), ["doc_id", "h"], "left")
              .orderBy(F.coalesce("later", F.lit(1)), F.xxhash64("doc_id", "h"), "doc_id", "h").limit(how.documents).select("doc_id", "h"))
    return named.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model of the labelled documents that ``sampled`` gives."""
    rows = sampled(docs, labels, how)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                blobs = []
                for text in part.column("text").to_pylist():
                    bag = passages_of(text)
                    picked = sorted({i * len(bag) // how.passages for i in range(how.passages)}) if len(bag) > how.passages else range(len(bag))
                    blobs.append(features([bag[i] for i in picked]).astype("<f2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("quality").cast(pa.int32()), pa.array(blobs, pa.binary())],
                                                 names=["doc_id", "quality", "bag"])

    found = shipped(rows).mapInArrow(measured, "doc_id string, quality int, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["bag"]))
    bags = [np.frombuffer(r["bag"], "<f2").reshape(-1, WIDTH) for r in found]
    sizes = np.array([len(b) for b in bags], np.int64)
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    if not len(x):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, 0.5)
    return fit(x, np.cumsum(sizes) - sizes, np.array([float(r["quality"] > 0) for r in found], np.float32), how)


def scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """``doc_id``, ``score``, ``n_passages`` and the largest attention weight of every whole text.

    Null text counts as empty, one empty passage.  Repeated rows and null ids are scored row by
    row; an empty table gives an empty result.  Columns of ``more`` are passed on.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                bags, starts, hs, ss, total = [], [], [], [], 0
                def flush():
                    if bags and fitted.prior is None:
                        h, s = fitted.encode(features(bags))
                        hs.append(h)
                        ss.append(s)
                    bags.clear()
                for text in part.column("text").to_pylist():
                    starts.append(total)
                    for passage in passages_of(text):
                        bags.append(passage)
                        total += 1
                        if len(bags) >= BLOCK:
                            flush()
                flush()
                sizes = np.diff(np.append(starts, total))
                if fitted.prior is None:
                    p, weight = fitted.score(np.concatenate(hs), np.concatenate(ss), np.array(starts))
                    top = np.maximum.reduceat(weight, np.array(starts))
                else:
                    p, top = np.full(len(starts), fitted.prior), 1 / sizes
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", *more)] + [pa.array(p, pa.float64()), pa.array(sizes, pa.int64()), pa.array(top, pa.float64())],
                                                 names=["doc_id", *more, "score", "n_passages", "top_attention"])

    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in ("doc_id", *more)]
    schema = ", ".join(f"{c} {k}" for c, k in kinds) + ", score double, n_passages long, top_attention double"
    return shipped(docs.select("doc_id", *more, text_of().alias("text"))).mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows whose score reaches the threshold, with all their columns.

    Where the input's labels hold one class or none nothing can be learned, and every row is kept.
    """
    model = train(docs, labels)
    if model.prior is not None:
        return docs
    rows, key = placed(docs)
    return without(rows, scored(rows, model, key).where(F.col("score") < threshold).select(key), key)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_attention")
