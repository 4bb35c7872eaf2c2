"""Language-model scores by a hidden Markov model over the words of a text.

Every token is a word or the end of the text.  A hidden state emits a word class, the class emits
the word: the most frequent words are classes of their own, every other word belongs to a class by
its last bytes, inside which it has its add-one share of the training tokens, one share standing
for all words not seen.  So the latent part has a fixed size while the vocabulary grows with the
corpus and is joined by word.

Training is Baum-Welch over all training documents: in each round every task runs the scaled
forward-backward recursion over its sequences and emits expected counts, which are summed across
partitions; the driver normalises the bounded tables.  Sequences are trained on in runs of at most
1024 tokens, so memory is bounded for any text; every token of every run counts.  Scoring is exact:
the scaled forward recursion over the whole text, whatever its length.

Word counts cover all training documents.  The most frequent ``TOP`` words travel to every task,
the others are joined by word; no other word is frequent, so no key of that join is hot.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import crc_mod, shipped, staged, text_of

TOP = 100_000
FLUSH = 200_000
SLICE = 32_768


@dataclass(frozen=True)
class Shape:
    states: int = 8
    own: int = 2000
    tails: int = 1024
    tail_bytes: int = 3
    rounds: int = 8
    run: int = 1024
    side: int = 500_000  # tokens of the runs that are trained on side by side
    seed: int = 11


SHAPE = Shape()


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes, shape: Shape = SHAPE) -> int:
    return zlib.crc32(word[-shape.tail_bytes:]) % shape.tails


class Endings(dict):
    """Classes by last bytes, each worked out once; forgotten when they become many."""

    def __init__(self, shape: Shape = SHAPE):
        super().__init__()
        self.shape = shape

    def __missing__(self, last: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        found = self[last] = tail_class(last, self.shape)
        return found


# ---- the latent part ------------------------------------------------------------------------


@dataclass
class Latent:
    """Start, transition (from, to) and emission (class, state) probabilities."""
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def layered(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order from long to short, the symbols of each step, and how many sequences reach it."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    begin = np.cumsum(lengths[order]) - lengths[order]
    alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    return order, [flat[begin[:n] + t] for t, n in enumerate(alive)], alive


def log10_likelihood(sequences: list[np.ndarray], model: Latent) -> np.ndarray:
    """Exact log10 probability of each class sequence, by the scaled forward recursion."""
    order, steps, _ = layered(sequences)
    total = np.zeros(len(sequences))
    ones = np.ones((len(model.start),) * 2)  # a product with it puts a row's sum into every column
    for t, symbols in enumerate(steps):
        now = model.emit.take(symbols, axis=0)
        now *= alpha[:len(symbols)] @ model.move if t else model.start
        scale = now @ ones
        now /= scale
        alpha = now
        total[:len(symbols)] += np.log10(scale[:, 0])
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected(sequences: list[np.ndarray], model: Latent, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    """Adds the expected counts of the sequences, by forward and backward recursion.

    Recursions run in single precision, which scaling keeps in range; counts are summed in double.
    """
    _, steps, alive = layered(sequences)
    if not steps:
        return
    k = emit.shape[1]
    begin, chances, moves = (x.astype(np.float32) for x in (model.start, model.emit, model.move))
    back, ones = np.ascontiguousarray(moves.T), np.ones((k, k), np.float32)
    at = np.concatenate(([0], np.cumsum(alive))).tolist()
    symbols = np.concatenate(steps)
    alphas = chances.take(symbols, axis=0)
    scales = np.empty_like(alphas)
    for t in range(len(steps)):
        now, scale = alphas[at[t]:at[t + 1]], scales[at[t]:at[t + 1]]
        now *= before[:len(now)] @ moves if t else begin
        np.matmul(now, ones, out=scale)
        now /= scale
        before = now
    joint, beta = np.zeros((k, k)), np.ones((0, k), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        n = at[t + 1] - at[t]
        if len(beta) < n:  # sequences that end here
            beta = np.concatenate((beta, np.ones((n - len(beta), k), np.float32)))
        if t:
            ahead = chances.take(steps[t], axis=0)
            ahead *= beta
            ahead /= scales[at[t]:at[t + 1]]
            joint += alphas[at[t - 1]:at[t - 1] + n].T @ ahead
        alphas[at[t]:at[t + 1]] *= beta  # now the expected states
        if t:
            beta = ahead @ back
    move += model.move * joint
    start += alphas[:at[1]].sum(0, dtype=float)
    columns = np.arange(k)
    for low in range(0, len(alphas), SLICE):
        part = alphas[low:low + SLICE]
        cells = (symbols[low:low + SLICE, None] * k + columns).ravel()
        emit += np.bincount(cells, weights=part.ravel(), minlength=emit.size).reshape(emit.shape)


def initial(shares: np.ndarray, shape: Shape = SHAPE) -> Latent:
    """States that stay, and emit the corpus shares of the classes each with its own bias."""
    draw = np.random.default_rng(shape.seed)
    k = shape.states
    emit = shares[:, None] * np.exp(draw.standard_normal((len(shares), k)))
    move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    return Latent(np.full(k, 1 / k), move, emit / emit.sum(0))


def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Latent:
    """Probabilities of expected counts; no class becomes impossible in a state."""
    start, move = start + 0.1, move + 0.1
    emit = emit + 0.5 * shares[:, None] * len(shares) / emit.shape[1] + 1e-3
    return Latent(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


# ---- counts ---------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``tail`` (its class by the last bytes), ``c`` over all rows of ``text``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        endings, last = Endings(), -SHAPE.tail_bytes
        def out():
            words = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([endings[w[last:]] for w in words], pa.int32()),
                                                pa.array(list(counts.values()), pa.int64())], names=["word", "tail", "c"])
            counts.clear()
            return batch
        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield out()
        yield out()
    rows = shipped(docs.select(text_of().alias("text"))).mapInArrow(counted, "word binary, tail int, c long")
    return rows.groupBy("word", "tail").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows: totals, the frequent words' counts, which have classes of their own, and the tails' totals."""
    tokens: int
    types: int
    ends: int
    frequent: dict[bytes, int]
    own: dict[bytes, int]
    tail_sums: np.ndarray
    floor: int  # words with a smaller count are not in ``frequent``


def vocabulary(counts: DataFrame, ends: int, shape: Shape = SHAPE, top: int = TOP) -> Vocabulary:
    """Bounded tables of staged word counts: at most ``top`` words, one total per tail class."""
    # Counts rounded down to three leading bits: a bounded histogram finds the smallest floor for which no more than ``top`` words remain.
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.col("c"))) - 2).cast("int")
    steps = counts.withColumn("b", bits).groupBy(F.expr("shiftright(c, b) * pow(2, b)").cast("long").alias("step"))
    floor, many = 1 << 62, 0
    for r in sorted(steps.agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        many += r["n"]
        if many > top:
            break
        floor = r["step"]
    frequent = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= floor).select("word", "c").collect()}
    ranked = sorted(frequent.items(), key=lambda item: (-item[1], item[0]))[:shape.own]
    own = {word: i for i, (word, _) in enumerate(ranked)}
    sums = np.zeros((shape.tails, 2), np.int64)
    total = types = 0
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sums[r["tail"]] = r["c"], r["v"]
        total, types = total + r["c"], types + r["v"]
    for word in own:
        sums[tail_class(word, shape)] -= frequent[word], 1
    return Vocabulary(total + ends, types + bool(ends), ends, frequent, own, sums, floor)


# ---- the job --------------------------------------------------------------------------------


def encoded(rows: DataFrame, vocab, shape: Shape = SHAPE) -> DataFrame:
    """Class sequences and what the frequent words add, with the rarer words of each text left to join."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        whole = math.log10(v.tokens + v.types + 1)
        inside = np.log10(v.tail_sums.sum(1) + 1)
        known = {}
        for word, c in v.frequent.items():
            at = v.own.get(word)
            tail = tail_class(word, shape)
            known[word] = (at if at is not None else shape.own + tail, math.log10(c + 1) - whole, 0.0 if at is not None else math.log10(c + 1) - float(inside[tail]))
        symbol = np.array([k[0] for k in known.values()] + [0], np.int64)
        values = np.array([k[1:] for k in known.values()] + [(0.0, 0.0)])
        place = {word: i for i, word in enumerate(known)}
        end = math.log10(v.ends + 1) - whole
        endings = Endings(shape)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sums, seqs, rare, times, tails, ends = [], [], [], [], [], [0]
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    at = np.array([place.get(w, -1) for w in words], np.int64)
                    seq = symbol[at]
                    missing = np.flatnonzero(at < 0)
                    others = Counter()
                    if len(missing):
                        others.update(words[i] for i in missing.tolist())
                        classes = {w: endings[w[-shape.tail_bytes:]] for w in others}
                        seq[missing] = [shape.own + classes[words[i]] for i in missing.tolist()]
                        rare += others
                        times += others.values()
                        tails += [classes[w] for w in others]
                    ends.append(len(rare))
                    base, within = values[at[at >= 0]].sum(0)
                    sums.append((len(words) + 1, int((at >= 0).sum()) + (v.ends > 0), base + end, within))
                    seqs.append(np.append(seq, shape.own + shape.tails).astype("<u2").tobytes())
                n, hit, base, within = zip(*sums) if sums else ((),) * 4
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, k)) for x, k in ((rare, pa.binary()), (times, pa.int64()), (tails, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row_id", "doc_id", "held_out")] + [
                    pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.array(seqs, pa.binary()), *lists],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "hit", "base", "within", "seq", "rare", "times", "tails"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return shipped(rows.select("row_id", "doc_id", "held_out", "text")).mapInArrow(
        encode, f"row_id long, doc_id {id_type}, held_out boolean, n_tokens long, hit long, base double, within double, seq binary, "
                "rare array<binary>, times array<long>, tails array<int>")


def baum_welch(sequences: DataFrame, shares: np.ndarray, shape: Shape = SHAPE) -> Latent:
    """The latent part fitted to every row of ``seq``."""
    model = initial(shares, shape)
    classes, k = len(shares), shape.states
    for _ in range(shape.rounds):
        shared = sequences.sparkSession.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
            first, later = [], []  # runs that begin a sequence, and the others
            held = {True: 0, False: 0}
            def take(runs, begins):
                expected(runs, shared.value, start if begins else np.zeros(k), move, emit)
                runs.clear()
                held[begins] = 0
            for batch in batches:
                for seq in batch.column("seq"):
                    seq = np.frombuffer(seq.as_py(), "<u2").astype(np.int64)
                    for at in range(0, len(seq), shape.run):
                        runs = later if at else first
                        runs.append(seq[at:at + shape.run])
                        held[not at] += len(runs[-1])
                        if held[not at] >= shape.side:
                            take(runs, not at)
            take(first, True)
            take(later, False)
            table = np.concatenate((emit, move, start[None]))
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(table[used].ravel()), k).cast(pa.list_(pa.float64()))],
                                             names=["at", "counts"])

        rows = shipped(sequences.select("seq")).mapInArrow(counted, "at int, counts array<double>")
        summed = rows.groupBy("at").agg(*[F.sum(F.col("counts")[i]).alias(f"s{i}") for i in range(k)]).collect()
        table = np.zeros((classes + k + 1, k))
        for r in summed:
            table[r["at"]] = [r[f"s{i}"] for i in range(k)]
        model = normalised(table[-1], table[classes:-1], table[:classes], shares)
    return model


def lm_scores(docs: DataFrame, shape: Shape = SHAPE, top: int = TOP) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Null text counts as empty, its only token the end.  Repeated rows and null ids are scored row
    by row.  Without training documents every word is unknown and the model is its start.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), text_of().alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = staged(word_counts(training), "words")
    v = vocabulary(counts, training.count(), shape, top)
    table = staged(encoded(rows, spark.sparkContext.broadcast(v), shape), "sequences", "zstd")
    shares = np.zeros(shape.own + shape.tails + 1)
    for word, at in v.own.items():
        shares[at] = v.frequent[word]
    shares[shape.own:-1] = v.tail_sums[:, 0]
    shares[-1] = v.ends
    shares = (shares + 0.1) / (shares + 0.1).sum()
    model = spark.sparkContext.broadcast(baum_welch(table.where(~F.col("held_out")), shares, shape))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log10_likelihood([np.frombuffer(s.as_py(), "<u2").astype(np.int64) for s in batch.column("seq")], model.value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found, pa.float64())], names=[*names, "latent"])

    names = ["row_id", "doc_id", "held_out", "n_tokens", "hit", "base", "within"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in names)
    scored = shipped(table.select(*names, "seq")).mapInArrow(forward, f"{kinds}, latent double")
    inside = [float(x) for x in np.log10(v.tail_sums.sum(1) + 1)]
    words = table.select("row_id", F.explode(F.arrays_zip("rare", "times", "tails")).alias("w")).select(
        "row_id", F.col("w.rare").alias("word"), F.col("w.times").alias("times"), F.col("w.tails").alias("tail"))
    rest = counts.where(F.col("c") < v.floor).select("word", "c")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    joined = words.join(rest, "word", "left").groupBy("row_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (log_c - F.lit(math.log10(v.tokens + v.types + 1)))).alias("more_base"),
        F.sum(F.col("times") * (log_c - F.element_at(F.array(*[F.lit(x) for x in inside]), F.col("tail") + 1))).alias("more_within"))
    zero = F.lit(0.0)
    return scored.join(joined, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hit") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("latent") + F.col("within") + F.coalesce("more_within", zero)).alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
