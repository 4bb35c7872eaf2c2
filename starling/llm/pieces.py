"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are split into words at spaces (no piece of the vocabulary reaches across the start of a run
of spaces; the model is checked for that).  All words not met before are merged together: flat
arrays hold the symbols and their words; each round looks up the rank of every adjacent pair, takes
the smallest per word by a segmented minimum, and merges all its occurrences at once, leftmost
first, dropping the absorbed symbols.  Words without a mergeable pair leave the arrays, until none
is left.

The library merges one pair at a time, the best first, the leftmost among equals.  Merging all
occurrences of a rank at once is the same unless a merge creates a pair that ranks no worse; pieces
for which the vocabulary allows that are marked, and of these only the leftmost is merged in a
round.  Words that are not done after many such rounds are finished by a heap, pair by pair.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm import tokenizers_public
from starling.llm.common import shipped, text_of

MODEL = "piece_bpe_32k.model"
SPACE_MARK = "▁"
NEVER = np.iinfo(np.int64).max
ROUNDS = 256
CACHE_WORDS = 300_000
BATCH_CHARS = 2_000_000


class Pieces:
    """The vocabulary as arrays: symbols of characters, pair table, bytes of every id."""

    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        plain = {name: i for i, name in enumerate(self.names)
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in plain):
            raise ValueError("a piece reaches across words; this encoder splits at spaces")
        self.symbol_of = np.arange(size, size + 0x110000, dtype=np.int64)
        for name, i in plain.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = i
        ordered = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in plain.values()}))}
        rank = {name: ordered[-sp.get_score(i)] for name, i in plain.items()}
        self.base = size + 0x110000
        def symbol(part):
            return int(self.symbol_of[ord(part)]) if len(part) == 1 else plain.get(part)
        table, eager = {}, set()
        for name in plain:
            for cut in range(1, len(name)):
                left, right = name[:cut], name[cut:]
                eager.update(part for part in (left, right) if len(part) > 1 and rank.get(part, -1) >= rank[name])
                a, b = symbol(left), symbol(right)
                if a is not None and b is not None:
                    table[a * self.base + b] = (rank[name], plain[name])
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.ranks, self.merged = np.array([table[k] for k in self.keys.tolist()], dtype=np.int64).T.copy()
        self.table = table
        self.one_by_one = np.zeros(size, bool)
        self.one_by_one[[plain[name] for name in eager]] = True
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        inner = {c for name in plain if len(name) > 1 for c in name}
        self.words = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n|[^{SPACE_MARK}\n]+" if "\n" not in inner else f"{SPACE_MARK}+[^{SPACE_MARK}]*")
        shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(name[3:5], 16)]) if sp.is_byte(i)
                 else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(self.names)]
        self.bytes_flat = np.frombuffer(b"".join(shown), np.uint8)
        self.bytes_len = np.array([len(b) for b in shown], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.seen: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the store of encoded words."""
        self.seen.clear()
        self.store, self.store_at, self.store_len, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words; ``word`` ascends."""
        done_symbols, done_words = [], []
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            at = np.full(len(symbols), -1, np.int64)
            at[:-1] = np.where(word[:-1] == word[1:], self.lookup(symbols[:-1], symbols[1:]), -1)
            rank = np.where(at >= 0, self.ranks[at], NEVER)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best != NEVER
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, at, rank, best = (a[open_] for a in (symbols, word, at, rank, best))
                if not len(symbols):
                    break
            place = np.arange(len(symbols))
            hit = rank == best
            # Overlapping occurrences follow one another: every other one from the left of a run.
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
            hit &= (place - run) % 2 == 0
            chosen = np.flatnonzero(hit)
            first = np.concatenate(([True], word[chosen][1:] != word[chosen][:-1]))
            chosen = chosen[first | ~self.one_by_one[self.merged[at[chosen]]]]
            symbols = symbols.copy()
            symbols[chosen] = self.merged[at[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        for w in np.unique(word).tolist() if len(symbols) else []:
            rest = self.finish(symbols[word == w].tolist())
            done_symbols.append(np.array(rest, np.int64))
            done_words.append(np.full(len(rest), w, np.int64))
        if not done_symbols:
            return symbols, word
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_symbols)[order], all_words[order]

    def finish(self, symbols: list[int]) -> list[int]:
        """Pair by pair, the best first, the leftmost among equals."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        alive, heap = [True] * len(symbols), []

        def offer(i):
            if 0 <= i and after[i] < len(symbols):
                found = self.table.get(symbols[i] * self.base + symbols[after[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]], found[1]))
        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = piece, False, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s, live in zip(symbols, alive) if live]

    def learn(self, words: list[str]) -> None:
        """Encodes words and adds them to the store."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols, word = self.merge(self.symbol_of[points], np.repeat(np.arange(len(words)), lengths))
        unknown = np.flatnonzero(symbols >= self.size)
        if len(unknown):  # characters without a piece fall back to their bytes
            spelled = [self.byte_ids[list(chr(p - self.size).encode())] for p in symbols[unknown].tolist()]
            width = np.ones(len(symbols), np.int64)
            width[unknown] = [len(s) for s in spelled]
            word, begin = np.repeat(word, width), np.cumsum(width) - width
            symbols = np.repeat(symbols, width)
            spots = np.concatenate([np.arange(b, b + len(s)) for b, s in zip(begin[unknown].tolist(), spelled)])
            symbols[spots] = np.concatenate(spelled)
        sizes = np.bincount(word, minlength=len(words))
        known, used = len(self.seen), self.filled
        while used + len(symbols) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while known + len(words) > len(self.store_at):
            self.store_at, self.store_len = (np.concatenate((a, np.zeros_like(a))) for a in (self.store_at, self.store_len))
        self.store[used:used + len(symbols)] = symbols
        self.store_at[known:known + len(words)] = used + np.cumsum(sizes) - sizes
        self.store_len[known:known + len(words)] = sizes
        self.filled = used + len(symbols)
        self.seen.update(zip(words, range(known, known + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text in them."""
        words, counts = [], []
        for text in texts:
            found = self.words.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []
            words += found
            counts.append(len(found))
        if len(self.seen) > CACHE_WORDS:
            self.forget()
        fresh = list(dict.fromkeys(w for w in words if w not in self.seen))
        if fresh:
            self.learn(fresh)
        which = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        sizes = self.store_len[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.store_at[which] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of flat ids; the space that encoding puts in front is taken off."""
        sizes = self.bytes_len[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes_flat[np.repeat(self.bytes_at[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        at = np.concatenate(([0], ends))[bounds].tolist()
        texts = []
        for k in range(len(at) - 1):
            text = raw[at[k]:at[k + 1]].decode("utf-8", "replace")
            mark = bounds[k] < bounds[k + 1] and self.names[ids[bounds[k]]].startswith(SPACE_MARK)
            texts.append(text[1:] if mark else text)
        return texts


@functools.cache
def pieces(model_file: str) -> Pieces:
    """The vocabulary of a model file, built once per worker."""
    return Pieces(model_file)


def _slices(batch: pa.RecordBatch, size_of) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of characters or ids; a larger row stands alone."""
    begin = total = 0
    for i in range(batch.num_rows):
        size = size_of(i)
        if i > begin and total + size > BATCH_CHARS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(begin)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``ids`` of every row's whole text; a null or empty text has no ids.

    Null ids and repeated rows are encoded row by row; an empty table gives an empty result.
    """
    file = tokenizers_public.path(model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(file)
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column("text")).to_pylist()
            begin = 0
            for part in _slices(batch, sizes.__getitem__):
                ids, bounds = vocab.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])
                begin += part.num_rows

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs.select("doc_id", text_of().alias("text"))).mapInArrow(encoded, f"doc_id {id_type}, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with ``ids`` turned into the text in ``decoded``, the other columns passed on."""
    file = tokenizers_public.path(model)
    others = [f for f in rows.schema.fields if f.name != "ids"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(file)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("ids")).to_pylist()
            for part in _slices(batch, sizes.__getitem__):
                column = part.column("ids")
                bounds = np.asarray(column.offsets, dtype=np.int64)
                texts = vocab.decode(np.asarray(column.flatten(), dtype=np.int64), bounds - bounds[0])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in others] + [pa.array(texts, pa.string())],
                                                 names=[f.name for f in others] + ["decoded"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["decoded string"])
    return shipped(rows).mapInArrow(decoded, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    rows = decode(rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"))
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
