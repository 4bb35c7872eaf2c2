"""Token counts by overlap resynchronisation.

A text is cut into chunks that overlap.  Each chunk is encoded on its own, with the byte offset of
every token.  Inside an overlap both encodings are compared, and they are spliced at a boundary
that is proven stable: the byte before it is not white space, the byte at it is a space or a line
feed, both encodings have a token boundary there, and they agree on all tokens from there to the
margin before the earlier chunk's end.  The pre-tokenizer never matches white space after another
character, so such a place splits in any context, and what precedes it is encoded alike whatever
follows beyond the margin.  Where no such boundary is found (one long word, other scripts) the
earlier chunk is widened, twice as far each time, and compared again; at worst it is the whole
text.  So a text is held once, its encoding only a chunk at a time, and the count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starling.llm import tokenizers_public
from starling.llm.common import shipped, text_of


@dataclass(frozen=True)
class Chunks:
    size: int = 16384
    overlap: int = 512
    margin: int = 32


LAYOUT = Chunks()
FILE, RANKS, SPECIAL, SPECIAL_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>", 50256
LIMIT = 512


def _encode(encoding, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the byte offset of every token's end."""
    try:
        ids = np.asarray(encoding.encode(text, allowed_special="all"), dtype=np.int64)
    except ValueError:  # a run of white space too long for its expression engine
        ids = np.asarray(tokenizers_public.library(tokenizers_public.path(FILE)).encode(text, add_special_tokens=False).ids, dtype=np.int64)
    sizes = _sizes(encoding)[ids] if len(ids) else np.zeros(0, np.int64)
    return ids, np.cumsum(sizes)


_SIZES: dict[int, np.ndarray] = {}


def _sizes(encoding) -> np.ndarray:
    if id(encoding) not in _SIZES:
        table = np.zeros(encoding.max_token_value + 1, np.int64)
        for token in encoding.token_byte_values():
            table[encoding.encode_single_token(token)] = len(token)
        for token in encoding.special_tokens_set:
            table[encoding.encode_single_token(token)] = len(token.encode())
        _SIZES[id(encoding)] = table
    return _SIZES[id(encoding)]


def splice_point(left, right, raw: bytes, start: int, margin: int) -> tuple[int, int] | None:
    """Token counts up to a common stable boundary: in the left chunk, and in the right one.

    ``left`` and ``right`` are (ids, ends) of chunks that begin at bytes 0 and ``start`` of ``raw``,
    the left chunk's bytes; the last ``margin`` bytes of the left one are not trusted.
    """
    last = len(raw) - margin
    lo, hi = np.searchsorted(left[1], start, "right"), np.searchsorted(left[1], last, "right")
    ends = left[1][lo:hi]
    shared = ends[np.isin(ends, right[1] + start)]
    for at in shared[:8]:  # the first is nearly always right; the widened chunk offers more
        at = int(at)
        if raw[at - 1: at].isspace() or raw[at: at + 1] not in (b" ", b"\n") or raw[at - 1] >= 0x80 or not 0x20 < raw[at - 1] < 0x7F:
            continue
        i, j = int(np.searchsorted(left[1], at, "right")), int(np.searchsorted(right[1], at - start, "right"))
        n = hi - i
        if np.array_equal(left[0][i:hi], right[0][j:j + n]):
            return i, j
    return None


def encode_long(encoding, text: str, layout: Chunks = LAYOUT) -> Iterator[np.ndarray]:
    """The ids of a text, a chunk's share at a time; joined they are those of the whole text."""
    begin, end = 0, layout.size
    skip = 0  # tokens of the current chunk that the previous share already holds
    current = _encode(encoding, text[:end])
    while end < len(text):
        overlap = layout.overlap
        while True:
            start = max(begin + 1, end - overlap)
            right = _encode(encoding, text[start:start + layout.size])
            raw = text[begin:end].encode()
            at = splice_point(current, right, raw, len(text[begin:start].encode()), layout.margin)
            if at and at[0] >= skip:
                break
            # No stable boundary in common: widen the left chunk, and with it the overlap.
            grown = min(len(text), end + max(layout.size, end - begin))
            overlap = max(layout.overlap, grown - end)
            end = grown
            current = _encode(encoding, text[begin:end])
            if end == len(text):
                yield current[0][skip:]
                return
        yield current[0][skip:at[0]]
        skip, current, begin, end = at[1], right, start, min(len(text), start + layout.size)
    yield current[0][skip:]


def count(encoding, text: str, layout: Chunks = LAYOUT) -> int:
    """Tokens of the whole text."""
    return sum(len(ids) for ids in encode_long(encoding, text, layout))


def token_counts(docs: DataFrame, layout: Chunks = LAYOUT, limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null text counts as empty: no bytes, no tokens.  Null ids and repeated rows are counted row by
    row; an empty table gives an empty result.
    """
    ranks = tokenizers_public.path(RANKS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizers_public.byte_bpe(ranks, SPECIAL, SPECIAL_ID)
        for batch in batches:
            texts = batch.column("text")
            counts = [count(encoding, texts[i].as_py(), layout) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return shipped(rows).mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long").select(
        "*", (F.col("n_tokens") > limit).alias("over_limit"))


def op2(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
