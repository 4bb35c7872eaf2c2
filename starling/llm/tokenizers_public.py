"""The public vocabularies, opened once per Python worker."""

from __future__ import annotations

import base64
import functools

import numpy as np


def path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.cache
def byte_bpe(ranks_path: str, special: str, special_id: int):
    """Byte-level BPE with its special string matched inside texts, as its library does by default."""
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})


@functools.cache
def library(file_path: str):
    """A tokenizer file as its library reads it."""
    import os

    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(file_path)


class WordRanks:
    """A word-end BPE as byte pair ranks, for words of letters.

    A byte that ends no UTF-8 letter marks the end of a word; the last byte with its mark is a
    token of lower rank than every merge, so it is joined first, as the vocabulary starts.  Ranks
    and merges agree step by step where the merges rebuild every token from its own bytes, which
    the tests check for the file in use.
    """
    MARK = "\0"

    def __init__(self, file_path: str):
        import json

        import tiktoken
        with open(file_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end = model["end_of_word_suffix"]
        merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        byte = _byte_of_character()
        singles = {c for c in byte} | {c + end for c in byte}
        ranks = {}
        for token, rank in model["vocab"].items():
            if token in merged or token in singles:
                body, closed = (token[:-len(end)], b"\0") if token.endswith(end) else (token, b"")
                ranks[bytes(byte[c] for c in body) + closed] = rank
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[rank for token, rank in ranks.items() if len(token) > 1 and token.endswith(b"\0")]] = True
        self.encoding = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each word."""
        if not words:
            return []
        ids = np.array(self.encoding.encode_ordinary(self.MARK.join(words) + self.MARK))
        raw = ids.astype("<u2").tobytes()
        cuts = [0, *(2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _byte_of_character() -> dict[str, int]:
    """The bytes behind the characters of byte-level vocabularies: visible ones stand for themselves, the others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def word_ranks(file_path: str) -> WordRanks:
    return WordRanks(file_path)
