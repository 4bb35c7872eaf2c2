import random
from collections import defaultdict
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from starling.llm import packing, pieces, token_counts as counts, tokenizers_public as public
from tests.llm.conftest import EDGES

PARTS = ["a", "the", " ", "  ", "\n", "'s", "'", "re", "<|endoftext|>", "<|endof", "9", "é", "!", "\t", "　", "日", "<s>", "▁", "ing", "\x00", "\x1c", "translate", "aaaa"]
text = st.lists(st.sampled_from(PARTS), max_size=120).map("".join)


@pytest.fixture(scope="module")
def library():
    return public.library(public.path(counts.FILE))


@settings(max_examples=150, deadline=None)
@given(text)
def test_spliced_counts(t):
    encoding = public.byte_bpe(public.path(counts.RANKS), counts.SPECIAL, counts.SPECIAL_ID)
    want = public.library(public.path(counts.FILE)).encode(t, add_special_tokens=False).ids
    for layout in (counts.LAYOUT, counts.Chunks(100, 50, 20), counts.Chunks(64, 40, 32)):
        assert [i for ids in counts.encode_long(encoding, t, layout) for i in ids.tolist()] == want


def test_counts_on_edges(spark, edges, nothing, library):
    got = sorted(map(tuple, counts.token_counts(edges).collect()), key=repr)
    sizes = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in EDGES]
    assert got == sorted(((i, b, n, n > 512) for i, b, n in sizes), key=repr)
    assert counts.token_counts(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=4))
def test_pieces_as_the_library(texts):
    vocab = pieces.pieces(public.path(pieces.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=public.path(pieces.MODEL))
    ids, bounds = vocab.encode(texts)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert vocab.decode(ids.astype(np.int64), bounds) == [library.decode(w) for w in want]


def test_pieces_of_long_words():
    vocab = pieces.Pieces(public.path(pieces.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=public.path(pieces.MODEL))
    draw = random.Random(1)
    for word in ("a" * 50_000, " " * 5_000, "".join(draw.choice("abcdefgh") for _ in range(9_000))):
        assert vocab.encode([word])[0].tolist() == library.encode(word)


def test_pieces_on_edges(spark, edges, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=public.path(pieces.MODEL))
    rows = pieces.encode(edges)
    got = sorted(((r["doc_id"], r["ids"]) for r in rows.collect()), key=repr)
    assert got == sorted(((i, library.encode(t or "")) for i, t, _ in EDGES), key=repr)
    back = sorted(((r["doc_id"], r["decoded"]) for r in pieces.decode(rows).collect()), key=repr)
    assert back == sorted(((i, library.decode(library.encode(t or ""))) for i, t, _ in EDGES), key=repr)
    assert pieces.decode(pieces.encode(nothing)).count() == 0


def check_plan(histogram, size):
    entries, sequences = packing.plan(histogram, size)
    inside, covered = defaultdict(list), defaultdict(set)
    for length, rank, count, places in entries:
        assert [p[0] for p in places] == [sum(q[1] for q in places[:i]) for i in range(len(places))] and sum(p[1] for p in places) == length
        for k in range(count):
            assert rank + k not in covered[length]
            covered[length].add(rank + k)
            for _, n, sequence, offset in places:
                inside[sequence + k].append((offset, n))
    assert {n: len(c) for n, c in covered.items()} == {n: c for n, c in histogram.items() if n and c}
    assert set(inside) == set(range(sequences))
    for parts in inside.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return sequences


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(1, 60)))
def test_plan_holds_every_tail_once(histogram):
    check_plan(histogram, 32)


def test_plan_pads_little():
    draw = random.Random(3)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2047, int(draw.lognormvariate(6.5, 0.7)))] += 1
    assert check_plan(histogram, 2048) * 2048 < 1.005 * sum(n * c for n, c in histogram.items())


def test_packing_on_edges(spark, edges, nothing):
    library = public.library(public.path(packing.FILE))
    rows = [r.asDict() for r in packing.pack(edges).collect()]
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in EDGES), key=repr)
    # Repeated rows have equal pieces, so documents are told apart by the sum over their pieces.
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    alone = {i: ids for i, ids in want if [j for j, _ in want].count(i) == 1}
    for i, ids in alone.items():
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048 and sum(2048 - n for n in at.values()) < 2048
    assert packing.pack(nothing).count() == 0


SPACES = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
LOOSE = st.lists(st.sampled_from(PARTS + SPACES + ["Report", "ROADS.", "Straße", "x9y,", "don't"]), max_size=60).map("".join)


@settings(max_examples=100, deadline=None)
@given(st.lists(LOOSE, min_size=1, max_size=6))
def test_packed_ids_as_the_library(texts):
    file = public.path(packing.FILE)
    words, library = packing._WORDS.setdefault(file, packing.Words(file)), public.library(file)
    want = [packing._packed(library.encode(t, add_special_tokens=False).ids + [1]) for t in texts]
    assert words.ids(texts, 1) == want and words.ids(texts, 1) == want


@pytest.mark.parametrize("few", [packing.FEW_STARTS, 0])
def test_packing_of_many_partitions(spark, tmp_path, monkeypatch, few):
    """Documents are numbered over partitions, and files written by as many tasks as read them, however many a shuffle has."""
    monkeypatch.setattr(packing, "FEW_STARTS", few)
    monkeypatch.setattr(packing, "staged", lambda df, label, *codec: _kept(df, f"{tmp_path}/{label}"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.range(0, 600, 1, 5).selectExpr("id as doc_id", "repeat('of the ', cast(id % 40 as int) * 37) as text")
        made = packing.pack(docs, 64)
        assert made.rdd.getNumPartitions() <= (5 if few else 24)
        rows = made.collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 5
    of, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append((r["start"], r["length"]))
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == r["doc_id"] % 40 * 74 + 1 and r["ids_crc32"] == zlib.crc32(r["ids"])
    for places, n in [(of[i], i % 40 * 74 + 1) for i in range(600)] + [(p, sum(k for _, k in p)) for p in inside.values()]:
        places.sort()
        assert [a for a, _ in places] == [sum(k for _, k in places[:i]) for i in range(len(places))] and sum(k for _, k in places) == n
    padding = sorted(64 - sum(k for _, k in p) for p in inside.values())
    assert set(inside) == set(range(len(inside))) and all(k < packing.MIN_FILL for k in padding[:-1])


def _kept(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_word_ranks_as_the_library():
    """The merges rebuild every token from its own bytes, so ranks give the library's ids for words of letters."""
    import json
    file = public.path(packing.FILE)
    with open(file, encoding="utf-8") as lines:
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.load(lines)["model"]["merges"]]
    order = {pair: rank for rank, pair in enumerate(merges)}
    for token in ("".join(pair) for pair in merges):
        ended = token.endswith("</w>")
        parts = list(token.removesuffix("</w>"))
        if ended:
            parts[-1] += "</w>"
        while len(parts) > 1:
            found = min(((order[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in order), default=None)
            assert found, token
            parts[found[1]:found[1] + 2] = ["".join(parts[found[1]:found[1] + 2])]
        assert parts == [token]
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEÀÉÖßñöüÿ") for _ in range(draw.randint(1, 18))) for _ in range(20_000)]
    library = public.library(file)
    want = [packing._packed(found.ids) for found in library.encode_batch(words, add_special_tokens=False)]
    assert list(packing.Words(file).encode(words)) == want
    mixed = ["don't", "x9y", "µm", "ªb", "é", "naïve", "ΑΣ", "日本", "ſ", "İx", "a\0b", "Straße", ""]
    assert list(packing.Words(file).encode(mixed)) == [packing._packed(library.encode(w, add_special_tokens=False).ids) for w in mixed]
