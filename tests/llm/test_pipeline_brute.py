"""The stages of the pipeline against plain Python versions on a small fixture."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from starling.llm import quality_mil as mil, quality_rules as rules
from tests.llm.test_dedup import brute
from tests.llm.test_rules_and_models import base

PATH = "/root/testdata/sf0.001"
LIMITS = rules.Rules()


def class_counts(flat):
    kinds = [str.islower, str.isupper, str.isnumeric]
    out = [0] * 6
    for c in flat:
        if c in ".,;:!?":
            out[3] += 1
        elif c in "#*$%&|<>":
            out[4] += 1
        else:
            out[next((i for i, kind in enumerate(kinds) if kind(c)), 5)] += 1
    return out


def js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += ((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)) / 2
    return math.sqrt(max(0.0, total))


def shares(counts):
    return [c / max(1, sum(counts)) for c in counts]


def kept_by_rules(docs):
    """doc_id to verdict, of (doc_id, text, lang)."""
    vocab = rules.vocabulary()
    rows, sums = {}, {}
    for i, text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        common = [words.count(w) for w in vocab]
        row = rows[i] = (lang, base(text), class_counts("".join(words)), common + [len(words) - sum(common)])
        if not row[1][5] and lang in rules.COMMON:
            old = sums.setdefault(lang, ([0] * 6, [0] * (len(vocab) + 1)))
            sums[lang] = tuple([a + b for a, b in zip(x, y)] for x, y in zip(old, row[2:]))
    known = {lang: tuple(shares(part) for part in both) for lang, both in sums.items()}
    bare = min(js([0] * len(vocab) + [1], ref[1]) for ref in known.values())
    most = max(ref[1][-1] for ref in known.values())
    out = {}
    for i, (lang, (n, chars, *_, failed), kinds, common) in rows.items():
        far_chars = chars >= 200 and min(js(shares(kinds), ref[0]) for ref in known.values()) > 0.3
        d = min(js(shares(common), ref[1]) for ref in known.values())
        lacks = (lang is None or lang in known) and common[-1] > most * n and d > LIMITS.max_bare_share * bare
        out[i] = not failed and not far_chars and not (n >= 60 and (d > 0.37 or lacks))
    return out


def plain_scores(docs, labels):
    """Scores of (doc_id, text); every label is in the sample."""
    def bag(text):
        return mil.features(mil.passages_of(text or ""))
    train = []
    for i, t in docs:
        if i in labels and zlib.crc32(str(i).encode()) % 4 != 2:
            x, n = bag(t), mil.Training().passages
            x = x[sorted({k * len(x) // n for k in range(n)})] if len(x) > n else x
            train.append((str(i), x.astype("<f2").tobytes(), float(labels[i] > 0)))
    train.sort()
    bags = [np.frombuffer(b, "<f2").reshape(-1, mil.WIDTH).astype(np.float32) for _, b, _ in train]
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    model = mil.fit(np.concatenate(bags), starts, np.array([y for *_, y in train], np.float32))
    return {i: model.score(*model.encode(bag(t)), np.array([0]))[0][0] for i, t in docs}


@pytest.fixture(scope="module")
def fixture(spark):
    """Given documents with invented-word junk, copies and near copies; ids of the clean ones."""
    draw = random.Random(8)
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    rows = [r.asDict() for r in docs.collect()]
    clean = [r for r in rows if labels.get(r["doc_id"]) == 1 and len(r["text"].split()) >= 60]
    more = []
    for k, r in enumerate(clean[:12]):
        words = r["text"].split(" ")
        words[len(words) // 2] = "changed"
        more += [r | {"doc_id": 5_000_000 + k}, r | {"doc_id": 6_000_000 + k, "text": " ".join(words)}]
    for k in range(6):
        text = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(5, 9))) for _ in range(150 + 50 * k))
        more.append(rows[0] | {"doc_id": 7_000_000 + k, "text": text, "lang": "en"})
    return spark.createDataFrame(rows + more, docs.schema).repartition(5), {r["doc_id"] for r in clean}, labels


def test_stages_match_plain_python(spark, fixture):
    docs, clean, labels = fixture
    stages = dict(corpus_pipeline.STAGES)

    def run(name, table):
        out = corpus_pipeline.staged(stages[name](spark, table, PATH), "brute")
        return out, {r["doc_id"]: r["text"] for r in out.collect()}
    want = kept_by_rules([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()])
    assert {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()} == want
    docs, now = run("quality rules", docs)
    assert set(now) == {i for i, kept in want.items() if kept}
    assert not any(7_000_000 <= i < 8_000_000 for i in now) and len(clean & set(now)) >= 0.95 * len(clean)
    scores = plain_scores(list(now.items()), labels)
    docs, then = run("quality classifier", docs)
    sure = {i: s for i, s in scores.items() if abs(s - mil.THRESHOLD) > 1e-3}
    assert {i for i in then if i in sure} == {i for i, s in sure.items() if s >= mil.THRESHOLD}
    assert len(clean & set(then)) >= 0.9 * len(clean)
    docs, now = run("exact dedup", docs)
    first = {}
    for i in sorted(then):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", then[i]), i)
    assert set(now) == set(first.values())
    docs, then = run("near dedup", docs)
    ids = sorted(now)
    roots = brute([now[i] for i in ids])
    assert set(then) == {i for k, i in enumerate(ids) if roots[k] == k}
    assert not any(6_000_000 <= i < 7_000_000 for i in then)
