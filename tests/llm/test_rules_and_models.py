import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from starling.llm import chat, hmm, quality_mil as mil, quality_rules as rules, sharding
from tests.llm.conftest import EDGES, LONG, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, documents, edges, nothing):
    tricky = [(100 + k, t, "en") for k, t in enumerate(["a b " * 40, "one two three four five six seven eight " * 2, "x\nx\n \n\nx y\nx", "a " * 15 + "b " * 15,
                                                          "\ta\x0bb\x0cc\r\nd\x85e f ", " ".join(map(str, range(30))) * 2])]
    docs = documents.select("doc_id", "text", "lang").union(frame(spark, EDGES + tricky).select("doc_id", "text", "lang"))
    got = sorted((tuple(r[c] for c in ["doc_id", *BASE]) for r in rules.judge(docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *base(r["text"])) for r in docs.collect()), key=repr)
    assert rules.judge(nothing).count() == 0 and rules.keep_good(nothing).count() == 0
    assert rules.keep_good(edges).columns == edges.columns


def test_distance(spark):
    def js(p, q):
        total = 0
        for a, b in zip(p, q):
            m = (a + b) / 2
            total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
        return math.sqrt(total)
    shares = [0.5, 0.25, 0.25, 0.0]
    for counts in ([2, 1, 1, 0], [0, 0, 0, 9], [1, 0, 3, 2]):
        got = spark.createDataFrame([(counts,)], "c array<long>").select(rules.distance(rules.F.col("c"), shares)).first()[0]
        assert got == pytest.approx(js([c / sum(counts) for c in counts], shares), abs=1e-9)


def test_rules_part_clean_from_junk(spark):
    path = "/root/testdata/sf0.01"
    judged = rules.op7(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    asked = judged[judged.n_words >= 60]
    assert asked[asked.quality == 1].kept.mean() > 0.97
    assert asked[asked.quality == 0].kept.mean() < 0.4


def test_long_texts_without_common_words_fail(spark):
    """Invented words with the letters, lengths and capitals of the given documents."""
    import random
    draw = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    common = set(rules.vocabulary())
    def invented(n):
        words = ("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(4, 9))) for _ in range(9 * n))
        words = [w for w in words if w not in common][:n]
        return " ".join(w.capitalize() + "," if i % 12 == 0 else w for i, w in enumerate(words))
    junk = [(10_000_000 + i, invented(n), lang) for i, (n, lang) in enumerate([(80, "en"), (300, "en"), (2000, "de"), (150, "es"), (90, "fr"), (200, None)])]
    other = [(20_000_000, invented(200), "xx")]  # a named language without a reference
    got = rules.judge(docs.union(spark.createDataFrame(junk + other, docs.schema)).repartition(5)).toPandas().set_index("doc_id")
    assert not got.loc[[i for i, _, _ in junk], "base_failed"].any() and (got.loc[[i for i, _, _ in junk], "char_distance"] < 0.3).all()
    assert not got.loc[[i for i, _, _ in junk], "kept"].any() and got.loc[20_000_000, "kept"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    asked = got[(got.n_words >= 60) & ~got.base_failed].join(labels, how="inner")
    assert asked[asked.quality == 1].kept.mean() > 0.98 and asked[asked.quality == 0].kept.mean() < 0.3


def test_common_words_where_references_have_few(spark):
    """References nearly without common words: a text that has some is not odd for it."""
    plain = " ".join(f"vord{i % 7}{i}" for i in range(97)) + " the of to"
    rows = [(i, " ".join(f"wort{i}x{j}" for j in range(200)), "en") for i in range(200)] + [(900, plain, "en")]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900]


def test_classifier_on_held_out(spark):
    path = "/root/testdata/sf0.1"
    rows = mil.op3(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert rows[rows.quality == 1].predicted.mean() > 0.98


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(9, 1), (2, 0), (3, 0), (11, 1), (None, 1), (8, None)], "doc_id long, quality int")
    rows = mil.scored(edges, mil.train(edges, labels, mil.Training(epochs=2))).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert max(r["n_passages"] for r in rows) == -(-len(LONG.split()) // mil.PASSAGE_WORDS)
    assert mil.keep_good(edges, labels.limit(0), 0.4).count() == len(EDGES)  # no labels: an even score
    assert mil.keep_good(edges, labels).columns == edges.columns
    assert mil.scored(nothing, mil.train(nothing, labels)).count() == 0


def test_training_sample(spark):
    """Labels of other documents take no places; a repeated id is bounded and does not crowd out the others."""
    docs = spark.range(30).selectExpr("id * 1000 as doc_id", "concat('text of ', id) as text")
    many = spark.range(3000).selectExpr("cast(3 as long) as doc_id", "concat('other text ', id) as text")
    same = spark.range(3000).selectExpr("cast(11 as long) as doc_id", "'one text' as text")
    labels = spark.range(40_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    ids = [i for i in [3, 11, *range(0, 30_000, 1000)] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 3 in ids and 11 in ids
    rows = mil.sampled(docs.union(many).union(same), labels, mil.Training(documents=100)).collect()
    assert len(rows) == 100 and {r["doc_id"] for r in rows} == set(ids) and sum(r["doc_id"] == 11 for r in rows) == 1


def test_classifier_keeps_clean_documents(spark, documents):
    """Few labelled documents among many labels are learned from; without any, or with one class, all are kept."""
    junk = spark.range(10_000_000, 10_000_200).selectExpr("id as doc_id", "repeat(concat('#$ ', id, ' |<> '), 80) as text", "'en' as lang")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality").where("quality = 1")
    clean = documents.select("doc_id", "text", "lang").join(labels, "doc_id", "left_semi")
    foreign = spark.range(20_000_000, 20_200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    labelled = labels.union(junk.selectExpr("doc_id", "0")).union(foreign)
    both = clean.union(junk)
    kept = {r["doc_id"] for r in mil.keep_good(both, labelled).select("doc_id").collect()}
    good = {r["doc_id"] for r in clean.collect()}
    assert len(kept & good) >= 0.95 * len(good) and len(kept - good) <= 10
    for few in (foreign, junk.selectExpr("doc_id", "0 as quality")):
        assert mil.keep_good(both, few).count() == both.count()


def test_gradients_lower_the_loss():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((600, mil.WIDTH)).astype(np.float32)
    starts = np.arange(0, 600, 3)
    y = (np.maximum.reduceat(x[:, 0], starts) > 1).astype(np.float32)  # one passage decides
    model = mil.fit(x, starts, y, mil.Training(epochs=60))
    p, weight = model.score(*model.encode(x), starts)
    assert ((p > 0.5) == y).mean() > 0.95 and np.allclose(np.add.reduceat(weight, starts), 1, atol=1e-5)


def random_model(k, m, seed=0):
    draw = np.random.default_rng(seed)
    return hmm.Latent(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), k), draw.dirichlet(np.ones(m), k).T)


def paths(symbols, model):
    for z in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[z[0]] * model.emit[symbols[0], z[0]]
        for t in range(1, len(z)):
            p *= model.move[z[t - 1], z[t]] * model.emit[symbols[t], z[t]]
        yield z, p


def test_forward_and_expected_counts_match_all_paths():
    model, draw = random_model(3, 4), np.random.default_rng(1)
    sequences = [draw.integers(0, 4, n) for n in (1, 5, 3, 5, 2)]
    got = hmm.log10_likelihood(sequences, model)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    hmm.expected(sequences, model, start, move, emit)
    want_start, want_move, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for k, s in enumerate(sequences):
        total = sum(p for _, p in paths(s, model))
        assert got[k] == pytest.approx(math.log10(total), abs=1e-9)
        for z, p in paths(s, model):
            want_start[z[0]] += p / total
            for t, state in enumerate(z):
                want_emit[s[t], state] += p / total
                if t:
                    want_move[z[t - 1], state] += p / total
    assert np.allclose(start, want_start) and np.allclose(move, want_move) and np.allclose(emit, want_emit)


def test_lm_base_and_gain(spark, documents, nothing):
    docs = documents.select("doc_id", "text").union(frame(spark, EDGES).select("doc_id", "text"))
    rows = sorted(hmm.lm_scores(docs, top=50).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [(r["doc_id"], WORD.findall((r["text"] or "").translate(lower)) + [None]) for r in docs.collect()]
    held = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts}
    c = Counter()
    for i, words in texts:
        if not held[i]:
            c.update(words)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in texts), key=lambda r: (str(r[0]), r[1], r[3]))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"]) for r in rows] == [w[:3] for w in want]
    assert np.allclose([r["base_score"] for r in rows], [w[3] for w in want]) and {r["train_tokens"] for r in rows} == {n}
    assert all(r["score"] < 0 and r["held_out"] == held[r["doc_id"]] for r in rows)
    usual = [r for r in rows if r["n_tokens"] < 20_000]
    assert sum(r["score"] for r in usual) > sum(r["base_score"] for r in usual)
    assert hmm.lm_scores(nothing).count() == 0


def check_shards(rows, shards):
    texts = {}
    for r in rows:
        texts.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(0 <= r["shard"] < shards for r in rows)


def minimax(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        need, room = 1, mid
        for s in sizes:
            if s > room:
                need, room = need + 1, mid
            room -= s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_shards_are_minimax(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    rows = documents.selectExpr("cast(octet_length(text) + 16 as long) as size", "shiftrightunsigned(xxhash64(text), 1) as pos")
    groups = rows.groupBy("pos").agg(sharding.F.sum("size")).orderBy("pos").collect()
    for shards in (2, 7, 20):
        ends, capacity = sharding.cuts(rows, shards)
        assert capacity == minimax([g[1] for g in groups], shards) and len(ends) < shards
        loads = Counter()
        for pos, size in groups:
            loads[sum(e < pos for e in ends)] += size
        assert max(loads.values()) <= capacity


@pytest.mark.parametrize("bits", [1, 6, 14])
def test_cuts_are_those_over_all_groups_and_even(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rows = documents.selectExpr("cast(octet_length(text) % 900 + 16 as long) as size", "shiftrightunsigned(xxhash64(text), 1) as pos")
    groups = [sharding.Span(g[1], g[0], True, 0, 63) for g in
              rows.groupBy("pos").agg(sharding.F.sum("size")).orderBy("pos").collect()]
    mean, biggest = sum(g.size for g in groups), max(g.size for g in groups)
    for shards in (3, 8, 17):
        ends, capacity = sharding.cuts(rows, shards)
        whole, unknown = sharding.even(groups, capacity, shards)
        assert not unknown and ends == [groups[at - 1].last for at in whole if at]
        loads = Counter()
        for g in groups:
            loads[sum(e < g.last for e in ends)] += g.size
        assert max(loads.values()) <= capacity and min(loads.values()) >= mean / shards - 2 * biggest and len(loads) == shards


def test_shards_on_edges(spark, documents, edges, nothing):
    rows = sharding.shard(edges, 4).collect()
    assert len(rows) == len(EDGES)
    check_shards(rows, 4)
    sizes = Counter(r["size"] for r in rows)
    assert sizes[16] == 4 and {r["text_crc32"] for r in rows if r["size"] == 16} == {0}
    assert sharding.shard(nothing).count() == 0
    hot = documents.select("doc_id", "text").union(spark.range(1000, 1300).selectExpr("id", "repeat('hot ', 700)"))
    rows = sharding.shard(hot, 8).collect()
    check_shards(rows, 8)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    rest = sorted(loads.values())[:-1]
    assert len(loads) == 8 and rest[0] > 0.6 * rest[-1]


def test_chat_round_trip():
    import random
    draw = random.Random(5)
    parts = [chat.OPEN, chat.CLOSE, "<\\|im_end|>", "<\\\\|im_start|>", "\\", "\n", "n", "<", "|>", "x", "assistant", "<|", "\\n"]
    for _ in range(5000):
        role, text = ("".join(draw.choice(parts) for _ in range(draw.randint(0, 6))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text
        out, raw = chat.render(role, text)
        more, _ = chat.render(text, role)
        assert [t[:2] for t in chat.parse(out + more)] == [(role, text), (text, role)] and chat.unescape(raw) == text
    for bad in ("x", chat.OPEN, f"{chat.OPEN}user\nx", f"{chat.OPEN}user\nx{chat.CLOSE}", f"{chat.OPEN}a{chat.OPEN}\nx{chat.CLOSE}\n"):
        with pytest.raises(chat.Malformed):
            chat.parse(bad)


def test_chat_rows(spark):
    import hashlib
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 5, "assistant", "é"), (3, None, "user", "z"), (3, 0, "assistant", LONG),
            (4, 0, "user", "same"), (4, 0, "user", "same")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted long, loss_begin string")
    got = {r["conv_id"]: r for r in chat.digested(chat.formatted(table)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb<|im_end|>\n") and got[1]["loss_sha256"] == sha("b<|im_end|>") and got[1]["loss_chars"] == 11
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[None]["loss_sha256"] == sha("é")
    assert got[3]["n_turns"] == 2 and got[3]["loss_sha256"] == sha(LONG) and got[4]["n_turns"] == 2
    assert chat.digested(chat.formatted(table.limit(0))).count() == 0
    probe = {r["conv_id"]: r for r in chat.op9(spark, "/root/testdata/sf0.001").collect()}
    text = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    assert probe[-1]["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n") and probe[-1]["loss_sha256"] == sha(text)
    told = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        told.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: sha("".join(f"{a}\n{t}\n" for a, t in turns)) for c, turns in told.items()} == {c: r["turns_sha256"] for c, r in probe.items() if c != -1}
