import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import hard_negatives, kmeans_tree, prefix_trie
from tests.conftest import same_rows

DATA = "/root/testdata"


# ---- hard negatives -------------------------------------------------------------------------


@pytest.mark.parametrize("data", ["sf0.01", "sf0.1"])
def test_hard_negatives_match_sql(spark, data):
    from tests.conftest import duck
    mine, theirs = same_rows(hard_negatives.op11(spark, f"{DATA}/{data}"), duck(f"{DATA}/{data}", ["embeddings"]), hard_negatives.ORACLE)
    assert mine and mine == theirs


def brute_negatives(rows, how):
    rows = [(i, n, label, v, a) for i, (n, label, v, a) in enumerate(rows)
            if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    def dot(a, b):
        return int(sum(x * y for x, y in zip(a, b)))
    def order(score, r):
        return (-score, r[1] is None, r[1] or 0, r[0])
    out = []
    for a in rows:
        if not a[4]:
            continue
        others = sorted(((dot(a[3], r[3]), r) for r in rows if r[0] != a[0]), key=lambda p: order(*p))
        for score, p in [x for x in others if x[1][2] == a[2]][:how.positives]:
            hit = [(s, r) for s, r in others if r[2] != a[2] and how.low * score <= 100 * s <= how.high * score][:how.negatives]
            out += [(a[1], p[1], rank, r[1], score, s) for rank, (s, r) in enumerate(hit, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, label int, values array<double>, anchor boolean, row string, q int, v string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], VECTORS)


def test_hard_negatives_on_edges(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), int(draw.integers(3)), [float(x) for x in draw.integers(-9, 10, 40)], i % 5 == 0) for i in range(80)]
    same = [float(x) for x in range(40)]
    rows += [(900, 1, same, True), (901, 2, same, False), (902, 2, same, False), (902, 2, same, False), (900, 1, same, True)]  # ties, repeated rows
    rows += [(None, 2, same, False), (903, None, same, True), (904, 1, None, True), (905, 1, [1.0, None], True), (906, 2, [float("nan")], True),
             (907, 1, [float("inf")], True), (908, 1, [], True), (909, 2, [5.0, 7.0], True), (910, 7, same, True), (911, 1, same, None)]
    how = hard_negatives.Mining(rows=32, tile=4, stride=8)
    got = hard_negatives.mine(vector_frame(spark, rows), how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows, how)
    assert hard_negatives.mine(vector_frame(spark, []), how).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(vector_frame(spark, [(1, 1, [1e12], True)]), how)


def test_an_index_leaves_out_no_pair_above_a_threshold():
    draw = np.random.default_rng(2)
    left_out = 0
    for scale in (1.0, 3.0):
        x, q = (np.round(draw.standard_normal((n, 64)) * 50 * np.exp(-np.arange(64) / 64 * scale)) for n in (400, 30))
        scores = q @ x.T
        least = np.sort(scores, axis=1)[:, -10]
        order, may = hard_negatives.candidates(x, q, least, 16)
        found = np.zeros(scores.shape, bool)
        found[:, order] = may
        assert found[scores >= least[:, None]].all()
        depth = hard_negatives.indexed(hard_negatives.tails(x), hard_negatives.tails(q), least, 16)
        left_out += int((depth < 64).sum())
    assert left_out  # some rows are indexed in part


# ---- nearest neighbours ---------------------------------------------------------------------


def brute_neighbours(rows, k=10):
    rows = [(i, n, v, a) for i, (n, v, a) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(r[2]) for r in rows), default=0)
    x = np.array([r[2] + [0.0] * (width - len(r[2])) for r in rows])
    out = {}
    for at, r in enumerate(rows):
        if r[3]:
            d = np.sqrt(((x - x[at]) ** 2).sum(1))
            order = sorted((float(d[i]), o[1] is None, o[1] or 0, o[0]) for i, o in enumerate(rows) if o[0] != r[0])
            out.setdefault(r[1], []).append([(s, None if none else i) for s, none, i, _ in order[:k]])
    return out


def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    measure = {}
    how = kmeans_tree.Search(leaf_rows=40)
    got = kmeans_tree.neighbours(rows.select("vec_id", F.col("embedding").alias("values"), (F.col("vec_id") % 100 == 0).alias("asks")), how, measure).collect()
    want = brute_neighbours([(r["vec_id"], list(r["embedding"]), r["vec_id"] % 100 == 0) for r in rows.collect()])
    assert {r["query_id"] for r in got} == set(want) and len(got) == 10 * len(want)
    hits = 0
    for q, (near,) in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {n for _, n in near})
        exact = dict((n, s) for s, n in near)
        assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine if m[1] in exact)
    assert hits >= 0.9 * len(got) and measure["recall"] >= 0.9 and measure["leaves"] > 16


def test_neighbours_on_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.standard_normal(6)], i % 10 == 0) for i in range(60)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows += [(i, same, i == 700) for i in range(700, 740)] + [(700, same, True), (None, same, False)]  # a hot vector, a repeated query
    rows += [(800, None, True), (801, [0.0] * 6, True), (802, [float("nan")], True), (803, [1.0, None], True), (804, [2.0], True), (805, [], True), (806, same, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, values array<double>, asks boolean, row string, leaf int")
    how = kmeans_tree.Search(leaf_rows=10, recall=1.0)
    got = kmeans_tree.neighbours(frame, how).collect()
    want = brute_neighbours(rows)
    assert {r["query_id"] for r in got} == set(want)
    for q, lists in want.items():
        mine = sorted(((r["rank"], round(r["score"], 9), r["vec_id"]) for r in got if r["query_id"] == q), key=repr)
        theirs = sorted(((rank, round(s, 9), n) for near in lists for rank, (s, n) in enumerate(near, 1)), key=repr)
        assert mine == theirs
    assert kmeans_tree.neighbours(frame.limit(0), how).collect() == []
    few = frame.where("vec_id in (0, 1, 2)")
    assert len(kmeans_tree.neighbours(few, how).collect()) == 2


def test_best_bin_first_visits_every_leaf_once():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((3000, 8))
    tree = kmeans_tree.Tree(x, 3000, kmeans_tree.Search(leaf_rows=50))
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 50
    leaf = tree.leaf_of(x)
    assert np.mean([next(tree.visits(v)) == at for v, at in zip(x[:200], leaf)]) > 0.9


# ---- prefix trie ----------------------------------------------------------------------------


def brute_trie(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in by_conv.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    def own(node):
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", node[-1][1])]) if node else 0
        return (len(members[node]) - 1) * words
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own(node)
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == node).encode()).hexdigest()) for node, m in members.items()), key=repr)


CONV = "conv_id long, turn long, role string, text string, key string, words string, part int, node string"


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "w", 1, "n") for r in rows], CONV)


EDGE_TALKS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "first"), (1, 0, "user", "hi"), (None, 0, "user", "none"),
              (0, 0, "user", "same start"), (0, 1, "assistant", "then  this\tand\x0bthat"), (0, 2, "user", "x"), (0, 3, "user", ""),
              (21, 0, "u", ""), (-3, 0, "user", "negative"), (-20, 0, "a", "b"), (-21, 1, "a", "b"), (400, 0, "", ""), (400, 1, "user", "long " * 20000)]


@pytest.mark.parametrize("keys", [20000, 5, 1])
def test_trie_on_edges(spark, keys):
    draw = np.random.default_rng(5)
    rows = EDGE_TALKS + [(c, t, "user", str(draw.integers(2))) for c in range(1000, 1060) for t in range(int(draw.integers(1, 8)))]
    rows += [(c, t, "r", "same") for c in range(2000, 2040) for t in range(3)]  # many alike
    rows += [(3000, t, "user", str(t % 3)) for t in range(300)] + [(3001, t, "user", str(t % 3)) for t in range(290)]  # long ones
    layout = prefix_trie.Layout(keys=keys, chunk=7, salts=4)
    got = sorted((tuple(r) for r in prefix_trie.trie(talk_frame(spark, rows), layout).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(talk_frame(spark, [])).collect() == []
    assert prefix_trie.trie(talk_frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_radix_tree_layouts_and_paths():
    draw = np.random.default_rng(6)
    keys = {bytes(draw.integers(0, 256, 16 * int(n), dtype=np.uint8)) for n in draw.integers(0, 4, 600)}
    keys |= {k[:16] for k in keys} | {k + bytes(16) for k in list(keys)[:50]} | {k[:15] + bytes([b]) for k in list(keys)[:1] for b in range(256) if len(k) > 15}
    tree = prefix_trie.RadixTree()
    for k in sorted(keys, key=lambda k: k[::-1]):
        tree.put(k, prefix_trie.Entry(1, 1, k.hex(), [0] * (len(k) // 16)))
    seen, layouts, todo = set(), set(), [tree.root]
    while todo:
        node = todo.pop()
        if node.entry is not None:
            seen.add(bytes.fromhex(node.entry.ends))
        if isinstance(node, prefix_trie.Inner):
            below = list(node)
            layouts.add(node.layout)
            assert [b for b, _ in below] == sorted(b for b, _ in below) and len(below) == node.size <= node.layout
            assert node is tree.root or len(below) + (node.entry is not None) > 1  # no node without a branch
            todo += [c for _, c in below]
    assert seen == keys and {4, 256} <= layouts
    rows = list(prefix_trie.nodes_of(tree, -1, -1))
    prefixes = {k[:d] for k in keys for d in range(0, len(k) + 1, 16)}
    assert len(rows) == len(prefixes) and rows[-1][3] == 0 and rows[-1][5] == len(keys)
