import math
import random
import re

import numpy as np

from starling.llm import exact_dedup, order_minhash as near
from tests.conftest import duck, same_rows
from tests.llm.conftest import EDGES, frame


def test_exact_matches_sql(spark):
    mine, theirs = same_rows(exact_dedup.op8(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), exact_dedup.ORACLE)
    assert mine == theirs


def test_exact_on_edges(spark, edges, nothing):
    rows = exact_dedup.find_copies(edges.repartition(5), fan_in=2).collect()
    assert len(rows) == len(EDGES)
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r)
    for group in groups.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert all(r["keep_id"] == min(ids, default=None) and r["group_size"] == len(group) for r in group)
        kept = [r for r in group if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == min(ids, default=None)
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in EDGES}
    assert len(groups) == len(norm)
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len(norm)
    assert exact_dedup.find_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_exact_merges_walk_over_sorted_runs(spark):
    """One exchange and one sort a merge, no aggregation; the merged run is sorted and holds the smallest id of each digest."""
    rows = spark.range(600).selectExpr("id as keep_row", "if(id % 5 = 0, null, 1000 - id) as keep_id", "cast(id % 8 as int) as run",
                                       "sha2(cast(id div 8 % 40 as string), 256) as digest", "1L as n", "7 as b0", "7 as b1", "3L as c0", "3L as c1")
    level = exact_dedup.first_runs(rows.selectExpr("run", "digest", "keep_row as row_id", "keep_id as doc_id", "b0 as n_bytes", "c0 as check"))
    once = exact_dedup.merged(level.withColumn("run", exact_dedup.F.lit(0)))
    text = once._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 1 and text.count("Sort [") == 2 and text.count("Aggregate [") == 1  # a sort and the aggregation are the first runs'
    pieces = exact_dedup.staged(once, "merged").select("digest", exact_dedup.F.input_file_name().alias("file"), exact_dedup.F.col("piece")).collect()
    for file in {r["file"] for r in pieces}:
        digests = [(r["piece"], r["digest"]) for r in pieces if r["file"] == file]
        assert digests == sorted(digests)
    plain = {}
    for r in rows.collect():
        plain.setdefault(r["digest"], []).append(r["keep_id"])
    found = {r["digest"]: (r["keep_id"], r["n"]) for r in once.collect()}
    assert found == {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in plain.items()}


def test_exact_texts_that_share_a_digest_stop_the_job(spark):
    rows = spark.createDataFrame([(0, 1, 0, "d", 5, 1), (1, 2, 1, "d", 6, 1)], "row_id long, doc_id long, run int, digest string, n_bytes int, check long")
    level = exact_dedup.first_runs(rows)
    assert level.count() == 2
    try:
        exact_dedup.merged(level.withColumn("run", exact_dedup.F.lit(0))).collect()
    except Exception as error:
        assert "different texts share a digest" in str(error)
    else:
        raise AssertionError("merged different texts")


def test_near_tells_texts_with_one_key_apart(spark):
    """Texts that share 64 bits get keys of their own, equal texts keep one; a new key that is taken again is changed too."""
    taken = spark.sql("select xxhash64(7L, 2L)").first()[0]
    rows = spark.createDataFrame([(0, 7, 1), (1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 7, 3), (5, taken, 9), (6, 8, 1)], "row_id long, text_key long, check long")
    keys = {r["row_id"]: r["text_key"] for r in near.told_apart(rows).collect()}
    assert keys[0] == keys[1] and keys[2] == keys[3] and len(set(keys.values())) == 5


def test_exact_hot_group(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id)) as text").repartition(13)
    rows = exact_dedup.find_copies(docs, fan_in=3)
    assert rows.where("kept").count() == 20_000 - 6_667 + 1
    assert rows.where("group_size = 6667 and keep_id = 0").count() == 6_667


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_edit_distance():
    draw = random.Random(4)
    for _ in range(400):
        a = [draw.randint(0, 5) for _ in range(draw.randint(1, 30))]
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            b[draw.randint(0, len(b)):][:1] = []
            b.insert(draw.randint(0, len(b)), draw.randint(0, 5))
            if draw.random() < 0.5 and b:
                del b[draw.randrange(len(b))]
        for most in (0, 1, 3, 7):
            assert near.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (distance(a, b) <= most)


def test_sketch_in_blocks_is_that_of_the_whole(monkeypatch):
    grams = near.kmers(near.word_hashes([str(i % 700) for i in range(3000)]), 5)
    whole = near.sketch(grams)
    monkeypatch.setattr(near, "BLOCK", 100)
    assert (near.sketch(grams) == whole).all()


def test_links_meet_at_every_length():
    """The chance that a pair at the threshold shares no entry, by the number of k-mers in its union."""
    for u in range(4, 300):
        c = -(-4 * u // 5)
        grams = near.kmers(near.word_hashes([f"w{i}" for i in range(u + 4)]), 5)
        assert len(grams) == u
        assert (1 - math.comb(c, 4) / math.comb(u, 4)) ** len(near.sketch(grams)) < 1e-5
    missed = 0
    for k in range(3000):  # eight words and one more
        words = [f"x{k}y{i}" for i in range(9)]
        a, b = (near.sketch(near.kmers(near.word_hashes(w), 5)) for w in (words[:8], words))
        missed += not np.intersect1d(a, b).size
    assert missed == 0


def test_order_counts():
    words = [f"w{i}" for i in range(400)]
    a, b = near.word_hashes(words), near.word_hashes(words[200:] + words[:200])
    assert not near.similar(a, b) and near.similar(a, near.word_hashes(words[:395]))


def brute(texts):
    hashes = [near.word_hashes(near.words_of(t or "")) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and (hashes[i].tolist() == hashes[j].tolist() or len(hashes[i]) and len(hashes[j]) and near.similar(hashes[i], hashes[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_matches_all_pairs(spark, documents):
    """Given documents, a large group of graded copies, and chains whose ends are not linked."""
    draw = random.Random(9)
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    words = [f"w{draw.randint(0, 5000)}" for _ in range(150)]
    for k in range(90):
        copy = list(words)
        for _ in range(k % 9):
            copy[draw.randrange(150)] = f"n{draw.randint(0, 9999)}"
        texts.append(" ".join(copy))
    for k in range(10):
        words = words[4:] + [f"c{k}{i}" for i in range(4)]
        texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in near.find_near(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(7)).collect()}
    want = brute(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) and got[i]["class_size"] == want.count(want[i]) for i in range(len(texts)))


def test_near_on_edges(spark, edges, nothing):
    rows = near.find_near(edges).collect()
    assert len(rows) == len(EDGES)
    empty = [r for r in rows if r["class_id"] == 3]
    assert {r["doc_id"] for r in empty} == {3, 5, 7, 13, None} and sum(r["kept"] for r in empty) == 1
    same = [r for r in rows if r["class_id"] == 1]
    assert len(same) == 4 and [r["doc_id"] for r in same if r["kept"]] == [1]
    assert {r["doc_id"] for r in rows if r["class_id"] == 8} == {8, 9}
    kept = near.drop_near(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r["kept"] for r in rows)
    assert near.find_near(nothing).count() == 0 and near.drop_near(nothing).count() == 0
