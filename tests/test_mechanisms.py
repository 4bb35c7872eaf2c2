"""Joins by order, rank selection, running sums, replicated tables, bucket joins, range digests, rejects: against plain versions."""

import random
import re

import pytest
from pyspark.sql import Window, functions as F

from starling.operators import checks, replicated
from starling.operators.ordered import in_bands, totals_at_least
from starling.operators.ranking import global_ranks, running_sums, top_ranks
from starling.plans import base, catalog  # noqa: F401
from starling.plans.warehouse import Star
from starling.sources import delimited, layout
from tests.conftest import DATA, duck, rows, same_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- sums over larger keys ---------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_totals_at_least(spark, parts):
    draw = random.Random(parts)
    left = [(draw.choice([None, *range(-20, 20)]), draw.choice([None, 1, 5])) for _ in range(300)]
    right = [(i, draw.choice([None, 100, *range(-25, 25)])) for i in range(80)] * 2  # repeated rows
    got = totals_at_least(spark.createDataFrame(left, "k int, w int"), "k", "w", spark.createDataFrame(right, "i int, a int"), "a", "total", parts)
    want = []
    for i, a in right:
        hit = [w for k, w in left if a is not None and k is not None and k >= a]
        if hit:
            want.append((i, a, sum(w for w in hit if w is not None) if any(w is not None for w in hit) else None))
    assert rows(got) == sorted(want, key=repr)
    none = spark.createDataFrame([], "k int, w int")
    assert totals_at_least(none, "k", "w", spark.createDataFrame(right, "i int, a int"), "a", "total").collect() == []


def test_many_keys_on_both_sides_form_no_pairs(spark):
    n = 100_000
    left, right = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("w")), spark.range(n).select(F.col("id").alias("a"))
    df = totals_at_least(left, "k", "w", right, "a", "total")
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert df.where(F.col("total") != n - F.col("a")).count() == 0 and df.count() == n


def test_theta_plans_have_no_nested_loop(spark, tiny):
    for name in ("join_theta", "join_theta_orders", "join_bands", "join_bands_of_parts", "staged_theta_join_np", "staged_theta_join_pp", "staged_theta_join_fp"):
        assert "NestedLoop" not in plan(base.REGISTRY[name](tiny)), name


# ---- bands ------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [0.5, 3, 1000])
def test_bands_overlap_nest_and_are_open(spark, width):
    draw = random.Random(1)
    values = [(i, draw.choice([None, -7.0, 0.0, 1e6, *[draw.uniform(-50, 50) for _ in range(40)]])) for i in range(200)]
    bands = [(j, a, a + draw.choice([0, 0.1, 5, 80])) for j, a in enumerate(draw.uniform(-60, 60) for _ in range(60))]
    bands += [(100, None, 0.0), (101, 0.0, None), (102, None, None), (103, 5.0, 4.0), (104, 2e6, None), (105, None, -1e9), (106, 0.0, 0.0)]
    got = in_bands(spark.createDataFrame(values, "i int, `a.b` double").withColumnRenamed("a.b", "v"), "v", spark.createDataFrame(bands, "j int, lo double, hi double"), "lo", "hi", width)
    want = [(i, v, j, lo, hi) for i, v in values for j, lo, hi in bands if v is not None and (lo is None or v >= lo) and (hi is None or v <= hi)]
    assert rows(got) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "i int, v double")
    assert in_bands(empty, "v", spark.createDataFrame(bands, "j int, lo double, hi double"), "lo", "hi", width).collect() == []


# ---- ranks and running sums -------------------------------------------------------------------------


def test_top_ranks_are_those_of_all(spark):
    draw = random.Random(2)
    data = [(i, draw.choice(["a", "b", None]), draw.choice([None, 1.0, 1.0, draw.uniform(0, 9)]), draw.choice([2.0, draw.uniform(-9, 9), None])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, p string, x double, y double")
    orders = {"rx": ("x", F.floor(F.col("x") * 3)), "ry": ("y", F.floor(F.col("y")))}
    whole = global_ranks(df, "p", **orders)
    for k in (1, 10, 1000):
        assert rows(top_ranks(df, "p", k, **orders)) == rows(whole.where(f"rx <= {k} or ry <= {k}"))
    assert top_ranks(df.limit(0), "p", 3, **orders).collect() == []


def test_values_of_other_buckets_are_not_ranked(spark):
    df = spark.range(20_000).select("id", F.lit("p").alias("p"), F.col("id").cast("double").alias("x"))
    out = top_ranks(df, "p", 5, r=("x", F.floor(F.col("x") / 10)))
    assert [tuple(r)[-1] for r in sorted(out.collect())] == [1, 2, 3, 4, 5]
    text = plan(out)
    windows = [x for x in text.splitlines() if re.search(r"Window \[", x)]
    assert any("_value" in w for w in windows) and all("_bucket" in w or "_range" in w for w in windows)


def test_running_sums_equal_the_window(spark):
    draw = random.Random(3)
    data = [(i, draw.choice(["hot", "hot", "b", None]), draw.choice([None, *range(-30, 30)]), draw.choice([None, 1, -2, 7])) for i in range(500)]
    data += [(1000 + i, "nulls", i, None) for i in range(5)]
    df = spark.createDataFrame(data, "i int, p string, o int, v int")
    got = running_sums(df, "p", "o", F.floor(F.col("o") / 4), "v", "s")
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("p").orderBy(F.asc_nulls_first("o"))))
    assert got.columns == want.columns and rows(got) == rows(want)


# ---- replicated tables -----------------------------------------------------------------------------


def test_broadcast_follows_the_size_of_the_files(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    small, big = spark.read.parquet(str(tmp_path / "t")), spark.range(10_000_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert replicated.file_bytes(small.where("id > 3")) == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
        assert "BroadcastHashJoin" in plan(big.join(replicated.if_small(small.where("id > 3")), "id"))
        assert "SortMergeJoin" in plan(big.join(replicated.if_small(small, limit=100), "id"))
        assert "SortMergeJoin" in plan(big.join(replicated.if_small(spark.range(5)), "id"))  # no files, no proof
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queries_replicate_reference_tables(spark, tiny):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q62", "q99", "q21", "q40"):
            assert "BroadcastHashJoin" in plan(base.REGISTRY[name](tiny)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- layout -------------------------------------------------------------------------------------------


def test_buckets_join_without_a_shuffle_and_split_a_hot_key(spark, tmp_path):
    big = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    big = big.unionByName(spark.createDataFrame([(9999, None)], "id long, k long"))
    small = spark.range(60).select((F.col("id") % 55).alias("j"), F.col("id").alias("name"))  # some keys twice
    want = rows(big.join(small, big["k"] == small["j"]))
    opened, salts = [], []
    for df, key, name in zip(layout.spread(big, "k", small, "j", 500), ("k", "j"), ("big", "small")):
        salts.append(df.groupBy(key, layout.SALT).count().agg(F.max("count")).first()[0])
        layout.save_hashed(df, f"mechanism_{name}_new", key, 8, str(tmp_path / name), layout.SALT)
        opened.append(layout.open_hashed(spark, f"mechanism_{name}", df.schema, key, 8, str(tmp_path / name), layout.SALT))
    joined = layout.join_hashed(opened[0], "k", opened[1], "j")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert rows(joined) == want and salts[0] < 700


def test_bucket_join_is_the_first_query_of_a_folder(spark, tmp_path):
    source, query = f"{DATA}/sf0.001", base.REGISTRY["join_buckets"]
    star = Star.of(spark, source, str(tmp_path))
    assert not star.staged("store_sales") and not star.staged("item")
    mine, want = same_rows(query(star), duck(source), query.oracle(base.oracle_bodies()["join_buckets"]))
    assert mine and mine == want
    assert rows(query(star, hot_rows=5)) == rows(query(star))


@pytest.mark.parametrize("name", ["join_buckets", "layout_hashed"])
def test_bucketed_tables_are_read_from_their_own_folder(spark, tmp_path, name):
    query, (one, other) = base.REGISTRY[name], [Star.of(spark, f"{DATA}/sf0.001", str(tmp_path / x)) for x in ("one", "other")]
    want = rows(query(one))
    assert all(str(tmp_path / "other") in f for f in query(other).inputFiles())
    one.remove()
    assert rows(query(other)) == want and rows(query(one)) == want


def test_bucket_numbers_stay_within_the_limit():
    assert layout.bucket_count(100 << 40) == layout.MOST_BUCKETS <= 100_000
    assert layout.bucket_count(0) == 8 and layout.bucket_count(1 << 30) == 16


# ---- differences and keys ------------------------------------------------------------------------------


def test_only_differing_ranges_are_joined(spark):
    before = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("x"))
    after = before.withColumn("x", F.when(F.col("k").isin(17, 30_001), -1).otherwise(F.col("x"))).where("k <> 40000")
    ranges = checks.differing_ranges(before, after, "k")
    assert ranges == [(17, 17), (30_001, 30_001), (40_000, 40_000)]
    got = checks.cell_differences_in_ranges(before, after, "k")
    assert rows(got) == [(17, "x", "51", "-1"), (30_001, "x", "90003", "-1")]
    assert checks.differing_ranges(before, before, "k") == [] and checks.cell_differences_in_ranges(before, before, "k").collect() == []
    far = checks.differing_ranges(before, before.withColumn("x", F.lit(0)), "k", most=4)  # too many: the level above
    assert far[0][0] == 0 and far[-1][1] == 49_999
    assert checks.differing_ranges(before.limit(0), before.limit(0), "k") == []


def test_orphans_are_found_beyond_any_bitmap(spark):
    parent = spark.createDataFrame([(i,) for i in (1, 2, 3, 32_768, 32_769, 10**12)], "pk long")
    child = spark.createDataFrame([(1, 3), (1, None), (5, 32_770), (5, 10**12), (None, 10**12 + 1), (2, -4), (32_768, 0)], "a long, b long")
    got = checks.foreign_key_profile({"c": child, "p": parent}, [("c", "a", "p", "pk"), ("c", "b", "p", "pk")])
    found = {r["column"]: r for r in got.collect()}
    assert (found["a"]["rows"], found["a"]["distinct_used"], found["a"]["orphan_rows"], found["a"]["max_used"]) == (6, 4, 2, 32_768)
    assert (found["b"]["rows"], found["b"]["distinct_used"], found["b"]["orphan_rows"], found["b"]["min_used"]) == (6, 6, 4, -4)
    assert {r["parent_keys"] for r in found.values()} == {6} and {r["child"] for r in found.values()} == {"c"}


# ---- rejects ----------------------------------------------------------------------------------------------


def test_rejects_have_reasons_and_add_up(spark, tmp_path):
    lines = ["1|a|2.5|", "2||", "x|b|1.0|", "3|c d |", "4|e|ten|", "|f|", "5|g|1|2|3|", "", "6|h|7"]
    (tmp_path / "in").write_text("\n".join(lines) + "\n", encoding="iso-8859-1")
    schema = spark.createDataFrame([], "n int, t string, d decimal(5,2)").schema
    fit, rejects, totals = delimited.load_sorted_out(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"))
    assert {(r["n"], r["t"], r["d"] and float(r["d"])) for r in fit.collect()} == {(1, "a", 2.5), (2, None, None), (3, "c d", None), (None, "f", None), (6, "h", 7.0)}
    reasons = {r["line"]: r["reason"] for r in rejects.collect()}
    assert reasons["x|b|1.0|"] == "n is no int" and reasons["4|e|ten|"] == "d is no decimal(5,2)"
    assert reasons["5|g|1|2|3|"] == "6 fields, not 3" and len(reasons) == 3
    assert sum(r["lines"] for r in totals.collect()) == fit.count() + rejects.count()
