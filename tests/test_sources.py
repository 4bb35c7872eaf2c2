import json

import pytest
from pyspark.sql import functions as F, types as T

from starling.plans import staged
from starling.plans.warehouse import Star
from starling.sources import delimited, extjson, layout, metrics, readers, schema
from tests.conftest import rows

DOC = {"namespace": "shop", "table": "thing", "primary_key": ["k"], "clustering_key": [],
       "cols": [{"col_name": "k", "type": "int"}, {"col_name": "name", "type": "varchar"}, {"col_name": "day", "type": "date"},
                {"col_name": "big", "type": "bigint"}, {"col_name": "price", "type": "decimal"}, {"col_name": "code", "type": "ascii"}]}


def test_schema_document(tmp_path):
    struct = schema.struct_type(DOC)
    assert struct == schema.struct_type(json.dumps(DOC))
    path = tmp_path / "thing.json"
    path.write_text(json.dumps(DOC))
    assert struct == schema.struct_type(str(path))
    assert struct["price"].dataType == T.DecimalType(7, 2) and not struct["k"].nullable and struct["name"].nullable
    assert schema.struct_type(schema.document("thing", struct, ["k"]))["price"] == struct["price"]
    assert schema.create_table(DOC).startswith("CREATE TABLE shop.thing (\n  k int,")
    assert schema.create_table(DOC).endswith("PRIMARY KEY (k)\n)")
    assert "PRIMARY KEY ((k, day))" in schema.create_table({**DOC, "primary_key": ["k", "day"]})
    with pytest.raises(ValueError):
        schema.spark_type("geometry")


def test_types_with_precision():
    assert schema.spark_type("decimal(5,2)") == T.DecimalType(5, 2)
    assert schema.spark_type("numeric(9,0)") == T.DecimalType(9, 0)
    assert schema.spark_type("char(16)") == T.StringType()
    assert schema.spark_type("smallint") == T.ShortType()


def test_delimited_edge_fields(spark, tmp_path):
    struct = schema.struct_type(DOC)
    lines = ['1|caf\xe9 "bar"  |1999-02-03|5000000000|1.50|A|', "2|||||", "3|x|2000-01-01|7|-0.25|", "4|y|2000-01-01|7|3.00|z"]
    (tmp_path / "thing.dat").write_bytes("\n".join(lines).encode("iso-8859-1"))
    got = {r.k: r for r in delimited.load(spark, str(tmp_path / "thing.dat"), struct).collect()}
    assert got[1].name == 'café "bar"' and got[1].big == 5000000000 and str(got[1].price) == "1.50" and got[1].code == "A"
    assert str(got[1].day) == "1999-02-03"
    assert all(got[2][c] is None for c in ("name", "day", "big", "price", "code"))
    assert got[3].code is None and got[4].code == "z"


def test_delimited_round_trip(spark, tiny, tmp_path):
    df = tiny.customer
    delimited.save(df, str(tmp_path / "c"))
    assert rows(delimited.load(spark, str(tmp_path / "c"), df.schema)) == rows(df)


def test_typed_json_lines(spark, tmp_path):
    struct = schema.struct_type(DOC)
    df = spark.sql("select 1 as k, 'say \"hi\" \\\\ x' as name, date'1999-02-03' as day, 5000000000L as big, 1.50BD as price, "
                   "cast(null as string) as code union all select 2, null, null, null, null, null")
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in struct])
    docs = {d["k"]: d for d in (json.loads(r.value) for r in extjson.to_lines(df).collect())}
    assert docs[1]["day"] == {"$date": "1999-02-03T00:00:00Z"} and docs[1]["big"] == {"$numberLong": "5000000000"}
    assert docs[1]["price"] == {"$numberDecimal": "1.50"} and docs[1]["name"] == 'say "hi" \\ x'
    assert docs[2] == {"k": 2, "name": None, "day": None, "big": None, "price": None, "code": None}
    extjson.save(df, str(tmp_path / "j"))
    assert rows(extjson.load(spark, str(tmp_path / "j"), struct)) == rows(df)


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:postgresql://db/", "select 1", user="u")
    assert plain["query"] == "select 1" and plain["fetchsize"] == "10000" and "dbtable" not in plain
    sliced = readers.jdbc_options("jdbc:x", "select * from t", driver="d", partition={"column": "k", "lower": 1, "upper": 9, "count": 4})
    assert sliced["dbtable"] == "(select * from t) extract" and sliced["numPartitions"] == "4" and "query" not in sliced


def test_scan_applies_the_query(spark, tiny, tmp_path):
    path = str(tmp_path / "w")
    tiny.warehouse.write.parquet(path)
    read = readers.scan("parquet", lambda table: {"path": path})
    assert read(spark, "warehouse", "select w_warehouse_sk from warehouse where w_warehouse_sk > 2").count() == tiny.warehouse.count() - 2


def test_staged_run_writes_csv_once(spark, tiny, tmp_path):
    session = spark.newSession()
    star = Star.of(session, tiny.sf_dir)
    read = readers.tables({x: star[x] for x in staged.SPECS["left_join"][2]})
    args = (staged.job_of("left_join", "pp"), read, str(tmp_path / "stage"), str(tmp_path / "out"), "run", 0)
    seconds = staged.run(session, *args)
    assert set(seconds) == {"acquisition", "processing", "overall"}
    assert seconds["overall"] >= seconds["acquisition"] + seconds["processing"] - 0.01
    want = rows(staged.on_star("left_join", "np")(tiny))
    assert [(int(r[0]),) for r in spark.read.csv(str(tmp_path / "out/run/0.csv")).collect()] == want
    with pytest.raises(Exception, match="(?i)exist"):
        staged.run(session, *args)


def test_staging_keeps_prefix_tables_apart(spark, tiny, tmp_path):
    names = ("customer", "customer_address")
    job = {"name": "x", "spark_sql": "select (select count(*) from customer) as a, (select count(*) from customer_address) as b",
           "datasets": {x: {"table_schema": x, "query": f"select * from {x}"} for x in names}}
    session = spark.newSession()
    star = Star.of(session, tiny.sf_dir)
    staged.stage(session, job, readers.tables({x: star[x] for x in names}), str(tmp_path))
    assert rows(staged.answer(session, job, str(tmp_path))) == [(150, 150)]


def test_staged_files_merge_schemas(spark, tmp_path):
    spark.sql("select 1 as a").write.parquet(str(tmp_path / "t.parquet/x=1"))
    spark.sql("select 2 as a, 3 as b").write.parquet(str(tmp_path / "t.parquet/x=2"))
    job = {"datasets": {"t": {"table_schema": "t", "query": ""}}, "spark_sql": "select a, b from t"}
    assert rows(staged.answer(spark.newSession(), job, str(tmp_path))) == sorted([(1, None), (2, 3)], key=repr)


def test_metrics(spark, tmp_path):
    for i, s in enumerate((1.0, 3.0)):
        metrics.record(spark, str(tmp_path / "m"), i, "id", "job", 3, 1, "off", {"overall": s, "acquisition": s / 2})
    got = metrics.summary(spark.read.parquet(str(tmp_path / "m"))).collect()[0]
    assert (got.runs, got.avg, got.min, got.max, round(got.stddev, 4)) == (2, 2.0, 1.0, 3.0, 1.4142)


def test_range_layout_splits_keys(spark, tiny, tmp_path):
    layout.save_ranged(tiny.store_sales, str(tmp_path / "r"), layout.RANGE_KEYS["store_sales"], 4)
    spans = (spark.read.parquet(str(tmp_path / "r")).groupBy(F.input_file_name()).agg(
        F.min(F.struct("ss_item_sk", "ss_ticket_number")).alias("lo"), F.max(F.struct("ss_item_sk", "ss_ticket_number")).alias("hi"))
        .orderBy("lo").collect())
    assert len(spans) == 4 and all(tuple(x.hi) < tuple(y.lo) for x, y in zip(spans, spans[1:]))


def test_hash_layout_groups_without_shuffle(spark, tiny):
    layout.save_hashed(tiny.store_sales, "hashed_store_sales", "ss_item_sk", 4)
    plan = spark.table("hashed_store_sales").groupBy("ss_item_sk").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table hashed_store_sales")
    assert "Exchange" not in plan


def test_bucket_count_follows_bytes():
    assert [layout.bucket_count(n << 20) for n in (0, 1024, 1025 * 128, 1 << 20)] == [8, 16, 2048, 16384]


def test_hashed_files_open_in_a_later_application(spark, tiny, tmp_path):
    path, df = str(tmp_path / "h"), tiny.store_sales
    layout.save_hashed(df, "hashed_once", "ss_item_sk", 4, path)
    assert not spark.catalog.tableExists("hashed_once")
    table = layout.open_hashed(spark, "hashed_again", df.schema, "ss_item_sk", 4, path)
    grouped = table.groupBy("ss_item_sk").count()
    text = grouped._jdf.queryExecution().executedPlan().toString()
    got, want = rows(grouped), rows(df.groupBy("ss_item_sk").count())
    spark.sql("drop table hashed_again")
    assert "Exchange" not in text and got == want


def lines(path, *texts):
    path.write_text("".join(t + "\n" for t in texts), encoding="ISO-8859-1")
    return str(path)


def test_delimited_refuses_surplus_and_short_lines(spark, tmp_path):
    schema = T.StructType().add("a", T.StringType()).add("n", T.IntegerType())
    assert rows(delimited.load(spark, lines(tmp_path / "ok", "x|1|", "y|2", "|"), schema)) == sorted([("x", 1), ("y", 2), (None, None)], key=repr)
    for bad in ("a|1|extra|more|", "a|1|extra", "b"):
        with pytest.raises(Exception, match="not 2 fields"):
            delimited.load(spark, lines(tmp_path / f"bad{len(bad)}", "x|1|", bad), schema).count()


def test_delimited_refuses_what_it_cannot_hold(spark, tmp_path):
    for k, text in enumerate(("a|b", "a\nb", "a\rb", "\u20ac")):
        with pytest.raises(Exception, match="does not fit"):
            delimited.save(spark.createDataFrame([(text,)], "a string"), str(tmp_path / str(k)))


def test_scan_takes_a_schema(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.sql("select 1 as a").write.json(path)
    read = readers.scan("json", lambda table: {"path": path}, {"docs": "a string, b date"})
    assert read(spark, "docs", "select * from docs").dtypes == [("a", "string"), ("b", "date")]


def test_jdbc_refuses_whole_tables_and_asks_for_bounds(spark):
    with pytest.raises(ValueError, match="partition column"):
        readers.jdbc("jdbc:x")(spark, "item", "select * from item")
    assert readers.whole_table(" SELECT * FROM a.item ;") and not readers.whole_table("select * from item where x = 1")
    assert readers.bounds_query("select k from item", "k") == "select min(k) as lower_bound, max(k) as upper_bound from (select k from item) extract"


@pytest.mark.parametrize("kind", ["skewed", "days", "one", "empty"])
def test_equal_slices_part_the_rows(spark, kind):
    keys = {"skewed": "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id * id end", "days": "date_add(date'2000-01-01', cast(id * id % 900 as int))",
            "one": "5", "empty": "id"}[kind]
    df = spark.range(0 if kind == "empty" else 3000).selectExpr(f"{keys} as k", "id")
    df.createOrReplaceTempView("sliced")
    bounds = [r[0] for r in spark.sql(readers.quantiles_query("select * from sliced", "k", 8)).collect()]
    sizes = [df.where(p).count() for p in readers.equal_slices("k", bounds)]
    assert sum(sizes) == df.count() and sizes[-1] == df.where("k is null").count()
    hot = 1000 if kind == "skewed" else 3000 if kind == "one" else 0
    assert max(sizes[:-1]) <= max(hot, -(-df.where("k is not null").count() // 8)) + 260
