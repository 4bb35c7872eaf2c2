"""Staged jobs: extract sources to Parquet, then run one SQL statement over the staged tables.

A job is a mapping ``{name, type, datasets: {label: {table_schema, query}}, spark_sql}``.  The
extract queries decide how much work the source does: none, the filters and columns, or all.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from starling.plans.base import REGISTRY, Query
from starling.plans.warehouse import Star
from starling.sources import readers
from starling.sources.metrics import Phases


def read_job(source: str | dict) -> dict:
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def stage(spark: SparkSession, job: dict, read: readers.Reader, folder: str) -> None:
    """Write every extract to exactly ``folder/<table>.parquet``."""
    source = getattr(read, "source", {})
    for name in source:
        source[name].createOrReplaceTempView(name)
    for extract in job["datasets"].values():
        table = extract["table_schema"]
        read(spark, table, extract["query"]).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")


def answer(spark: SparkSession, job: dict, folder: str) -> DataFrame:
    """The final statement over the staged tables, files of differing columns merged."""
    for extract in job["datasets"].values():
        table = extract["table_schema"]
        spark.read.option("mergeSchema", "true").parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(job["spark_sql"])


def run(spark: SparkSession, source: str | dict, read: readers.Reader, folder: str, output: str,
        run_id: str, idx: int) -> dict[str, float]:
    """Stage, answer and write ``output/<run_id>/<idx>.csv``; an existing result is an error.

    The job's tables become views of the session: give concurrent jobs a session each.
    """
    job, phases = read_job(source), Phases()
    phases.timed("acquisition", lambda: stage(spark, job, read, folder))
    result = answer(spark, job, folder)
    phases.timed("processing", lambda: result.write.csv(f"{output}/{run_id}/{idx}.csv"))
    return phases.seconds


MONEY = ("wholesale_cost list_price sales_price ext_discount_amt ext_sales_price ext_wholesale_cost "
         "ext_list_price ext_tax coupon_amt ext_ship_cost net_paid net_paid_inc_tax net_paid_inc_ship "
         "net_paid_inc_ship_tax net_profit").split()


def _wide_aggregate():
    cells = []
    for col in (f"cs_{m}" for m in MONEY):
        cells += [f"min({col}) as min_{col}", f"max({col}) as max_{col}",
                  f"try_divide(cast(sum({col}) as double), cast(count({col}) as double)) as avg_{col}",
                  f"sum({col}) as sum_{col}", f"count({col}) as count_{col}"]
    return "select " + ", ".join(cells) + " from catalog_sales"


def _counts_by_warehouse(years, match, hint=""):
    """Web sales count per warehouse first: the few counts join, however the keys must match."""
    return (f"select {hint} coalesce(sum(s.n), 0) as cnt from (select ws_warehouse_sk, count(*) as n from web_sales "
            f"join date_dim on d_date_sk = ws_sold_date_sk {years} group by ws_warehouse_sk) s "
            f"join warehouse w on {match}")


def _counts_at_least(years):
    """Web sales of warehouses numbered at least as high as each warehouse, without pairs.

    Keys of both sides are counted and put in order; ranges of 4,096 keys are summed up from the
    top, and inside a range a running sum goes through its keys.
    """
    return ("with keys as (select k, sum(sold) as sold, sum(houses) as houses from ("
            f"select ws_warehouse_sk as k, 1L as sold, 0L as houses from web_sales join date_dim on d_date_sk = ws_sold_date_sk {years} "
            "union all select w_warehouse_sk, 0L, 1L from warehouse) where k is not null group by k), "
            "ranges as (select k div 4096 as r, sum(sold) as sold from keys group by k div 4096), "
            "above as (select r, coalesce(sum(sold) over (order by r desc rows between unbounded preceding and 1 preceding), 0) as higher from ranges), "
            "inside as (select k div 4096 as r, houses, sum(sold) over (partition by k div 4096 order by k desc rows unbounded preceding) as sold from keys) "
            "select coalesce(sum(houses * (sold + higher)), 0) as cnt from inside join above using (r)")


def _triples(date_filter, store_filter=""):
    """Customer, item and day sold both by catalog and in stores."""
    return ("select count(*) as cnt from ("
            "select cs_sold_date_sk, cs_bill_customer_sk, cs_item_sk from catalog_sales "
            f"join date_dim on d_date_sk = cs_sold_date_sk {date_filter} intersect "
            "select ss_sold_date_sk, ss_customer_sk, ss_item_sk from store_sales "
            f"join date_dim on d_date_sk = ss_sold_date_sk {date_filter} {store_filter}) both_channels")


def _returned(date_filter, price_filter):
    return ("select count(*) as cnt from store_sales s "
            f"join date_dim on d_date_sk = ss_sold_date_sk {date_filter} "
            "left join store_returns r on r.sr_item_sk = s.ss_item_sk "
            f"and r.sr_ticket_number = s.ss_ticket_number {price_filter}")


MERGE = "/*+ merge(w) */"
AS_FLOAT = "cast(s.ws_warehouse_sk as float) = cast(w.w_warehouse_sk as float)"
EARLY_1999 = "where d_year = 1999 and d_dom <= 4"

# Per job: the statement over whole tables, the statement over trimmed extracts, the extracts.
SPECS = {
    "intersect": (_triples(EARLY_1999), _triples(""), {
        "date_dim": f"select d_date_sk from date_dim {EARLY_1999}",
        "store_sales": "select ss_sold_date_sk, ss_customer_sk, ss_item_sk from store_sales",
        "catalog_sales": "select cs_sold_date_sk, cs_bill_customer_sk, cs_item_sk from catalog_sales"}),
    "wide_aggregate": (_wide_aggregate(), None, {"catalog_sales": ""}),
    "left_join": (_returned("and d_year = 1999", "where ss_sales_price >= 10.00"), _returned("", ""), {
        "date_dim": "select d_date, d_date_sk from date_dim where d_year = 1999",
        "store_sales": "select ss_ticket_number, ss_item_sk, ss_customer_sk, ss_sales_price, ss_sold_date_sk "
                       "from store_sales where ss_sales_price >= 10.00",
        "store_returns": "select sr_ticket_number, sr_item_sk, sr_returned_date_sk from store_returns"}),
    "merge_join": (_counts_by_warehouse("where d_year = 2000", AS_FLOAT, MERGE), _counts_by_warehouse("", AS_FLOAT, MERGE), {
        "web_sales": "select ws_sold_date_sk, ws_warehouse_sk from web_sales",
        "warehouse": "select w_warehouse_sk from warehouse",
        "date_dim": "select d_date_sk from date_dim where d_year = 2000"}),
    "theta_join": (_counts_at_least("where d_year between 2000 and 2001"), _counts_at_least(""), {
        "web_sales": "select ws_sold_date_sk, ws_warehouse_sk from web_sales",
        "warehouse": "select w_warehouse_sk from warehouse",
        "date_dim": "select d_date_sk from date_dim where d_year between 2000 and 2001"}),
}


def job_of(name: str, mode: str, profitable_only: bool = False) -> dict:
    """The job in mode ``np`` (whole tables), ``pp`` (trimmed extracts) or ``fp`` (answered at the source).

    ``profitable_only`` keeps only profitable store sales in the trimmed ``intersect`` extract, as
    the reference's own trimmed job does; it changes the answer.
    """
    whole, trimmed, extracts = SPECS[name]
    if mode == "np":
        datasets = {x: {"table_schema": x, "query": f"select * from {x}"} for x in extracts}
        return {"name": f"{name}_np", "type": "no-pushdown", "datasets": datasets, "spark_sql": whole}
    if mode == "pp" and trimmed:
        datasets = {x: {"table_schema": x, "query": q} for x, q in extracts.items()}
        if profitable_only and name == "intersect":
            datasets["store_sales"]["query"] += " where ss_net_profit > 0"
        return {"name": f"{name}_pp", "type": "partial-pushdown", "datasets": datasets, "spark_sql": trimmed}
    if mode == "fp":
        return {"name": f"{name}_fp", "type": "full-pushdown", "spark_sql": "select * from pushdown",
                "datasets": {"pushdown": {"table_schema": "pushdown", "query": whole}}}
    raise ValueError(f"{name} has no mode {mode!r}")


def on_star(name: str, mode: str):
    """The job with the star as its source."""
    def build(t: Star) -> DataFrame:
        session = t.spark.newSession()
        own = t.in_session(session)
        source = {x: own[x] for x in SPECS[name][2]}
        job = job_of(name, mode)
        folder = own.once(f"staged/{name}_{mode}", lambda path: stage(session, job, readers.tables(source), path))
        return answer(session, job, folder)
    return build


for _name, (_whole, _trimmed, _extracts) in SPECS.items():
    _cols = ([(f"{f}_cs_{m}", "i" if f == "count" else "n") for m in MONEY for f in ("min", "max", "avg", "sum", "count")]
             if _name == "wide_aggregate" else [("cnt", "i")])
    for _mode in ("np", "pp", "fp"):
        if _mode != "pp" or _trimmed:
            REGISTRY[f"staged_{_name}_{_mode}"] = Query(f"staged_{_name}_{_mode}", on_star(_name, _mode), _cols)
