"""Query registry: one declaration gives a query's output columns, order and limit.

``cols`` lists the output as ``name`` (text), ``name:i`` (bigint), ``name:n`` (double) or
``name:d`` (date).  ``order`` lists sort keys, ``-name`` for descending; the remaining columns
break ties, so a limited result is always the same rows.  A sort key with a leading underscore is
used for ordering only.  ``bind`` holds parameter values suited to the order data where the
function's own defaults, the reference's constants, would select nothing.  ``on_star`` is False
for queries that read the order tables as they are.  Nulls sort first ascending and last
descending, Spark's own rule, unless ``nulls`` says "first" or "last" for every key.
"""

from __future__ import annotations

import pathlib
import re
from dataclasses import dataclass, field, replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.plans import star
from starling.plans.warehouse import Star

TYPES = {"i": "bigint", "n": "double", "d": "date", "s": "string"}
ORACLE = pathlib.Path(__file__).resolve().parents[2] / "oracle"


@dataclass
class Query:
    name: str
    build: Callable
    cols: list[tuple[str, str]]
    order: list[str] = field(default_factory=list)
    limit: int | None = None
    bind: dict = field(default_factory=dict)
    on_star: bool = True
    nulls: str = ""

    def nulls_first(self, down: bool) -> bool:
        return {"first": True, "last": False}.get(self.nulls, not down)

    def sort_keys(self, order: list[str] | None = None) -> list[tuple[str, bool]]:
        keys = [(k.lstrip("-"), k.startswith("-")) for k in order or self.order]
        if self.limit is not None:
            keys += [(c, False) for c, _ in self.cols if c not in {k for k, _ in keys}]
        return keys

    def choose(self, name: str, columns: str, order: str = "", nulls: str = "") -> "Query":
        """The query with some of its output columns, chosen at run time, sorted by them."""
        kinds = dict(self.cols)
        for key in columns.split() + [k.lstrip("-") for k in order.split() if not k.lstrip("-").startswith("_")]:
            allowed(key, " ".join(kinds))
        kept = [(x, kinds[x]) for x in columns.split()]
        return replace(self, name=name, cols=kept, order=order.split() or [k for k in self.order if k.lstrip("-") in dict(kept)],
                       nulls=nulls or self.nulls)

    def __call__(self, tables, order_by: str | None = None, **params) -> DataFrame:
        """The answer on any mapping of star tables; ``order_by`` names other sort keys."""
        df = self.build(tables, **params)
        order = order_by.split() if order_by else self.order
        for key in order:
            allowed(key.lstrip("-"), " ".join([c for c, _ in self.cols] + self.order))
        hidden = [k.lstrip("-") for k in order if k.lstrip("-").startswith("_")]
        df = df.select(*[F.col(c).cast(TYPES[t]).alias(c) for c, t in self.cols], *hidden)
        if order:
            place = {(False, True): F.asc_nulls_first, (False, False): F.asc_nulls_last,
                     (True, True): F.desc_nulls_first, (True, False): F.desc_nulls_last}
            df = df.orderBy(*[place[down, self.nulls_first(down)](c) for c, down in self.sort_keys(order)])
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.drop(*hidden)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query on the star of ``sf_dir``, with the parameters bound for that data."""
        return self(Star.of(spark, sf_dir), **self.bind)

    def oracle(self, body: str) -> str:
        body = body.strip().rstrip(";")
        entries = (star.oracle_prefix(body) if self.on_star else []) + [f"answer as ({body})"]
        picked = ", ".join(f"cast({c} as {TYPES[t]}) as {c}" for c, t in self.cols)
        sql = "with " + ",\n".join(entries) + f"\nselect {picked} from answer"
        if self.order:
            sql += " order by " + ", ".join(
                f"answer.{c} {'desc' if down else 'asc'} nulls {'first' if self.nulls_first(down) else 'last'}"
                for c, down in self.sort_keys())
        return sql + (f" limit {self.limit}" if self.limit is not None else "")


REGISTRY: dict[str, Query] = {}


def query(name: str, cols: str, order: str = "", limit: int | None = None, on_star: bool = True, **bind):
    """Register a ``(tables, **params) -> DataFrame`` function."""
    parsed = [(c.split(":") + ["s"])[:2] for c in cols.split()]

    def wrap(fn):
        q = Query(name, fn, [(c, t) for c, t in parsed], order.split(), limit, bind, on_star)
        REGISTRY[name] = q
        return q
    return wrap


def oracle_bodies() -> dict[str, str]:
    """``-- name: <query>`` sections of the oracle files; ``{{query}}`` stands for another section."""
    bodies = {}
    for path in sorted(ORACLE.glob("*.sql")):
        for part in re.split(r"^-- name:", path.read_text(), flags=re.M)[1:]:
            name, _, sql = part.partition("\n")
            bodies[name.strip()] = sql
    return {name: re.sub(r"\{\{(\w+)\}\}", lambda m: bodies[m[1]].strip().rstrip(";"), sql) for name, sql in bodies.items()}


def allowed(value: str, options: str) -> str:
    """A run-time choice of column or aggregate, checked against a fixed list."""
    if value not in options.split():
        raise ValueError(f"{value!r} is not one of: {options}")
    return value
