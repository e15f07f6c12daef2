"""Query catalog: every operator bound to the test tables, with SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkframe.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("scalars", "votes", "pages", "matching", "ordering", "rasters", "jobs", "logs")


def query(name: str, oracle: str | None = None):
    """Register fn(tables) -> DataFrame under name, with its SQL twin if there is one."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(Tables(spark, folder))
            # one integer and one float width, so results compare by value
            widths = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
            return df.selectExpr(*[f"CAST(`{c}` AS {widths[d]}) AS `{c}`" if d in widths else f"`{c}`" for c, d in df.dtypes])

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"inkframe.catalog.{m}")
