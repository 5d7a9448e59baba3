"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.plans.views import VIEWS, table, view, with_views
from engram.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Data:
    """Lazy access to tables and views: `d.segments`, `d.documents`, …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name) if name in VIEWS else table(self.spark, self.sf_dir, name)

    def wide(self, name: str) -> DataFrame:
        """The table for heavy row work: spread over the cores when its few files would keep most of them idle."""
        return view(self.spark, self.sf_dir, name, wide=True) if name in VIEWS else spread(getattr(self, name))


def query(name: str, check: str | None = None):
    """Register `fn(d: Data) -> DataFrame`; `check` is the same result in plain SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Data(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name] = with_views(check)
        return fn

    return register
