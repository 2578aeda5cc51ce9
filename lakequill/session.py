"""A session runs statements of the dialect over a catalog, in a Spark session of its own: the caller's settings stay as they are."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from .config import ExecConfig
from .errors import from_spark
from .plans import binder, explain
from .sources.catalog import Catalog


@dataclass
class Rows:
    """A query's result."""

    columns: list[str]
    rows: list[Row]
    elapsed: float

    @property
    def num_rows(self) -> int:
        return len(self.rows)


@dataclass
class Text:
    """What EXPLAIN prints."""

    text: str


def split_explain(sql: str) -> tuple[str, str]:
    """(query, explain or analyze; the statement behind the prefix)."""
    m = re.match(r"\s*EXPLAIN(\s+ANALYZE)?\b", sql, re.I)
    if m is None:
        return "query", sql
    return ("analyze" if m[1] else "explain"), sql[m.end() :]


class Session:
    def __init__(self, spark: SparkSession, data: str | Catalog | dict[str, DataFrame], config: ExecConfig | None = None, tables: list[str] | None = None):
        """``data``: a folder, a catalog or DataFrames by name; ``tables``: the tables of a folder that are needed, default all."""
        self.config = config or ExecConfig()
        self.spark = spark.newSession()
        for key, value in self.config.session_confs().items():
            self.spark.conf.set(key, value)
        if isinstance(data, str):
            self.catalog = Catalog.open(self.spark, data, names=tables)
        else:
            self.catalog = (Catalog.from_tables(spark, data) if isinstance(data, dict) else data).adopted(self.spark)

    def bind(self, sql: str) -> binder.Query:
        try:
            return binder.bind(self.catalog, sql)
        except Exception as e:  # noqa: BLE001
            raise from_spark(e) from e

    def dataframe(self, sql: str) -> DataFrame:
        """The query as a DataFrame, not run."""
        return self.bind(sql).frame

    def logical_plan(self, sql: str) -> str:
        return self.dataframe(sql)._jdf.queryExecution().optimizedPlan().toString()

    def physical_plan(self, sql: str) -> str:
        return self.dataframe(sql)._jdf.queryExecution().executedPlan().toString()

    def stream(self, sql: str) -> Iterator[Row]:
        """The rows of a query one partition at a time: the driver never holds all of them."""
        query = self.bind(sql)
        try:
            yield from query.frame.toLocalIterator(prefetchPartitions=True)
        except Exception as e:  # noqa: BLE001
            raise from_spark(e) from e

    def run(self, sql: str) -> Rows | Text:
        kind, body = split_explain(sql)
        query = self.bind(body)
        try:
            if kind == "explain":
                return Text(explain.explained(query))
            if kind == "analyze":
                return Text(explain.analyzed(query))
            began = time.perf_counter()
            rows = query.frame.collect()
            return Rows(query.columns, rows, time.perf_counter() - began)
        except Exception as e:  # noqa: BLE001
            raise from_spark(e) from e
