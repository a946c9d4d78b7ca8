"""Where queries register themselves, and tables of literal rows for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "timestamp": "TIMESTAMP"}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def quote(v: str) -> str:
    return _literal(v)


class Rows:
    """Literal rows as a DataFrame and as SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.fields = [f.strip().split(" ", 1) for f in schema.split(", ")]

    def df(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(f"c{i}" for i in range(len(self.fields)))
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        out = ", ".join(f"c{i}::{SQL_TYPES[t]} AS {n}" for i, (n, t) in enumerate(self.fields))
        return f"(SELECT {out} FROM (VALUES {body}) v({names}))"


class Over(Rows):
    """Rows that are made of the given tables, with literal ones for what the tables don't have, as a DataFrame and as SQL."""

    def __init__(self, schema: str, rows: list[tuple], made: Callable[[SparkSession, str], DataFrame], sql: str):
        super().__init__(schema, rows)
        self.made, self.made_sql = made, sql

    def df(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        own = self.made(spark, sf)
        return own.select(*[F.col(n).cast(t).alias(n) for n, t in self.fields]).union(super().df(spark))

    @property
    def sql(self) -> str:
        out = ", ".join(f"{n}::{SQL_TYPES[t]} AS {n}" for n, t in self.fields)
        return f"(SELECT {out} FROM ({self.made_sql}) UNION ALL SELECT {', '.join(n for n, _ in self.fields)} FROM {super().sql})"
