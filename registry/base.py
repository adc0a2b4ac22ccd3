"""Registration of queries and small helpers for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic import fixtures


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None


class Tables:
    """Derived tables of one scale factor by attribute name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Query] = {}


def query(sql: str | Callable[[], str] | None = None, needs: tuple[str, ...] = ()):
    """Register the decorated function under its name. ``sql`` follows a WITH clause that defines ``needs``."""

    def text() -> str:
        body = sql() if callable(sql) else sql
        if not needs:
            return body
        joiner = ",\n" if body.lstrip().startswith("--more") else "\n"
        return fixtures.with_tables(*needs) + joiner + body.replace("--more", "", 1)

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), None if sql is None else text)
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The same columns with the named doubles rounded; minus zero becomes zero."""

    def one(c: str) -> Column:
        return (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if c in names else F.col(f"`{c}`")

    return df.select(*[one(c) for c in df.columns])
