"""Loading tables and small SQL pieces used by several queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_port(ports: dict[str, DataFrame]) -> DataFrame:
    """All output ports in one table, labelled."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("port", F.lit(name)) for name, df in ports.items()],
    )


def registry():
    """Two dicts and a decorator that fills them."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def register(name: str, statement: str | None = None):
        def keep(fn):
            queries[name] = fn
            if statement is not None:
                sql[name] = statement
            return fn

        return keep

    return queries, sql, register


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def sql_words(x: str) -> str:
    """White-space separated tokens of a text."""
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"
