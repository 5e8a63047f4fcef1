"""Writing tables: CSV, JSON, chosen columns, and several ports at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import as_list, cell_text, col
from tabloom.operators.ordering import with_row_index
from tabloom.sources.files import _encoding

BOM = "﻿"


def write_csv(
    df: DataFrame, path: str, encoding: str = "utf-8", delimiter: str = ",",
    include_index: bool = False, order_by=None, mode: str = "overwrite",
) -> None:
    """Write a folder of CSV parts with a header each; quotes are doubled.

    ``include_index`` numbers the rows from 0 in the stated order. ``utf-8-sig``
    puts the byte order mark before every header.
    """
    if include_index:
        names = list(df.columns)
        df = with_row_index(df, order_by, "_index").select(F.col("_index").alias(" "), *[col(c) for c in names])
    cells = []
    for i, field in enumerate(df.schema.fields):
        kind, name = field.dataType, field.name
        label = BOM + name if i == 0 and encoding == "utf-8-sig" else name
        plain = isinstance(kind, (T.StringType, T.IntegralType, T.DecimalType))
        cell = col(name) if plain else F.when(col(name).isNotNull(), cell_text(df, name))
        cells.append(cell.alias(label))
    df.select(*cells).write.mode(mode).options(
        header=True, sep="\t" if delimiter == "\\t" else delimiter,
        encoding=_encoding(df.sparkSession, encoding), quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_json(df: DataFrame, path: str, orient: str = "records", mode: str = "overwrite") -> None:
    """Records: one JSON object per line. Columns: a folder per column with its cells, one per line, and their
    row numbers (rows in the order of their cells), so that a table of any size is written by all tasks."""
    if orient == "records":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    if orient != "columns":
        raise ValueError(f"unknown orient: {orient}")
    numbered = with_row_index(df.select(F.struct(*map(col, df.columns)).alias("r")), [F.to_json("r")], "row")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col("r").getField(c).alias("value")), {"ignoreNullFields": "false"}).alias("cell")) for c in df.columns])
    long = numbered.select("row", F.inline(cells))
    line = F.concat(F.lit('{"row":'), F.col("row").cast("string"), F.lit(","), F.substr("cell", F.lit(2)))
    long.select("column", line.alias("line")).write.mode(mode).partitionBy("column").text(path)


def export_columns(df: DataFrame, columns=None) -> DataFrame:
    """Choose, order and rename columns; unknown ones are skipped."""
    wanted = [c for c in as_list(columns) if c["source"] in df.columns]
    if not wanted:
        return df
    return df.select(*[col(c["source"]).alias(c.get("label") or c["source"]) for c in wanted])


def write_table(df: DataFrame, path: str, columns=None, mode: str = "overwrite") -> None:
    export_columns(df, columns).write.mode(mode).parquet(path)


def write_routed(df: DataFrame, path: str, port: str = "_port", kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write all ports of a tagged table (``routing.tagged``) in one pass over it: a folder ``_port=name`` for each.

    The parent is computed once, however many ports there are. Rows without a port are refused.
    """
    named = F.coalesce(col(port), F.raise_error(F.lit("a row without a port")).cast("string"))
    df.withColumn(port, named).write.mode(mode).partitionBy(port).format(kind).save(path)


def read_routed(like: DataFrame, path: str, names, port: str = "_port", kind: str = "parquet") -> dict[str, DataFrame]:
    """The ports in ``path`` as tables with the columns of ``like``; a port that got no row is empty."""
    fields = [f for f in like.schema.fields if f.name != port]
    schema = T.StructType([*fields, T.StructField(port, T.StringType())])
    table = like.sparkSession.read.format(kind).schema(schema).load(path)
    return {name: table.filter(col(port) == name).drop(port) for name in names}


def write_ports(ports: dict[str, DataFrame], paths: dict[str, str], write=write_table) -> None:
    """Write tables of different kinds to their own places, one after the other. Ports of one table that differ only in
    their rows are written in one pass by :func:`write_routed`."""
    for name, path in paths.items():
        write(ports[name], path)
