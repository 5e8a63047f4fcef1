"""CSV and JSON sources, and rows out of nested JSON payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom._columns import col
from tabloom.operators.ordering import head

# Accepted encodings and their Java names.
ENCODINGS = {
    "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1",
    "gbk": "GBK", "shift-jis": "Shift_JIS",
}
# Cell texts that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
_DECIMAL = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|-inf)\s*$"


def _encoding(spark: SparkSession, name: str) -> str:
    if name not in ENCODINGS:
        raise ValueError(f"unknown encoding: {name}")
    if name in ("gbk", "shift-jis"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return ENCODINGS[name]


def infer_types(df: DataFrame) -> DataFrame:
    """Numbers and booleans from text columns, decided by one aggregate over all rows.

    A whole-number column with missing cells becomes double, texts stay texts.
    """
    tests = []
    for i, name in enumerate(df.columns):
        c = col(name)
        tests += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(c.rlike(_WHOLE), 1)).alias(f"w{i}"),
            F.count(F.when(c.rlike(_DECIMAL), 1)).alias(f"d{i}"),
            F.count(F.when(c.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)).alias(f"b{i}"),
        ]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *tests).first()
    typed = []
    for i, name in enumerate(df.columns):
        filled, c = found[f"n{i}"], col(name)
        if filled and found[f"w{i}"] == filled:
            c = F.trim(c).cast("bigint" if filled == found["rows"] else "double")
        elif filled and found[f"d{i}"] == filled:
            c = F.trim(c).try_cast("double")
        elif filled and found[f"b{i}"] == filled == found["rows"]:
            c = F.lower(c) == "true"
        typed.append(c.alias(name))
    return df.select(*typed)


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8-sig",
    delimiter: str = ",",
    max_rows: int = 0,
    order_by=None,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV files, drop rows whose cells are all missing, keep the first n.

    ``multi_line`` accepts line breaks inside quoted cells; such a file cannot be
    split and is one task, so it has to be asked for. With a
    ``schema`` no inference pass is made. ``max_rows`` needs ``order_by``
    unless any n rows will do.
    """
    reader = spark.read.options(
        header=True, sep="\t" if delimiter == "\\t" else delimiter,
        encoding=_encoding(spark, encoding), multiLine=multi_line, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if schema is not None:
        df = reader.schema(schema).csv(path).na.drop("all")
    else:
        raw = reader.csv(path)
        raw = raw.select(*[F.when(~col(c).isin(*MISSING), col(c)).alias(c) for c in raw.columns])
        df = infer_types(raw.na.drop("all"))
    if max_rows > 0:
        df = head(df, max_rows, order_by) if order_by else df.limit(max_rows)
    return df


def _variant_type_to_ddl(text: str) -> str:
    """Type text of ``schema_of_variant_agg`` as a column type."""
    text = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", text).replace("OBJECT<", "STRUCT<")
    return text.replace("VOID", "STRING").replace("VARIANT", "STRING")


def payload_type(df: DataFrame, payload_col: str) -> str:
    """Common type of all payloads, found by one distributed aggregate."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(payload_col))).alias("t")).first()["t"]
    return _variant_type_to_ddl(found or "STRING")


def _walk(value: Column, kind: T.DataType, json_path: str) -> tuple[Column, T.DataType]:
    """Follow a dot path: names into objects, digits into lists; others stay put."""
    for key in [k for k in json_path.split(".") if k]:
        if isinstance(kind, T.StructType):
            if key not in kind.fieldNames():
                raise ValueError(f"path member not found: {key}")
            value, kind = value.getField(key), kind[key].dataType
        elif isinstance(kind, T.ArrayType) and key.isdigit():
            value, kind = F.try_element_at(value, F.lit(int(key) + 1)), kind.elementType
    return value, kind


def flatten_payloads(
    df: DataFrame,
    payload_col: str,
    json_path: str = "",
    orient: str = "auto",
    keep=(),
    schema: str | None = None,
) -> DataFrame:
    """Rows out of one JSON payload per row.

    A list gives a row per item, an object of lists a row per position, any
    other object one row, a scalar the column ``value``. ``keep`` names columns
    of ``df`` to carry along; ``schema`` (a type text) saves the inference pass.
    """
    if orient not in ("auto", "records", "columns"):
        raise ValueError(f"unknown orient: {orient}")
    kind_text = schema or payload_type(df, payload_col)
    kind = T._parse_datatype_string(f"v {kind_text}")["v"].dataType
    wrapped = F.concat(F.lit('{"v":'), col(payload_col), F.lit("}"))
    value = F.from_json(wrapped, T.StructType([T.StructField("v", kind)]))["v"]
    value, kind = _walk(value, kind, json_path)
    kept = [col(c) for c in keep]
    if isinstance(kind, T.ArrayType):
        rows = df.select(*kept, F.explode(value).alias("_item"))
        if isinstance(kind.elementType, T.StructType):
            return rows.select(*kept, "_item.*")
        return rows.select(*kept, F.col("_item").alias("0"))
    if isinstance(kind, T.StructType):
        lists = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
        if lists and orient in ("auto", "columns"):
            zipped = F.arrays_zip(*[value.getField(n).alias(n) for n in lists])
            rows = df.select(*kept, value.alias("_v"), F.explode(zipped).alias("_item"))
            cells = [
                (F.col("_item").getField(n) if n in lists else F.col("_v").getField(n)).alias(n)
                for n in kind.fieldNames()
            ]
            return rows.select(*kept, *cells)
        return df.select(*kept, value.alias("_v")).select(*kept, "_v.*")
    return df.select(*kept, value.alias("value"))


def read_json(
    spark: SparkSession, path: str, json_path: str = "", orient: str = "records",
    json_lines: bool = False, schema: str | None = None,
) -> DataFrame:
    """One JSON document per file, or one per line with ``json_lines``."""
    text = spark.read.text(path, wholetext=not json_lines)
    return flatten_payloads(text.filter("trim(value) <> ''"), "value", json_path, orient, schema=schema)


def profile_source(df: DataFrame, rows: int = 5) -> dict:
    from tabloom.operators.views import profile

    return profile(df, rows)
