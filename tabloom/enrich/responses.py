"""From model responses to clean JSON and from JSON to columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import strip
from tabloom.functions.text import clean_cell

OK, REPAIRED, FAILED = "ok", "repaired", "failed"


def clean_response(c: Column) -> Column:
    """Drop thinking sections, code fences and trailing commas."""
    text = strip(F.regexp_replace(strip(c), r"(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    text = strip(F.regexp_replace(text, r"\s*```\s*$", ""))
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


_TOKEN = re.compile(r'\s+|[{}\[\],:]|"(?:[^"\\]|\\.)*(?P<close>")?|[^\s{}\[\],:"]+', re.DOTALL)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])|\\')
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def close_cut_json(text: str) -> str:
    """Complete a JSON text that stops early.

    One pass reads the text by its grammar. Each open container remembers where its last complete entry
    ended; at the end of the text everything behind that is cut off, and the containers are closed from the
    inside out. A text value that was being received in an object is kept as far as it came; a key without
    value and an unfinished list item are not.
    """
    out: list[str] = []
    stack: list[list] = []  # closing bracket, pieces up to the last complete entry, waiting for a key
    received = False
    for m in _TOKEN.finditer(text):
        token, last = m[0], m.end() == len(text)
        if token in ("{", "["):
            out.append(token)
            stack.append(["}" if token == "{" else "]", len(out), token == "{"])
            continue
        if token[0] == '"':
            token = _ESCAPE.sub(lambda e: e[0] if e[1] else "\\\\", token)
            if not m["close"]:
                if stack and stack[-1][0] == "}" and not stack[-1][2]:
                    out.append(token + '"')
                    stack[-1][1] = len(out)
                break
        elif last and received and stack and token not in ("}", "]", ",", ":") and not token.isspace() and not _SCALAR.fullmatch(token):
            break
        out.append(token)
        if token.isspace():
            continue
        if token in ("}", "]"):
            if stack:
                stack.pop()
            if not stack:
                return "".join(out)
        elif token == ",":
            if stack:
                stack[-1][2] = stack[-1][0] == "}"
            continue
        elif token == ":":
            if stack:
                stack[-1][2] = False
            continue
        if stack and not stack[-1][2]:
            stack[-1][1], received = len(out), True
    if stack:
        del out[stack[-1][1] :]
    return "".join(out) + "".join(closing for closing, _, _ in reversed(stack))


def recover_json(cleaned: str) -> str | None:
    """First JSON object of an untidy text as valid JSON, ``None`` when hopeless."""
    decoder = json.JSONDecoder(strict=False)
    start = cleaned.find("{")
    if start < 0:
        try:
            return json.dumps(decoder.decode(cleaned), ensure_ascii=False)
        except ValueError:
            return None
    body = cleaned[start:]
    for attempt in (lambda: cleaned, lambda: body, lambda: close_cut_json(body)):
        try:
            return json.dumps(decoder.raw_decode(attempt())[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``json`` (valid JSON text or null) and ``status``.

    Tidy responses are recognised on the JVM; only the others pass through the
    Python recovery, in Arrow batches.
    """

    @F.pandas_udf("string")
    def recover(texts: pd.Series) -> pd.Series:
        return texts.map(recover_json, na_action="ignore")

    text = F.coalesce(F.col(response), F.lit(""))
    df = df.withColumn("_clean", clean_response(text))
    # A text that starts with an object counts by its first object.
    tidy = F.try_parse_json("_clean").isNotNull() & F.col("_clean").startswith("{")
    df = df.withColumn("_tidy", F.coalesce(tidy, F.lit(False)))
    untidy = F.when(~F.col("_tidy") & (F.col("_clean") != ""), F.col("_clean"))
    df = df.withColumn("_fixed", recover(untidy))
    return df.withColumns(
        {
            "json": F.when(F.col("_tidy"), F.col("_clean")).otherwise(F.col("_fixed")),
            "status": F.when(F.col("_tidy"), OK).when(F.col("_fixed").isNotNull(), REPAIRED).otherwise(FAILED),
        }
    ).drop("_clean", "_tidy", "_fixed")


def split_failed(parsed: DataFrame) -> dict[str, DataFrame]:
    """Usable rows, and the quarantine of rows without any JSON."""
    return {
        "parsed": parsed.filter(F.col("status") != FAILED),
        "quarantine": parsed.filter(F.col("status") == FAILED),
    }


def get(v: Column, *path: str) -> Column:
    """A member of a variant object as variant; null when absent."""
    route = "$"
    for name in path:
        quote = '"' if "'" in name else "'"
        route += f"[{quote}{name}{quote}]"
    return F.try_variant_get(v, route, "variant")


def member(json_text: Column, *path: str) -> Column:
    """A member of a JSON text as variant; null when absent."""
    return get(F.try_parse_json(json_text), *path)


def _scalar_text(v: Column) -> Column:
    """Text of a JSON scalar; null, false, zero and '' are empty."""
    kind = F.schema_of_variant(v)
    text = v.try_cast("string")
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    zero = number & (v.try_cast("double") == 0)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")).otherwise(F.lit("")))
        .when(zero, F.lit(""))
        .otherwise(F.coalesce(text, F.to_json(v)))
    )


def variant_text(v: Column) -> Column:
    """Text of a JSON value: list items joined by ``, ``, scalars as they read."""
    items = v.try_cast("array<variant>")
    joined = F.array_join(F.filter(F.transform(items, _scalar_text), lambda t: t != ""), ", ")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.coalesce(F.when(is_list, joined), _scalar_text(v), F.lit(""))


def map_fields(df: DataFrame, mapping: dict[str, str], json_column: str = "json") -> DataFrame:
    """Add one clean text column per JSON field; missing fields are empty.

    The JSON is parsed once per row, each member is taken out once.
    """
    keys = list(mapping)
    names = [c for c in df.columns if c not in mapping.values()]
    df = df.withColumn("_parsed", F.try_parse_json(json_column))
    df = df.select(*[f"`{c}`" for c in names], *[get(F.col("_parsed"), k).alias(f"_m{i}") for i, k in enumerate(keys)])
    texts = [clean_cell(variant_text(F.col(f"_m{i}"))).alias(mapping[k]) for i, k in enumerate(keys)]
    return df.select(*[f"`{c}`" for c in names], *texts)


def unpack_results(
    parsed: DataFrame, members: DataFrame, index_key: str = "index", results_key: str = "results"
) -> DataFrame:
    """Give each packed row its own result object: (row_id, json).

    Results are matched by their index; unknown indexes are ignored, the later
    of two results with the same index wins, rows without a result get ``{}``.
    """
    whole = F.from_json("json", "map<string,string>")
    items = F.from_json(F.try_element_at(whole, F.lit(results_key)), "array<string>")
    one = parsed.select("batch_id", F.posexplode(items).alias("_pos", "item"))
    index = F.coalesce(
        member(F.col("item"), index_key).try_cast("string").try_cast("double"), F.lit(-1.0)
    ).cast("int")
    found = one.groupBy("batch_id", index.alias("position")).agg(F.max_by("item", "_pos").alias("item"))
    return members.join(found, ["batch_id", "position"], "left").select(
        "row_id", F.coalesce("item", F.lit("{}")).alias("json")
    )
