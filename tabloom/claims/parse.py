"""Claims and verdicts out of parsed model responses (doc_id, json)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import strip
from tabloom.claims.fields import GEO_FIELDS, OCR_FIELDS, RECORD_FIELDS, TYPE_SPECIFIC
from tabloom.enrich.responses import get
from tabloom.functions.evidence import sanitize_box
from tabloom.session import dealt, grown, row_tasks

#: Claims that one task joins.
CLAIM_ROWS = 100_000

_EMPTY_JSON = ("null", "[]", '""', "0", "0.0", "false", "{}")


def _truthy(v: Column) -> Column:
    """A JSON member counts as true unless absent, null, false, zero or empty."""
    return v.isNotNull() & ~F.to_json(v).isin(*_EMPTY_JSON)


def _members(v: Column) -> Column:
    """Members of a variant object as map name -> variant; null for anything else."""
    return v.try_cast("map<string,variant>")


def _text(v: Column, default: str = "", size: int | None = None) -> Column:
    text = F.coalesce(v.try_cast("string"), F.to_json(v))
    return F.when(_truthy(v), F.substring(text, 1, size) if size else text).otherwise(F.lit(default))


def _value_text(v: Column) -> Column:
    """A claimed value as text: lists joined, booleans yes/no, null stays null."""
    kind = F.schema_of_variant(v)
    items = F.transform(v.try_cast("array<variant>"), lambda x: F.when(_truthy(x), x.try_cast("string")))
    return (
        F.when(F.is_variant_null(v), F.lit(None).cast("string"))
        .when(kind.startswith("ARRAY"), F.array_join(F.array_compact(items), ", "))
        .when(kind == "BOOLEAN", F.when(F.to_json(v) == "true", "yes").otherwise("no"))
        .otherwise(F.coalesce(v.try_cast("string"), F.to_json(v)))
    )


def _placed(responses: DataFrame, placed: bool) -> DataFrame:
    return responses if placed else dealt(responses, "doc_id")


def _free_entry(e: Column) -> Column:
    prefixed = e["key"].startswith("ts_")
    name = F.when(prefixed, F.substr(e["key"], F.lit(4))).otherwise(e["key"])
    return F.struct(
        prefixed.cast("int").alias("rank"), F.concat(F.lit(TYPE_SPECIFIC), name).alias("field"),
        e["value"].alias("entry"),
    )


def flatten_claims(parsed: DataFrame, placed: bool = False) -> DataFrame:
    """One row per grounded claim of a response.

    The response holds ``fields`` and ``type_specific`` objects, or the fields at
    the top level. Unknown fields and entries without value or box are dropped.
    With ``placed`` the responses were built from rows ``dealt`` by doc_id, so that
    their texts need not travel again; the result is the same.
    """
    known = list(RECORD_FIELDS)
    # A task takes a bounded number of responses, whose claims it groups without a further shuffle.
    # Every stage names what the next one uses more than once.
    top = _placed(parsed.select("doc_id", "json"), placed).select("doc_id", F.try_parse_json("json").alias("_top"))
    parts = top.select(
        "doc_id", "_top",
        _members(get(F.col("_top"), "fields")).alias("_fields"),
        _members(get(F.col("_top"), "type_specific")).alias("_free"),
    )
    nested = F.coalesce(F.size("_fields") > 0, F.lit(False))
    fixed = F.map_filter(
        F.when(nested, F.col("_fields")).otherwise(_members(F.col("_top"))), lambda k, v: k.isin(*known)
    )
    # A name with the prefix ranks after the same name without it.
    entries = F.concat(
        F.transform(
            F.map_entries(fixed),
            lambda e: F.struct(F.lit(0).alias("rank"), e["key"].alias("field"), e["value"].alias("entry")),
        ),
        F.coalesce(F.transform(F.map_entries("_free"), _free_entry), F.array()),
    )
    rows = parts.select("doc_id", F.inline(entries).alias("_order", "field", "entry")).filter(
        F.col("field") != TYPE_SPECIFIC
    )
    taken = rows.filter(_members(F.col("entry")).isNotNull()).select(
        "doc_id", "field", "_order",
        *[get(F.col("entry"), name).alias(f"_{name}") for name in
          ("value", "evidence_bbox", "evidence_text", "evidence_kind")],
    ).filter(F.col("_value").isNotNull() & _truthy(F.col("_evidence_bbox")))
    claims = taken.select(
        "doc_id", "field", "_order",
        _value_text(F.col("_value")).alias("value"),
        F.col("_evidence_bbox").try_cast("array<double>").alias("_box"),
        _text(F.col("_evidence_text"), size=500).alias("evidence_text"),
        _text(F.col("_evidence_kind"), "direct_quote").alias("evidence_kind"),
    ).select(
        "doc_id", "field", "_order",
        F.struct("value", sanitize_box(F.col("_box")).alias("evidence_bbox"), "evidence_text", "evidence_kind")
        .alias("_claim"),
    )
    # A name given twice (with and without prefix) keeps one entry.
    return claims.groupBy("doc_id", "field").agg(F.max_by("_claim", "_order").alias("_claim")).select(
        "doc_id", "field", "_claim.*"
    )


def checkable(claims: DataFrame) -> DataFrame:
    """Claims with a value other than blank or ``N/A``."""
    text = strip(F.coalesce("value", F.lit("")))
    return claims.filter((text != "") & (F.upper(text) != "N/A"))


def domain_of(field: Column) -> Column:
    return F.when(field.isin(*GEO_FIELDS), "geo").when(field.isin(*OCR_FIELDS), "ocr").otherwise("visual")


def route_claims(claims: DataFrame) -> DataFrame:
    """Add the reviewing ``domain``: geo, ocr or visual."""
    return claims.withColumn("domain", domain_of(F.col("field")))


def parse_verdicts(parsed: DataFrame, sent: DataFrame, placed: bool = False) -> DataFrame:
    """(doc_id, field, ok, issue, what_you_see) for claims that were really sent.

    ``parsed`` has doc_id and json, and domain when reviewers work per domain; a
    response without JSON gives no verdict. ``placed`` as in :func:`flatten_claims`.
    """
    keys = ["doc_id", "domain"] if "domain" in parsed.columns else ["doc_id"]
    top = _placed(parsed.select(*keys, "json"), placed).select(*keys, F.try_parse_json("json").alias("_top"))
    inner = top.select(*keys, F.coalesce(get(F.col("_top"), "verdicts"), F.col("_top")).alias("_inner"))
    rows = inner.select(*keys, F.explode(_members(F.col("_inner"))).alias("field", "entry"))
    taken = rows.filter(_members(F.col("entry")).isNotNull()).select(
        *keys, "field", *[get(F.col("entry"), n).alias(f"_{n}") for n in ("ok", "issue", "what_you_see")]
    )
    verdicts = taken.select(
        *keys, "field", (F.col("_ok").isNull() | _truthy(F.col("_ok"))).alias("ok"),
        _text(F.col("_issue"), size=400).alias("issue"),
        _text(F.col("_what_you_see"), size=400).alias("what_you_see"),
    )
    # tasks of the join follow the number of claims sent, since their compressed bytes say little about it
    place = [*keys, "field"]
    sent_keys = route_claims(sent).select(*place)
    tasks = row_tasks(sent_keys, CLAIM_ROWS)
    taken, known = verdicts.repartition(tasks, *place), sent_keys.repartition(tasks, *place)
    return taken.join(grown(known), place, "left_semi").select("doc_id", "field", "ok", "issue", "what_you_see")


def correction_feedback(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, feedback): flagged claims with the reviewer's reasons as JSON text.

    A document has at most as many entries as it has fields.
    """
    flagged = verdicts.filter(~F.col("ok")).join(grown(claims), ["doc_id", "field"], "left")
    entry = F.struct(
        "field", F.col("value").alias("your_value"),
        F.col("evidence_bbox").alias("your_evidence_bbox"),
        F.col("evidence_text").alias("your_evidence_text"),
        F.col("issue").alias("critic_says_wrong_because"),
        F.col("what_you_see").alias("critic_sees_in_that_bbox"),
    )
    return flagged.groupBy("doc_id").agg(
        F.to_json(F.array_sort(F.collect_list(entry)), {"ignoreNullFields": "false"}).alias("feedback")
    )
