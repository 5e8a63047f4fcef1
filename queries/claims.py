"""Claims about parts: extraction responses, verdicts and answers derived from the part table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from queries.common import registry, table
from tabloom.claims import fields as names
from tabloom.claims import parse, record, rounds
from tabloom.claims.analysis import map_analysis as analyse
from tabloom.session import checkpointed, dealt, grown

QUERIES, SQL, register = registry()

_BOX = "[1, 2, 30, 40]"
# One extraction response per part; every third one uses the flat layout.
_RESPONSES = f"""
    SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS flat, concat(
        '"title": {{"value": "', p_name, '", "evidence_bbox": {_BOX}, "evidence_text": "seen"}}, ',
        '"date_year": {{"value": ', 1800 + p_size, ', "evidence_bbox": [95, 0, 10, 0.5], "evidence_kind": "computed"}}, ',
        '"country": {{"value": ["North", "", "South', p_size % 4, '", "North"], "evidence_bbox": {_BOX}}}, ',
        '"has_insets": {{"value": ', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, ', "evidence_bbox": {_BOX}}}, ',
        '"projection": {{"value": " n/a", "evidence_bbox": {_BOX}}}, ',
        '"city": {{"value": null, "evidence_bbox": {_BOX}}}, ',
        '"scale_ratio": {{"value": "63360", "evidence_bbox": {_BOX}, "evidence_text": "scale bar", "evidence_kind": "computed"}}, ',
        '"bogus": {{"value": 1, "evidence_bbox": {_BOX}}}, "notes": {{"value": "no box"}}, "edition": "no entry"') AS body,
        concat('{{"ts_theme": {{"value": "', p_type, '", "evidence_bbox": [200, 5]}}, "datum": {{"value": 7, "evidence_bbox": {_BOX}}}}}')
        AS extra
    FROM part
"""
_PLAIN = f"""
    SELECT p_partkey AS doc_id, 'title' AS field, p_name AS value, 1.0 AS x, 30.0 AS w, 'seen' AS evidence_text, 'direct_quote' AS evidence_kind FROM part
    UNION ALL SELECT p_partkey, 'date_year', CAST(1800 + p_size AS VARCHAR), 90.0, 10.0, '', 'computed' FROM part
    UNION ALL SELECT p_partkey, 'country', 'North, South' || (p_size % 4) || ', North', 1.0, 30.0, '', 'direct_quote' FROM part
    UNION ALL SELECT p_partkey, 'has_insets', CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END, 1.0, 30.0, '', 'direct_quote' FROM part
    UNION ALL SELECT p_partkey, 'projection', ' n/a', 1.0, 30.0, '', 'direct_quote' FROM part
    UNION ALL SELECT p_partkey, 'city', NULL, 1.0, 30.0, '', 'direct_quote' FROM part
    UNION ALL SELECT p_partkey, 'scale_ratio', '63360', 1.0, 30.0, 'scale bar', 'computed' FROM part
    UNION ALL SELECT p_partkey, 'type_specific.theme', p_type, 0.0, 100.0, '', 'direct_quote' FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 'type_specific.datum', '7', 1.0, 30.0, '', 'direct_quote' FROM part WHERE p_partkey % 3 <> 0
"""


def _parts(spark, sf):
    """Parts dealt while their rows are narrow. Responses and answers are built behind this: a task that wrote those of a whole
    file into a shuffle of more than 200 tasks would hold all of them."""
    return dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")


def _parsed(spark, sf):
    _parts(spark, sf).createOrReplaceTempView("_claims_part")
    df = spark.sql(_RESPONSES.replace("FROM part", "FROM _claims_part"))
    nested = F.concat(F.lit('{"fields": {'), "body", F.lit('}, "type_specific": '), "extra", F.lit("}"))
    return df.select("doc_id", F.when(F.col("flat"), F.concat(F.lit("{"), "body", F.lit("}"))).otherwise(nested).alias("json"))


def _claims(spark, sf):
    """Claims are written once, as every later step reads them several times."""
    return checkpointed(parse.flatten_claims(_parsed(spark, sf), placed=True))


def _shown(claims):
    return claims.select(
        "doc_id", "field", "value", F.col("evidence_bbox")[0].alias("x"), F.col("evidence_bbox")[2].alias("w"),
        "evidence_text", "evidence_kind")


_CAST = "doc_id, field, value, CAST(x AS DOUBLE) AS x, CAST(w AS DOUBLE) AS w, evidence_text, evidence_kind"
_USABLE = "value IS NOT NULL AND upper(trim(value)) NOT IN ('', 'N/A')"


@register("flatten_claims", f"SELECT {_CAST} FROM ({_PLAIN})")
def flatten_claims(spark, sf):
    return _shown(parse.flatten_claims(_parsed(spark, sf), placed=True))


@register("checkable_claims", f"SELECT {_CAST} FROM ({_PLAIN}) WHERE {_USABLE}")
def checkable_claims(spark, sf):
    return _shown(parse.checkable(_claims(spark, sf)))


def _list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


_DOMAIN = (
    f"CASE WHEN field IN ({_list(names.GEO_FIELDS)}) THEN 'geo' WHEN field IN ({_list(names.OCR_FIELDS)}) THEN 'ocr' "
    "ELSE 'visual' END")


@register("route_claims", f"SELECT doc_id, field, {_DOMAIN} AS domain FROM ({_PLAIN})")
def route_claims(spark, sf):
    return parse.route_claims(_claims(spark, sf)).select("doc_id", "field", "domain")


# Verdicts: the title is refused for every second part, the theme always, the country
# by a missing flag; a field that was never sent and a failed response give nothing.
_VERDICTS = f"""
    SELECT doc_id, field, ok, issue, what_you_see FROM (
        SELECT p_partkey AS doc_id, unnest(['title', 'date_year', 'country', 'type_specific.theme']) AS field,
               unnest([p_partkey % 2 = 0, p_size % 5 <> 0, true, false]) AS ok,
               unnest(['spelling', '', 'none given', 'not on map']) AS issue,
               unnest(['reads ' || p_name || '!', '', '', ' ']) AS what_you_see
        FROM part WHERE p_partkey % 10 <> 9)
    WHERE field <> 'type_specific.theme' OR doc_id % 3 <> 0
"""


def _verdict_responses(spark, sf):
    part = _parts(spark, sf)
    flag = F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("0")
    year = F.when(F.col("p_size") % 5 != 0, "1").otherwise("false")
    body = F.concat(
        F.lit('{"title": {"ok": '), flag, F.lit(', "issue": "spelling", "what_you_see": "reads '), "p_name",
        F.lit('!"}, "date_year": {"ok": '), year, F.lit(', "issue": null}, "country": {"issue": "none given"}, '),
        F.lit('"type_specific.theme": {"ok": false, "issue": "not on map", "what_you_see": " "}, '),
        F.lit('"never_sent": {"ok": false}, "edition": 3}'))
    wrapped = F.when(F.col("p_partkey") % 4 == 0, body).otherwise(F.concat(F.lit('{"verdicts": '), body, F.lit("}")))
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 10 != 9, wrapped).alias("json"))


def _verdicts(spark, sf, claims=None):
    sent = parse.checkable(_claims(spark, sf) if claims is None else claims)
    return checkpointed(parse.parse_verdicts(_verdict_responses(spark, sf), sent, placed=True))


@register(
    "parse_verdicts",
    f"SELECT doc_id, field, CAST(ok AS INT) AS ok, issue, what_you_see FROM ({_VERDICTS})",
)
def parse_verdicts(spark, sf):
    return _verdicts(spark, sf).withColumn("ok", F.col("ok").cast("int"))


@register(
    "correction_feedback",
    f"""
    SELECT doc_id, count(*) AS flagged, string_agg(v.field || '=' || value || '/' || issue, ';' ORDER BY v.field) AS listed
    FROM ({_VERDICTS}) v JOIN ({_PLAIN}) c USING (doc_id, field) WHERE NOT ok GROUP BY 1
    """,
)
def correction_feedback(spark, sf):
    claims = _claims(spark, sf)
    feedback = parse.correction_feedback(claims, _verdicts(spark, sf, claims))
    entries = F.from_json(
        "feedback", "array<struct<field: string, your_value: string, critic_says_wrong_because: string>>")
    listed = F.transform(entries, lambda e: F.concat(
        e["field"], F.lit("="), e["your_value"], F.lit("/"), e["critic_says_wrong_because"]))
    return feedback.select(
        "doc_id", F.size(entries).cast("bigint").alias("flagged"), F.array_join(listed, ";").alias("listed"))


# Corrections: a new title for parts with p_partkey % 4 = 1, a new year always, an unknown field.
_CORRECTED = """
    SELECT p_partkey AS doc_id, 'title' AS field, 'New ' || p_name AS value FROM part WHERE p_partkey % 4 = 1
    UNION ALL SELECT p_partkey, 'date_year', '1900' FROM part
    UNION ALL SELECT p_partkey, 'edition', 'first' FROM part
"""


def _corrections(spark, sf):
    _parts(spark, sf).createOrReplaceTempView("_claims_part")
    df = spark.sql(_CORRECTED.replace("FROM part", "FROM _claims_part"))
    return df.select(
        "doc_id", "field", "value", F.array(*[F.lit(float(v)) for v in (5, 5, 20, 20)]).alias("evidence_bbox"),
        F.lit("again").alias("evidence_text"), F.lit("direct_quote").alias("evidence_kind"))


_MERGED = f"""
    SELECT c.doc_id, c.field, CASE WHEN NOT coalesce(v.ok, true) THEN n.value ELSE coalesce(n.value, c.value) END AS value
    FROM ({_PLAIN}) c LEFT JOIN ({_CORRECTED}) n USING (doc_id, field) LEFT JOIN ({_VERDICTS}) v USING (doc_id, field)
    WHERE coalesce(v.ok, true) OR n.value IS NOT NULL
"""


@register("merge_corrections", _MERGED)
def merge_corrections(spark, sf):
    claims = _claims(spark, sf)
    merged = rounds.merge_corrections(claims, _corrections(spark, sf), _verdicts(spark, sf, claims))
    return merged.select("doc_id", "field", "value")


def _rounds(spark, sf):
    """Reviewer: verdicts of round 0, later only titles that do not start with New are refused."""
    start = _claims(spark, sf)
    first, fresh = _verdicts(spark, sf, start), _corrections(spark, sf)

    def review(claims, number):
        if number == 0:
            return first.join(grown(claims.select("doc_id")), "doc_id", "left_semi")
        refused = (F.col("field") == "title") & ~F.col("value").startswith("New")
        return claims.select(
            "doc_id", "field", (~refused).alias("ok"), F.lit("again").alias("issue"), F.lit("x").alias("what_you_see"))

    def correct(feedback, number):
        return fresh.join(grown(feedback.select("doc_id")), "doc_id", "left_semi")

    return rounds.correction_rounds(start, review, correct, 1)


_FLAGGED_DOCS = f"SELECT DISTINCT doc_id FROM ({_VERDICTS}) WHERE NOT ok"
_ROUND_CLAIMS = f"""
    SELECT doc_id, field, value FROM ({_PLAIN}) WHERE doc_id NOT IN ({_FLAGGED_DOCS})
    UNION ALL SELECT doc_id, field, value FROM ({_MERGED}) WHERE doc_id IN ({_FLAGGED_DOCS})
"""


@register("correction_rounds", _ROUND_CLAIMS)
def correction_rounds(spark, sf):
    return _rounds(spark, sf).claims.select("doc_id", "field", "value")


@register(
    "flag_history",
    f"""
    SELECT doc_id, field FROM ({_VERDICTS}) WHERE NOT ok
    UNION SELECT doc_id, field FROM ({_MERGED}) WHERE doc_id IN ({_FLAGGED_DOCS}) AND field = 'title'
        AND NOT starts_with(value, 'New')
    """,
)
def flag_history(spark, sf):
    return _rounds(spark, sf).flagged


_REREADS = """
    SELECT p_partkey AS doc_id, unnest(['title', 'date_year', 'type_specific.theme']) AS field,
           unnest([CASE WHEN p_size % 9 = 0 THEN 'null' ELSE 'Reread ' || p_name END, '1850', 'other']) AS value,
           unnest([p_size % 2 = 0, true, true]) AS confident, 'verbatim ' || p_size AS verbatim_text
    FROM part
"""


def _rereads(spark, sf):
    part = _parts(spark, sf)
    items = F.explode(F.array(
        F.struct(F.lit("title").alias("field"),
                 F.when(F.col("p_size") % 9 == 0, "null").otherwise(F.concat(F.lit("Reread "), "p_name")).alias("value"),
                 (F.col("p_size") % 2 == 0).alias("confident")),
        F.struct(F.lit("date_year").alias("field"), F.lit("1850").alias("value"), F.lit(True).alias("confident")),
        F.struct(F.lit("type_specific.theme").alias("field"), F.lit("other").alias("value"), F.lit(True).alias("confident"))))
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("verbatim "), "p_size").alias("verbatim_text"), items.alias("i")
    ).select("doc_id", "i.*", "verbatim_text")


_REREAD = f"""
    SELECT c.doc_id, c.field, CASE WHEN t.value IS NULL THEN c.value ELSE t.value END AS value,
           CASE WHEN t.value IS NULL THEN evidence_text ELSE 'reread crop: ' || verbatim_text END AS evidence_text, t.value IS NOT NULL AS taken
    FROM ({_PLAIN}) c LEFT JOIN (SELECT r.* FROM ({_REREADS}) r JOIN ({_VERDICTS}) v USING (doc_id, field)
        WHERE NOT ok AND confident AND value NOT IN ('', 'null') AND field <> 'type_specific.theme') t USING (doc_id, field)
"""


@register("apply_rereads", f"SELECT doc_id, field, value, evidence_text FROM ({_REREAD})")
def apply_rereads(spark, sf):
    start = _claims(spark, sf)
    claims, _, _ = rounds.apply_rereads(start, _verdicts(spark, sf, start), _rereads(spark, sf))
    return claims.select("doc_id", "field", "value", "evidence_text")


_PRESENCE = """
    SELECT p_partkey AS doc_id, 'country' AS field, unnest(['North', 'South' || (p_size % 4), 'East']) AS name,
           unnest([CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END, p_size % 4 < 2, true]) AS visible
    FROM part
"""


def _presence(spark, sf):
    part = _parts(spark, sf)
    north = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1)
    items = F.explode(F.array(
        F.struct(F.lit("North").alias("name"), north.alias("visible")),
        F.struct(F.concat(F.lit("South"), F.col("p_size") % 4).alias("name"), (F.col("p_size") % 4 < 2).alias("visible")),
        F.struct(F.lit("East").alias("name"), F.lit(True).alias("visible"))))
    return checkpointed(part.select(F.col("p_partkey").alias("doc_id"), F.lit("country").alias("field"), items.alias("i")).select(
        "doc_id", "field", "i.*"))


_KEPT = """(SELECT p_partkey AS doc_id, concat_ws(', ', CASE WHEN p_size % 3 = 1 THEN 'North' END,
    CASE WHEN p_size % 4 < 2 THEN 'South' || (p_size % 4) END, CASE WHEN p_size % 3 = 1 THEN 'North' END) AS kept FROM part)"""


@register(
    "prune_absent_names",
    f"""
    SELECT doc_id, field, CASE WHEN field = 'country' THEN kept ELSE value END AS value,
           CASE WHEN field = 'country' THEN 'presence-verified: ' || kept ELSE evidence_text END AS evidence_text
    FROM ({_PLAIN}) JOIN {_KEPT} USING (doc_id) WHERE field <> 'country' OR kept <> ''
    """,
)
def prune_absent_names(spark, sf):
    start = _claims(spark, sf)
    claims, _, _ = rounds.prune_absent_names(start, _verdicts(spark, sf, start), _presence(spark, sf))
    return claims.select("doc_id", "field", "value", "evidence_text")


@register(
    "pruned_fields",
    f"SELECT doc_id, field FROM ({_PLAIN}) JOIN {_KEPT} USING (doc_id) WHERE field = 'country' AND value <> kept",
)
def pruned_fields(spark, sf):
    start = _claims(spark, sf)
    return rounds.prune_absent_names(start, _verdicts(spark, sf, start), _presence(spark, sf))[2]


# A claim changed after the check (year of even parts) is not demoted.
_DEMOTED = f"""
    SELECT v.doc_id, v.field FROM ({_VERDICTS}) v JOIN ({_PLAIN}) c USING (doc_id, field)
    WHERE NOT ok AND NOT (field = 'date_year' AND doc_id % 2 = 0)
"""


def _demoted(spark, sf):
    checked = _claims(spark, sf)
    changed = (F.col("field") == "date_year") & (F.col("doc_id") % 2 == 0)
    now = checked.withColumn("value", F.when(changed, "1777").otherwise(F.col("value")))
    verdicts = _verdicts(spark, sf, checked)
    left, demoted = rounds.demote(now, verdicts, checked)
    return left, checkpointed(demoted), verdicts, checked


@register("demote_claims", _DEMOTED)
def demote_claims(spark, sf):
    return _demoted(spark, sf)[1]


_RESCUES = """
    SELECT p_partkey AS doc_id, 'title' AS field, 'Saved ' || p_name AS value, p_size % 3 = 0 AS confident FROM part
    UNION ALL SELECT p_partkey, 'type_specific.theme', 'saved', true FROM part
"""


def _rescued(spark, sf):
    left, demoted, verdicts, checked = _demoted(spark, sf)
    _parts(spark, sf).createOrReplaceTempView("_claims_part")
    rescues = spark.sql(_RESCUES.replace("FROM part", "FROM _claims_part")).withColumn("reasoning", F.lit("because"))
    claims, saved = rounds.rescue(left, demoted, verdicts, checked, rescues)
    return claims, saved, demoted, verdicts


@register(
    "rescue_claims",
    f"""
    SELECT doc_id, field, value, 1.0::DOUBLE AS x, 'rescued from critic observation: because' AS evidence_text
    FROM ({_RESCUES}) JOIN ({_DEMOTED}) USING (doc_id, field) WHERE confident AND field = 'title'
    """,
)
def rescue_claims(spark, sf):
    claims, saved, _, _ = _rescued(spark, sf)
    return claims.join(grown(saved), ["doc_id", "field"], "left_semi").select(
        "doc_id", "field", "value", F.col("evidence_bbox")[0].alias("x"), "evidence_text")


@register(
    "claim_audit",
    f"""
    WITH d AS ({_DEMOTED}), s AS (SELECT doc_id, field FROM ({_RESCUES}) JOIN d USING (doc_id, field) WHERE confident AND field = 'title'),
    u AS (SELECT doc_id, field FROM ({_VERDICTS}) WHERE NOT ok AND (doc_id, field) NOT IN (SELECT (doc_id, field) FROM d))
    SELECT p_partkey AS doc_id,
        coalesce((SELECT string_agg(field, ', ' ORDER BY field) FROM u WHERE u.doc_id = p_partkey), '') AS uncertain,
        coalesce((SELECT string_agg(field, ', ' ORDER BY field) FROM d WHERE d.doc_id = p_partkey
                  AND (doc_id, field) NOT IN (SELECT (doc_id, field) FROM s)), '') AS demoted,
        coalesce((SELECT string_agg(field, ', ' ORDER BY field) FROM s WHERE s.doc_id = p_partkey), '') AS rescued
    FROM part
    """,
)
def claim_audit(spark, sf):
    claims, saved, demoted, verdicts = _rescued(spark, sf)
    none = saved.limit(0)
    flagged = verdicts.filter(~F.col("ok")).select("doc_id", "field")
    audit = rounds.audit(claims, flagged, demoted, saved, none, none)
    return audit.select(
        "doc_id", F.col("map_review_fields_uncertain").alias("uncertain"),
        F.col("map_review_fields_demoted").alias("demoted"), F.col("map_review_fields_rescued").alias("rescued"))


def _wide(spark, sf):
    documents = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))
    failed = documents.filter(F.col("doc_id") % 50 == 7)
    return record.wide_records(_claims(spark, sf), documents, failed=failed)


_OK = "p_partkey % 50 <> 7"


@register(
    "wide_records",
    f"""
    SELECT p_partkey AS doc_id, CASE WHEN {_OK} THEN p_name ELSE '' END AS map_title,
        CASE WHEN {_OK} THEN CAST(1800 + p_size AS BIGINT) END AS map_date_year, CASE WHEN {_OK} THEN 63360::BIGINT END AS map_scale_ratio,
        CASE WHEN {_OK} THEN 'N/A' ELSE '' END AS map_projection,
        CASE WHEN {_OK} THEN 'North, South' || (p_size % 4) || ', North' ELSE '' END AS map_country, '' AS map_city,
        CASE WHEN {_OK} THEN CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END ELSE '' END AS map_has_insets,
        CASE WHEN {_OK} THEN 'computed_from_bar' ELSE '' END AS map_scale_source, '' AS map_not_applicable,
        CASE WHEN {_OK} AND p_partkey % 3 <> 0 THEN '7' ELSE '' END AS ts_datum,
        CASE WHEN {_OK} AND p_partkey % 3 <> 0 THEN p_type ELSE '' END AS ts_theme
    FROM part
    """,
)
def wide_records(spark, sf):
    return _wide(spark, sf).select(
        "doc_id", "map_title", "map_date_year", "map_scale_ratio", "map_projection", "map_country", "map_city",
        "map_has_insets", "map_scale_source", "map_not_applicable", "ts_datum", "ts_theme")


@register(
    "wide_records_map",
    f"""
    SELECT p_partkey AS doc_id, CASE WHEN {_OK} THEN p_name ELSE '' END AS map_title,
        CASE WHEN {_OK} AND p_partkey % 3 <> 0 THEN 'ts_datum=7|ts_theme=' || p_type ELSE '' END AS extra
    FROM part
    """,
)
def wide_records_map(spark, sf):
    documents = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))
    failed = documents.filter(F.col("doc_id") % 50 == 7)
    wide = record.wide_records(_claims(spark, sf), documents, failed=failed, extra_map=True)
    entries = F.transform(F.array_sort(F.map_entries("map_extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return wide.select("doc_id", "map_title", F.array_join(entries, "|").alias("extra"))


@register(
    "extra_fields_long",
    "SELECT p_partkey AS doc_id, unnest(['ts_theme', 'ts_datum']) AS \"column\", unnest([p_type, '7']) AS value FROM part "
    "WHERE p_partkey % 3 <> 0",
)
def extra_fields_long(spark, sf):
    return record.long_extra(_claims(spark, sf))


_DC = {
    "dc:identifier": "p_partkey || '.tif'",
    "dc:title": "CASE WHEN p_size % 6 = 0 THEN '' ELSE p_name END",
    "dc:creator": "''",
    "dc:publisher": "p_brand",
    "dc:date": "CASE WHEN p_size % 4 = 0 THEN 'ca. ' || (1800 + p_size) WHEN p_size % 4 = 1 THEN '' ELSE CAST(1800 + p_size AS VARCHAR) END",
    "dcterms:created": "CASE WHEN p_size % 4 = 1 THEN '' ELSE CAST(1800 + p_size AS VARCHAR) END",
    "dcterms:hasVersion": "''",
    "dc:type": "'Image; cartographic (' || p_type || ')'",
    "dc:format": "'paper; ' || p_size || '.5 cm × 20 cm'",
    "dcterms:medium": "'paper'",
    "dcterms:extent": "p_size || '.5 cm × 20 cm'",
    "dc:language": "'en, fr'",
    "dc:subject": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'roads, ' || p_type END",
    "dc:coverage": "'Australia; ' || p_brand",
    "dcterms:spatial": "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'name=Bounding Box; northlimit=-10.0; southlimit=-44.5; westlimit=112.0; "
                       "eastlimit=154.0; projection=WGS84' END",
    "dc:description": "'A map ; Scale: 4 miles — Scale ratio: 1:63360 ; Condition: good'",
    "dcterms:conformsTo": "'DCMI Metadata Terms'",
}


@register(
    "dublin_core",
    "SELECT p_partkey, " + ", ".join(f'{sql} AS "{name}"' for name, sql in _DC.items()) + " FROM part",
)
def dublin_core(spark, sf):
    size = F.col("p_size")
    df = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_partkey", F.lit(".tif")).alias("filename"),
        F.when(size % 6 == 0, " n/a ").otherwise(F.col("p_name")).alias("map_title"),
        F.when(size % 4 == 0, F.concat(F.lit(" ca. "), 1800 + size)).when(size % 4 == 2, "N/A").otherwise("").alias("map_date"),
        F.when(size % 4 != 1, 1800.0 + size).alias("map_date_year"),
        F.col("p_brand").alias("map_publisher"), F.lit("N/A").alias("map_edition"),
        F.lit("4 miles").alias("map_scale"), F.lit("63360").alias("map_scale_ratio"), F.lit("").alias("map_projection"),
        F.col("p_type").alias("map_type"),
        F.when(size % 2 == 0, F.col("p_type")).otherwise(F.lit("roads")).alias("map_subject"),
        F.lit("Australia").alias("map_coverage"), F.lit("Australia").alias("map_country"), F.lit("N/A").alias("map_province"),
        F.col("p_brand").alias("map_city"), F.lit("paper").alias("map_medium"), F.lit("English, FR").alias("map_language"),
        F.lit("good").alias("map_condition"), F.lit(" A map").alias("map_description"),
        (size + 0.5).alias("map_width_cm"), F.lit(20.0).alias("map_height_cm"),
        F.lit("112").alias("map_bbox_west"), F.lit(154.0).alias("map_bbox_east"), F.lit(-44.5).alias("map_bbox_south"),
        F.when(size % 3 != 0, "-10").otherwise("N/A").alias("map_bbox_north"))
    return record.dublin_core(df).select("p_partkey", *[F.col(f"`{c}`") for c in names.DUBLIN_CORE])


# ── All passes together ──────────────────────────────────────────────────────

def _entry(value):
    return {"value": value, "evidence_bbox": [1, 2, 30, 40], "evidence_text": "seen"}


def _model(request):
    """A stand-in for the model whose answers depend on the document's number: nine courses that a document can take."""
    kind, task, payload = request["doc_id"] % 9, request["task"], request["payload"]
    answer = {}
    if task == "extract":
        answer = {"fields": {"title": _entry(payload), "country": _entry("Here, There")}}
    elif task == "review":
        title = next((c["value"] for c in json.loads(payload) if c["field"] == "title"), "")
        wrong = kind in (2, 3, 4, 6) or (kind == 1 and not title.startswith("mended "))
        answer = {"verdicts": {"title": {"ok": not wrong, "issue": "unlike", "what_you_see": "blurred"}, "country": {"ok": True}}}
    elif task == "correct" and kind != 6:
        value = json.loads(payload)[0]["your_value"]
        answer = {"fields": {"title": _entry(f"mended {value}" if kind == 1 else value)}}
    elif task == "reread":
        answer = {"value": "read again", "confident": kind == 4, "verbatim_text": "AGAIN"}
    elif task == "presence":
        answer = {"visible": request["name"] == "Here" or kind != 5}
    elif task == "rescue":
        answer = {"value": "rescued", "confident": kind == 3, "reasoning": "r"}
    text = "I see nothing" if task == "extract" and kind == 7 else json.dumps(answer)
    return {"text": text, "input_tokens": 10, "output_tokens": 2}


@register(
    "map_analysis",
    """
    WITH p AS (SELECT p_partkey, p_name, p_partkey % 9 AS kind, [5, 8, 13, 13, 12, 5, 7, 1, 0][p_partkey % 9 + 1] AS calls FROM part)
    SELECT p_partkey, CASE kind WHEN 0 THEN p_name WHEN 1 THEN 'mended ' || p_name WHEN 3 THEN 'rescued' WHEN 4 THEN 'read again' WHEN 5 THEN p_name ELSE '' END AS map_title,
           CASE WHEN kind >= 7 THEN '' WHEN kind = 5 THEN 'Here' ELSE 'Here, There' END AS map_country,
           CASE WHEN kind = 1 THEN 'title' ELSE '' END AS map_review_fields_uncertain, CASE WHEN kind = 2 THEN 'title' ELSE '' END AS map_review_fields_demoted,
           CASE WHEN kind = 3 THEN 'title' ELSE '' END AS map_review_fields_rescued, CASE WHEN kind = 4 THEN 'title' ELSE '' END AS map_review_fields_rereaded,
           CASE WHEN kind = 5 THEN 'country' ELSE '' END AS map_review_fields_presence_pruned,
           CAST(10 * calls AS BIGINT) AS map_input_tokens, CAST(2 * calls AS BIGINT) AS map_output_tokens,
           CASE kind WHEN 7 THEN 'failed' WHEN 8 THEN 'skipped' ELSE 'done' END AS map_state,
           CASE kind WHEN 0 THEN p_name WHEN 1 THEN 'mended ' || p_name WHEN 3 THEN 'rescued' WHEN 4 THEN 'read again' WHEN 5 THEN p_name ELSE '' END AS "dc:title"
    FROM p
    """,
)
def map_analysis(spark, sf):
    """Extraction with review, correction, second reading, presence, demotion and rescue, from image to Dublin Core."""
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 8, F.col("p_name")).alias("image"))
    found = analyse(part, "p_partkey", "image", predict=_model, dublin_core_export=True)
    return found.select(
        "p_partkey", "map_title", "map_country", "map_review_fields_uncertain", "map_review_fields_demoted", "map_review_fields_rescued",
        "map_review_fields_rereaded", "map_review_fields_presence_pruned", "map_input_tokens", "map_output_tokens", "map_state", "dc:title")
