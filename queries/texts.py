"""Scalar functions over whole texts and over values derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import registry, sql_squeeze, sql_strip, sql_words, table
from tabloom.functions import evidence, text
from tabloom.functions.registry import get_function
from tabloom.lookup.classification import area_description, parse_shelf_mark, subject_description
from tabloom.lookup.fixed_values import AREA_CODES, SUBJECT_CODES

QUERIES, SQL, register = registry()


def _documents(name: str, function: str, expression: str, source: str = "documents", **params):
    key, column = {"documents": ("doc_id", "text"), "part": ("p_partkey", "p_name"),
                   "pages": ("page_id", "html"), "orders": ("o_orderkey", "o_orderpriority")}[source]

    def run(spark, sf):
        df = table(spark, sf, source).select(key, column)
        return df.select(key, get_function(function)(F.col(column), **params).alias("result"))

    register(name, f"SELECT {key}, {expression.replace("{x}", column)} AS result FROM {source}")(run)


_documents("text_trim", "trim", sql_squeeze("{x}"))
_documents("text_lowercase", "lowercase", sql_strip("lower({x})"))
_documents("text_uppercase", "uppercase", "upper(trim({x}, ' ' || chr(10)))", source="part")
_documents(
    "text_title_case", "title_case",
    "array_to_string(list_transform(regexp_extract_all(lower({x}), '([a-z]+|[^a-z]+)'), "
    "lambda w: upper(w[1]) || substr(w, 2)), '')", source="part")
_documents("text_title_case_priority", "title_case",
           "array_to_string(list_transform(regexp_extract_all(lower({x}), '([a-z]+|[^a-z]+)'), "
           "lambda w: upper(w[1]) || substr(w, 2)), '')", source="orders")
_documents("text_strip_html", "strip_html",
           sql_strip("regexp_replace({x}, '<[^>]+>', '', 'g')"),
           source="pages")
_documents("text_number", "number",
           "TRY_CAST(nullif(regexp_extract({x}, '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)")
_documents("text_regex_extract", "regex_extract", "regexp_extract({x}, '([A-Z][a-z]+) of', 1)",
           pattern="([A-Z][a-z]+) of")
_documents("text_regex_extract_whole", "regex_extract", "regexp_extract({x}, '[a-z]+ing')", pattern="[a-z]+ing")
_documents("text_find_replace", "find_replace", "replace({x}, 'th', 'TH.')", find="th", replace="TH.")
_documents("text_fix_encoding", "fix_encoding",
           sql_strip("regexp_replace(replace({x}, chr(65533), ''), '  +', ' ', 'g')"))
_documents("text_clean_cell", "clean_cell",
           sql_strip("regexp_replace(regexp_replace({x}, '\\r\\n|\\r|\\n|\\t', ' ', 'g'), '  +', ' ', 'g')"))
_documents("text_call_number", "call_number",
           f"CASE WHEN len({sql_words('{x}')}) >= 2 THEN array_to_string({sql_words('{x}')}[1:2], ' ') "
           f"ELSE {sql_strip('{x}')} END")

# ── Dates: every spelling derived from the order year ────────────────────────

_SPELLINGS = (
    "'[' || y || '?]'", "left(y, 3) || '[' || right(y, 1) || ']'", "'[n.d.]'", "'N. D.'",
    "'[between ' || y || ' and ' || (o_orderkey % 100 + 1900) || '?]'",
    "left(y, 3) || '-?-' || left(y, 3) || '-?'", "'c.' || y", "'ca. ' || y", "y || '-' || right(y, 2)",
    "y || '–1850'", "' ' || y || ' ?'", "left(y, 3) || '-?'", "left(y, 2) || '--?'", "left(y, 2) || '-'",
    "substr(CAST(o_orderkey % 100 + 100 AS VARCHAR), 2) || '--'", "'printed in ' || y || ', London'", "'undated'", "''",
)
_RAW_DATES = (
    "SELECT o_orderkey, CASE o_orderkey % " + str(len(_SPELLINGS)) + " "
    + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SPELLINGS))
    + " END AS raw FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)"
)
_SPARK_RAW_DATES = _RAW_DATES.replace("AS VARCHAR", "AS STRING")


@register(
    "date_rules",
    f"""
    WITH r AS ({_RAW_DATES}),
    s AS (SELECT *, regexp_replace(CASE WHEN trim(raw) LIKE '[%]' THEN trim(substr(trim(raw), 2, length(trim(raw)) - 2))
                 ELSE trim(raw) END, '[\\[\\]]', '', 'g') AS d FROM r)
    SELECT o_orderkey, raw, CASE
        WHEN trim(raw) = '' OR regexp_matches(d, '^[Nn]\\.?\\s*[Dd]\\.?\\s*$') THEN ''
        WHEN regexp_matches(d, '(?i)^between\\s+[0-9]{{4}}\\s+and\\s+[0-9]{{4}}') THEN regexp_extract(d, '[0-9]{{4}}')
        WHEN regexp_matches(d, '^[0-9]{{3}}-\\??\\s*[-–]\\s*[0-9]{{3}}-') THEN CAST(CAST(d[1:3] AS INT) * 10 AS VARCHAR) || 's'
        WHEN regexp_matches(d, '^ca?\\.?\\s*[0-9]{{4}}') THEN regexp_extract(d, '[0-9]{{4}}')
        WHEN regexp_matches(d, '^[0-9]{{4}}\\s*[-–]\\s*[0-9]{{2,4}}') THEN d[1:4]
        WHEN regexp_matches(d, '^[0-9]{{4}}\\s*\\??$') THEN d[1:4]
        WHEN regexp_matches(d, '^[0-9]{{3}}-?\\??\\s*$') THEN CAST(CAST(d[1:3] AS INT) * 10 AS VARCHAR) || 's'
        WHEN regexp_matches(d, '^[0-9]{{2}}-{{1,2}}\\??\\s*$') THEN (CAST(d[1:2] AS INT) + 1) || CASE
            WHEN (CAST(d[1:2] AS INT) + 1) % 100 IN (11, 12, 13) THEN 'th'
            WHEN (CAST(d[1:2] AS INT) + 1) % 10 = 1 THEN 'st' WHEN (CAST(d[1:2] AS INT) + 1) % 10 = 2 THEN 'nd'
            WHEN (CAST(d[1:2] AS INT) + 1) % 10 = 3 THEN 'rd' ELSE 'th' END || ' century'
        WHEN regexp_matches(d, '[0-9]{{4}}') THEN regexp_extract(d, '[0-9]{{4}}')
        ELSE trim(raw) END AS date
    FROM s
    """,
)
def date_rules(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_dates_orders")
    df = spark.sql(_SPARK_RAW_DATES.replace("FROM orders", "FROM _dates_orders"))
    return df.select("o_orderkey", "raw", get_function("date")(F.col("raw")).alias("date"))


@register(
    "date_text",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN regexp_extract(text, '[0-9]{4}') ELSE '' END AS year "
    "FROM documents",
)
def date_text(spark, sf):
    df = table(spark, sf, "documents")
    found = F.regexp_extract("text", r"[0-9]{4}", 0)
    return df.select("doc_id", get_function("date")(found).alias("year"))


# ── Scales, descriptions, shelf marks ────────────────────────────────────────

_SCALES = """CASE p_partkey % 4 WHEN 0 THEN '1 : ' || (p_partkey * 37 + 5)
    WHEN 1 THEN 'Scale 1:' || (p_partkey + 1000) // 1000 || ',' || right(CAST(p_partkey % 1000 + 1000 AS VARCHAR), 3) || '.'
    WHEN 2 THEN 'about ' || p_size || ' miles to an inch' ELSE ' 1: ' || p_size || ' ' || right(CAST(p_partkey % 1000 + 1000 AS VARCHAR), 3) END"""


@register(
    "scale_text",
    f"""
    SELECT p_partkey, CASE WHEN n <> '' THEN '1:' || regexp_replace(format('{{:,}}', CAST(n AS BIGINT)), ' ', '')
           ELSE trim(raw) END AS scale
    FROM (SELECT p_partkey, raw, translate(regexp_extract(raw, '1\\s*:\\s*([0-9,\\s]+)', 1), ', ', '') AS n
          FROM (SELECT p_partkey, {_SCALES} AS raw FROM part))
    """,
)
def scale_text(spark, sf):
    df = table(spark, sf, "part").withColumn("raw", F.expr(
        _SCALES.replace("//", "div").replace("AS VARCHAR", "AS STRING")))
    return df.select("p_partkey", get_function("scale")(F.col("raw")).alias("scale"))


_ISBD = """CASE p_partkey % 5 WHEN 0 THEN p_size || ' maps : col. ; ' || p_size || ' x ' || (p_size + 1) || ' cm'
    WHEN 1 THEN '1 map ; ' || p_size || '.5x' || p_size || 'CM' WHEN 2 THEN p_name || ' colour'
    WHEN 3 THEN '' ELSE p_name END"""


@register(
    "description_isbd",
    f"""
    SELECT p_partkey, CASE WHEN raw = '' THEN '' ELSE n || ' map' || CASE WHEN CAST(n AS INT) > 1 THEN 's' ELSE '' END
        || ' ; ' || CASE WHEN contains(lower(raw), 'col') THEN 'col.' ELSE 'b&w' END
        || CASE WHEN size = '' THEN '' ELSE ' ; ' || size END END AS description
    FROM (SELECT p_partkey, raw,
          coalesce(nullif(regexp_extract(raw, '^([0-9]+)\\s+maps?', 1), ''), '1') AS n,
          regexp_extract(raw, '(?i)([0-9]+(?:\\.[0-9]+)?\\s*x\\s*[0-9]+(?:\\.[0-9]+)?\\s*cm)', 1) AS size
          FROM (SELECT p_partkey, {_ISBD} AS raw FROM part))
    """,
)
def description_isbd(spark, sf):
    df = table(spark, sf, "part").withColumn("raw", F.expr(_ISBD))
    return df.select("p_partkey", get_function("description_isbd")(F.col("raw")).alias("description"))


def _values(codes: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in codes.items())


_AREA_SQL = """coalesce(
    (SELECT v FROM areas WHERE k = c), (SELECT v || ' (sub-area .' || split_part(c, '.', 2) || ')' FROM areas
        WHERE k = split_part(c, '.', 1) AND len(string_split(c, '.')) = 2),
    (SELECT v || ' (sub-area ' || c || ')' FROM areas
        WHERE k = CAST(CAST(floor(floor(TRY_CAST(c AS DOUBLE)) / 100) * 100 AS BIGINT) AS VARCHAR)), '')"""
_MARKS = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 1000 AS VARCHAR)
    WHEN p_partkey % 3 = 1 THEN (p_partkey % 900 + 100) || '.' || p_size ELSE p_name END
    || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN ' 1900' ELSE ' ' || substr(p_name, 1, 1 + p_size % 3) || ' 1886.' END
    AS mark FROM part"""


@register(
    "shelf_mark",
    f"""
    WITH areas(k, v) AS (VALUES {_values(AREA_CODES)}), subjects(k, v) AS (VALUES {_values(SUBJECT_CODES)}),
    marks AS ({_MARKS}),
    parts AS (SELECT p_partkey, mark, split_part(mark, ' ', 1) AS c,
              CASE WHEN regexp_matches(split_part(mark, ' ', 2), '^[a-z]') THEN split_part(mark, ' ', 2) ELSE '' END AS s
              FROM marks)
    SELECT p_partkey, mark AS raw, c AS area_code, {_AREA_SQL} AS area_description, s AS subject_code,
        coalesce((SELECT v FROM subjects WHERE k = s), (SELECT v || ' (' || s || ')' FROM subjects WHERE k = left(s, 1)), '')
            AS subject_description, CASE WHEN c <> '' AND s <> '' THEN 1 ELSE 0 END AS is_valid
    FROM parts
    """,
)
def shelf_mark(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("_marks_part")
    df = spark.sql(_MARKS.replace("AS VARCHAR", "AS STRING").replace("FROM part", "FROM _marks_part"))
    parsed = parse_shelf_mark(df, "mark").drop("mark")
    return parsed.withColumn("is_valid", F.col("is_valid").cast("int"))


@register(
    "area_descriptions",
    f"""
    WITH areas(k, v) AS (VALUES {_values(AREA_CODES)}),
    codes AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c FROM orders)
    SELECT c AS code, {_AREA_SQL} AS description FROM codes
    """,
)
def area_descriptions(spark, sf):
    codes = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("code")).distinct()
    return codes.select("code", area_description(F.col("code")).alias("description"))


@register(
    "subject_descriptions",
    f"""
    WITH subjects(k, v) AS (VALUES {_values(SUBJECT_CODES)}),
    codes AS (SELECT DISTINCT substr(p_name, 1, 2) AS s FROM part)
    SELECT s AS code, coalesce((SELECT v FROM subjects WHERE k = s),
        (SELECT v || ' (' || s || ')' FROM subjects WHERE k = left(s, 1)), '') AS description FROM codes
    """,
)
def subject_descriptions(spark, sf):
    codes = table(spark, sf, "part").select(F.substring("p_name", 1, 2).alias("code")).distinct()
    return codes.select("code", subject_description(F.col("code")).alias("description"))


# ── Sizes, languages, boxes ──────────────────────────────────────────────────

_NAMES = """SELECT l_orderkey, l_linenumber, 'map ' || l_partkey || CASE WHEN l_returnflag = 'N' THEN ''
    ELSE ' ' || l_quantity || 'cm X ' || (l_linenumber * 10) || ' cm' END || '.tif' AS name FROM lineitem"""


@register(
    "size_from_name",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_quantity END AS width_cm,
           CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE CAST(l_linenumber * 10 AS DOUBLE) END AS height_cm FROM lineitem
    """,
)
def size_from_name(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("_names_lineitem")
    df = spark.sql(_NAMES.replace("FROM lineitem", "FROM _names_lineitem"))
    width, height = evidence.size_from_name(F.col("name"))
    return df.select("l_orderkey", "l_linenumber", width.alias("width_cm"), height.alias("height_cm"))


@register(
    "physical_size",
    """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE CAST(round(CAST(CAST(p_partkey AS DOUBLE) / (p_size % 7 * 50) * 2.54 AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS cm
    FROM part
    """,
)
def physical_size(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", evidence.physical_size(F.col("p_partkey"), F.col("p_size") % 7 * 50).alias("cm"))


@register(
    "iso_language",
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'en, fr' WHEN 'de' THEN 'de, Klingon' WHEN 'fr' THEN 'fr' ELSE lang END AS language
    FROM documents
    """,
)
def iso_language(spark, sf):
    df = table(spark, sf, "documents")
    listed = (
        F.when(F.col("lang") == "en", "English, FR").when(F.col("lang") == "de", " german ,, Klingon")
        .when(F.col("lang") == "fr", "French").otherwise(F.upper("lang")))
    return df.select("doc_id", evidence.iso_language(listed).alias("language"))


@register(
    "dcmi_box",
    """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'name=Bounding Box; northlimit=' || CAST(p_size * 1.5 AS DOUBLE)
        || '; southlimit=' || CAST(-p_size * 1.0 AS DOUBLE) || '; westlimit=' || CAST(p_size * 0.5 AS DOUBLE)
        || '; eastlimit=' || CAST(p_size * 2.0 AS DOUBLE) || '; projection=WGS84' END AS box
    FROM part
    """,
)
def dcmi_box(spark, sf):
    df = table(spark, sf, "part")
    size = F.col("p_size").cast("double")
    north = F.when(F.col("p_size") % 3 != 0, size * 1.5)
    return df.select("p_partkey", evidence.dcmi_box(size * 0.5, size * 2.0, -size, north).alias("box"))


@register(
    "join_nonempty",
    """
    SELECT p_partkey, array_to_string(list_filter([p_type,
        CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE p_name END,
        CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand END], lambda x: x NOT IN ('', 'N/A')), '; ')
        AS joined FROM part
    """,
)
def join_nonempty(spark, sf):
    df = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 2 == 0, "n/a").otherwise(F.col("p_name"))
    brand = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_brand"))
    return df.select("p_partkey", text.join_nonempty(
        [F.col("p_type"), name, F.lit(None), brand, F.col("p_type")]).alias("joined"))


@register(
    "scale_source",
    """
    SELECT o_orderkey, CASE
        WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'printed_ratio'
        WHEN o_orderstatus = 'F' THEN 'direct_quote_other'
        WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'computed_from_bar'
        WHEN o_orderstatus = 'O' THEN 'computed_from_text' ELSE 'unknown' END AS source
    FROM orders
    """,
)
def scale_source(spark, sf):
    df = table(spark, sf, "orders")
    quote = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1:"), "o_custkey")).otherwise("about so")
    computed = F.when(F.col("o_orderkey") % 3 == 0, "4 Miles to an inch").otherwise("stated in words")
    words = F.when(F.col("o_orderstatus") == "F", quote).when(F.col("o_orderstatus") == "O", computed).otherwise("")
    kind = F.when(F.col("o_orderstatus") == "F", "direct_quote").otherwise("computed")
    return df.select("o_orderkey", evidence.scale_source(words, kind).alias("source"))


_BOX = "[l_quantity * 3 - 20, l_linenumber * 20 - 30, l_discount * 1200, l_tax * 800]"


@register(
    "sanitize_box",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(100 - w, b[1])), 2) AS x,
           round(greatest(0, least(100 - h, b[2])), 2) AS y, round(w, 2) AS w, round(h, 2) AS h
    FROM (SELECT *, {_BOX} AS b, greatest(1, least(100, l_discount * 1200)) AS w, greatest(1, least(100, l_tax * 800)) AS h
          FROM lineitem)
    """,
)
def sanitize_box(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("box", evidence.sanitize_box(F.array(
        F.col("l_quantity") * 3 - 20, F.col("l_linenumber") * 20.0 - 30,
        F.col("l_discount") * 1200, F.col("l_tax") * 800)))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[F.col("box")[i].alias(n) for i, n in enumerate("xywh")])


@register(
    "pad_box",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, round(least(100 - x, l_linenumber + 12), 6) AS w,
           round(least(100 - y, 50 + 12), 6) AS h
    FROM (SELECT *, round(greatest(0, l_quantity - 6), 6) AS x, round(greatest(0, l_quantity * 1.9 - 6), 6) AS y FROM lineitem)
    """,
)
def pad_box(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("box", evidence.pad_box(F.array(
        F.col("l_quantity"), F.col("l_quantity") * 1.9, F.col("l_linenumber").cast("double"), F.lit(50.0))))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[F.round(F.col("box")[i], 6).alias(n) for i, n in enumerate("xywh")])


@register(
    "list_text",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ', ' || p_type WHEN 1 THEN p_name ELSE '[' || p_name END AS joined "
    "FROM part",
)
def list_text(spark, sf):
    df = table(spark, sf, "part")
    quoted = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_type", F.lit("', '']"))
    raw = F.when(F.col("p_partkey") % 3 == 0, quoted).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(
        F.concat(F.lit("["), "p_name"))
    return df.select("p_partkey", text.list_text(raw).alias("joined"))

