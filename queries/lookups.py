"""Dictionary, place, heading lookups against tables used as dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import registry, table
from tabloom.lookup import fuzzy, substrings
from tabloom.lookup.dictionary import lookup
from tabloom.lookup.fixed_values import HEADING_TEMPLATES, SUBJECT_CODES, THEME_SUBDIVISIONS, THEME_SUBJECTS
from tabloom.lookup.headings import subject_headings
from tabloom.lookup.places import match_area
from tabloom.lookup.places import _match_large as match_area_by_join
from tabloom.lookup.tables import fold_case

QUERIES, SQL, register = registry()


def _nation_dictionary(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("key"), F.nullif(F.col("n_regionkey").cast("string"), F.lit("3")).alias("value"),
        F.col("n_nationkey").cast("bigint").alias("ord"))


@register(
    "lookup_exact",
    """
    SELECT c_custkey, coalesce(nullif(CAST(n_regionkey AS VARCHAR), '3'), 'none') AS region
    FROM customer LEFT JOIN nation ON lower(n_name) = 'nation_' || (c_nationkey * 2)
    """,
)
def lookup_exact(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Nation_"), F.col("c_nationkey") * 2).alias("source"))
    return lookup(df, _nation_dictionary(spark, sf), "source", "region", no_match_value="none").drop("source")


@register(
    "lookup_exact_case_sensitive",
    """
    SELECT c_custkey, coalesce(nullif(CAST(n_regionkey AS VARCHAR), '3'), '') AS region
    FROM customer LEFT JOIN nation ON n_name = CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' ELSE 'Nation_' END || c_nationkey
    """,
)
def lookup_exact_case_sensitive(spark, sf):
    prefix = F.when(F.col("c_custkey") % 2 == 0, "NATION_").otherwise("Nation_")
    df = table(spark, sf, "customer").select("c_custkey", F.concat(prefix, "c_nationkey").alias("source"))
    return lookup(df, _nation_dictionary(spark, sf), "source", "region", case_sensitive=True).drop("source")


# Case folding: keys that become equal keep their first place and their last value.
_SEGMENT_KEYS = (
    "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS key, "
    "c_name AS value, c_custkey AS ord FROM customer"
)


@register(
    "lookup_folded_keys",
    f"""
    WITH d AS (SELECT lower(key) AS key, arg_max(value, ord) AS value FROM ({_SEGMENT_KEYS}) GROUP BY 1)
    SELECT o_orderkey, coalesce(value, '') AS found FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN d ON key = lower(c_mktsegment)
    """,
)
def lookup_folded_keys(spark, sf):
    customer = table(spark, sf, "customer")
    dictionary = customer.select(
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("key"),
        F.col("c_name").alias("value"), F.col("c_custkey").alias("ord"))
    df = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment")
    return lookup(df, dictionary, "c_mktsegment", "found").select("o_orderkey", "found")


@register(
    "lookup_built_in",
    "WITH d(k, v) AS (VALUES "
    + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in SUBJECT_CODES.items())
    + ") SELECT p_partkey, coalesce(v, '?') AS subject FROM part LEFT JOIN d ON k = lower(substr(p_name, 1, 1))",
)
def lookup_built_in(spark, sf):
    df = table(spark, sf, "part").withColumn("letter", F.upper(F.substring("p_name", 1, 1)))
    return lookup(df, "bl_subject_codes", "letter", "subject", no_match_value="?").select("p_partkey", "subject")


def _passages(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("text").alias("key"), F.col("item_id").cast("string").alias("value"),
        (-F.col("item_id")).alias("ord"))


_CONTAINS_SQL = """
    WITH d AS (SELECT lower(text) AS key, arg_max(CAST(item_id AS VARCHAR), -item_id) AS value,
               min(-item_id) AS ord FROM benchmark GROUP BY 1)
    SELECT doc_id, coalesce(arg_min(value, ord), 'none') AS item FROM documents LEFT JOIN d ON contains(lower(text), key)
    GROUP BY doc_id
"""


@register("lookup_contains", _CONTAINS_SQL)
def lookup_contains(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return lookup(df, _passages(spark, sf), "text", "item", "contains", no_match_value="none").drop("text")


@register("lookup_contains_by_join", _CONTAINS_SQL)
def lookup_contains_by_join(spark, sf):
    """The way taken for dictionaries above the broadcast bound."""
    from tabloom.lookup.dictionary import _joined

    df = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("_text"))
    found = _joined(df, fold_case(_passages(spark, sf)), "contains")
    return found.select("doc_id", F.coalesce("_value", F.lit("none")).alias("item"))


@register(
    "dictionary_hits",
    """
    SELECT md5(t) AS digest, key, CAST(item_id AS VARCHAR) AS value
    FROM (SELECT DISTINCT lower(text) AS t FROM documents)
    JOIN (SELECT lower(text) AS key, min(item_id) AS item_id FROM benchmark GROUP BY 1) ON contains(t, key)
    """,
)
def dictionary_hits(spark, sf):
    texts = table(spark, sf, "documents").select(F.lower("text").alias("text")).distinct()
    keys = table(spark, sf, "benchmark").groupBy(F.lower("text").alias("key")).agg(
        F.min("item_id").alias("ord"))
    return substrings.hits(texts, keys.withColumn("value", F.col("ord").cast("string"))).drop("ord")


# Runs of one letter: the longest common block of two runs is the shorter one, letters of other runs never meet,
# and z is in no key, so difflib's ratio is 2 * least(m, n) / (m + n + z).
_RUNS = """
    WITH k AS (SELECT repeat(chr(97 + s_nationkey), 3 + s_suppkey % 9) AS key, s_nationkey AS letter, 3 + s_suppkey % 9 AS n,
               min(s_suppkey) AS ord FROM supplier GROUP BY ALL),
    t AS (SELECT c_custkey, c_nationkey AS letter, 2 + c_custkey % 11 AS m, c_custkey % 4 AS z,
          repeat(chr(97 + c_nationkey), 2 + c_custkey % 11) || repeat('z', c_custkey % 4) AS typo FROM customer),
    r AS (SELECT c_custkey, typo, key, ord, (2 * least(m, n))::DOUBLE / (m + z + n) AS ratio FROM t JOIN k USING (letter)),
    best AS (SELECT * FROM r WHERE ratio > 0.7::DOUBLE QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ratio DESC, ord) = 1)
"""


def _runs(spark, sf):
    supplier, customer = table(spark, sf, "supplier"), table(spark, sf, "customer")
    keys = supplier.select(F.expr("repeat(char(97 + s_nationkey), cast(3 + s_suppkey % 9 as int))").alias("key"), "s_suppkey")
    keys = keys.groupBy("key").agg(F.min("s_suppkey").alias("ord"))
    typo = F.expr("repeat(char(97 + c_nationkey), cast(2 + c_custkey % 11 as int)) || repeat('z', cast(c_custkey % 4 as int))")
    return customer.select("c_custkey", typo.alias("typo")), keys


@register(
    "lookup_fuzzy",
    f"{_RUNS} SELECT c_custkey, t.typo, coalesce(key, '') AS found FROM t LEFT JOIN best USING (c_custkey)",
)
def lookup_fuzzy(spark, sf):
    """Texts with letters dropped, repeated or appended, against a dictionary."""
    df, keys = _runs(spark, sf)
    return lookup(df, keys.withColumn("value", F.col("key")), "typo", "found", "fuzzy")


@register("lookup_fuzzy_blocks", f"{_RUNS} SELECT DISTINCT typo AS text, 'k' || ord AS value FROM best")
def lookup_fuzzy_blocks(spark, sf):
    """The way taken for large dictionaries: block by block, best key per text."""
    df, keys = _runs(spark, sf)
    keys = keys.withColumn("value", F.concat(F.lit("k"), "ord"))
    return fuzzy.best_keys(df.select(F.col("typo").alias("text")).distinct(), keys, block_rows=100)


# Real names, as many as the tables hold; without a SQL form, checked against difflib in tests/test_lookup.py.


@register("lookup_fuzzy_names")
def lookup_fuzzy_names(spark, sf):
    """Part names with a letter dropped, appended or all reversed, against the distinct names."""
    part = table(spark, sf, "part")
    names = part.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("ord")).withColumn(
        "value", F.col("key"))
    typo = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", "e", "")).when(
        F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.reverse("p_name"))
    df = part.select("p_partkey", typo.alias("typo"))
    return lookup(df, names, "typo", "found", "fuzzy").select("p_partkey", "typo", "found")


@register("lookup_fuzzy_names_blocks")
def lookup_fuzzy_names_blocks(spark, sf):
    """Customer names against supplier names, block by block."""
    names = table(spark, sf, "supplier").select(
        F.lower("s_name").alias("key"), F.col("s_suppkey").cast("string").alias("value"), F.col("s_suppkey").alias("ord"))
    texts = table(spark, sf, "customer").select(F.lower("c_name").alias("text")).distinct()
    return fuzzy.best_keys(texts, names)


# Names end in a number, and a text is a name with a letter appended or one taken out. A name of the same length that holds
# all letters of the text in order, or is held by it, has the same ratio, which is the highest; no other name reaches it.
_CODES = """
    WITH k AS (SELECT lower(s_name) AS key, min(s_suppkey) AS ord FROM supplier GROUP BY 1),
    t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) || '?' WHEN 1 THEN 's' || lower(s_name)
          ELSE substr(lower(s_name), 1, length(s_name) - 1) END AS typo FROM supplier),
    less AS (SELECT DISTINCT ord, substr(key, 1, p - 1) || substr(key, p + 1) AS typo FROM (SELECT key, ord, unnest(range(1, length(key) + 1)) AS p FROM k)),
    more AS (SELECT DISTINCT s_suppkey, substr(typo, 1, p - 1) || substr(typo, p + 1) AS key FROM (SELECT s_suppkey, typo, unnest(range(1, length(typo) + 1)) AS p FROM t WHERE s_suppkey % 3 < 2)),
    found AS (SELECT s_suppkey, min(ord) AS ord FROM (SELECT s_suppkey, ord FROM t JOIN less USING (typo) WHERE s_suppkey % 3 = 2
              UNION ALL SELECT s_suppkey, ord FROM more JOIN k USING (key)) GROUP BY 1)
"""


def _codes(spark, sf):
    supplier = table(spark, sf, "supplier")
    name, kind = F.lower("s_name"), F.col("s_suppkey") % 3
    typo = F.when(kind == 0, F.concat(name, F.lit("?"))).when(kind == 1, F.concat(F.lit("s"), name)).otherwise(
        F.expr("substr(lower(s_name), 1, length(s_name) - 1)"))
    keys = supplier.groupBy(name.alias("key")).agg(F.min("s_suppkey").alias("ord"))
    return supplier.select("s_suppkey", typo.alias("typo")), keys.withColumn("value", F.concat(F.lit("k"), "ord"))


@register("lookup_fuzzy_codes", f"{_CODES} SELECT s_suppkey, 'k' || ord AS found FROM found")
def lookup_fuzzy_codes(spark, sf):
    """Supplier names with one letter more or less against all supplier names, which differ by their numbers alone."""
    df, keys = _codes(spark, sf)
    return lookup(df, keys, "typo", "found", "fuzzy").select("s_suppkey", "found")


@register("lookup_fuzzy_codes_blocks", f"{_CODES} SELECT DISTINCT typo AS text, 'k' || ord AS value FROM t JOIN found USING (s_suppkey)")
def lookup_fuzzy_codes_blocks(spark, sf):
    """The same, band by band and block by block."""
    df, keys = _codes(spark, sf)
    return fuzzy.best_keys(df.select(F.col("typo").alias("text")).distinct(), keys)


# ── Places ───────────────────────────────────────────────────────────────────

_GEO = """
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'NATION_' || c_nationkey
        WHEN 1 THEN 'Town, nation_' || (c_nationkey % 7) || ' & Nation_' || c_nationkey
        WHEN 2 THEN 'the old nation_' || c_nationkey || ' colony' ELSE '' END AS geo_city,
        CASE WHEN c_custkey % 6 < 2 THEN 'nation_3' WHEN c_custkey % 6 = 4 THEN 'near ' || c_mktsegment || '/nation_9'
        WHEN c_custkey % 6 = 5 THEN 'unknown' ELSE ' Nation_' || (c_nationkey + 3) END AS geo_country
    FROM customer
"""
_PLACES_SQL = f"""
    WITH g AS ({_GEO}), p AS (SELECT lower(n_name) AS place, CAST(100 + n_nationkey AS VARCHAR) AS code FROM nation),
    cells AS (SELECT c_custkey, 1 AS col, lower(trim(geo_city)) AS cell FROM g UNION ALL
              SELECT c_custkey, 2, lower(trim(geo_country)) FROM g),
    found AS (
        SELECT c_custkey, col, 1 AS stage, length(place) AS n, code FROM cells JOIN p ON cell = place
        UNION ALL
        SELECT c_custkey, col, 2, length(place), code FROM (SELECT c_custkey, col,
            unnest(list_transform(regexp_split_to_array(cell, '[,;/&]'), lambda x: trim(x))) AS part FROM cells) JOIN p ON part = place
        UNION ALL
        SELECT c_custkey, col, 3, length(place), code FROM cells JOIN p ON contains(cell, place) WHERE length(place) >= 8),
    best AS (SELECT c_custkey, code FROM found
             QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY col, stage, n DESC, code DESC) = 1)
    SELECT g.c_custkey, coalesce(code, '') AS area FROM g LEFT JOIN best USING (c_custkey)
"""


def _geo(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_geo_customer")
    return spark.sql(_GEO.replace("FROM customer", "FROM _geo_customer"))


def _nation_places(spark, sf):
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("key"), (F.col("n_nationkey") + 100).cast("string").alias("value"),
        F.col("n_nationkey").alias("ord"))


@register("match_area", _PLACES_SQL)
def match_area_query(spark, sf):
    df = match_area(_geo(spark, sf), "geo_city,missing,geo_country", "area", 8, _nation_places(spark, sf))
    return df.select("c_custkey", "area")


@register("match_area_by_join", _PLACES_SQL)
def match_area_join(spark, sf):
    """The way taken for place tables above the broadcast bound."""
    df = match_area_by_join(
        _geo(spark, sf), ["geo_city", "geo_country"], "area", 8, _nation_places(spark, sf))
    return df.select("c_custkey", "area")


# ── Subject headings ─────────────────────────────────────────────────────────

_SUBJECTS = """
    SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Australia' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'United States'
        WHEN 3 THEN 'New Zealand' WHEN 4 THEN 'France' ELSE '' END AS country,
        CASE p_size % 5 WHEN 0 THEN 'South Australia' WHEN 1 THEN 'England' WHEN 2 THEN 'North Island' ELSE NULL END AS state,
        CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'France' ELSE '' END AS city,
        CASE p_size % 7 WHEN 0 THEN 'Nautical and Topographic' WHEN 1 THEN 'MINING' WHEN 2 THEN 'war' ELSE NULL END AS theme
    FROM part
"""


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_TEMPLATE_CASE = " ".join(
    f"WHEN country = {_text(c)} AND coalesce(state, '') = {_text(s or '')} THEN replace({_text(t)}, '{{locality}}', locality)"
    for (c, s), t in HEADING_TEMPLATES.items())
_THEME_CASE = " ".join(
    f"WHEN contains(lower(theme), {_text(w)}) THEN {_text(v)}" for w, v in THEME_SUBDIVISIONS.items())


@register(
    "subject_headings",
    f"""
    WITH s AS (SELECT *, coalesce(nullif(city, ''), nullif(state, ''), nullif(country, '')) AS locality FROM ({_SUBJECTS})),
    a AS (SELECT *, CASE WHEN locality IS NULL THEN NULL {_TEMPLATE_CASE} ELSE locality END AS area FROM s),
    h AS (SELECT p_partkey, area || ' -- Maps' AS h1, area || ' -- ' || CASE {_THEME_CASE} END AS h2,
          CASE WHEN state IS NOT NULL AND city <> '' THEN state || ' -- Maps' END AS h3,
          CASE WHEN country <> '' AND country <> city THEN country || ' -- Maps' END AS h4 FROM a)
    SELECT p_partkey, concat_ws('; ', h1, CASE WHEN h2 IS DISTINCT FROM h1 THEN h2 END,
        CASE WHEN h3 IS DISTINCT FROM h1 AND h3 IS DISTINCT FROM h2 THEN h3 END,
        CASE WHEN h4 IS DISTINCT FROM h1 AND h4 IS DISTINCT FROM h2 AND h4 IS DISTINCT FROM h3 THEN h4 END) AS headings
    FROM h
    """,
)
def subject_headings_query(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("_subjects_part")
    df = spark.sql(_SUBJECTS.replace("FROM part", "FROM _subjects_part"))
    return subject_headings(df, "country", "state", "city", "theme", "headings").select("p_partkey", "headings")


@register(
    "theme_subjects",
    "WITH d(k, v, o) AS (VALUES "
    + ", ".join(f"({_text(k)}, {_text(v)}, {i})" for i, (k, v) in enumerate(THEME_SUBJECTS.items()))
    + ") SELECT doc_id, coalesce(arg_min(v, o), '') AS subject FROM documents LEFT JOIN d ON contains(lower(text), k) "
    "GROUP BY doc_id",
)
def theme_subjects(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return lookup(df, "theme_to_bl_subject", "text", "subject", "contains").drop("text")
