"""Filters, routers, computed columns, joins, grouping, deduplication, sampling, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import registry, sql_strip, table, with_port
from tabloom.operators import columns, grouping, joins, ordering, routing, rows, views
from tabloom.session import checkpointed

QUERIES, SQL, register = registry()

# ── Filters and routers ──────────────────────────────────────────────────────

# A nullable segment: null rules are part of the semantics.
_CUSTOMER = "SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


def _customer(spark, sf):
    return table(spark, sf, "customer").withColumn(
        "segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    )


def _filter_sql(test: str) -> str:
    return (
        f"SELECT c_custkey, segment, CASE WHEN {test} THEN 'matched' ELSE 'unmatched' END AS port "
        f"FROM ({_CUSTOMER})"
    )


def _filter(operator: str, value: str, column: str = "segment"):
    def run(spark, sf):
        df = _customer(spark, sf)
        hit = routing.filter_predicate(df, column, operator, value)
        port = F.when(hit, "matched").otherwise("unmatched")
        return df.select("c_custkey", "segment", port.alias("port"))

    return run


register("filter_equals", _filter_sql("coalesce(segment, '') = 'MACHINERY'"))(_filter("equals", "MACHINERY"))
register("filter_not_equals", _filter_sql("coalesce(segment, '') <> 'MACHINERY'"))(
    _filter("not_equals", "MACHINERY"))
register("filter_contains", _filter_sql("regexp_matches(coalesce(segment, ''), '(?i)h.n|mob')"))(
    _filter("contains", "h.n|mob"))
register("filter_not_contains", _filter_sql("NOT regexp_matches(coalesce(segment, ''), '(?i)house')"))(
    _filter("not_contains", "house"))
register("filter_is_empty", _filter_sql("coalesce(segment, '') = ''"))(_filter("is_empty", ""))
register("filter_is_not_empty", _filter_sql("coalesce(segment, '') <> ''"))(_filter("is_not_empty", ""))
register("filter_regex", _filter_sql("regexp_matches(coalesce(segment, ''), '^(?:A|FU)')"))(
    _filter("regex", "A|FU"))
register("filter_greater_than", _filter_sql("c_acctbal > 5000"))(_filter("greater_than", "5000", "c_acctbal"))
register("filter_less_than", _filter_sql("c_acctbal < 100.5"))(_filter("less_than", "100.5", "c_acctbal"))


@register(
    "route_orders",
    """
    SELECT o_orderkey, CASE
        WHEN lower(o_orderpriority) = '1-urgent' AND o_totalprice >= 300000 THEN 'route_1'
        WHEN contains(lower(o_orderpriority), 'high') THEN 'route_2'
        WHEN regexp_matches(o_orderstatus, '[FP]') AND o_totalprice < 50000 THEN 'route_3'
        WHEN o_totalprice <= 20000 THEN 'route_4'
        ELSE 'default' END AS port
    FROM orders
    """,
)
def route_orders(spark, sf):
    rules = [
        {"output": "route_1", "conditions": [
            {"column": "o_orderpriority", "op": "equals", "value": "1-urgent"},
            {"column": "o_totalprice", "op": ">=", "value": "300000"}]},
        {"output": "route_2", "conditions": [{"column": "o_orderpriority", "op": "contains", "value": "HIGH"}]},
        {"output": "route_3", "conditions": [
            {"column": "o_orderstatus", "op": "regex", "value": "[FP]"},
            {"column": "o_totalprice", "op": "less_than", "value": "50000"}]},
        {"output": "route_1", "conditions": [{"column": "no_such_column", "op": "is_empty"}]},
        {"output": "route_4", "conditions": [{"column": "o_totalprice", "operator": "<=", "value": "20000"}]},
    ]
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", routing.route_column(orders, rules).alias("port"))


@register(
    "filter_ports",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'matched' ELSE 'unmatched' END AS port FROM orders
    """,
)
def filter_ports(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_port(routing.filter_rows(orders, "o_totalprice", "greater_than", "250000")).drop("o_totalprice")


@register(
    "route_ports",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'route_1' WHEN 'O' THEN 'route_2' ELSE 'default' END AS port
    FROM orders
    """,
)
def route_ports(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rules = [{"output": f"route_{i}", "conditions": [{"column": "o_orderstatus", "op": "equals", "value": v}]}
             for i, v in ((1, "f"), (2, "o"))]
    return with_port(routing.route(orders, rules)).drop("o_orderstatus")


@register(
    "presence_filter",
    """
    SELECT p_partkey, CASE WHEN trim(path) <> '' AND lower(trim(path)) <> 'nan' THEN 1 ELSE 0 END AS has_path
    FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '' WHEN 'LARGE' THEN ' nan ' WHEN 'MEDIUM' THEN '  '
                 ELSE p_name END AS path FROM part)
    """,
)
def presence_filter(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "path",
        F.when(F.col("p_type") == "SMALL", "").when(F.col("p_type") == "LARGE", " nan ")
        .when(F.col("p_type") == "MEDIUM", "  ").otherwise(F.col("p_name")),
    )
    return part.select("p_partkey", routing.has_path(part, "path").cast("int").alias("has_path"))


@register(
    "missing_cell_mask",
    f"""
    SELECT c_custkey, array_to_string(list_filter([
        CASE WHEN coalesce(segment, '') = '' THEN 'segment' ELSE '' END,
        CASE WHEN {sql_strip("note")} = '' THEN 'note' ELSE '' END,
        'absent'], lambda x: x <> ''), ',') AS missing
    FROM (SELECT *, CASE WHEN c_acctbal < 1000 THEN ' ' ELSE 'x' END AS note FROM ({_CUSTOMER}))
    """,
)
def missing_cell_mask(spark, sf):
    df = _customer(spark, sf).withColumn("note", F.when(F.col("c_acctbal") < 1000, " ").otherwise("x"))
    names = routing.missing_fields(df, ["segment", "note", "c_custkey", "absent"])
    return df.select("c_custkey", F.array_join(names, ",").alias("missing"))


# ── Computed columns ─────────────────────────────────────────────────────────

@register(
    "template_column",
    f"""
    SELECT c_custkey, c_name || ' (' || coalesce(segment, '') || ') #' || c_custkey || ' {{other}}' AS label
    FROM ({_CUSTOMER})
    """,
)
def template_column(spark, sf):
    df = columns.formula(_customer(spark, sf), "label", "{c_name} ({segment}) #{c_custkey} {other}")
    return df.select("c_custkey", "label")


@register(
    "expression_column",
    """
    SELECT p_partkey, round(p_retailprice * (1 + p_size / 100.0) - 3 ** 2 + 0 // 7, 6) AS price,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 5), 6) END AS share
    FROM part
    """,
)
def expression_column(spark, sf):
    df = table(spark, sf, "part")
    df = columns.formula(
        df, "price", "[p_retailprice] * (1 + [p_size] / 100) - 3 ** 2 + [p_name] // 7", "expression")
    df = columns.formula(df, "share", "[p_retailprice] / ([p_size] % 5)", "expression")
    return df.select("p_partkey", F.round("price", 6).alias("price"), F.round("share", 6).alias("share"))


@register(
    "count_filled",
    f"""
    SELECT c_custkey, round((1 + CASE WHEN coalesce(segment, '') = '' THEN 0 ELSE 1 END
        + CASE WHEN c_acctbal < 1000 THEN 0 ELSE 1 END) / 4.0 * 100, 6) AS completeness
    FROM ({_CUSTOMER})
    """,
)
def count_filled(spark, sf):
    df = _customer(spark, sf).withColumn("note", F.when(F.col("c_acctbal") < 1000, " ").otherwise("x"))
    df = columns.formula(
        df, "completeness", "count_filled([c_name],[segment],[note],[unknown]) / 4 * 100", "expression")
    return df.select("c_custkey", F.round("completeness", 6).alias("completeness"))


@register(
    "normalize_steps",
    """
    SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment,
           CAST(regexp_extract(upper(c_name), '[0-9]+') AS DOUBLE) AS name_number
    FROM customer
    """,
)
def normalize_steps(spark, sf):
    df = columns.normalize(
        table(spark, sf, "customer"),
        [
            {"column": "*", "function": "uppercase"},
            {"column": "c_name", "output_column": "name_number", "function": "number"},
            {"column": "missing", "function": "trim"},
            {"column": "c_name", "function": "no_such_function"},
        ],
    )
    return df.select("c_custkey", "c_name", "c_mktsegment", "name_number")


@register(
    "reorder_columns",
    """
    SELECT p_partkey, p_name AS ts_zone_note, p_type AS ts_theme, p_brand AS ts_grid_system FROM part
    """,
)
def reorder_columns(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_name").alias("ts_zone_note"), F.col("p_type").alias("ts_theme"), "p_partkey",
        F.col("p_brand").alias("ts_grid_system"),
    )
    return columns.reorder_type_specific(df)


@register(
    "new_columns",
    "SELECT c_custkey, 'label,half' AS added FROM customer",
)
def new_columns(spark, sf):
    before = table(spark, sf, "customer")
    after = before.withColumns({"label": F.col("c_name"), "half": F.col("c_acctbal") / 2})
    return after.select("c_custkey", F.lit(",".join(columns.new_columns([before], after))).alias("added"))


# ── Joins ────────────────────────────────────────────────────────────────────

_NULL_KEYS = """
    l AS (SELECT o_orderkey, o_orderstatus AS tag, CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_custkey END AS k
          FROM orders),
    r AS (SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey END AS k, c_mktsegment AS tag, c_name
          FROM customer)
"""


def _merge(how: str, salt: int = 1):
    def run(spark, sf):
        left = table(spark, sf, "orders").select(
            "o_orderkey", F.col("o_orderstatus").alias("tag"),
            F.when(F.col("o_orderkey") % 1000 != 0, F.col("o_custkey")).alias("k"))
        right = table(spark, sf, "customer").select(
            F.when(F.col("c_custkey") % 500 != 0, F.col("c_custkey")).alias("k"),
            F.col("c_mktsegment").alias("tag"), "c_name")
        return joins.merge(left, right, "k", "k", how, salt)

    return run


def _merge_sql(how: str) -> str:
    return (
        f"WITH {_NULL_KEYS} SELECT l.o_orderkey, l.tag, coalesce(l.k, r.k) AS k, r.tag AS tag_right, r.c_name "
        f"FROM l {how} JOIN r ON l.k IS NOT DISTINCT FROM r.k"
    )


register("merge_left", _merge_sql("LEFT"))(_merge("left"))
register("merge_right", _merge_sql("RIGHT"))(_merge("right"))
register("merge_inner", _merge_sql("INNER"))(_merge("inner"))
register("merge_outer", _merge_sql("FULL OUTER"))(_merge("outer"))
register("merge_salted", _merge_sql("INNER"))(_merge("inner", salt=4))
register("merge_outer_salted", _merge_sql("FULL"))(_merge("outer", salt=4))


@register(
    "merge_other_key",
    "SELECT s.*, n.n_nationkey, n.n_name, n.n_regionkey FROM supplier s LEFT JOIN nation n "
    "ON s.s_nationkey = n.n_nationkey",
)
def merge_other_key(spark, sf):
    return joins.merge(table(spark, sf, "supplier"), table(spark, sf, "nation"), "s_nationkey", "n_nationkey")


# ── Grouping and pivot ───────────────────────────────────────────────────────

@register(
    "group_lineitem",
    """
    SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(sum(l_quantity), 4) AS sum_qty,
           min(l_discount) AS min_disc, max(l_extendedprice) AS max_price, round(avg(l_tax), 8) AS avg_tax,
           count(DISTINCT l_suppkey) AS suppliers, round(stddev_samp(l_quantity), 6) AS sd_qty,
           round(var_samp(l_quantity), 6) AS var_qty
    FROM lineitem GROUP BY ALL
    """,
)
def group_lineitem(spark, sf):
    def agg(column, function, output):
        return {"column": column, "function": function, "output_column": output}

    df = grouping.group_by(
        table(spark, sf, "lineitem"), "l_returnflag, l_linestatus",
        [agg("l_quantity", "count", "n"), agg("l_quantity", "sum", "sum_qty"),
         agg("l_discount", "min", "min_disc"), agg("l_extendedprice", "max", "max_price"),
         agg("l_tax", "mean", "avg_tax"), agg("l_suppkey", "nunique", "suppliers"),
         agg("l_quantity", "std", "sd_qty"), agg("l_quantity", "var", "var_qty")],
    )
    return df.withColumns({
        "sum_qty": F.round("sum_qty", 4), "avg_tax": F.round("avg_tax", 8),
        "sd_qty": F.round("sd_qty", 6), "var_qty": F.round("var_qty", 6)})


@register(
    "group_null_keys",
    f"""
    SELECT segment, count(segment) AS segment_count, round(coalesce(sum(positive), 0), 4) AS positive_sum,
           arg_min(positive, c_custkey) FILTER (positive IS NOT NULL) AS positive_first,
           arg_max(positive, c_custkey) FILTER (positive IS NOT NULL) AS positive_last
    FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS positive FROM ({_CUSTOMER})) GROUP BY 1
    """,
)
def group_null_keys(spark, sf):
    df = _customer(spark, sf).withColumn("positive", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")))
    result = grouping.group_by(
        df, ["segment"],
        [{"column": "segment", "function": "count"}, {"column": "positive", "function": "sum"},
         {"column": "positive", "function": "first"}, {"column": "positive", "function": "last"}],
        order_by="c_custkey",
    )
    return result.withColumn("positive_sum", F.round("positive_sum", 4))


@register(
    "group_mode",
    """
    SELECT l_returnflag, l_linenumber_mode, l_shipdate_count FROM (
        SELECT l_returnflag, l_linenumber AS l_linenumber_mode,
               row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS rn,
               CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS l_shipdate_count
        FROM lineitem GROUP BY l_returnflag, l_linenumber) WHERE rn = 1
    """,
)
def group_mode(spark, sf):
    return grouping.group_by(
        table(spark, sf, "lineitem"), "l_returnflag",
        [{"column": "l_linenumber", "function": "mode"}, {"column": "l_shipdate", "function": "count"}],
    )


@register(
    "group_median",
    "SELECT o_orderpriority, round(median(o_totalprice), 6) AS mid FROM orders GROUP BY 1",
)
def group_median(spark, sf):
    df = grouping.group_by(
        table(spark, sf, "orders"), "o_orderpriority",
        [{"column": "o_totalprice", "function": "median", "output_column": "mid"}])
    return df.withColumn("mid", F.round("mid", 6))


_FLAGS = ("A", "N", "R")


def _pivot_sql(agg: str, missing: str) -> str:
    cells = ", ".join(
        f"coalesce({agg.format(f=f)}, {missing}) AS {f}" for f in _FLAGS)
    return f"SELECT l_linenumber, {cells} FROM lineitem GROUP BY 1"


@register("pivot_sum", _pivot_sql("round(sum(l_quantity) FILTER (l_returnflag = '{f}'), 4)", "0"))
def pivot_sum(spark, sf):
    df = grouping.pivot(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return df.select("l_linenumber", *[F.round(f, 4).alias(f) for f in _FLAGS])


@register(
    "pivot_count_given_values",
    _pivot_sql("count(l_quantity) FILTER (l_returnflag = '{f}')", "0"),
)
def pivot_count_given_values(spark, sf):
    return grouping.pivot(
        table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", "count",
        values=list(_FLAGS))


@register(
    "pivot_text_fill",
    """
    SELECT o_orderpriority,
           coalesce(CAST(min(o_orderkey) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) AS VARCHAR), '-') AS F,
           coalesce(CAST(min(o_orderkey) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000) AS VARCHAR), '-') AS O,
           coalesce(CAST(min(o_orderkey) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) AS VARCHAR), '-') AS P
    FROM orders WHERE o_totalprice > 400000 GROUP BY 1
    """,
)
def pivot_text_fill(spark, sf):
    df = table(spark, sf, "orders").withColumn("big", F.when(F.col("o_totalprice") > 400000, F.col("o_orderkey")))
    return grouping.pivot(df, "o_orderpriority", "o_orderstatus", "big", "min", "-")


@register(
    "pivot_first",
    """
    SELECT user_id, coalesce(arg_min(value, event_id) FILTER (event_type = 'click'), 0) AS click,
           coalesce(arg_min(value, event_id) FILTER (event_type = 'error'), 0) AS error,
           coalesce(arg_min(value, event_id) FILTER (event_type = 'purchase'), 0) AS purchase,
           coalesce(arg_min(value, event_id) FILTER (event_type = 'signup'), 0) AS signup,
           coalesce(arg_min(value, event_id) FILTER (event_type = 'view'), 0) AS view
    FROM events GROUP BY 1
    """,
)
def pivot_first(spark, sf):
    return grouping.pivot(
        table(spark, sf, "events"), "user_id", "event_type", "value", "first", order_by="event_id")


@register(
    "pivot_map",
    """
    SELECT l_returnflag, l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem
    WHERE l_returnflag IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2
    """,
)
def pivot_map(spark, sf):
    """A column for each supplier would grow with the table; the map of a row is shown entry by entry."""
    wide = grouping.pivot_map(table(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", "l_linenumber")
    return wide.select("l_returnflag", F.explode("cells").alias("l_suppkey", "lines"))


_CALLS = """
    SELECT conv_id AS run_id, turn AS row, CASE role WHEN 'user' THEN length(text) END AS input_tokens,
           CASE role WHEN 'assistant' THEN length(text) END AS output_tokens FROM conversations
"""


def _calls(spark, sf):
    size = F.length("text").cast("bigint")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("row"),
        F.when(F.col("role") == "user", size).alias("input_tokens"),
        F.when(F.col("role") == "assistant", size).alias("output_tokens"))


def _usage_sql(group: str) -> str:
    return f"""
    SELECT run_id, row, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
           CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
           CAST(coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) AS BIGINT) AS total_tokens
    FROM ({_CALLS}) GROUP BY {group}
    """


register("usage_totals", _usage_sql("run_id, row"))(lambda spark, sf: grouping.usage_totals(_calls(spark, sf)))
register("usage_totals_rollup", _usage_sql("ROLLUP (run_id, row)"))(
    lambda spark, sf: grouping.usage_totals(_calls(spark, sf), rollup=True))

# ── Deduplication, sampling, unions, limits ──────────────────────────────────


def _dedup(keep: str, frame: str):
    order = {"first": "event_id", "last": "event_id DESC"}.get(keep)
    test = "count(*) OVER (PARTITION BY user_id, kind) > 1" if keep == "none" else (
        f"row_number() OVER (PARTITION BY user_id, kind ORDER BY {order}) > 1")
    statement = f"""
        SELECT event_id, user_id, kind, CASE WHEN {test} THEN 'duplicates' ELSE 'unique' END AS port
        FROM (SELECT event_id, user_id, nullif(event_type, 'view') AS kind FROM events)
    """

    def run(spark, sf):
        df = table(spark, sf, "events").select(
            "event_id", "user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
        return with_port(rows.deduplicate(df, "user_id,kind", keep, "event_id"))

    register(frame, statement)(run)


_dedup("first", "deduplicate_first")
_dedup("last", "deduplicate_last")
_dedup("none", "deduplicate_none")


@register(
    "deduplicate_rows",
    """
    SELECT c_nationkey, seg, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, seg) > 1 THEN 'duplicates'
           ELSE 'unique' END AS port
    FROM (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
    """,
)
def deduplicate_rows(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return with_port(rows.deduplicate(df))


@register(
    "deduplicate_documents",
    """
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicates'
           ELSE 'unique' END AS port FROM documents
    """,
)
def deduplicate_documents(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return with_port(rows.deduplicate(df, ["text"], "first", "doc_id")).drop("text")


def _sample_sql(count: str) -> str:
    return f"""
    SELECT o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || chr(1) || '7')) AS rn, count(*) OVER () AS n
        FROM orders) WHERE rn <= {count}
    """


@register("sample_count", _sample_sql("500"))
def sample_count(spark, sf):
    df = rows.sample(table(spark, sf, "orders"), "count", 500, seed=7, key="o_orderkey")
    return df.select("o_orderkey", "o_totalprice")


@register("sample_percent", _sample_sql("round_even(n * 0.125, 0)"))
def sample_percent(spark, sf):
    df = rows.sample(table(spark, sf, "orders"), "percent", percent=12.5, seed=7, key="o_orderkey")
    return df.select("o_orderkey", "o_totalprice")


@register(
    "union_inputs",
    """
    SELECT c_custkey AS id, CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment, NULL AS name FROM customer
    UNION ALL SELECT s_suppkey, 'n/a', NULL, s_name FROM supplier
    """,
)
def union_inputs(spark, sf):
    one = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    two = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("n/a").alias("balance"), F.col("s_name").alias("name"))
    return rows.union_inputs([one, two])


@register(
    "head_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def head_orders(spark, sf):
    return ordering.head(
        table(spark, sf, "orders"), 100, ["-o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@register(
    "row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders",
)
def row_index(spark, sf):
    return ordering.with_row_index(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "row_index"
    ).select("o_orderkey", "row_index")


@register(
    "drop_all_null",
    """
    SELECT a, b FROM (SELECT nullif(event_type, 'view') AS a, CASE WHEN value > 10 THEN value END AS b FROM events)
    WHERE a IS NOT NULL OR b IS NOT NULL
    """,
)
def drop_all_null(spark, sf):
    return rows.drop_all_null(table(spark, sf, "events").select(
        F.nullif(F.col("event_type"), F.lit("view")).alias("a"),
        F.when(F.col("value") > 10, F.col("value")).alias("b")))


# ── Views ────────────────────────────────────────────────────────────────────

@register(
    "preview",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 200) AS text FROM documents ORDER BY documents.doc_id "
    "LIMIT 100",
)
def preview(spark, sf):
    return views.preview(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@register(
    "filter_columns",
    "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'low') "
    "AND contains(lower(o_orderstatus), 'f') AND contains(CAST(o_custkey AS VARCHAR), '1')",
)
def filter_columns(spark, sf):
    return views.filter_columns(
        table(spark, sf, "orders"), {"o_orderpriority": "LOW", "o_orderstatus": "f", "o_custkey": "1"}
    ).select("o_orderkey")


@register(
    "search_all_columns",
    "SELECT p_partkey FROM part WHERE contains(lower(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size)), '17')",
)
def search_all_columns(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return views.search_all(df, "17").select("p_partkey")


@register(
    "sort_events",
    "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST",
)
def sort_events(spark, sf):
    return ordering.sort(table(spark, sf, "events").select("event_id", "value"), "value", "desc")


@register(
    "row_count",
    "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS passed, (SELECT count(*) FROM orders) || ' rows' AS message "
    "FROM orders GROUP BY 1",
)
def row_count(spark, sf):
    """Rows per status, and how many rows were seen passing while they were counted."""
    df, seen = views.observed(table(spark, sf, "orders"), "orders")
    counted = checkpointed(df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
    rows = seen.get["rows"]
    return counted.withColumns({"passed": F.lit(rows).cast("bigint"), "message": F.lit(views.row_message(rows, rows))})


# ── Flagship: tiers of orders per market segment ─────────────────────────────

_TIERS = [
    {"output": "route_1", "conditions": [{"column": "o_totalprice", "op": ">=", "value": "400000"}]},
    {"output": "route_2", "conditions": [{"column": "o_totalprice", "op": ">=", "value": "200000"}]},
]


@register(
    "order_tiers",
    """
    SELECT CASE WHEN o_totalprice >= 400000 THEN 'route_1' WHEN o_totalprice >= 200000 THEN 'route_2'
           ELSE 'default' END AS tier, c_mktsegment, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
    """,
)
def order_tiers(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = joins.merge(orders, customers, "o_custkey", "c_custkey")
    tiered = joined.withColumn("tier", routing.route_column(joined, _TIERS))
    result = grouping.group_by(
        tiered, "tier,c_mktsegment",
        [{"column": "o_orderkey", "function": "count", "output_column": "n_orders"},
         {"column": "o_totalprice", "function": "sum", "output_column": "revenue"}])
    return result.withColumn("revenue", F.round("revenue", 2))
