import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import columns, grouping, joins, ordering, routing, rows, views


def listed(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_filter_is_a_partition(table):
    df = table("i int, v string", [(1, "abc"), (2, None), (3, ""), (4, " "), (5, "ABC.")])
    for operator in ("equals", "not_equals", "contains", "not_contains", "is_empty", "is_not_empty", "regex",
                     "greater_than", "less_than"):
        ports = routing.filter_rows(df, "v", operator, "5" if "than" in operator else "ABC.")
        assert ports["matched"].count() + ports["unmatched"].count() == 5
    assert [r.i for r in routing.filter_rows(df, "v", "is_empty")["matched"].collect()] == [2, 3]
    assert [r.i for r in routing.filter_rows(df, "v", "contains", "bc")["matched"].collect()] == [1, 5]
    with pytest.raises(ValueError):
        routing.filter_rows(df, "none", "equals", "")
    with pytest.raises(ValueError):
        routing.filter_rows(df, "v", "like", "")


def test_number_comparison(table):
    df = table("v string", [(v,) for v in (" 5 ", "1e3", "x", "1_000", "", None, "5d", "nan", "inf", "0x1A")])
    got = [r.v for r in routing.filter_rows(df, "v", "greater_than", "4")["matched"].collect()]
    assert got == [" 5 ", "1e3", "inf"]


def test_router(table):
    df = table("i int, a string, n double", [(1, "X", 5.0), (2, "x", None), (3, None, 9.0), (4, "y", 80.0)])
    rules = '[{"output": "route_2", "conditions": [{"column": "a", "op": "equals", "value": "x"}, {"column": "n", "op": ">=", "value": "5"}]},' \
            '{"output": "route_1", "conditions": [{"column": "gone", "op": "is_empty"}]},' \
            '{"output": "route_4", "conditions": [{"column": "a", "op": "is_empty"}]},' \
            '{"output": "route_3", "conditions": [{"column": "n", "op": ">", "value": "many"}]}]'
    ports = routing.route(df, rules)
    assert {name: [r.i for r in p.collect()] for name, p in ports.items()} == {
        "route_1": [], "route_2": [1], "route_3": [], "route_4": [3], "default": [2, 4]}
    everything = routing.route(df, rules[:-1] + ',{"output": "route_1", "conditions": []}]')
    assert everything["default"].count() == 0


def test_template(table):
    df = table("A string, `B c` double, d boolean", [("{B c}", 1.5e7, True), (None, 2.0, None)])
    got = [r.t for r in columns.formula(df, "t", "<{A}|{B c}|{d}|{e}>").collect()]
    assert got == ["<{B c}|15000000.0|True|{e}>", "<|2.0||{e}>"]


def test_expression(table):
    df = table("`a b` string, n int", [("7", 2), ("x", None)])

    def value(formula):
        return [r.v for r in columns.formula(df, "v", formula, "expression").collect()]

    assert value("[a b] * 2 + [n]") == [16.0, 0.0]
    assert value("-[a b] // [n]") == [-4.0, None]
    assert value("[a b] % 4") == [3.0, 0.0]
    assert value("count_filled([a b],[n],[zz]) / 2 * 100") == [100.0, 50.0]
    assert value("1 < [n] <= 2") == [True, False]
    assert value("[nope] + 1") == [None, None]
    for bad in ("__import__('os')", "[n].x", "'a'", "lambda: 1", "[n] and 1"):
        with pytest.raises(ValueError):
            value(bad)


def test_normalize(table):
    df = table("a string, b string, n int", [(" x ", "12-", 3)])
    out = columns.normalize(df, [
        {"column": "*", "function": "trim"}, {"column": "n", "output_column": "m", "function": "uppercase"},
        {"column": "b", "function": "regex_extract", "params": {"pattern": r"\d+"}}, {"column": "zz"}])
    assert tuple(out.first()) == ("x", "12", 3, "3")


def test_deduplicate_matches_brute_force(spark):
    random.seed(5)
    data = [(i, random.choice(["a", "b", None]), random.choice([1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(data, "i int, k string, n int")
    for keep in ("first", "last", "none"):
        groups = {}
        for row in data:
            groups.setdefault(row[1:], []).append(row)
        unique = {"first": [g[0] for g in groups.values()], "last": [g[-1] for g in groups.values()],
                  "none": [g[0] for g in groups.values() if len(g) == 1]}[keep]
        ports = rows.deduplicate(df, "k,n", keep, "i")
        assert sorted(listed(ports["unique"])) == sorted(unique)
        assert sorted(r.i for r in ports["duplicates"].collect()) == sorted(
            r[0] for r in data if r not in unique)
        two = rows.deduplicate(df, ["k", "n"], keep, ["n", "i"])
        assert two["unique"].count() + two["duplicates"].count() == 200


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_deduplicate_without_order(table, keep):
    data = [("a", 1), ("a", 1), ("a", 2), ("b", None), (None, None), (None, None)]
    df = table("k string, n int", data)
    for keys in (None, "k"):
        ports = rows.deduplicate(df, keys, keep)
        both = listed(ports["unique"]) + listed(ports["duplicates"])
        assert sorted(map(str, both)) == sorted(map(str, data))
    ports = rows.deduplicate(df, "k", keep)
    assert sorted(map(str, listed(ports["unique"]))) == sorted(map(str, {
        "first": [("a", 1), ("b", None), (None, None)], "last": [("a", 2), ("b", None), (None, None)],
        "none": [("b", None)]}[keep]))


def test_sample(spark, monkeypatch):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    one = sorted(r.id for r in rows.sample(df, "count", 777, seed=3, key="id").collect())
    assert len(one) == 777
    assert one == sorted(r.id for r in rows.sample(df.repartition(5), "count", 777, seed=3, key="id").collect())
    # Refining the cut must not change the sample.
    monkeypatch.setattr(rows, "_FINE_ENOUGH", 0)
    monkeypatch.setattr(rows, "_DIGITS", 1)
    assert one == sorted(r.id for r in rows.sample(df, "count", 777, seed=3, key="id").collect())
    monkeypatch.undo()
    assert one != sorted(r.id for r in rows.sample(df, "count", 777, seed=0, key="id").collect())
    assert rows.sample(df, "percent", percent=25, key="id").count() == 1250
    assert rows.sample(spark.range(10), "percent", percent=25, key="id").count() == 2
    assert rows.sample(df, "count", 9999, key="id").count() == 5000
    assert rows.sample(df, "count", 0, key="id").count() == 0


def test_row_index_and_head(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = sorted((r.v, r._index) for r in ordering.with_row_index(df, "v").collect())
    assert [i for _, i in got] == list(range(1000))
    small = listed(ordering.head(df, 5, "-v"))
    monkeypatch.setattr(ordering, "HEAP_LIMIT", 0)
    assert sorted(listed(ordering.head(df, 5, "-v")), reverse=True) == small
    with pytest.raises(ValueError):
        ordering.head(df, 5, None)


def test_median_and_mode(spark):
    random.seed(1)
    data = [(random.choice("aab") if i % 9 else None, float(random.randint(0, 40)) if i % 7 else None) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v double")
    import statistics

    got = {r.k: (r.m, r.o) for r in grouping.group_by(df, "k", [
        {"column": "v", "function": "median", "output_column": "m"},
        {"column": "v", "function": "mode", "output_column": "o"}]).collect()}
    for key in {k for k, _ in data}:
        values = [v for k, v in data if k == key and v is not None]
        assert got[key] == (statistics.median(values), min(statistics.multimode(values)))


def test_group_errors_and_nulls(table):
    df = table("k string, v int", [("a", 1), ("a", None), (None, None)])
    got = listed(grouping.group_by(df, "k", [{"column": "v", "function": "sum"}, {"column": "v", "function": "count"}]))
    assert got == [("a", 1, 1), (None, 0, 0)]
    with pytest.raises(ValueError):
        grouping.group_by(df, "k", [{"column": "v"}, {"column": "v"}])
    with pytest.raises(ValueError):
        grouping.group_by(df, "k", [{"column": "v", "function": "first"}])


def test_pivot(table):
    df = table("i string, p string, v int", [("x", "A", 1), ("x", "B", None), ("y", "A", 3), (None, "A", 4), ("z", None, 5)])
    assert listed(grouping.pivot(df, "i", "p", "v", "sum")) == [("x", 1, 0), ("y", 3, 0)]
    assert grouping.pivot(df, "i", "p", "v", "max").columns == ["i", "A"]
    assert listed(grouping.pivot(df, "i", "p", "v", "sum", "none")) == [("x", "1", "0"), ("y", "3", "none")]


def test_pivot_of_any_width(spark, table):
    df = table("i string, p string, v int", [("x", "A", 1), ("x", "B", None), ("y", "A", 3), ("y", "A", 4), (None, "A", 4), ("z", None, 5)])
    assert listed(grouping.pivot_map(df, "i", "p", "v")) == [("x", {"A": 1, "B": 0}), ("y", {"A": 7})]
    assert listed(grouping.pivot_map(df, "i", "p", "v", "max")) == [("x", {"A": 1}), ("y", {"A": 4})]
    assert grouping.pivot_map(df.limit(0), "i", "p", "v").isEmpty()
    many = spark.range(50_000).selectExpr("id % 3 AS i", "id AS p", "id * 2 AS v")
    with pytest.raises(ValueError, match="pivot_map"):
        grouping.pivot(many, "i", "p", "v")
    got = grouping.pivot_map(many, "i", "p", "v").collect()
    assert sorted(r.i for r in got) == [0, 1, 2]
    assert all(r.cells == {p: 2 * p for p in range(r.i, 50_000, 3)} for r in got)


def test_merge_names(table):
    left = table("k int, v int", [(1, 10), (None, 11)])
    right = table("k int, v int, w int", [(1, 20, 1), (None, 21, 2), (3, 22, 3)])
    out = joins.merge(left, right, "k", "k", "outer")
    assert out.columns == ["k", "v", "v_right", "w"]
    assert sorted(map(str, listed(out))) == sorted(map(str, [(1, 10, 20, 1), (None, 11, 21, 2), (3, None, 22, 3)]))
    assert joins.merge(left, right, "k", "w").columns == ["k", "v", "k_right", "v_right", "w"]
    for how in ("left", "right", "inner"):
        plain = sorted(map(str, listed(joins.merge(left, right, "k", "k", how))))
        assert plain == sorted(map(str, listed(joins.merge(left, right, "k", "k", how, salt=3))))
    with pytest.raises(ValueError):
        joins.merge(left, right, "", "k")


def test_union_and_views(table, spark):
    one = table("a int, b string", [(1, "x")])
    two = table("a string, c timestamp_ntz", [("y", datetime.datetime(2020, 1, 1))])
    out = rows.union_inputs([one, two])
    assert out.columns == ["a", "b", "c"] and [r.a for r in out.collect()] == ["1", "y"]
    assert views.preview(table("t string", [("z" * 500,)])).first()[0] == "z" * 200
    assert views.profile(one) == {"columns": ["a", "b"], "row_count": 1, "sample": [{"a": 1, "b": "x"}]}
    df, seen = views.observed(spark.range(7), "seven")
    df.collect()
    assert views.row_message(seen.get["rows"], 3) == "7 rows"
    assert views.row_message(0, 3) == "Exported 3 rows"
    assert columns.new_columns([one], out) == ["c"]


def test_streaming_rows(spark, tmp_path):
    """Row-wise operators take a streaming table unchanged."""
    spark.range(10).withColumn("t", F.lit(" a ")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    cleaned = columns.normalize(stream, [{"column": "t", "function": "trim"}])
    kept = routing.filter_rows(cleaned, "id", "less_than", "4")["matched"]
    query = kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    query.awaitTermination()
    assert listed(spark.table("kept"), "id") == [(i, "a") for i in range(4)]


def test_salted_joins_are_plain_joins(table):
    left = table("k string, a int", [("x", i) for i in range(30)] + [(None, 1), ("y", 2), ("z", 3)])
    right = table("k string, a int, b string", [("x", 5, "p"), ("x", 6, "q"), (None, 7, "n"), ("w", 8, "w"), ("w", 9, None)])
    other = right.withColumnRenamed("k", "key 2")
    for how in ("inner", "left", "right", "outer"):
        for side, name in ((right, "k"), (other, "key 2")):
            plain, salted = (joins.merge(left, side, "k", name, how, salt=n) for n in (1, 4))
            assert salted.columns == plain.columns and salted.dtypes == plain.dtypes
            assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
    outer = joins.merge(left, right, "k", "k", "outer", salt=4)
    assert outer.count() == 30 * 2 + 1 + 2 + 2
    assert joins.merge(left.limit(0), right, "k", "k", "outer", salt=3).count() == 5
