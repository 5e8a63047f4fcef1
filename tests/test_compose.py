import pytest
from pyspark.sql import functions as F

from tabloom.plans import compose, templates
from tabloom.plans.templates import edge, node


def test_cleanup_from_file_to_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1, Ann \n2,Bob\n3,Ann\n,\n")
    spec = templates.csv_cleanup([{"column": "*", "function": "trim"}], "name", "id", str(tmp_path / "in.csv"))
    results = compose.run_pipeline(spark, spec)
    assert {r.id for r in results[("unique", "duplicates")].collect()} == {3}
    paths = compose.write_sinks(spec, results, str(tmp_path / "out"))
    assert sorted(r.name for r in spark.read.parquet(paths[0]).collect()) == ["Ann", "Bob"]


def test_several_edges_into_one_port(spark):
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y",)], "a string")
    spec = {"nodes": [node("s", "input_csv"), node("t", "input_csv"), node("n", "transform_normalize", operations="[]"),
                      node("o", "output_json", filename="o.json")],
            "edges": [{"source": "s", "target": "n"}, edge("t", "n"), edge("n", "o")]}
    results = compose.run_pipeline(spark, spec, {"s": one, "t": two})
    assert sorted(map(str, results[("n", "output")].collect())) == sorted(["Row(a='1', b='x')", "Row(a='y', b=None)"])


def test_errors(spark):
    loop = {"nodes": [node("a", "transform_filter"), node("b", "transform_filter")], "edges": [edge("a", "b"), edge("b", "a")]}
    with pytest.raises(ValueError, match="cycle"):
        compose.run_pipeline(spark, loop)
    with pytest.raises(ValueError, match="unknown operator"):
        compose.run_pipeline(spark, {"nodes": [node("a", "nope")]})
    with pytest.raises(ValueError, match="sources"):
        compose.run_pipeline(spark, {"nodes": [node("a", "input_xlsx")]})
    spec = {"nodes": [node("a", "input_csv"), node("b", "transform_sample")], "edges": [edge("a", "b", "left")]}
    with pytest.raises(ValueError, match="port"):
        compose.run_pipeline(spark, spec, {"a": spark.range(1)})


def test_every_operator_runs_in_a_pipeline(spark):
    df = spark.createDataFrame([(i, f"Paris {i % 3}", float(i), "Paris") for i in range(12)], "i int, t string, v double, p string")
    reply = spark.range(12).select(F.col("id").alias("row_id"), F.lit('{"a": "A", "answer": "x", "confidence": 80}').alias("response"))
    configs = {
        "transform_formula": {"output_column": "f", "formula": "{t}"},
        "transform_filter": {"column": "v", "operator": "greater_than", "value": "5"},
        "transform_split": {"rules": []},
        "transform_group": {"group_by": "t", "aggregations": [{"column": "v", "function": "max"}]},
        "transform_pivot": {"index": "t", "pivot_column": "p", "value_column": "v"},
        "transform_deduplicate": {"columns": "t", "order_by": "i"},
        "transform_sample": {"count": 5, "key": "i"},
        "lookup_dictionary": {"dictionary": {"paris 1": "one"}, "source_column": "t", "output_column": "o"},
        "lookup_bl_area": {"geo_columns": "p", "places": {"paris": "249"}},
        "lookup_lcsh": {"country_col": "p"},
        "ai_enrich": {"row_id": "i", "user_prompt_template": "{t}", "json_field_mapping": {"a": "a"}, "responses": reply},
        "ai_classify": {"row_id": "i", "prompt_template": "{t}", "labels": "A,B", "responses": reply},
        "ai_autofill": {"row_id": "i", "fields_to_fill": ["a"], "responses": reply},
        "ai_vision": {"row_id": "i", "image_column": "t", "user_prompt_template": "{t}", "json_field_mapping": {"a": "a"}, "responses": reply},
    }
    spec = {"nodes": [node("s", "input_csv")] + [node(k, k, **v) for k, v in configs.items()],
            "edges": [edge("s", k) for k in configs]}
    results = compose.run_pipeline(spark, spec, {"s": df})
    assert {n for n, _ in results} == {"s", *configs}
    assert results[("ai_autofill", "output")].filter("a = 'A'").count() == 12
    assert results[("lookup_bl_area", "output")].first().bl_area_matched == "249"
    search = {"nodes": [node("s", "input_csv"), node("k", "input_csv"),
                        node("q", "ai_search", row_id="i", query_template="{t}", knowledge_id="i", knowledge_columns="t", responses=reply)],
              "edges": [edge("s", "q"), edge("k", "q", target_port="knowledge")]}
    found = compose.run_pipeline(spark, search, {"s": df, "k": df})[("q", "output")]
    assert {(r.ai_answer, r.ai_confidence) for r in found.collect()} == {("x", 80.0)}


def test_linkage_pipeline(spark, tmp_path):
    left = spark.createDataFrame([(1, "10 a 1900", "Old� town")], "id int, `Call Number` string, title string")
    right = spark.createDataFrame([(5, "10 a 1900 old town.tif", "/x")], "rid int, filename string, file_path string")
    spec = templates.catalogue_linkage("id", "rid", "title", "filename")
    results = compose.run_pipeline(spark, spec, {"catalogue": left, "images": right})
    assert results[("write_matched", "input")].first().title == "Old town"
    assert len(compose.write_sinks(spec, results, str(tmp_path))) == 4


def test_plugin(spark):
    def register(operator, function, dictionary):
        operator("double", lambda inputs, config: {"output": inputs["input"].unionAll(inputs["input"])})
        function("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
        dictionary("pets", {"cat": "meow"})

    compose.register_plugin(register)
    spec = {"nodes": [node("s", "input_csv"), node("d", "double"),
                      node("n", "transform_normalize", operations=[{"column": "t", "function": "shout"}]),
                      node("l", "lookup_dictionary", builtin_name="pets", source_column="p", output_column="o")],
            "edges": [edge("s", "d"), edge("d", "n"), edge("n", "l")]}
    df = spark.createDataFrame([("a", "Cat")], "t string, p string")
    assert [tuple(r) for r in compose.run_pipeline(spark, spec, {"s": df})[("l", "output")].collect()] == [("A!", "Cat", "meow")] * 2


def test_settings_as_text(spark):
    from tabloom.plans.compose import typed

    got = typed({"percent": "50", "min_match_length": "5", "batch_size": "3", "case_sensitive": "false", "batch_mode": "True",
                 "fill_value": "", "mode": "", "count": "", "top_k": None, "include_index": 0, "confidence_threshold": "0.5"})
    assert got == {"percent": 50.0, "min_match_length": 5, "batch_size": 3, "case_sensitive": False, "batch_mode": True,
                   "fill_value": "", "include_index": False, "confidence_threshold": 0.5}


def test_pivot_keeps_an_empty_fill_value(spark):
    spec = {"nodes": [{"id": "a", "type": "input_csv"}, {"id": "p", "type": "transform_pivot", "data": {"config": {
        "index": "k", "pivot_column": "c", "value_column": "v", "agg_func": "sum", "fill_value": ""}}}], "edges": [{"source": "a", "target": "p"}]}
    df = spark.createDataFrame([("x", "a", 1), ("y", "b", 2)], "k string, c string, v int")
    out = compose.run_pipeline(spark, spec, {"a": df})[("p", "output")]
    assert sorted(map(tuple, out.collect())) == [("x", "1", ""), ("y", "", "2")]


def test_payloads_of_a_service_are_opened_along_the_path(spark):
    spec = {"nodes": [{"id": "a", "type": "input_api", "data": {"config": {"json_path": "data.items"}}}], "edges": []}
    df = spark.createDataFrame([('{"data": {"items": [{"n": 1}, {"n": 2}]}}',)], "body string")
    assert sorted(r.n for r in compose.run_pipeline(spark, spec, {"a": df})[("a", "output")].collect()) == [1, 2]


def test_map_analysis_from_a_spec(spark):
    responses = spark.createDataFrame([
        (1, "extract", "", "", '{"fields": {"title": {"value": "T", "evidence_bbox": [1, 2, 3, 4]}}}'),
        (1, "review", "ocr", "", '{"title": {"ok": true}}')], "doc_id int, task string, domain string, field string, response string")
    config = {"row_id": "id", "image_column": "path", "responses": responses, "max_correction_rounds": "1", "dublin_core_export": "true"}
    spec = {"nodes": [{"id": "a", "type": "input_csv"}, {"id": "m", "type": "ai_map_analysis", "data": {"config": config}}], "edges": [{"source": "a", "target": "m"}]}
    df = spark.createDataFrame([(1, "x.tif"), (2, "y.tif"), (3, None)], "id int, path string")
    rows = {r.id: r for r in compose.run_pipeline(spark, spec, {"a": df})[("m", "output")].collect()}
    assert [(rows[i].map_title, rows[i].map_state, rows[i]["dc:title"]) for i in (1, 2, 3)] == [("T", "done", "T"), ("", "failed", ""), ("", "skipped", "")]
