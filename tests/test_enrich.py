import json
import os
import time
import uuid

from pyspark.sql import functions as F

from tabloom.enrich import operators
from tabloom.enrich.calls import infer, infer_stored, is_transient
from tabloom.enrich.requests import pack_requests, row_context
from tabloom.enrich.responses import map_fields, parse_responses, unpack_results


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    return [(r.status, json.loads(r.json) if r.json else None) for r in parse_responses(df).orderBy("i").collect()]


def test_malformed_responses(spark):
    cases = {
        '```json\n{"a": 1}\n```': ("ok", {"a": 1}),
        '```{"a": 1}```': ("ok", {"a": 1}),
        '<think>{"no": 1}</think> {"a": 1,}': ("ok", {"a": 1}),
        'Sure: {"a": [1, 2,]} done': ("repaired", {"a": [1, 2]}),
        '{"a": 1, "b": "cut in a st': ("repaired", {"a": 1, "b": "cut in a st"}),
        '{"a": 1, "b': ("repaired", {"a": 1}),
        '{"a': ("repaired", {}),
        '{"a": {"x": ["p", "q"], "y": [{"z": 1': ("repaired", {"a": {"x": ["p", "q"], "y": [{"z": 1}]}}),
        '{"a": "bad \\S escape", "b": 2': ("repaired", {"a": "bad \\S escape", "b": 2}),
        '{"a": "line\nbreak"}': ("repaired", {"a": "line\nbreak"}),
        '{"names": ["x","y","z"': ("repaired", {"names": ["x", "y", "z"]}),
        '{"k": ["a","b","c","d","e': ("repaired", {"k": ["a", "b", "c", "d"]}),
        '{"a": 1, "b": {"c": [1, {"d": "par': ("repaired", {"a": 1, "b": {"c": [1, {"d": "par"}]}}),
        '{"a": 1, "b": tru': ("repaired", {"a": 1}),
        '{"a": "x\\': ("repaired", {"a": "x"}),
        "no json": ("failed", None), "": ("failed", None), '{"a": tru': ("failed", None), None: ("failed", None),
    }
    assert parse(spark, list(cases)) == list(cases.values())


def test_field_mapping(spark):
    df = spark.createDataFrame([('{"s": " x\\ny ", "l": ["a", "", null, 1, 0, true, "0"], "n": 0, "f": 85.5, "t": true, "z": null, "o": {"k": 1}, "a\'b": "q"}',)], "json string")
    keys = {k: f"c_{i}" for i, k in enumerate(["s", "l", "n", "f", "t", "z", "o", "none", "a'b"])}
    assert list(map_fields(df, keys).drop("json").first()) == ["x y", "a, 1, True, 0", "", "85.5", "True", "", '{"k":1}', "", "q"]


def test_transient(spark):
    df = spark.createDataFrame([("HTTP 429 x",), ("Rate Limit",), ("invalid key",), (None,)], "m string")
    assert [r[0] for r in df.select(is_transient(F.col("m"))).collect()] == [True, True, False, False]


def test_retries_and_errors(spark, tmp_path):
    folder = str(tmp_path)

    def predict(request):
        mark = os.path.join(folder, f"{request['i']}")
        count = int(open(mark).read()) + 1 if os.path.exists(mark) else 1
        with open(mark, "w") as f:
            f.write(str(count))
        if request["i"] == 1 and count < 3:
            raise RuntimeError("503 upstream")
        if request["i"] == 2:
            raise ValueError("refused")
        if request["i"] == 3:
            raise TimeoutError("timed out")
        return {"text": "fine", "input_tokens": 5, "output_tokens": 2}

    df = spark.range(4).withColumnRenamed("id", "i").withColumn("content", F.lit("big"))
    got = {r.i: (r.response, r.error, r.attempts, r.input_tokens)
           for r in infer(df, predict, base_delay=0, keep=["i"]).collect()}
    assert got == {0: ("fine", None, 1, 5), 1: ("fine", None, 3, 5), 2: (None, "refused", 1, 0), 3: (None, "timed out", 4, 0)}


def test_stored_answers_are_not_asked_again(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def predict(request):
        with open(os.path.join(calls, f"{request['prompt']}-{os.urandom(4).hex()}"), "w"):
            pass
        if request["prompt"] == "c" and len(os.listdir(calls)) <= 3:
            raise ValueError("no")
        return request["prompt"].upper()

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "i int, prompt string").coalesce(1)
    store = str(tmp_path / "answers")
    first = {r.i: r.response for r in infer_stored(df, predict, store, ["prompt"]).collect()}
    assert first == {1: "A", 2: "B", 3: "A", 4: None} and len(os.listdir(calls)) == 3
    second = {r.i: r.response for r in infer_stored(df, predict, store, ["prompt"]).collect()}
    assert second == {1: "A", 2: "B", 3: "A", 4: "C"} and len(os.listdir(calls)) == 4


def test_stored_answers_cost_each_call_once(spark, tmp_path):
    """Every operator, read by two sinks and built a second time, sends each request once."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def predict(request):
        with open(calls / uuid.uuid4().hex, "w") as f:
            f.write(request["prompt"])
        return json.dumps({"answer": "x", "v": "x", "fields": {"b": "x"}, "confidence": 90, "results": [{"index": i, "v": "x"} for i in range(2)]})

    df = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "c", "")], "i int, a string, b string")
    files = spark.createDataFrame([(x, bytearray(b"\xff\xfe")) for x in "abc"], "path string, content binary")
    runs = {
        "classify": (lambda s: operators.classify(df, "i", "{{a}}", ["x", "y"], predict=predict, store=s), 3),
        "enrich": (lambda s: operators.enrich(df, "i", "{{a}}", {"v": "v"}, predict, batch_size=2, store=s), 2),
        "fill": (lambda s: operators.fill_missing(df, "i", ["b"], "{{a}}", predict, store=s), 3),
        "answer": (lambda s: operators.answer(df, "i", "{{a}}", predict, store=s), 3),
        "images": (lambda s: operators.enrich_images(df, "i", "a", "same", {"v": "v"}, predict, files=files, store=s), 3),
    }
    expected = 0
    for name, (build, sent) in runs.items():
        store = str(tmp_path / name)
        expected += sent
        out = build(store)
        assert out.count() == 3 and len(out.collect()) == 3 and len(build(store).collect()) == 3
        assert len(os.listdir(calls)) == expected, name


def test_calls_are_spaced(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(6)], "i int, prompt string").coalesce(1)
    got = infer(df, lambda r: str(time.monotonic()), per_minute=600).collect()
    starts = sorted(float(r.response) for r in got)
    assert all(b - a > 0.07 for a, b in zip(starts, starts[1:]))


def test_packing_round_trip(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(13)], "i int, prompt string").repartition(4)
    requests, members = pack_requests(df, "i", "prompt", 5, 100)
    got = {r.batch_id: (r.size, r.max_tokens, r.prompt) for r in requests.collect()}
    assert [got[b][:2] for b in range(3)] == [(5, 500), (5, 500), (3, 300)]
    assert got[2][2] == "=== Item 0 ===\np10\n\n=== Item 1 ===\np11\n\n=== Item 2 ===\np12"
    parsed = spark.createDataFrame(
        [(0, '{"results": [{"index": "1", "v": "x"}, {"index": 1.0, "v": "y"}, {"v": "z"}, {"index": 7, "v": "q"}]}'), (1, None)],
        "batch_id long, json string")
    out = {r.row_id: json.loads(r.json) for r in unpack_results(parsed, members).collect()}
    assert len(out) == 13 and out[1] == {"index": 1.0, "v": "y"} and out[0] == {} and out[7] == {}


def test_enrich_failure_gives_empty_cells(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(6)], "i int, t string")

    def predict(request):
        if "t3" in request["prompt"]:
            raise ValueError("refused")
        n = request["prompt"].count("=== Item")
        return json.dumps({"results": [{"index": k, "v": k} for k in range(n)]})

    got = [r.v for r in operators.enrich(df, "i", "t{t}", {"v": "v"}, predict, batch_size=2, base_delay=0).orderBy("i").collect()]
    assert got == ["", "1", "", "", "", "1"]
    single = operators.enrich(df, "i", "t{t}", {"v": "v"}, lambda r: '{"v": "' + r["prompt"] + '"}', batch_mode=False)
    assert [r.v for r in single.orderBy("i").collect()] == [f"t{i}" for i in range(6)]


def test_fill_missing_skips_complete_rows(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, " ", "y"), (3, None, None)], "i int, a string, b string")

    def predict(request):
        assert request["i"] != 1
        return '{"a": "A", "b": ["p", "q"], "confidence": {"b": 49}}' if request["i"] == 2 else '{"fields": {"a": "AA", "b": "BB"}}'

    out = operators.fill_missing(df, "i", [{"column": "a"}, "b", "c"], predict=predict)
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, "x", "y", ""), (2, "A", "y", ""), (3, "AA", "BB", "")]
    assert row_context(df) is not None


def test_vision_reads_files(spark, tmp_path):
    for name in ("a.tif", "b.tif"):
        (tmp_path / name).write_bytes(name.encode())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    df = spark.createDataFrame([(1, str(tmp_path / "a.tif"), "old"), (2, "nan", "old"), (3, str(tmp_path / "zz.tif"), "old")],
                               "i int, p string, cap string")

    def predict(request):
        if request["content"] is None:
            raise FileNotFoundError("no file")
        return json.dumps({"cap": bytes(request["content"]).decode()})

    out = operators.enrich_images(df, "i", "p", "see {i}", {"cap": "cap"}, predict, files=files)
    assert [r.cap for r in out.orderBy("i").collect()] == ["a.tif", "old", ""]


def test_images_are_read_by_the_asking_task(spark, tmp_path):
    """Files and archive entries reach the call as bytes without a column of bytes in the plan; a missing file is none."""
    import zipfile

    (tmp_path / "a.jpg").write_bytes(b"12")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/b.jpg", b"123")
    paths = [(1, f"{tmp_path}/a.jpg"), (2, f"{tmp_path}/z.zip!/in/b.jpg"), (3, f"{tmp_path}/none.jpg"), (4, "")]
    df = spark.createDataFrame(paths, "i int, p string")

    def predict(request):
        return json.dumps({"n": str(len(request["content"] or b""))})

    for store in (None, str(tmp_path / "answers")):
        out = operators.enrich_images(df, "i", "p", "see", {"n": "n"}, predict, read_files=True, **({"store": store} if store else {}))
        assert "content" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r.i: r.n for r in out.collect()} == {1: "2", 2: "3", 3: "0", 4: ""}
