"""Prompts, calls, responses and acceptance rules with deterministic answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import registry, table
from queries.retrieval import BM25_SQL
from tabloom.enrich import operators
from tabloom.enrich.calls import infer, is_transient
from tabloom.enrich.requests import pack_requests, render_prompts, row_context
from tabloom.enrich.responses import map_fields, parse_responses, split_failed, unpack_results

QUERIES, SQL, register = registry()

_TURNS = "SELECT conv_id * 1000 + turn AS row_id, role, text FROM conversations"


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", "text")


@register("render_prompts", f"SELECT row_id, 'Role: ' || role || '; say ' || text AS prompt FROM ({_TURNS})")
def render_prompts_query(spark, sf):
    return render_prompts(_turns(spark, sf), "Role: {role}; say {text}").select("row_id", "prompt")


_PACKED = f"""
    SELECT row_id, role, (row_number() OVER (ORDER BY row_id) - 1) // 5 AS batch_id,
           (row_number() OVER (ORDER BY row_id) - 1) % 5 AS position FROM ({_TURNS})
"""


@register(
    "pack_requests",
    f"""
    SELECT batch_id, string_agg('=== Item ' || position || ' ===' || chr(10) || role || ' ' || row_id, chr(10) || chr(10)
        ORDER BY position) AS prompt, count(*) AS size, count(*) * 300 AS max_tokens FROM ({_PACKED}) GROUP BY 1
    """,
)
def pack_requests_query(spark, sf):
    prompts = render_prompts(_turns(spark, sf), "{role} {row_id}")
    return pack_requests(prompts, "row_id", "prompt", 5, 300)[0]


@register("pack_members", f"SELECT batch_id, position, row_id FROM ({_PACKED})")
def pack_members(spark, sf):
    prompts = render_prompts(_turns(spark, sf), "{role} {row_id}")
    return pack_requests(prompts, "row_id", "prompt", 5)[1]


def _shout(request):
    """Deterministic stand-in for a model: fails for two kinds of requests."""
    if request["role"] == "system":
        raise RuntimeError("HTTP 503 from server")
    if len(request["text"]) % 7 == 0:
        raise ValueError("content refused")
    return {"text": request["text"].upper(), "input_tokens": len(request["text"]), "output_tokens": 3}


@register(
    "infer_calls",
    f"""
    SELECT row_id, CASE WHEN failed THEN NULL ELSE len END AS answer_length, CASE WHEN role = 'system' THEN 'HTTP 503 from server'
        WHEN failed THEN 'content refused' END AS error, CASE WHEN role = 'system' THEN 4 ELSE 1 END AS attempts,
        CASE WHEN failed THEN 0 ELSE len END AS input_tokens
    FROM (SELECT row_id, role, length(text) AS len, role = 'system' OR length(text) % 7 = 0 AS failed FROM ({_TURNS}))
    """,
)
def infer_calls(spark, sf):
    df = infer(_turns(spark, sf), _shout, concurrency=4, base_delay=0.0)
    # Upper case may lengthen a text (ß), so the length is taken over the lower case.
    size = F.when(F.col("response").isNotNull(), F.length("text").cast("bigint"))
    return df.select("row_id", size.alias("answer_length"), "error", "attempts", "input_tokens")


@register(
    "transient_errors",
    """
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS transient FROM events
    """,
)
def transient_errors(spark, sf):
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Error 429: "), "props"))
        .when(F.col("event_type") == "view", "Deadline EXCEEDED").when(F.col("event_type") == "click", "invalid key"))
    return table(spark, sf, "events").select("event_id", is_transient(message).cast("int").alias("transient"))


# Responses in all the shapes a model may return; the payload is the part name.
_SHAPES = (
    "{j}", "```json\n{j}\n```", "```{j}```", "<think>maybe {{}} so</think>\n{j}", "Here you are: {j} bye",
    '{{"name": "{n}", "size": {s},}}', '{j} {{"name": "other"}}', '{{"name": "{n}", "size": {s}, "tail": "cut of',
    '{{"name": "{n}", "size": {s}, "tail', '{{"name": "{n}", "list": ["a"], "size": {s}, ', "no json at all", "",
)


def _shaped(spark, sf):
    part = table(spark, sf, "part")
    whole = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "size": '), "p_size", F.lit(', "none": null}'))
    response = None
    for i, shape in enumerate(_SHAPES):
        text = F.lit(shape.replace("{{", "{").replace("}}", "}"))
        text = F.replace(F.replace(F.replace(text, F.lit("{j}"), whole), F.lit("{n}"), F.col("p_name")),
                         F.lit("{s}"), F.col("p_size").cast("string"))
        hit = F.col("p_partkey") % len(_SHAPES) == i
        response = F.when(hit, text) if response is None else response.when(hit, text)
    return part.select("p_partkey", response.alias("response"))


@register(
    "parse_responses",
    """
    SELECT p_partkey, CASE WHEN s >= 10 THEN '' ELSE p_name END AS name,
           CASE WHEN s >= 10 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size, '' AS none,
           CASE WHEN s = 7 THEN 'cut of' ELSE '' END AS tail,
           CASE WHEN s >= 10 THEN 'failed' WHEN s IN (4, 7, 8, 9) THEN 'repaired' ELSE 'ok' END AS status
    FROM (SELECT *, p_partkey % 12 AS s FROM part)
    """,
)
def parse_responses_query(spark, sf):
    parsed = parse_responses(_shaped(spark, sf))
    fields = {"name": "name", "size": "size", "none": "none", "tail": "tail"}
    return map_fields(parsed, fields).select("p_partkey", "name", "size", "none", "tail", "status")


@register("quarantined_responses", "SELECT p_partkey FROM part WHERE p_partkey % 12 >= 10")
def quarantined_responses(spark, sf):
    return split_failed(parse_responses(_shaped(spark, sf)))["quarantine"].select("p_partkey")


@register(
    "map_json_fields",
    """
    SELECT event_id, CASE WHEN k = '0' THEN '' ELSE k END AS k, event_type || ', ' || k AS both, '' AS missing,
           CASE WHEN event_id % 2 = 0 THEN 'True' ELSE '' END AS flag
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
    """,
)
def map_json_fields(spark, sf):
    k = F.get_json_object("props", "$.k")
    events = table(spark, sf, "events").withColumn("json", F.concat(
        F.substring(F.col("props"), F.lit(1), F.length("props") - 1),
        F.lit(', "both": ["'), "event_type", F.lit('", "", null, "'), k, F.lit('"], "flag": '),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}")))
    fields = {"k": "k", "both": "both", "missing": "missing", "flag": "flag"}
    return map_fields(events, fields).select("event_id", *fields.values())


@register(
    "unpack_results",
    f"""
    SELECT row_id, CASE WHEN position = 1 THEN '' WHEN position = 2 THEN 'later' ELSE role END AS role FROM ({_PACKED})
    """,
)
def unpack_results_query(spark, sf):
    prompts = render_prompts(_turns(spark, sf), "{role}")
    _, members = pack_requests(prompts, "row_id", "prompt", 5)
    members = members.join(prompts.select("row_id", "role"), "row_id")
    item = F.struct(F.col("position").alias("index"), "role")
    extra = F.array(
        F.struct(F.lit(2).alias("index"), F.lit("later").alias("role")),
        F.struct(F.lit(99).alias("index"), F.lit("out of range").alias("role")))
    # The model answers in reverse order, leaves item 1 out and repeats item 2.
    answers = members.groupBy("batch_id").agg(
        F.concat(F.reverse(F.array_sort(F.collect_list(F.when(F.col("position") != 1, item)))), extra).alias("results"))
    parsed = answers.select("batch_id", F.to_json(F.struct("results")).alias("json"))
    unpacked = unpack_results(parsed, members.select("batch_id", "position", "row_id"))
    return map_fields(unpacked, {"role": "role"}).select("row_id", "role")


def _size_model(request):
    """Answers every packed item with the length of its text."""
    import json
    import re

    blocks = re.split(r"(?:^|\n\n)=== Item (\d+) ===\n", request["prompt"])[1:]
    results = [
        {"index": int(i), "length": len(body), "kind": ["turn", body.split(":", 1)[0]]}
        for i, body in zip(blocks[::2], blocks[1::2])
    ]
    return "```json\n" + json.dumps({"results": results}) + "\n```"


@register(
    "enrich_batches",
    f"SELECT row_id, CAST(length(role) + 2 + length(CAST(row_id AS VARCHAR)) AS VARCHAR) AS text_length, 'turn, ' || role AS kind "
    f"FROM ({_TURNS})",
)
def enrich_batches(spark, sf):
    df = operators.enrich(
        _turns(spark, sf), "row_id", "{role}: {row_id}", {"length": "text_length", "kind": "kind"}, _size_model, batch_size=4)
    return df.select("row_id", "text_length", "kind")


@register(
    "enrich_from_responses",
    "SELECT p_partkey, p_name AS label, CAST(p_size AS VARCHAR) AS size_text FROM part",
)
def enrich_from_responses(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    responses = part.select(
        F.col("p_partkey").alias("row_id"),
        F.to_json(F.struct(F.col("p_name").alias("n"), F.col("p_size").alias("s"))).alias("response"))
    df = operators.enrich(part, "p_partkey", "{p_name}", {"n": "label", "s": "size_text"}, responses=responses)
    return df.select("p_partkey", "label", "size_text")


@register(
    "classify_documents",
    """
    SELECT doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'unsure' WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'Good text'
           ELSE 'BAD' END AS label
    FROM documents d LEFT JOIN labels USING (doc_id)
    """,
)
def classify_documents(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    reply = F.when(F.col("doc_id") % 5 == 0, " Unsure\n").when(F.col("quality") == 1, "good\nTEXT ").when(
        F.col("quality") == 0, "bad")
    responses = documents.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), reply.alias("response"))
    df = operators.classify(
        documents, "doc_id", "Judge {lang}", "Good text, BAD, bad", "label", responses=responses)
    return df.select("doc_id", "label")


@register(
    "confidence_gate",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_size >= 25 THEN p_name ELSE '' END AS ai_answer,
           CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 AND p_size < 25 THEN 0
           ELSE p_size END AS DOUBLE) AS ai_confidence
    FROM part
    """,
)
def confidence_gate(spark, sf):
    part = table(spark, sf, "part")
    number = F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('"'), "p_size", F.lit('"'))).otherwise(
        F.col("p_size").cast("string"))
    confidence = F.when((F.col("p_partkey") % 4 == 1) & (F.col("p_size") < 25), F.lit("")).otherwise(
        F.concat(F.lit(', "confidence": '), number))
    json = F.when(F.col("p_partkey") % 4 != 0, F.concat(
        F.lit('{"answer": " '), "p_name", F.lit('\\n"'), confidence, F.lit("}")))
    gated = operators.gate(part.withColumn("json", json), confidence_threshold=25)
    return gated.select("p_partkey", "ai_answer", "ai_confidence")


def _first_source(request):
    """Answers with the length of the first context paragraph, sure only when there is one."""
    import json

    context = request["prompt"].split("Search Results:\n", 1)[1].rsplit("\n\nAnswer in JSON", 1)[0]
    found = context.startswith("[1]")
    return json.dumps({"answer": f"{len(context)}" if found else "none", "confidence": 90 if found else 10})


_ANSWER_BM25 = BM25_SQL.replace("{k}", "2")


@register(
    "answer_with_retrieval",
    f"""
    WITH {_ANSWER_BM25},
    dedup AS (SELECT query_id, trim(text, ' ' || chr(10) || chr(9)) AS key, sum(1.0 / (60 + rank)) AS s, min(rank) AS first,
              arg_min(text, rank) AS text FROM bm_top JOIN documents USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, first) AS rank FROM dedup),
    c AS (SELECT query_id, sum(length('[' || rank || '] (rrf(bm25)) ' || text)) + (count(*) - 1) * 2 AS n FROM r GROUP BY 1)
    SELECT item_id, CASE WHEN n IS NULL THEN '' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END AS ai_answer,
           CAST(CASE WHEN n IS NULL THEN 10 ELSE 90 END AS DOUBLE) AS ai_confidence
    FROM benchmark LEFT JOIN c ON query_id = item_id
    """,
)
def answer_with_retrieval(spark, sf):
    df = operators.answer(
        table(spark, sf, "benchmark"), "item_id", "{text}", _first_source,
        knowledge=table(spark, sf, "documents"), knowledge_id="doc_id", knowledge_columns="text", top_k=2, embedder=None)
    return df.select("item_id", "ai_answer", "ai_confidence")


@register(
    "fill_missing_cells",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN NULL
           ELSE 'seg ' || c_nationkey END AS segment,
           CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 THEN 'x' WHEN c_acctbal >= 0 THEN 'x' ELSE 'note' END AS note
    FROM customer
    """,
)
def fill_missing_cells(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, "x").otherwise(" ").alias("note"))
    low = F.when(F.col("c_custkey") % 3 == 0, 49).otherwise(50)
    responses = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.concat(F.lit('{"fields": {"segment": "seg '), "c_nationkey", F.lit('", "note": "note"}, "confidence": {"segment": '),
                 low, F.lit("}}")).alias("response"))
    return operators.fill_missing(df, "c_custkey", ["segment", "note"], responses=responses)


@register(
    "fill_prompts",
    """
    SELECT c_custkey, 'Known data about this item:' || chr(10) || 'c_custkey: ' || c_custkey || chr(10) || 'note: x' || chr(10)
        || chr(10) || 'Fields to extract (only these):' || chr(10) || '- segment: market segment' || chr(10) || chr(10)
        || 'Search Results:' || chr(10) || '(No search results found)' || chr(10) || chr(10)
        || 'Extract the requested fields from the search results. Return JSON only.' AS prompt
    FROM customer WHERE c_mktsegment = 'BUILDING'
    """,
)
def fill_prompts(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.lit("x").alias("note"))
    fields = [{"column": "segment", "description": "market segment"}, {"column": "note"}]
    return operators.fill_prompts(df, "c_custkey", fields, "{c_custkey}")


@register(
    "row_context",
    """
    SELECT doc_id, 'doc_id: ' || doc_id || chr(10) || 'text: ' || substr(text, 1, 200)
        || CASE WHEN lang = 'fr' THEN '' ELSE chr(10) || 'lang: ' || lang END AS context FROM documents
    """,
)
def row_context_query(spark, sf):
    df = table(spark, sf, "documents").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    return df.select("doc_id", row_context(df, fields=3, columns=["doc_id", "text", "lang"]).alias("context"))


@register(
    "enrich_images",
    """
    SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'kept' WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END AS caption
    FROM part
    """,
)
def enrich_images(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_type", F.lit("kept").alias("caption"),
        F.when(F.col("p_type") == "SMALL", "").when(F.col("p_type") == "LARGE", "nan").otherwise(
            F.concat(F.lit("/scans/"), "p_partkey", F.lit(".tif"))).alias("file_path"))
    reply = F.when(F.col("p_partkey") % 2 == 0, "failed").otherwise(
        F.concat(F.lit('{"caption": "'), "p_name", F.lit('"}')))
    responses = part.select(F.col("p_partkey").alias("row_id"), reply.alias("response"))
    df = operators.enrich_images(
        part, "p_partkey", "file_path", "Describe {p_name}", {"caption": "caption"}, responses=responses)
    return df.select("p_partkey", "caption")
