"""Enrichment operators: mapping, classification, retrieval answers, filling, vision.

Each takes either a ``predict`` function or a ready table of responses
(``row_id``, ``response``), so data rules are independent of any model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import as_list, cell_text, col, require, strip
from tabloom.enrich.calls import ask
from tabloom.enrich.requests import pack_requests, render_prompts, row_context
from tabloom.enrich.responses import get, map_fields, parse_responses, unpack_results, variant_text
from tabloom.functions.text import clean_cell
from tabloom.operators.columns import template
from tabloom.operators.routing import has_path, missing_fields
from tabloom.retrieval import bm25, vectors
from tabloom.retrieval.corpus import build_corpus
from tabloom.retrieval.fusion import as_hits, context_blocks, fuse
from tabloom.sources.images import read_bytes


def _responses(requests: DataFrame, predict, responses, row_id: str, **options) -> DataFrame:
    """(row id, response) from a given table or from calls."""
    if responses is not None:
        return responses.select(F.col("row_id").alias("_row"), F.col("response").alias("_response"))
    if predict is None:
        raise ValueError("either predict or responses is required")
    answered = ask(requests, predict, keep=[row_id], **options)
    return answered.select(col(row_id).alias("_row"), F.col("response").alias("_response"))


def _attach(df: DataFrame, row_id: str, answers: DataFrame) -> DataFrame:
    return df.join(answers, col(row_id) == F.col("_row"), "left").drop("_row")


def enrich(
    df: DataFrame,
    row_id: str,
    user_prompt_template: str,
    json_field_mapping: dict[str, str],
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    batch_mode: bool = True,
    batch_size: int = 5,
    max_tokens: int = 300,
    system_prompt: str = "",
    **options,
) -> DataFrame:
    """Fill columns from the JSON a model returns for each row.

    With a ``responses`` table, each response belongs to one row. In batch mode
    several rows share a request and results are matched by index.
    """
    prompts = render_prompts(df, user_prompt_template, "prompt").select(col(row_id), "prompt")
    if responses is None and batch_mode and batch_size > 1:
        requests, members = pack_requests(prompts, row_id, "prompt", batch_size, max_tokens)
        requests = requests.withColumn("system", F.lit(system_prompt))
        answered = ask(requests, predict, keep=["batch_id"], **options)
        objects = unpack_results(parse_responses(answered), members)
        answers = objects.select(F.col("row_id").alias("_row"), "json")
    else:
        requests = prompts.withColumns(
            {"system": F.lit(system_prompt), "max_tokens": F.lit(int(max_tokens))}
        )
        answers = _responses(requests, predict, responses, row_id, **options)
        answers = parse_responses(answers, "_response").select("_row", "json")
    filled = map_fields(answers, json_field_mapping).drop("json")
    targets = list(json_field_mapping.values())
    filled = filled.select("_row", *[col(t).alias(f"_new_{i}") for i, t in enumerate(targets)])
    joined = _attach(df, row_id, filled)
    return joined.withColumns(
        {t: F.coalesce(F.col(f"_new_{i}"), F.lit("")) for i, t in enumerate(targets)}
    ).drop(*[f"_new_{i}" for i in range(len(targets))])


def canonical_label(reply: Column, labels) -> Column:
    """Spelling of the matching label; an unknown reply stays, in lower case."""
    answer = F.lower(clean_cell(F.coalesce(reply, F.lit(""))))
    chosen = answer
    for label in reversed(as_list(labels)):
        chosen = F.when(answer == label.lower(), F.lit(label)).otherwise(chosen)
    return chosen


def classify(
    df: DataFrame,
    row_id: str,
    prompt_template: str,
    labels,
    output_column: str = "classification",
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    **options,
) -> DataFrame:
    names = as_list(labels)
    system = f"Classify into exactly one label: {', '.join(names)}. Reply with ONLY the label."
    requests = render_prompts(df, prompt_template, "prompt").select(col(row_id), "prompt")
    requests = requests.withColumns({"system": F.lit(system), "max_tokens": F.lit(50)})
    answers = _responses(requests, predict, responses, row_id, **options)
    joined = _attach(df, row_id, answers)
    return joined.withColumn(output_column, canonical_label(F.col("_response"), names)).drop("_response")


def json_number(v: Column, default: float) -> Column:
    """Number of a JSON member; absent gives the default, unreadable gives null."""
    return F.when(v.isNull(), F.lit(float(default))).otherwise(
        v.try_cast("string").try_cast("double")
    )


def gate(
    df: DataFrame,
    json_column: str = "json",
    output_column: str = "ai_answer",
    confidence_column: str = "ai_confidence",
    confidence_threshold: float = 70,
) -> DataFrame:
    """Keep the answer at or above the threshold; a failure is '' with confidence 0."""
    df = df.withColumn("_parsed", F.try_parse_json(json_column))
    df = df.withColumns(
        {
            "_sure": json_number(get(F.col("_parsed"), "confidence"), 0.0),
            "_said": get(F.col("_parsed"), "answer"),
        }
    )
    sure = F.col("_sure")
    usable = F.col("_parsed").isNotNull() & sure.isNotNull()
    answer = clean_cell(variant_text(F.col("_said")))
    return df.withColumns(
        {
            output_column: F.when(usable & (sure >= confidence_threshold), answer).otherwise(F.lit("")),
            confidence_column: F.when(usable, sure).otherwise(F.lit(0.0)),
        }
    ).drop("_parsed", "_sure", "_said")


def retrieve_context(
    df: DataFrame,
    row_id: str,
    query_template: str,
    knowledge: DataFrame | None = None,
    knowledge_id: str | None = None,
    knowledge_columns=None,
    top_k: int = 5,
    external: DataFrame | None = None,
    embedder: vectors.Embedder | None = vectors.hashed_embedder,
    vector_store: str | None = None,
) -> DataFrame:
    """(query_id, query, context): fused keyword, vector and external hits per row.

    With ``vector_store``, a shared folder, texts are embedded once over any number of calls.
    """
    queries = df.select(col(row_id).alias("query_id"), template(df, query_template).alias("query"))
    lists = []
    if knowledge is not None:
        corpus = build_corpus(knowledge, knowledge_id, knowledge_columns)
        lists.append(as_hits(bm25.search(queries, corpus, top_k), corpus, "bm25"))
        if embedder is not None:
            def with_vector(rows: DataFrame, text: str) -> DataFrame:
                if vector_store is not None:
                    return vectors.embedded(rows, text, vector_store, embedder)
                return rows.withColumn("vector", vectors.embed(F.col(text), embedder))

            near = vectors.search(
                with_vector(queries.select("query_id", "query"), "query").select("query_id", "vector"),
                with_vector(corpus.select("doc_id", "text"), "text").select("doc_id", "vector"),
                top_k,
            )
            lists.append(as_hits(near, corpus, "vector"))
    if external is not None:
        lists.append(external)
    if not lists:
        from tabloom.retrieval.fusion import NO_RESULTS

        return queries.withColumn("context", F.lit(NO_RESULTS))
    return context_blocks(queries, fuse(lists, top_k=top_k))


def answer(
    df: DataFrame,
    row_id: str,
    query_template: str,
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    output_column: str = "ai_answer",
    confidence_column: str = "ai_confidence",
    confidence_threshold: float = 70,
    system_prompt: str = "",
    max_tokens: int = 500,
    options: dict | None = None,
    store: str | None = None,
    **retrieval,
) -> DataFrame:
    """Retrieval-augmented answer per row with a confidence gate; ``options`` and ``store`` go to the calls."""
    context = retrieve_context(df, row_id, query_template, **retrieval)
    prompt = F.concat(
        F.lit("Question: "), "query", F.lit("\n\nSearch Results:\n"), "context",
        F.lit("\n\nAnswer in JSON format."),
    )
    requests = context.select(
        F.col("query_id").alias(row_id), prompt.alias("prompt"),
        F.lit(system_prompt).alias("system"), F.lit(int(max_tokens)).alias("max_tokens"),
    )
    answers = _responses(requests, predict, responses, row_id, store=store, **(options or {}))
    parsed = parse_responses(answers, "_response").drop("_response", "status")
    joined = _attach(df, row_id, parsed.withColumnRenamed("json", "_json"))
    return gate(joined, "_json", output_column, confidence_column, confidence_threshold).drop("_json")


def fill_prompts(df: DataFrame, row_id: str, fields, query_template: str,
                 hits: DataFrame | None = None, only_fill_empty: bool = True) -> DataFrame:
    """Requests for the rows that have something to fill: (row id, prompt)."""
    wanted = [f if isinstance(f, dict) else {"column": f} for f in as_list(fields)]
    described = F.create_map(
        *[F.lit(x) for f in wanted for x in (f["column"], f.get("description") or f["column"])]
    )
    marked = df.withColumns(
        {
            "_missing": missing_fields(df, wanted, only_fill_empty),
            "_known": row_context(df),
            "_query": strip(template(df, query_template)),
        }
    ).filter(F.size("_missing") > 0)
    queries = marked.select(col(row_id).alias("query_id"), "_missing", "_known", "_query")
    if hits is None:
        from tabloom.retrieval.fusion import NO_RESULTS

        queries = queries.withColumn("context", F.lit(NO_RESULTS))
    else:
        queries = context_blocks(queries, hits)
    asked = F.array_join(
        F.transform("_missing", lambda f: F.concat(F.lit("- "), f, F.lit(": "), described[f])), "\n"
    )
    prompt = F.concat(
        F.lit("Known data about this item:\n"), "_known",
        F.lit("\n\nFields to extract (only these):\n"), asked,
        F.lit("\n\nSearch Results:\n"), "context",
        F.lit("\n\nExtract the requested fields from the search results. Return JSON only."),
    )
    return queries.select(F.col("query_id").alias(row_id), prompt.alias("prompt"))


def fill_missing(
    df: DataFrame,
    row_id: str,
    fields_to_fill,
    query_template: str = "",
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    hits: DataFrame | None = None,
    only_fill_empty: bool = True,
    confidence_threshold: float = 50,
    system_prompt: str = "",
    **options,
) -> DataFrame:
    """Fill only the missing cells, from answers with enough confidence.

    Rows with nothing missing are never sent; a value is taken when it is not
    blank and its confidence (100 when not given) reaches the threshold.
    """
    wanted = [f["column"] if isinstance(f, dict) else f for f in as_list(fields_to_fill)]
    if not wanted:
        raise ValueError("no fields to fill")
    df = df.withColumns({c: F.lit("") for c in wanted if c not in df.columns})
    requests = fill_prompts(df, row_id, fields_to_fill, query_template, hits, only_fill_empty)
    requests = requests.withColumn("system", F.lit(system_prompt))
    answers = _responses(requests, predict, responses, row_id, **options)
    parsed = parse_responses(answers, "_response").select("_row", F.col("json").alias("_json"))
    joined = _attach(df, row_id, parsed)
    joined = joined.withColumn("_parsed", F.try_parse_json("_json"))
    joined = joined.withColumn("_fields", F.coalesce(get(F.col("_parsed"), "fields"), F.col("_parsed")))
    read, updates = {"_missing": missing_fields(df, wanted, only_fill_empty)}, {}
    for i, name in enumerate(wanted):
        read[f"_v{i}"] = get(F.col("_fields"), name)
        read[f"_c{i}"] = json_number(get(F.col("_parsed"), "confidence", name), 100.0)
    joined = joined.withColumns(read)
    joined = joined.withColumns(
        {f"_t{i}": clean_cell(variant_text(F.col(f"_v{i}"))) for i in range(len(wanted))}
    )
    for i, name in enumerate(wanted):
        take = (
            F.array_contains("_missing", name) & (F.col(f"_t{i}") != "")
            & (F.col(f"_c{i}") >= confidence_threshold)
        )
        updates[name] = F.when(F.coalesce(take, F.lit(False)), F.col(f"_t{i}")).otherwise(
            col(name).cast("string")
        )
    helpers = [f"_{x}{i}" for x in "vct" for i in range(len(wanted))]
    return joined.withColumns(updates).drop("_json", "_parsed", "_fields", "_missing", *helpers)


def _with_file(predict: Callable[[dict], object]) -> Callable[[dict], object]:
    return lambda request: predict({**request, "content": read_bytes(request["_path"])})


def enrich_images(
    df: DataFrame,
    row_id: str,
    image_column: str,
    user_prompt_template: str,
    json_field_mapping: dict[str, str],
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    files: DataFrame | None = None,
    system_prompt: str = "",
    max_tokens: int = 6000,
    read_files: bool = False,
    **options,
) -> DataFrame:
    """Fields read from images: rows with a usable path are sent with the file content.

    With ``read_files`` the file, or the entry of an archive, is read by the task that asks, just before the call, so
    that no image is shuffled; a stored answer then belongs to the path. Else ``files`` is a ``binaryFile`` table
    (path, content). Rows without an image keep their cells.
    """
    require(df, [image_column])
    usable = df.filter(has_path(df, image_column))
    prompts = usable.select(
        col(row_id), template(df, user_prompt_template).alias("prompt"),
        strip(cell_text(df, image_column)).alias("_path"),
        F.lit(system_prompt).alias("system"), F.lit(int(max_tokens)).alias("max_tokens"),
    )
    if responses is None and files is not None:
        plain = F.regexp_replace(F.col("path"), "^file:(//)?", "")
        prompts = prompts.join(
            files.select(plain.alias("_file"), "content"), F.col("_path") == F.col("_file"), "left"
        ).drop("_file")
    elif read_files and predict is not None:
        predict = _with_file(predict)
    answers = _responses(prompts, predict, responses, row_id, **options)
    parsed = parse_responses(answers, "_response")
    filled = map_fields(parsed, {k: f"_new_{i}" for i, k in enumerate(json_field_mapping)})
    filled = filled.select("_row", *[f"_new_{i}" for i in range(len(json_field_mapping))])
    joined = _attach(df, row_id, filled)
    sent = has_path(df, image_column)
    updates = {}
    for i, name in enumerate(json_field_mapping.values()):
        before = col(name).cast("string") if name in df.columns else F.lit("")
        updates[name] = F.when(sent, F.coalesce(F.col(f"_new_{i}"), F.lit(""))).otherwise(before)
    return joined.withColumns(updates).drop(*[f"_new_{i}" for i in range(len(updates))])
