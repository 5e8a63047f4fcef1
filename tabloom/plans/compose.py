"""Turn a spec of nodes and edges into lazy DataFrames.

A node is ``{"id", "type", "data": {"config": {...}}}``; an edge names source,
target and optionally ``sourceHandle`` (default ``output``) and ``targetHandle``
(default ``input``). Nothing runs until a result is used; Spark plans and
schedules the whole.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from tabloom.claims.analysis import map_analysis
from tabloom.enrich import operators as enrichment
from tabloom.functions.registry import register_function
from tabloom.linkage.ports import cross_match
from tabloom.lookup.dictionary import lookup
from tabloom.lookup.headings import subject_headings
from tabloom.lookup.places import match_area
from tabloom.lookup.tables import register_dictionary
from tabloom.operators import columns, grouping, joins, routing, rows
from tabloom.sources import files, images, sinks

Ports = dict[str, DataFrame]
Operator = Callable[[Ports, dict], Ports]


WHOLE = {"count", "seed", "min_match_length", "batch_size", "max_tokens", "top_k", "max_rows", "max_images", "max_correction_rounds", "salt"}
REAL = {"percent", "per_minute", "confidence_threshold", "ambiguity_gap"}
TRUTH = {"batch_mode", "only_fill_empty", "case_sensitive", "include_index", "scan_subfolders", "multi_line", "enable_reread", "enable_rescue",
         "dublin_core_export"}
# Settings whose empty text says something; elsewhere it means that nothing was chosen.
EMPTY_SPEAKS = {"fill_value", "no_match_value", "value", "system_prompt", "formula"}


def typed(config: dict) -> dict:
    """The settings of a node with numbers and truth values in their types, however they were written."""
    out = {}
    for name, value in config.items():
        if value is None or (isinstance(value, str) and not value.strip() and name not in EMPTY_SPEAKS):
            continue
        if name in WHOLE:
            value = int(float(value))
        elif name in REAL:
            value = float(value)
        elif name in TRUTH and isinstance(value, str):
            value = value.strip().lower() not in ("false", "0", "no", "off", "none")
        elif name in TRUTH:
            value = bool(value)
        out[name] = value
    return out


def _one(fn: Callable[..., DataFrame], *names: str) -> Operator:
    """An operator with one input and one output that takes the named settings."""

    def run(inputs: Ports, config: dict) -> Ports:
        return {"output": fn(inputs["input"], **{k: v for k, v in config.items() if k in names})}

    return run


def _merge(inputs: Ports, config: dict) -> Ports:
    return {
        "output": joins.merge(
            inputs["left"], inputs["right"], config.get("left_key", ""), config.get("right_key", ""),
            config.get("how") or "left", salt=config.get("salt") or 1,
        )
    }


def _lookup(inputs: Ports, config: dict) -> Ports:
    return {
        "output": lookup(
            inputs["input"], config.get("dictionary") or config.get("builtin_name"),
            config["source_column"], config["output_column"], config.get("match_mode") or "exact",
            config.get("case_sensitive", False), config.get("no_match_value") or "",
        )
    }


def _cross(inputs: Ports, config: dict) -> Ports:
    return cross_match(
        inputs["left"], inputs["right"], config["left_id"], config["right_id"],
        config["left_match_columns"], config["right_match_columns"],
        config.get("match_mode") or "hybrid", config.get("confidence_threshold", 0.7),
        config.get("ambiguity_gap", 0.15), config.get("top_k", 5),
        predict=config.get("predict"), responses=config.get("responses"),
        **{k: config[k] for k in ("embedder", "store") if config.get(k) is not None},
    )


def _search(inputs: Ports, config: dict) -> Ports:
    names = (
        "row_id", "query_template", "predict", "responses", "output_column", "confidence_column",
        "confidence_threshold", "system_prompt", "knowledge_id", "knowledge_columns", "top_k",
        "external", "embedder", "store", "vector_store",
    )
    known = {k: v for k, v in config.items() if k in names}
    return {"output": enrichment.answer(inputs["input"], knowledge=inputs.get("knowledge"), **known)}


OPERATORS: dict[str, Operator] = {
    "transform_normalize": _one(columns.normalize, "operations"),
    "transform_formula": _one(columns.formula, "output_column", "formula", "formula_type"),
    "transform_filter": lambda i, c: routing.filter_rows(
        i["input"], c.get("column", ""), c.get("operator") or "equals", c.get("value", "")
    ),
    "transform_split": lambda i, c: routing.route(i["input"], c.get("rules", [])),
    "transform_merge": _merge,
    "transform_group": _one(grouping.group_by, "group_by", "aggregations", "order_by"),
    "transform_pivot": _one(
        grouping.pivot, "index", "pivot_column", "value_column", "agg_func", "fill_value", "values", "order_by"
    ),
    "transform_deduplicate": lambda i, c: rows.deduplicate(
        i["input"], c.get("columns"), c.get("keep") or "first", c.get("order_by")
    ),
    "transform_sample": _one(rows.sample, "mode", "count", "percent", "seed", "key"),
    "lookup_dictionary": _lookup,
    "lookup_bl_area": _one(match_area, "geo_columns", "output_column", "min_match_length", "places"),
    "lookup_lcsh": _one(
        subject_headings, "country_col", "state_col", "city_col", "theme_col", "output_column"
    ),
    "ai_enrich": _one(
        enrichment.enrich, "row_id", "user_prompt_template", "json_field_mapping", "predict",
        "responses", "batch_mode", "batch_size", "max_tokens", "system_prompt", "store", "per_minute",
    ),
    "ai_classify": _one(
        enrichment.classify, "row_id", "prompt_template", "labels", "output_column", "predict", "responses", "store", "per_minute"
    ),
    "ai_search": _search,
    "ai_autofill": _one(
        enrichment.fill_missing, "row_id", "fields_to_fill", "query_template", "predict", "responses",
        "hits", "only_fill_empty", "confidence_threshold", "system_prompt", "store", "per_minute",
    ),
    "ai_vision": _one(
        enrichment.enrich_images, "row_id", "image_column", "user_prompt_template",
        "json_field_mapping", "predict", "responses", "files", "read_files", "system_prompt", "max_tokens", "store", "per_minute",
    ),
    "ai_cross_match": _cross,
    "ai_map_analysis": _one(
        map_analysis, "row_id", "image_column", "predict", "responses", "max_correction_rounds", "enable_reread",
        "enable_rescue", "dublin_core_export", "store",
    ),
}
SINKS = ("output_csv", "output_json", "output_xlsx")
SOURCES = ("input_csv", "input_json", "input_images", "input_api", "input_xlsx")


def register_operator(name: str, operator: Operator) -> None:
    OPERATORS[name] = operator


def register_plugin(register: Callable) -> None:
    """Let a plugin add operators, scalar functions and dictionaries."""
    register(register_operator, register_function, register_dictionary)


def _read(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    if kind == "input_csv":
        return files.read_csv(
            spark, config["path"], config.get("encoding") or "utf-8-sig", config.get("delimiter") or ",",
            config.get("max_rows", 0), multi_line=config.get("multi_line", True),
        )
    if kind == "input_json":
        return files.read_json(
            spark, config["path"], config.get("json_path") or "", config.get("orient") or "records"
        )
    if kind == "input_images":
        if config.get("folder_path"):
            return images.read_folder(
                spark, config["folder_path"], config.get("scan_subfolders", False), config.get("max_images", 0),
            )
        return images.read_archives(spark, config["path"], config.get("max_images", 0))
    raise ValueError(f"{kind} needs a table in 'sources'")


def _given(table: DataFrame, kind: str, config: dict) -> DataFrame:
    """A table handed in for a source. For ``input_api`` one text column is the payloads that the service
    answered with; they are opened along ``json_path``."""
    if kind == "input_api" and len(table.columns) == 1 and table.dtypes[0][1] == "string":
        return files.flatten_payloads(table, table.columns[0], config.get("json_path", ""), config.get("orient", "auto"))
    return table


def run_pipeline(
    spark: SparkSession, spec: dict, sources: dict[str, DataFrame] | None = None
) -> dict[tuple[str, str], DataFrame]:
    """The DataFrame of every (node, port). ``sources`` overrides source nodes by id.

    A sink node appears with the table it would write at port ``input``;
    :func:`write_sinks` writes them.
    """
    sources = sources or {}
    nodes = {n["id"]: n for n in spec["nodes"]}
    edges = spec.get("edges", [])
    upstream: dict[str, set[str]] = {n: set() for n in nodes}
    for edge in edges:
        upstream[edge["target"]].add(edge["source"])
    try:
        order = list(TopologicalSorter(upstream).static_order())
    except CycleError as error:
        raise ValueError("the pipeline has a cycle") from error
    results: dict[tuple[str, str], DataFrame] = {}
    for node_id in order:
        node = nodes[node_id]
        kind, config = node["type"], typed(node.get("data", {}).get("config", {}))
        fed: dict[str, list[DataFrame]] = {}
        for edge in edges:
            if edge["target"] == node_id:
                port = (edge["source"], edge.get("sourceHandle") or "output")
                if port not in results:
                    raise ValueError(f"unknown port {port[1]} of node {port[0]}")
                fed.setdefault(edge.get("targetHandle") or "input", []).append(results[port])
        inputs = {p: t[0] if len(t) == 1 else rows.union_inputs(t) for p, t in fed.items()}
        if node_id in sources:
            outputs = {"output": _given(sources[node_id], kind, config)}
        elif kind in SOURCES:
            outputs = {"output": _read(spark, kind, config)}
        elif kind in SINKS:
            outputs = {"input": sinks.export_columns(inputs["input"], config.get("columns"))}
        elif kind in OPERATORS:
            outputs = OPERATORS[kind](inputs, config)
        else:
            raise ValueError(f"unknown operator: {kind}")
        results.update({(node_id, port): table for port, table in outputs.items()})
    return results


def write_sinks(spec: dict, results: dict[tuple[str, str], DataFrame], folder: str) -> list[str]:
    """Write every sink node below a folder; returns the paths."""
    written = []
    for node in spec["nodes"]:
        if node["type"] not in SINKS:
            continue
        config = typed(node.get("data", {}).get("config", {}))
        path = f"{folder}/{config.get('filename') or node['id']}"
        table = results[(node["id"], "input")]
        if node["type"] == "output_csv":
            sinks.write_csv(
                table, path, config.get("encoding") or "utf-8", config.get("delimiter") or ",",
                config.get("include_index", False), config.get("order_by"),
            )
        elif node["type"] == "output_json":
            sinks.write_json(table, path, config.get("orient") or "records")
        else:
            sinks.write_table(table, path)
        written.append(path)
    return written
