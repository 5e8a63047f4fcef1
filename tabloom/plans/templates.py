"""Ready-made pipelines, built from the settings that differ between uses."""

from __future__ import annotations

from itertools import pairwise


def node(node_id: str, kind: str, **config) -> dict:
    return {"id": node_id, "type": kind, "data": {"config": config}}


def edge(source: str, target: str, source_port: str = "output", target_port: str = "input") -> dict:
    return {"source": source, "sourceHandle": source_port, "target": target, "targetHandle": target_port}


def chain(*ids: str) -> list[dict]:
    return [edge(a, b) for a, b in pairwise(ids)]


def csv_cleanup(operations: list, key_columns: str = "", order_by=None, path: str = "") -> dict:
    """Read, normalise, deduplicate, write the unique rows."""
    nodes = [
        node("read", "input_csv", path=path),
        node("clean", "transform_normalize", operations=operations),
        node("unique", "transform_deduplicate", columns=key_columns, keep="first", order_by=order_by),
        node("write", "output_xlsx", filename="cleaned"),
    ]
    return {"nodes": nodes, "edges": [*chain("read", "clean", "unique"), edge("unique", "write", "unique")]}


def data_merge(left_key: str, right_key: str, how: str = "left", paths: tuple[str, str] = ("", "")) -> dict:
    """Read two tables, join them on a key, write the result."""
    nodes = [
        node("left", "input_csv", path=paths[0]),
        node("right", "input_csv", path=paths[1]),
        node("merge", "transform_merge", left_key=left_key, right_key=right_key, how=how),
        node("write", "output_xlsx", filename="merged"),
    ]
    edges = [edge("left", "merge", target_port="left"), edge("right", "merge", target_port="right")]
    return {"nodes": nodes, "edges": [*edges, edge("merge", "write")]}


def classification(row_id: str, prompt: str, labels: str, path: str = "", **model) -> dict:
    """Read, classify every row, write."""
    nodes = [
        node("read", "input_csv", path=path),
        node("classify", "ai_classify", row_id=row_id, prompt_template=prompt, labels=labels, **model),
        node("write", "output_xlsx", filename="classified"),
    ]
    return {"nodes": nodes, "edges": chain("read", "classify", "write")}


# Columns of a map catalogue that count for completeness.
CATALOGUE_COLUMNS = (
    "TITLE", "Author", "Date Published ", "Publisher", "Scale", "Subject", "Description ",
    "Call Number", "Format", "Place of Publication",
)
# JSON fields asked from the model and the columns they fill.
GEO_FIELDS = {
    "continent": "geo_continent", "country": "geo_country", "state": "geo_state",
    "city": "geo_city", "theme": "primary_theme",
}
FULL_GEO_FIELDS = GEO_FIELDS | {
    "county": "geo_county", "feature": "geo_feature", "series": "map_series",
    "sheet_no": "sheet_number", "sheet_name": "sheet_name", "lat": "approx_lat", "lon": "approx_lon",
}


def completeness(columns=CATALOGUE_COLUMNS) -> str:
    """Expression for the share of filled columns in percent."""
    listed = ",".join(f"[{c}]" for c in columns)
    return f"count_filled({listed}) / {len(columns)} * 100"


def _routes() -> list[dict]:
    def rule(route: str, *conditions: tuple[str, str, str]) -> dict:
        return {
            "output": route,
            "conditions": [{"column": c, "op": o, "value": v} for c, o, v in conditions],
        }

    return [
        rule("route_1", ("Listed on current Catalogue", "equals", "LISTED on Catalogue"),
             ("completeness", ">=", "70")),
        rule("route_2", ("Series (if known)", "is_not_empty", "")),
        rule("route_3", ("completeness", ">=", "40")),
        rule("route_4"),
    ]


def _subject_chain(source_edges: list[dict], filename: str, first: str) -> tuple[list[dict], list[dict]]:
    """Area code, subject headings and output, fed by the given edges."""
    nodes = [
        node("area", "lookup_bl_area", geo_columns="geo_city,geo_feature,geo_state,geo_country,geo_continent",
             output_column="bl_area_matched", min_match_length=5),
        node("headings", "lookup_lcsh", country_col="geo_country", state_col="geo_state",
             city_col="geo_city", theme_col="primary_theme", output_column="subject_lcsh"),
        node("write", "output_xlsx", filename=filename),
    ]
    return nodes, [*source_edges, *chain(first, "headings", "write")]


def catalogue_enrichment(row_id: str, path: str = "", **model) -> dict:
    """Clean a map catalogue, route by completeness, enrich two tiers, add codes and headings.

    The two enriched tiers are combined row by row at one input port.
    """
    operations = [
        {"column": "Date Published ", "output_column": "date_year", "function": "date"},
        {"column": "Scale", "output_column": "scale_clean", "function": "scale"},
        {"column": "TITLE", "output_column": "title_clean", "function": "trim"},
        {"column": "Call Number", "output_column": "bl_parsed", "function": "call_number"},
    ]
    keys = ", ".join(f'"{k}":""' for k in GEO_FIELDS)
    nodes = [
        node("read", "input_csv", path=path),
        node("clean", "transform_normalize", operations=operations),
        node("score", "transform_formula", output_column="completeness", formula_type="expression",
             formula=completeness()),
        node("tiers", "transform_split", rules=_routes()),
        node("enrich_c", "ai_enrich", row_id=row_id, json_field_mapping=GEO_FIELDS, max_tokens=150,
             user_prompt_template="Title: {TITLE}\nJSON: {" + keys + "}", **model),
        node("enrich_d", "ai_enrich", row_id=row_id, json_field_mapping=FULL_GEO_FIELDS, max_tokens=300,
             user_prompt_template="Title: {TITLE}\nPublisher: {Publisher} | Date: {Date Published }", **model),
    ]
    tail, edges = _subject_chain([edge("enrich_c", "area"), edge("enrich_d", "area")], "enriched", "area")
    edges = [
        *chain("read", "clean", "score", "tiers"),
        edge("tiers", "enrich_c", "route_3"), edge("tiers", "enrich_d", "route_4"), *edges,
    ]
    return {"nodes": [*nodes, *tail], "edges": edges}


def catalogue_linkage(left_id: str, right_id: str, left_columns: str, right_columns: str, **settings) -> dict:
    """Match a catalogue to its scans and write the four results."""
    outputs = ("matched", "ambiguous", "unmatched_left", "unmatched_right")
    nodes = [
        node("catalogue", "input_csv"),
        node("images", "input_images"),
        node("repair", "transform_normalize", operations=[{"column": "*", "function": "fix_encoding"}]),
        node("match", "ai_cross_match", left_id=left_id, right_id=right_id,
             left_match_columns=left_columns, right_match_columns=right_columns, **settings),
        *[node(f"write_{name}", "output_xlsx", filename=name) for name in outputs],
    ]
    edges = [
        edge("catalogue", "repair"), edge("repair", "match", target_port="left"),
        edge("images", "match", target_port="right"),
        *[edge("match", f"write_{name}", name) for name in outputs],
    ]
    return {"nodes": nodes, "edges": edges}
