"""Grounded extraction of records from page images: all passes over claims put together.

extract → flatten → review per domain → correct → re-read → presence → demote → rescue → audit → wide record.
Every question is one request row (doc_id, task, round, domain, field, name, payload); answers come from an
injected ``predict`` or from a table of responses. Each pass asks once, and its answers are checkpointed, so that
neither a second use nor a lost task pays for a call again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import cell_text, col, strip
from tabloom.claims.fields import PRESENCE_FIELDS, REREAD_FIELDS
from tabloom.claims.parse import flatten_claims, parse_verdicts, route_claims
from tabloom.claims.record import dublin_core, wide_records
from tabloom.claims.rounds import apply_rereads, audit, correction_rounds, demote, prune_absent_names, rescue
from tabloom.enrich.calls import infer, infer_stored
from tabloom.enrich.responses import FAILED, member, parse_responses, variant_text
from tabloom.session import checkpointed, grown

REQUEST = ["doc_id", "task", "round", "domain", "field", "name", "payload"]
_PLACE = ["doc_id", "task", "round", "domain", "field", "name"]
REVIEW_COLUMNS = [
    f"map_review_fields_{what}" for what in ("uncertain", "demoted", "rescued", "rereaded", "presence_pruned")
]


class _Asker:
    """Sends requests and keeps what every document has cost."""

    def __init__(self, predict, responses: DataFrame | None, store: str | None):
        if (predict is None) == (responses is None):
            raise ValueError("give either predict or responses")
        self.predict, self.responses, self.store = predict, responses, store
        self.costs: list[DataFrame] = []

    def ask(self, task: str, requests: DataFrame, number: int = 0) -> DataFrame:
        """Parsed answers: the columns that place a request, json and status."""
        given = {"task": F.lit(task), "round": F.lit(number), **{c: F.lit("") for c in ("domain", "field", "name") if c not in requests.columns}}
        rows = requests.withColumns(given).select(*REQUEST)
        if self.responses is not None:
            table = self.responses
            missing = {c: F.lit(0 if c == "round" else "") for c in _PLACE[2:] if c not in table.columns}
            answers = rows.join(grown(table.withColumns(missing).select(*_PLACE, "response")), _PLACE, "left")
            answers = answers.withColumns({"input_tokens": F.lit(0), "output_tokens": F.lit(0)})
        elif self.store:
            answers = infer_stored(rows, self.predict, self.store, REQUEST)
        else:
            answers = infer(rows, self.predict)
        answers = checkpointed(answers)
        self.costs.append(answers.select("doc_id", "input_tokens", "output_tokens"))
        return parse_responses(answers).select(*_PLACE[0:1], *_PLACE[3:], "json", "status")

    def tokens(self) -> DataFrame:
        total = self.costs[0]
        for one in self.costs[1:]:
            total = total.unionByName(one)
        return total.groupBy("doc_id").agg(
            F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("map_input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("map_output_tokens"),
        )


def _said(name: str) -> Column:
    return variant_text(member(F.col("json"), name))


def _yes(name: str) -> Column:
    return F.coalesce(F.lower(member(F.col("json"), name).try_cast("string")) == "true", F.lit(False))


def map_analysis(
    df: DataFrame,
    row_id: str,
    image_column: str,
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    max_correction_rounds: int = 2,
    enable_reread: bool = True,
    enable_rescue: bool = True,
    dublin_core_export: bool = False,
    store: str | None = None,
) -> DataFrame:
    """Add the ``map_`` record of every row that has an image, its review columns, tokens and state.

    Rows without an image are not asked about, their cells stay empty (``map_state`` skipped); the same holds for
    rows whose extraction gave no JSON (failed). ``responses`` has doc_id, task and response, and round, domain,
    field and name where a task uses them. Tasks: extract, review (per round and domain), correct (per round),
    reread (per field), presence (per field and name), rescue (per field).
    """
    asker = _Asker(predict, responses, store)
    known = df.withColumn("doc_id", col(row_id))
    pages = known.select("doc_id", cell_text(known, image_column).alias("payload")).filter(strip(F.col("payload")) != "")
    extracted = checkpointed(asker.ask("extract", pages))
    failed = extracted.filter(F.col("status") == FAILED).select("doc_id")
    claims = checkpointed(flatten_claims(extracted.filter(F.col("status") != FAILED).select("doc_id", "json")))

    def review(sent: DataFrame, number: int) -> DataFrame:
        entry = F.struct("field", "value", "evidence_bbox", "evidence_text", "evidence_kind")
        asked = route_claims(sent).groupBy("doc_id", "domain").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))
        answers = asker.ask("review", asked, number)
        return parse_verdicts(checkpointed(answers.filter(F.col("status") != FAILED).select("doc_id", "domain", "json")), sent)

    def correct(feedback: DataFrame, number: int) -> DataFrame:
        answers = asker.ask("correct", feedback.select("doc_id", F.col("feedback").alias("payload")), number)
        return flatten_claims(checkpointed(answers.filter(F.col("status") != FAILED).select("doc_id", "json")))

    seen = correction_rounds(claims, review, correct, max_correction_rounds)
    key = ["doc_id", "field"]
    now, verdicts, checked = checkpointed(seen.claims), checkpointed(seen.verdicts), checkpointed(seen.checked)
    none = now.select(*key).limit(0)
    reread = pruned = rescued = none
    if enable_reread:
        doubted = verdicts.filter(~F.col("ok") & F.col("field").isin(*REREAD_FIELDS)).select(*key)
        asked = now.join(grown(doubted), key, "left_semi").select(*key, F.to_json("evidence_bbox").alias("payload"))
        answers = asker.ask("reread", asked).select(
            *key, _said("value").alias("value"), _yes("confident").alias("confident"), _said("verbatim_text").alias("verbatim_text")
        )
        now, verdicts, reread = map(checkpointed, apply_rereads(now, verdicts, answers))
        names = now.filter(F.col("field").isin(*PRESENCE_FIELDS)).select(
            *key, F.explode(F.array_distinct(F.transform(F.split("value", ","), strip))).alias("name"), F.to_json("evidence_bbox").alias("payload")
        )
        answers = asker.ask("presence", names.filter("name <> ''")).select(*key, "name", _yes("visible").alias("visible"))
        now, verdicts, pruned = map(checkpointed, prune_absent_names(now, verdicts, answers))
    now, demoted = map(checkpointed, demote(now, verdicts, checked))
    if enable_rescue:
        notes = verdicts.filter(~F.col("ok") & (strip(F.col("what_you_see")) != ""))
        asked = notes.join(grown(demoted), key, "left_semi").select(*key, F.col("what_you_see").alias("payload"))
        answers = asker.ask("rescue", asked).select(
            *key, _said("value").alias("value"), _yes("confident").alias("confident"), _said("reasoning").alias("reasoning")
        )
        now, rescued = map(checkpointed, rescue(now, demoted, verdicts, checked, answers))
    result = wide_records(now, known, failed=failed)
    marks = audit(now, seen.flagged, demoted, rescued, reread, pruned)
    state = pages.select("doc_id").join(grown(failed.withColumn("_failed", F.lit(True))), "doc_id", "left").select(
        "doc_id", F.when(F.col("_failed"), "failed").otherwise("done").alias("map_state")
    )
    result = result.join(grown(marks), "doc_id", "left").join(grown(asker.tokens()), "doc_id", "left").join(grown(state), "doc_id", "left")
    result = result.withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in REVIEW_COLUMNS},
            **{c: F.coalesce(c, F.lit(0)) for c in ("map_input_tokens", "map_output_tokens")},
            "map_state": F.coalesce("map_state", F.lit("skipped")),
        }
    )
    if dublin_core_export:
        result = dublin_core(result)
    return result if "doc_id" in df.columns else result.drop("doc_id")
