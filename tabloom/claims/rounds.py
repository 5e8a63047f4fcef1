"""Merging corrections and the later passes over flagged claims."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom._columns import strip
from tabloom.claims.fields import PRESENCE_FIELDS, REREAD_FIELDS, TYPE_SPECIFIC
from tabloom.claims.parse import CLAIM_ROWS, checkable, correction_feedback
from tabloom.session import checkpointed, dealt, grown, row_tasks

KEY = ["doc_id", "field"]
CLAIM = ["value", "evidence_bbox", "evidence_text", "evidence_kind"]


def _spread(claims: DataFrame) -> DataFrame:
    """Claims over as many tasks as their number asks for; what they are joined with follows them."""
    return dealt(claims, *KEY, rows=CLAIM_ROWS)


def _alike(*tables: DataFrame) -> list[DataFrame]:
    """Tables over the same tasks by claim, as many as the longest asks for: what is joined or grouped by claim stays there, and
    no task first collects the rows of a whole file."""
    tasks = max(row_tasks(one.select(*KEY), CLAIM_ROWS) for one in tables)
    return [one.repartition(tasks, *KEY) for one in tables]


def merge_corrections(previous: DataFrame, new: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims after a correction round.

    Flagged: the new claim, or nothing when it was not sent again. Accepted: the
    new claim when sent again, else the old one. New field names are ignored.
    """
    old = _spread(previous).select(*KEY, F.struct(*CLAIM).alias("_old"))
    fresh = new.select(*KEY, F.struct(*CLAIM).alias("_new"))
    flags = verdicts.select(*KEY, (~F.col("ok")).alias("_flagged"))
    joined = old.join(grown(fresh), KEY, "left").join(grown(flags), KEY, "left")
    flagged = F.coalesce("_flagged", F.lit(False))
    merged = F.when(flagged, F.col("_new")).otherwise(F.coalesce("_new", "_old"))
    return joined.select(*KEY, merged.alias("_claim")).filter("_claim is not null").select(*KEY, "_claim.*")


@dataclass
class Reviewed:
    claims: DataFrame
    verdicts: DataFrame  # last verdict per field
    checked: DataFrame  # claims as they were last checked
    flagged: DataFrame  # (doc_id, field) flagged in any round


def correction_rounds(
    claims: DataFrame,
    review: Callable[[DataFrame, int], DataFrame],
    correct: Callable[[DataFrame, int], DataFrame],
    max_correction_rounds: int = 2,
) -> Reviewed:
    """Check, correct and check again, at most ``max_correction_rounds`` corrections.

    ``review(claims, round)`` gives verdicts, ``correct(feedback, round)`` gives
    new claims. Only documents with flags stay in the loop; the state is
    checkpointed between rounds so no review is asked twice.
    """
    done: list[DataFrame] = []
    last: list[tuple[DataFrame, DataFrame]] = []
    flagged: list[DataFrame] = []
    active = claims
    for number in range(max_correction_rounds + 1):
        sent = checkable(active)
        verdicts = checkpointed(review(sent, number))
        bad = verdicts.filter(~F.col("ok")).select(*KEY)
        flagged.append(bad)
        docs = bad.select("doc_id").distinct()
        finished = number == max_correction_rounds or bad.isEmpty()
        if finished:
            done.append(active)
            last.append((verdicts, sent))
            break
        done.append(active.join(grown(docs), "doc_id", "left_anti"))
        last.append((verdicts.join(grown(docs), "doc_id", "left_anti"), sent.join(grown(docs), "doc_id", "left_anti")))
        again = active.join(grown(docs), "doc_id", "left_semi")
        fresh = correct(correction_feedback(sent, verdicts), number)
        active = checkpointed(merge_corrections(again, fresh, verdicts))

    def all_of(tables: list[DataFrame]) -> DataFrame:
        result = tables[0]
        for table in tables[1:]:
            result = result.unionByName(table)
        return result

    return Reviewed(
        all_of(done), all_of([v for v, _ in last]), all_of([c for _, c in last]),
        all_of(flagged).distinct(),
    )


def _usable(value: Column) -> Column:
    return F.coalesce((value != "") & (value != "null"), F.lit(False))


def _accept(verdicts: DataFrame, keys: DataFrame) -> DataFrame:
    """Verdicts with the given keys set to ok."""
    settled = keys.select(*KEY).distinct()
    accepted = settled.select(
        *KEY, F.lit(True).alias("ok"), F.lit("").alias("issue"), F.lit("").alias("what_you_see")
    )
    return verdicts.join(grown(settled), KEY, "left_anti").unionByName(accepted)


def apply_rereads(
    claims: DataFrame, verdicts: DataFrame, rereads: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take confident second readings of flagged text fields.

    Returns the claims, the verdicts and the keys that were re-read.
    """
    flagged = verdicts.filter(~F.col("ok") & F.col("field").isin(*REREAD_FIELDS)).select(*KEY)
    good = (
        rereads.filter(F.col("confident") & _usable(F.col("value")))
        .join(grown(flagged), KEY, "left_semi")
        .join(grown(claims.select(*KEY)), KEY, "left_semi")
        .select(*KEY, F.col("value").alias("_value"), F.coalesce("verbatim_text", F.lit("")).alias("_seen"))
    )
    text = F.substring(F.concat(F.lit("reread crop: "), F.substring("_seen", 1, 300)), 1, 400)
    taken = F.col("_value").isNotNull()
    updated = _spread(claims).join(grown(good), KEY, "left").select(
        *KEY, F.coalesce("_value", "value").alias("value"), "evidence_bbox",
        F.when(taken, text).otherwise(F.col("evidence_text")).alias("evidence_text"), "evidence_kind",
    )
    return updated, _accept(verdicts, good), good.select(*KEY)


def prune_absent_names(
    claims: DataFrame, verdicts: DataFrame, presence: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep only the place names that were seen on the page; drop a field without any.

    ``presence`` is (doc_id, field, name, visible). Returns the claims, the
    verdicts and the keys that lost names.
    """
    target = F.col("field").isin(*PRESENCE_FIELDS) & (strip(F.coalesce("value", F.lit(""))) != "")
    claims, presence = _alike(claims, presence.filter(F.col("visible")))
    seen = presence.groupBy(*KEY).agg(F.collect_set("name").alias("_seen"))
    names = F.transform(F.split("value", ","), strip)
    found = F.array_join(F.filter(names, lambda n: (n != "") & F.array_contains("_seen", n)), ", ")
    joined = claims.join(grown(seen), KEY, "left").withColumns({"_target": target, "_kept": F.when(target, found)})
    kept = F.coalesce("_kept", F.lit(""))
    text = F.substring(F.concat(F.lit("presence-verified: "), kept), 1, 400)
    on = F.col("_target")
    updated = joined.filter(~on | (kept != "")).select(
        *KEY, F.when(on, kept).otherwise(F.col("value")).alias("value"), "evidence_bbox",
        F.when(on, text).otherwise(F.col("evidence_text")).alias("evidence_text"), "evidence_kind",
    )
    checked = joined.filter(on)
    pruned = checked.filter(strip(F.col("value")) != strip(kept)).select(*KEY)
    return updated, _accept(verdicts, checked), pruned


def demote(claims: DataFrame, verdicts: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove claims that are still flagged and unchanged since they were checked."""
    flagged = verdicts.filter(~F.col("ok")).select(*KEY)
    claims = _spread(claims)
    before = checked.select(*KEY, F.col("value").alias("_checked"))
    demoted = (
        claims.join(grown(flagged), KEY, "left_semi").join(grown(before), KEY, "left")
        .filter(F.col("value").eqNullSafe(F.col("_checked"))).select(*KEY)
    )
    return claims.join(grown(demoted), KEY, "left_anti"), demoted


def rescue(
    claims: DataFrame, demoted: DataFrame, verdicts: DataFrame, checked: DataFrame, rescues: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Bring a demoted field back with a value read from the reviewer's notes."""
    noted = verdicts.filter(~F.col("ok") & (strip(F.col("what_you_see")) != "")).select(*KEY)
    good = (
        rescues.filter(F.col("confident") & _usable(F.col("value")))
        .join(grown(demoted), KEY, "left_semi").join(grown(noted), KEY, "left_semi")
        .join(grown(checked.select(*KEY, F.col("evidence_bbox").alias("_box"))), KEY, "left")
    )
    page = F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 100.0)])
    reason = F.substring(F.coalesce("reasoning", F.lit("")), 1, 300)
    made = good.select(
        *KEY, "value", F.coalesce("_box", page).alias("evidence_bbox"),
        F.substring(F.concat(F.lit("rescued from critic observation: "), reason), 1, 400)
        .alias("evidence_text"),
        F.lit("computed").alias("evidence_kind"),
    )
    return claims.unionByName(made), good.select(*KEY)


def audit(
    claims: DataFrame,
    ever_flagged: DataFrame,
    demoted: DataFrame,
    rescued: DataFrame,
    reread: DataFrame,
    pruned: DataFrame,
) -> DataFrame:
    """Per document the sorted field lists a human reviewer needs."""
    marks = None
    sources = {
        "flagged": ever_flagged, "demoted": demoted, "rescued": rescued,
        "reread": reread, "pruned": pruned, "present": claims,
    }
    for name, table in sources.items():
        one = table.select(*KEY, F.lit(name).alias("mark"))
        marks = one if marks is None else marks.unionByName(one)
    has = {n: F.max(F.col("mark") == n) for n in sources}
    # one document's marks in one task, and as many tasks as there are marks for
    state = dealt(marks, "doc_id", rows=CLAIM_ROWS).groupBy(*KEY).agg(*[flag.alias(n) for n, flag in has.items()])
    fixed = F.col("rescued") | F.col("reread") | F.col("pruned")
    lost = F.col("demoted") & ~F.col("rescued")
    columns = {
        "map_review_fields_uncertain": F.col("flagged") & F.col("present") & ~lost & ~fixed,
        "map_review_fields_demoted": lost,
        "map_review_fields_rescued": F.col("rescued"),
        "map_review_fields_rereaded": F.col("reread"),
        "map_review_fields_presence_pruned": F.col("pruned"),
    }
    return state.groupBy("doc_id").agg(
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("field")))), ", ").alias(name)
            for name, test in columns.items()
        ]
    )


def output_name(field: Column) -> Column:
    """``ts_`` column name of a type-specific field."""
    return F.concat(F.lit("ts_"), F.substr(field, F.lit(len(TYPE_SPECIFIC) + 1)))
