import random

from pyspark.sql import functions as F

from tabloom import session
from tabloom.claims import parse, record, rounds

BOX = [1.0, 2.0, 3.0, 4.0]
CLAIM = "doc_id int, field string, value string, evidence_bbox array<double>, evidence_text string, evidence_kind string"
VERDICT = "doc_id int, field string, ok boolean, issue string, what_you_see string"


def claims(table, rows):
    return table(CLAIM, [(d, f, v, BOX, "t", "direct_quote") for d, f, v in rows])


def pairs(df):
    return sorted((r.doc_id, r.field, r.value) for r in df.collect())


def test_layouts_and_broken_entries(table):
    parsed = table("doc_id int, json string", [
        (1, '{"fields": {"title": {"value": "A", "evidence_bbox": [1,2,3]}, "zzz": {"value": 1, "evidence_bbox": [1,2,3,4]}},'
            '"type_specific": {"ts_datum": {"value": "two", "evidence_bbox": [1]}, "datum": {"value": "one", "evidence_bbox": [1]}, "": {"value": 1, "evidence_bbox": [1]}}}'),
        (2, '{"title": {"value": false, "evidence_bbox": [0,0,200,50]}, "city": {"evidence_bbox": [1]}, "notes": {"value": "x", "evidence_bbox": []}, "edition": "x"}'),
        (3, None), (4, "[1]"), (5, '{"fields": [], "title": {"value": {"k": 1}, "evidence_bbox": "abc"}}')])
    got = parse.flatten_claims(parsed)
    assert pairs(got) == [(1, "title", "A"), (1, "type_specific.datum", "two"), (2, "title", "no"), (5, "title", '{"k":1}')]
    boxes = {r.doc_id: r.evidence_bbox for r in got.filter("field = 'title'").collect()}
    assert boxes == {1: [0, 0, 100, 100], 2: [0, 0, 100, 50], 5: [0, 0, 100, 100]}


def test_domains(table):
    df = parse.route_claims(claims(table, [(1, f, "x") for f in ("city", "title", "medium", "type_specific.city", "zzz")]))
    assert [r.domain for r in df.orderBy("field").collect()] == ["geo", "visual", "ocr", "visual", "visual"]


def run_by_hand(start, reviews, fixes, limit):
    """Document by document, as a program without tables would do it."""
    final, last, flagged = {}, {}, set()
    for doc, fields in start.items():
        fields = dict(fields)
        for number in range(limit + 1):
            verdicts = {f: ok for f, ok in reviews[doc][number].items() if f in fields}
            last[doc] = verdicts
            bad = {f for f, ok in verdicts.items() if not ok}
            flagged |= {(doc, f) for f in bad}
            if not bad or number == limit:
                break
            new = fixes[doc][number]
            fields = {
                f: new.get(f) if f in bad else new.get(f, v)
                for f, v in fields.items() if f not in bad or f in new}
        final[doc] = fields
    return final, last, flagged


def test_correction_rounds_match_one_by_one(spark, table):
    random.seed(11)
    names, limit = ["title", "notes", "city", "type_specific.x"], 2
    start = {d: {f: f"{f}{d}" for f in names if random.random() < .8} for d in range(25)}
    reviews = {d: [{f: random.random() < .7 for f in names if random.random() < .9} for _ in range(3)] for d in start}
    fixes = {d: [{f: f"fix{n}" for f in names + ["medium"] if random.random() < .6} for n in range(2)] for d in start}
    base = claims(table, [(d, f, v) for d, fs in start.items() for f, v in fs.items()])

    def review(sent, number):
        rows = [(d, f, ok, "i", "w") for d in reviews for f, ok in reviews[d][number].items()]
        return table(VERDICT, rows).join(sent.select("doc_id", "field"), ["doc_id", "field"], "left_semi")

    def correct(feedback, number):
        rows = [(d, f, v) for d in fixes for f, v in fixes[d][number].items()]
        return claims(table, rows).join(feedback.select("doc_id"), "doc_id", "left_semi")

    got = rounds.correction_rounds(base, review, correct, limit)
    final, last, flagged = run_by_hand(start, reviews, fixes, limit)
    assert pairs(got.claims) == sorted((d, f, v) for d, fs in final.items() for f, v in fs.items())
    assert {(r.doc_id, r.field): r.ok for r in got.verdicts.collect()} == {
        (d, f): ok for d, fs in last.items() for f, ok in fs.items()}
    assert {(r.doc_id, r.field) for r in got.flagged.collect()} == flagged


def test_passes_and_audit(table):
    start = claims(table, [
        (1, "title", "a"), (1, "notes", "b"), (1, "country", "X, Y ,Z"), (1, "city", "Q"), (1, "medium", "c"),
        (1, "edition", "d"), (1, "subject", "e"), (2, "title", "ok")])
    verdicts = table(VERDICT, [
        (1, "title", False, "", "sees T"), (1, "notes", False, "", "sees N"), (1, "medium", False, "", "sees M"),
        (1, "edition", False, "", " "), (1, "city", False, "", "x"), (1, "subject", False, "", "y"), (2, "title", True, "", "")])
    rereads = table("doc_id int, field string, value string, confident boolean, verbatim_text string", [
        (1, "title", "T", True, "v"), (1, "notes", "N", False, ""), (1, "medium", "M", True, ""), (2, "title", "no", True, "")])
    c, v, reread = rounds.apply_rereads(start, verdicts, rereads)
    assert [(r.doc_id, r.field) for r in reread.collect()] == [(1, "title")]
    presence = table("doc_id int, field string, name string, visible boolean", [
        (1, "country", "Z", True), (1, "country", "X", True), (1, "country", "Y", None), (1, "city", "Q", False)])
    c, v, pruned = rounds.prune_absent_names(c, v, presence)
    assert {(r.doc_id, r.field) for r in pruned.collect()} == {(1, "country"), (1, "city")}
    checked = start.withColumn("value", F.when(F.col("field") == "subject", "before").otherwise(F.col("value")))
    c, demoted = rounds.demote(c, v, checked)
    assert {r.field for r in demoted.collect()} == {"notes", "medium", "edition"}
    rescues = table("doc_id int, field string, value string, confident boolean, reasoning string", [
        (1, "medium", "ink", True, "said so"), (1, "notes", "null", True, ""), (1, "edition", "2nd", True, "no note")])
    c, saved = rounds.rescue(c, demoted, v, checked, rescues)
    assert pairs(c) == [(1, "country", "X, Z"), (1, "medium", "ink"), (1, "subject", "e"), (1, "title", "T"), (2, "title", "ok")]
    kinds = {r.field: r.evidence_kind for r in c.filter("doc_id = 1").collect()}
    assert kinds["medium"] == "computed" and kinds["title"] == "direct_quote"
    flagged = verdicts.filter("not ok").select("doc_id", "field")
    audit = rounds.audit(c, flagged, demoted, saved, reread, pruned).orderBy("doc_id").collect()
    assert tuple(audit[0])[1:] == ("subject", "edition, notes", "medium", "title", "city, country")
    assert tuple(audit[1])[1:] == ("", "", "", "", "")


def test_records(table):
    c = claims(table, [(1, "title", "A\nB"), (1, "date_year", "1886.0"), (1, "scale_ratio", "N/A"), (1, "bbox_west", "x"),
                       (1, "type_specific.zeta", "z"), (1, "type_specific.datum", "d"), (2, "title", "n/a"), (3, "title", "lost")])
    docs = table("doc_id int", [(1,), (2,), (3,), (4,)])
    wide = record.wide_records(c, docs, failed=table("doc_id int", [(3,)]))
    rows = {r.doc_id: r for r in wide.collect()}
    assert wide.columns[-2:] == ["ts_datum", "ts_zeta"] and len(wide.columns) == 1 + 28 + 2 + 2
    assert (rows[1].map_title, rows[1].map_date_year, rows[1].map_scale_ratio, rows[1].map_bbox_west) == ("A B", 1886, None, None)
    assert rows[1].map_not_applicable == "scale_ratio" and rows[2].map_title == "N/A"
    assert rows[3].map_title == "" and rows[4].map_notes == "" and rows[4].ts_zeta == ""
    core = record.dublin_core(wide)
    assert core.columns[-17:][0] == "dc:identifier"
    assert core.filter("doc_id = 1").first()["dcterms:created"] == "1886"


def test_feedback(table):
    c = claims(table, [(1, "title", "A")])
    v = table(VERDICT, [(1, "title", False, "wrong", "sees"), (1, "notes", True, "", "")])
    text = parse.correction_feedback(c, v).first().feedback
    assert text == ('[{"field":"title","your_value":"A","your_evidence_bbox":[1.0,2.0,3.0,4.0],"your_evidence_text":"t",'
                    '"critic_says_wrong_because":"wrong","critic_sees_in_that_bbox":"sees"}]')


def test_claims_are_dealt_by_rows_and_never_broadcast(spark, monkeypatch):
    """A small file of many responses: its tasks follow from the rows, and no side that grows is sent through the driver."""
    monkeypatch.setattr(session, "DEALT_ROWS", 300)
    monkeypatch.setattr(rounds, "CLAIM_ROWS", 500)
    body = '{"fields": {"title": {"value": "a", "evidence_bbox": [1, 2, 3, 4]}, "notes": {"value": "b", "evidence_bbox": [1, 2, 3, 4]}}}'
    documents = spark.range(4_500).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(body).alias("json"))
    claims = parse.flatten_claims(documents)
    assert claims.rdd.getNumPartitions() == 15 and claims.count() == 9_000
    few = claims.filter("doc_id < 1000")
    verdicts = few.select("doc_id", "field", F.lit(False).alias("ok"), F.lit("").alias("issue"), F.lit("").alias("what_you_see"))
    rereads = few.select("doc_id", "field", F.lit("new").alias("value"), F.lit(True).alias("confident"), F.lit("seen").alias("verbatim_text"))
    now, _, taken = rounds.apply_rereads(claims, verdicts, rereads)
    assert "Broadcast" not in now._jdf.queryExecution().executedPlan().toString()
    assert now.filter("value = 'new'").count() == taken.count() == 2000 and now.count() == 9_000


def test_verdicts_and_marks_are_dealt_by_rows(spark, monkeypatch):
    """Few bytes, many rows: by bytes alone each step would be one task."""
    monkeypatch.setattr(parse, "CLAIM_ROWS", 100)
    monkeypatch.setattr(rounds, "CLAIM_ROWS", 100)
    sent = spark.range(3000).select(
        F.col("id").cast("int").alias("doc_id"), F.lit("title").alias("field"), F.lit("x").alias("value"),
        F.lit(None).cast("array<double>").alias("evidence_bbox"), F.lit("").alias("evidence_text"), F.lit("").alias("evidence_kind"))
    parsed = sent.select("doc_id", F.lit('{"verdicts": {"title": {"ok": false, "issue": "i"}}}').alias("json"))
    verdicts = parse.parse_verdicts(parsed, sent)
    assert verdicts.count() == 3000 and verdicts.rdd.getNumPartitions() >= 30
    key = verdicts.select("doc_id", "field")
    marks = rounds.audit(sent, key, key.limit(0), key.limit(0), key.limit(0), key.limit(0))
    assert marks.filter("map_review_fields_uncertain = 'title'").count() == 3000 and marks.rdd.getNumPartitions() >= 30


def test_texts_of_responses_do_not_travel(spark, monkeypatch):
    """Responses built from a small file come dealt by document; only the narrow rows behind them are shuffled, once."""
    from queries import claims as derived

    monkeypatch.setattr(session, "DEALT_ROWS", 10)
    parsed = derived._parsed(spark, "/root/testdata/sf0.001")
    assert parsed.rdd.getNumPartitions() == 20
    placed, plain = parse.flatten_claims(parsed, placed=True), parse.flatten_claims(parsed)
    plan = derived.flatten_claims(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(p_partkey") == plan.count("Exchange ") == 1
    assert placed.count() > 0 and placed.exceptAll(plain).isEmpty() and plain.exceptAll(placed).isEmpty()
    longs = derived.extra_fields_long(spark, "/root/testdata/sf0.001")
    assert longs.rdd.getNumPartitions() == 20


def test_presence_is_dealt_by_rows(spark, monkeypatch):
    """Answers of a small file: they are grouped by claim over tasks that follow the rows, and meet the claims there."""
    monkeypatch.setattr(rounds, "CLAIM_ROWS", 100)
    start = spark.range(1000).select(
        F.col("id").cast("int").alias("doc_id"), F.lit("city").alias("field"), F.lit(" A,B,, A,C,").alias("value"),
        F.lit(None).cast("array<double>").alias("evidence_bbox"), F.lit("").alias("evidence_text"), F.lit("").alias("evidence_kind"))
    start = start.unionByName(start.withColumn("field", F.lit("notes")))
    names = F.explode(F.array(*[F.lit(n) for n in ("A", "A", "C", "D", "")] + [F.lit(None).cast("string")])).alias("name")
    answers = session.checkpointed(start.filter("field = 'city' and doc_id % 2 = 0").coalesce(1).select("doc_id", "field", names, F.lit(True).alias("visible")))
    verdicts = start.select("doc_id", "field", F.lit(False).alias("ok"), F.lit("").alias("issue"), F.lit("").alias("what_you_see"))
    now, _, pruned = rounds.prune_absent_names(session.checkpointed(start), verdicts, answers)
    assert {(r.field, r.value, r.n) for r in now.groupBy("field", "value").agg(F.count("*").alias("n")).collect()} == {
        ("city", "A, A, C", 500), ("notes", " A,B,, A,C,", 1000)}
    assert pruned.count() == 1000 and pruned.rdd.getNumPartitions() == 30
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan
