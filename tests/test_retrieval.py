import math
import random

import numpy as np
from pyspark.sql import functions as F

from tabloom.linkage import candidates
from tabloom.retrieval import bm25, fusion, knowledge, vector_index, vectors, word_scan
from tabloom.retrieval.corpus import build_corpus


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    """Plain Okapi scores of all texts for one query."""
    docs = [t.lower().split() for t in corpus]
    mean = sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    result = []
    for d in docs:
        score = 0.0
        for w in query.lower().split():
            tf = d.count(w)
            score += idf.get(w, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        result.append(score)
    return result


def make_corpus(seed=1, n=60):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 25))) for _ in range(n)]
    queries = ["the w1 W2 w2", "w3", "zzz", "", "w4 w5 w6 the the"]
    return texts, queries


def test_bm25_matches_formula(spark):
    texts, queries = make_corpus()
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    hits = bm25.search(asked, corpus, 7)
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 9)))
    for q, query in enumerate(queries):
        scores = okapi(texts, query)
        order = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 10), i))[:7]
        want = [(k + 1, i, round(scores[i], 9)) for k, i in enumerate(order) if scores[i] > 0]
        assert sorted(got.get(q, [])) == want


def test_bm25_blocks_and_chunks_do_not_change_hits(spark, monkeypatch):
    texts, queries = make_corpus(n=300)
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([*enumerate(queries), (7, None), (8, "w1 w29")], "query_id int, query string")
    whole = {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in bm25.search(asked, corpus, 3).collect()}
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 7)
    monkeypatch.setattr(bm25, "FOLDER_COUNTS", 100)
    index = bm25.build_index(corpus)
    assert index.block_count > 40 and index.folders > 10
    for chunk in (1, 100):
        hits = bm25.search(asked, None, 3, index, chunk_queries=chunk).collect()
        assert {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in hits} == whole
    names = corpus.select(F.concat(F.lit("d"), F.lpad("doc_id", 3, "0")).alias("doc_id"), "text")
    assert {(r.query_id, int(r.doc_id[1:])) for r in bm25.search(asked, names, 3).collect()} == {x[:2] for x in whole}
    assert bm25.search(asked, corpus.limit(0), 3).count() == 0 and bm25.search(asked.limit(0), corpus, 3).count() == 0


def test_bm25_reads_its_own_words_and_blocks_within_reach(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 20)
    monkeypatch.setattr(bm25, "FOLDER_COUNTS", 500)
    rng = random.Random(3)
    texts = [" ".join(["common", f"rare{i // 4}"] + rng.choices([f"w{j}" for j in range(400)], k=30)) for i in range(800)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    index = bm25.build_index(corpus)
    assert index.blocks.count() > 5000
    one = spark.createDataFrame([(1, "common rare7")], "query_id int, query string")
    asked = bm25.query_weights(one, index)
    # the folders of two words, of some fifty
    scanned = bm25._own_folders(index.blocks, asked)
    assert len(scanned.inputFiles()) and scanned.count() < 0.2 * index.blocks.count()
    placed = bm25.bounds(asked, index)
    assert placed.count() == index.block_count
    order = bm25.Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = placed.withColumn("place", F.row_number().over(order))
    first = bm25._scored(placed.where("place <= 4"), asked, index, 4, 1)
    rest = bm25.worth_reading(placed.where("place > 4"), first, 4)
    assert rest.count() <= 2  # 34 blocks hold the common word and cannot reach the fourth score
    assert {r.doc_id for r in bm25.search(one, None, 4, index).collect()} == {28, 29, 30, 31}


def test_few_queries_need_no_index(spark, monkeypatch):
    texts, queries = make_corpus(n=200)
    spaces = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and (chr(i).isspace() or chr(i) in "\u180e\u200b\ufeff")]
    texts += ["W1" + c + "w2" for c in spaces] + ["\u0130x \u03a3\u03a3 w3"]
    corpus = spark.createDataFrame([*((f"d{i:03}", t) for i, t in enumerate(texts)), ("none", None)], "doc_id string, text string")
    asked = spark.createDataFrame([*enumerate(queries), (7, None), (8, "i\u0307x w1\u3000w29"), (9, "\u03c3\u03c2")], "query_id int, query string")
    index = bm25.build_index(corpus)

    def rows(hits):
        return sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in hits.collect())

    want = rows(bm25.search(asked, None, 6, index))
    lefts = corpus.select(F.col("doc_id").alias("left_id"), "text").withColumn("vector", vectors.embed(F.col("text")))
    rights = asked.select(F.col("query_id").alias("right_id"), F.coalesce("query", F.lit("")).alias("text"))
    rights = rights.withColumn("vector", vectors.embed(F.col("text")))

    def near():
        return sorted((r.right_id, r.left_id, round(r.score, 9), r.reason) for r in candidates.fallback(lefts, rights, 4).collect())

    with monkeypatch.context() as m:
        m.setattr(word_scan, "FEW_WORDS", 0)
        assert rows(bm25.search(asked, corpus, 6)) == want
        indexed = near()
    monkeypatch.setattr(bm25, "build_index", None)
    monkeypatch.setattr(word_scan, "HELD_WORDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert rows(bm25.search(asked, corpus, 6)) == want and len({r[0] for r in want}) == 5
        assert near() == indexed and indexed
        assert bm25.search(asked, corpus.limit(0), 6).count() == 0 and bm25.search(asked.limit(0), corpus, 6).count() == 0
        assert candidates.fallback(lefts.limit(0), rights).count() == 0 and candidates.fallback(lefts, rights.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bm25_plan_does_not_grow_with_queries(spark):
    texts, _ = make_corpus()
    index = bm25.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))

    def plan(n):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 30).alias("query"))
        return bm25.search(asked, None, 2, index, chunk_queries=10, few_blocks=0)._jdf.queryExecution().analyzed().toString().count("\n")

    assert plan(5) == plan(2000)


def test_vector_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(50, 8))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[7] = data[3]  # a tie
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "doc_id int, vector array<double>")
    asked = docs.select(F.col("doc_id").alias("query_id"), "vector")
    want = set()
    for q in range(50):
        scores = (data @ data[q]).round(10)
        order = sorted(range(50), key=lambda i: (-scores[i], i))[:4]
        want |= {(q, i, k + 1) for k, i in enumerate(order) if scores[i] > 0}

    def run():
        return {(r.query_id, r.doc_id, r["rank"]) for r in vectors.search(asked, docs, 4).collect()}

    assert run() == want
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vectors, "DOC_BLOCK", 15)
    assert run() == want
    one = docs.limit(1).select(vectors.dot(F.col("vector"), F.col("vector"))).first()[0]
    assert abs(one - 1) < 1e-9


def test_clustered_vectors_give_the_exact_best(spark, monkeypatch):
    """Clusters, even vectors, ties, a zero and null vectors, long and short ones: as by brute force, with far clusters skipped."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12)) * 5
    clustered = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 0.05
    even = rng.normal(size=(1500, 12)) * rng.uniform(0.1, 3, (1500, 1))
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 40)
    for data, skips in ((clustered, True), (even, False)):
        data[7], data[11] = data[3], 0.0
        rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(-1, None)]
        docs = spark.createDataFrame(rows, "doc_id long, vector array<double>")
        asked = docs.filter("doc_id % 10 = 0 or doc_id < 12").select(F.col("doc_id").alias("query_id"), "vector")
        index = vector_index.build(docs, per_cluster=50)
        assert index.counts.sum() == len(data) and index.documents.count() == len(data)
        got = {(r.query_id, r.doc_id, r["rank"]) for r in vector_index.search(asked, index, 6).collect()}
        want = set()
        for (q,) in asked.filter("vector is not null").select("query_id").collect():
            scores = (data @ data[q]).round(10)
            order = sorted(range(len(data)), key=lambda i: (-scores[i], i))[:6]
            want |= {(q, i, k + 1) for k, i in enumerate(order) if scores[i] > 0}
        assert got == want
        _, near, far = vector_index.candidates(asked, index, 6)
        seen = sum(index.counts[list(r.clusters)].sum() for part in (near, far) for r in part.collect())
        assert not skips or seen < 0.2 * len(data) * near.count()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)
    through = vectors.search(asked, docs, 6, index_from=1000)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in through.collect()} == want
    none = vector_index.build(docs.filter("doc_id < 0"))
    assert vector_index.search(asked, none, 6).isEmpty()


def test_visits_report_by_span_and_not_by_cluster(spark, monkeypatch):
    """Even vectors are sent to all clusters: what leaves the tasks is the best of each span, and the result is exact."""
    monkeypatch.setattr(vector_index, "SPAN_BYTES", 8 * 6 * 300)
    data = np.random.default_rng(6).normal(size=(900, 6))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "doc_id long, vector array<double>")
    index = vector_index.build(docs, per_cluster=10)
    routed = docs.filter("doc_id < 200").select(
        F.col("doc_id").alias("query_id"), "vector", F.sequence(F.lit(0), F.lit(len(index.counts) - 1)).alias("clusters"))
    found = vector_index.visit(routed, index, 5).collect()
    assert 200 * 5 <= len(found) <= 200 * 5 * 4 and len({(r.query_id, r.doc_id) for r in found}) == len(found)
    best = {}
    for r in found:
        best.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    for q, rows in best.items():
        scores = (data @ data[q]).round(10)
        assert [d for _, d in sorted(rows)[:5]] == sorted(range(900), key=lambda i: (-scores[i], i))[:5]


def test_texts_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return np.array([[float(len(t)), 1.0] for t in texts]).reshape(-1, 2)

    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "")], "doc_id int, text string")
    store = str(tmp_path / "vectors")
    for rows, total in ((df, 2), (df, 2), (df.unionAll(spark.createDataFrame([(5, "abc")], df.schema)), 3)):
        out = vectors.embedded(rows, "text", store, counting)
        got = {r.doc_id: r.vector for r in out.collect()}
        out.count(), out.collect()
        assert out.columns == ["doc_id", "text", "vector"] and calls.value == total
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 1.0], 4: [0.0, 1.0], 5: [3.0, 1.0]}


def test_embedding(spark, tmp_path):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    out = [np.array(r[0]) for r in df.select(vectors.embed(F.col("t"))).collect()]
    assert len(out[0]) == 384 and abs(np.linalg.norm(out[0]) - 1) < 1e-12 and not out[1].any() and not out[2].any()
    custom = df.select(vectors.embed(F.col("t"), lambda texts: np.array([[len(t), 1.0] for t in texts])).alias("vector"))
    stored = vectors.store_vectors(custom, str(tmp_path / "v"))
    assert sorted(r.vector for r in stored.collect()) == [[0.0, 1.0], [0.0, 1.0], [5.0, 1.0]]


def test_fusion_rules(table):
    schema = "query_id int, doc_id string, text string, score double, source string, rank int, metadata map<string,string>"
    one = table(schema, [(1, "a", "x ", 3.0, "bm25", 1, {"row_index": "a"}), (1, "b", "y", 2.0, "bm25", 2, {"row_index": "b"}),
                         (1, "c", " ", 1.0, "bm25", 3, {})])
    two = table(schema, [(1, "b", "y", .9, "vector", 1, {"row_index": "b"}), (1, "d", " x", .8, "vector", 2, {"a": "1", "b": "2"})])
    got = [(r["rank"], r.text, r.source, round(r.score, 12)) for r in fusion.fuse([one, two]).orderBy("rank").collect()]
    total = round(1 / 61 + 1 / 62, 12)
    assert got == [(1, " x", "rrf(vector)", total), (2, "y", "rrf(bm25)", total)]
    queries = table("query_id int, query string", [(1, "q"), (2, "r")])
    web = fusion.external_hits(
        table("query_id int, text string, rank int, url string, title string", [(1, "page", 2, "http://u", None)]), "bing")
    assert web.first().score == 0.5
    text = {r.query_id: r.context for r in fusion.context_blocks(queries, fusion.fuse([one, web], top_k=2)).collect()}
    assert text == {1: "[1] (rrf(bm25)) x \n\n[2] (rrf(bm25)) y", 2: fusion.NO_RESULTS}


def test_corpus_and_knowledge(table):
    df = table("i int, a string, n double", [(1, "x", None), (2, None, 2.5)])
    assert [r.text for r in build_corpus(df, "i", "a,zz,n").orderBy("doc_id").collect()] == ["x", "2.5"]
    assert [r.text for r in build_corpus(df, "i").orderBy("doc_id").collect()] == ["1 x", "2 2.5"]
    assert build_corpus(df, "i", "zz").count() == 0
    entries = table("id int, title string, phases array<string>, content string",
                    [(2, None, ["extract"], "two"), (1, "One", ["critic", "extract"], "one"), (3, "No", ["critic"], "x")])
    assert knowledge.knowledge_text(entries, "extract") == (
        "═══ REFERENCE KNOWLEDGE BASE ═══\n\n### One\none\n\n### Untitled\ntwo\n")
    assert knowledge.knowledge_text(entries, "other") == ""
