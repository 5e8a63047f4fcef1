"""Retrieval of documents for the benchmark passages, and of nearest vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import registry, sql_words, table
from tabloom.retrieval import bm25, fusion, knowledge, vector_index, vectors
from tabloom.retrieval.corpus import build_corpus

QUERIES, SQL, register = registry()


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _corpus(spark, sf):
    return build_corpus(table(spark, sf, "documents"), "doc_id", "text")


BM25_SQL = f"""
    toks AS (SELECT doc_id, {sql_words('lower(text)')} AS t FROM documents),
    tot AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM toks),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM
           (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
    raw AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, tot GROUP BY term, n_docs),
    idf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25 FROM raw) ELSE r END AS idf FROM raw),
    qt AS (SELECT item_id AS query_id, term, count(*) AS qn FROM
           (SELECT item_id, unnest({sql_words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
    bm AS (SELECT query_id, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM qt JOIN idf USING (term) JOIN tf USING (term), tot GROUP BY ALL),
    bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank
               FROM bm) WHERE rank <= {{k}} AND score > 0)
"""


_BM25 = BM25_SQL.replace("{k}", "10")


@register(
    "build_corpus",
    "SELECT doc_id, text FROM (SELECT doc_id, concat_ws(' ', source, CASE WHEN lang <> 'fr' THEN lang END, n_chars) AS text "
    "FROM documents)",
)
def build_corpus_query(spark, sf):
    df = table(spark, sf, "documents").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    return build_corpus(df, "doc_id", "source, lang, unknown, n_chars")


@register(
    "bm25_search",
    f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_top",
)
def bm25_search(spark, sf):
    hits = bm25.search(_queries(spark, sf), _corpus(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6))


@register(
    "bm25_terms",
    f"WITH {_BM25} SELECT term, count(*) AS df, round(any_value(idf), 8) AS idf FROM tf JOIN idf USING (term) "
    "GROUP BY term",
)
def bm25_terms(spark, sf):
    return bm25.build_index(_corpus(spark, sf)).terms.drop("folder").withColumn("idf", F.round("idf", 8))


_VECTORS_SQL = """
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
               list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY
                   round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 10) DESC, d.vec_id) AS rank
        FROM embeddings q, embeddings d) WHERE rank <= 5 AND score > 0
"""


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return [rows.select(F.col("vec_id").alias(name), F.col("embedding").alias("vector")) for name in ("query_id", "doc_id")]


@register("vector_search", _VECTORS_SQL)
def vector_search(spark, sf):
    return vectors.search(*_vectors(spark, sf), 5).withColumn("score", F.round("score", 6))


@register("vector_search_clusters", _VECTORS_SQL)
def vector_search_clusters(spark, sf):
    """The same through the clustered index, in clusters of about 100 vectors."""
    queries, documents = _vectors(spark, sf)
    index = vector_index.build(documents, per_cluster=100)
    return vector_index.search(queries, index, 5).withColumn("score", F.round("score", 6))


_HASHED_SQL = """
    slots AS (SELECT kind, id, slot, count(*) AS c FROM (
        SELECT kind, id, CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % 384 AS slot FROM (
            SELECT 'q' AS kind, item_id AS id, unnest({qw}) AS term FROM benchmark UNION ALL
            SELECT 'd', doc_id, unnest({dw}) FROM documents)) GROUP BY ALL),
    unit AS (SELECT kind, id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)) AS v FROM slots),
    near AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score
             FROM unit q JOIN unit d ON q.slot = d.slot AND q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
    near_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank
                 FROM near) WHERE rank <= {k} AND score > 0)
""".replace("{qw}", sql_words("lower(text)")).replace("{dw}", sql_words("lower(text)"))


_HASHED = _HASHED_SQL.replace("{k}", "5")


def _near(spark, sf, top_k):
    queries = _queries(spark, sf).select("query_id", vectors.embed(F.col("query")).alias("vector"))
    documents = _corpus(spark, sf).select("doc_id", vectors.embed(F.col("text")).alias("vector"))
    return vectors.search(queries, documents, top_k)


@register(
    "text_vector_search",
    f"WITH {_HASHED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM near_top",
)
def text_vector_search(spark, sf):
    return _near(spark, sf, 5).withColumn("score", F.round("score", 6))


def _lists(spark, sf, top_k=5):
    queries, corpus = _queries(spark, sf), _corpus(spark, sf)
    found = bm25.search(queries, corpus, 2 * top_k)
    keyword = fusion.as_hits(found.filter(F.col("rank") <= top_k), corpus, "bm25")
    # A second list of other length and order: every second hit of the same search.
    ranked = found.filter(F.col("rank") % 2 == 0).withColumn("rank", (F.col("rank") / 2).cast("int"))
    web = fusion.external_hits(
        fusion.with_text(ranked, corpus).select(
            "query_id", F.concat(F.lit("  "), "text").alias("text"), "rank",
            F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.lit("t").alias("title")), "bing")
    return queries, [keyword, web]


_FUSED_SQL = f"""
    WITH {_BM25},
    lists AS (
        SELECT query_id, rank, 0 AS list, text, 'bm25' AS source, 1 AS meta, CAST(NULL AS VARCHAR) AS url
        FROM bm_top JOIN documents USING (doc_id) WHERE rank <= 5
        UNION ALL
        SELECT query_id, CAST(rank / 2 AS BIGINT), 1, text, 'web:bing', 2, 'http://x/' || doc_id
        FROM bm_top JOIN documents USING (doc_id) WHERE rank % 2 = 0),
    keyed AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS key FROM lists),
    fused AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS score,
              arg_max(struct_pack(source := source, url := url), meta * 1000000 - list * 1000 - rank) AS hit,
              min(list * 1000 + rank) AS first FROM keyed WHERE key <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM fused)
"""


@register(
    "fuse_hits",
    f"{_FUSED_SQL} SELECT query_id, rank, round(score, 8) AS score, 'rrf(' || hit.source || ')' AS source, "
    "coalesce(hit.url, '') AS url, md5(key) AS digest FROM ranked WHERE rank <= 6",
)
def fuse_hits(spark, sf):
    _, lists = _lists(spark, sf)
    fused = fusion.fuse(lists, top_k=6)
    return fused.select(
        "query_id", "rank", F.round("score", 8).alias("score"), "source",
        F.coalesce(F.try_element_at("metadata", F.lit("url")), F.lit("")).alias("url"),
        F.md5(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("digest"))


@register(
    "context_blocks",
    f"""{_FUSED_SQL} SELECT item_id AS query_id, coalesce(c, '(No search results found)') AS context FROM benchmark LEFT JOIN
    (SELECT query_id, string_agg('[' || rank || '] (' || coalesce(hit.url, 'rrf(' || hit.source || ')') || ') ' ||
        CASE WHEN hit.source = 'web:bing' THEN '  ' ELSE '' END || key, chr(10) || chr(10) ORDER BY rank) AS c
     FROM ranked WHERE rank <= 3 GROUP BY 1) ON query_id = item_id""",
)
def context_blocks(spark, sf):
    queries, lists = _lists(spark, sf)
    fused = fusion.fuse(lists, top_k=3)
    return fusion.context_blocks(queries, fused).select(
        "query_id", F.regexp_replace("context", r"(?U)\s+(?=\n\n\[|$)", "").alias("context"))


@register(
    "knowledge_sections",
    "SELECT item_id AS id, '### ' || CASE WHEN item_id % 5 = 0 THEN 'Untitled' ELSE 'Item ' || item_id END || chr(10) || text "
    "|| chr(10) AS section FROM benchmark WHERE item_id % 3 <> 0",
)
def knowledge_sections(spark, sf):
    entries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"),
        F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("Item "), "item_id")).alias("title"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("critic"))).otherwise(
            F.array(F.lit("extract"), F.lit("critic"))).alias("phases"),
        F.col("text").alias("content"))
    return knowledge.knowledge_sections(entries, "extract")


@register(
    "knowledge_text",
    """
    SELECT r_regionkey, (SELECT '═══ REFERENCE KNOWLEDGE BASE ═══' || chr(10) || chr(10) ||
        string_agg('### ' || n_name || chr(10) || n_regionkey || chr(10), chr(10) ORDER BY n_nationkey) FROM nation
        WHERE n_regionkey <> 2) AS knowledge FROM region
    """,
)
def knowledge_text(spark, sf):
    entries = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"),
        F.when(F.col("n_regionkey") != 2, F.array(F.lit("extract"))).otherwise(F.array(F.lit("critic"))).alias("phases"),
        F.col("n_regionkey").cast("string").alias("content"))
    return knowledge.add_knowledge(table(spark, sf, "region").select("r_regionkey"), entries, "extract")
