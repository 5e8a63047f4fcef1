"""Embedding of texts and exact nearest vectors by dot product."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.retrieval.bm25 import TIE_DIGITS, keep_top
from tabloom.session import small_rows

DIMENSIONS = 384
QUERY_BLOCK, DOC_BLOCK = 1024, 8192
#: Documents from which many queries are worth an index.
INDEX_FROM = 50_000

Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=200_000)
def _slot(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % DIMENSIONS


def hashed_embedder(texts: list[str]) -> np.ndarray:
    """Token counts hashed into 384 cells, unit length; stands in for a model."""
    result = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        slots = [_slot(t) for t in (text or "").lower().split()]
        if slots:
            result[row] = np.bincount(slots, minlength=DIMENSIONS)
            result[row] /= np.linalg.norm(result[row])
    return result


def embed(text: Column, embedder: Embedder = hashed_embedder) -> Column:
    """Vector column from a text column; the embedder sees one Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embedder(texts.fillna("").tolist()), dtype=float)))

    return run(text)


def embedded(
    texts: DataFrame, text_column: str, store: str, embedder: Embedder = hashed_embedder
) -> DataFrame:
    """The table with a column ``vector``; vectors live in a folder keyed by the digest of the text.

    Equal texts are embedded once, and later calls embed only texts that the folder does not hold. The folder is
    shared by all executors and belongs to one embedder; new vectors are committed before this returns. A null text
    counts as empty.
    """
    spark = texts.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    keyed = texts.withColumn("_digest", F.sha2(text, 256))
    todo = keyed.select("_digest", text.alias("_text")).dropDuplicates(["_digest"])
    schema = "digest string, vector array<double>"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(schema).parquet(store).select(F.col("digest").alias("_digest"))
        todo = todo.join(known, "_digest", "left_anti")
    todo.select(F.col("_digest").alias("digest"), embed(F.col("_text"), embedder).alias("vector")).write.mode("append").parquet(store)
    # Two jobs that ran at once may both have written a text.
    known = spark.read.schema(schema).parquet(store).dropDuplicates(["digest"])
    return keyed.join(known.withColumnRenamed("digest", "_digest"), "_digest", "left").select(
        *[F.col(f"`{c}`") for c in texts.columns], "vector")


def store_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write vectors once and read them back, so later searches skip the embedder."""
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns of one row."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda total, v: total + v,
    )


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in values])


def top_positions(line: np.ndarray, top_k: int) -> np.ndarray:
    """Positions of the highest values, ties by position."""
    chosen = np.arange(len(line))
    if len(line) > top_k:
        limit = np.partition(line, len(line) - top_k)[len(line) - top_k]
        chosen = np.flatnonzero(line >= limit)
    return chosen[np.argsort(-line[chosen], kind="stable")][:top_k]


def _local_top(query_ids, query_matrix, doc_ids, doc_matrix, top_k: int) -> pd.DataFrame:
    """Best documents of one block for each query, ties by document id."""
    order = np.argsort(doc_ids, kind="stable")
    doc_ids, product = doc_ids[order], (query_matrix @ doc_matrix[order].T).round(TIE_DIGITS)
    out_query, out_doc, out_score = [], [], []
    for row, line in enumerate(product):
        chosen = top_positions(line, top_k)
        out_query.extend([query_ids[row]] * len(chosen))
        out_doc.extend(doc_ids[chosen])
        out_score.extend(line[chosen])
    return pd.DataFrame({"query_id": out_query, "doc_id": out_doc, "score": out_score})


def local_candidates(queries: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """(query_id, doc_id, score): the best top_k documents of every block per query.

    Few queries (measured) travel to the documents, which then are not moved at
    all; otherwise both tables are cut into blocks and multiplied pairwise.
    """
    from tabloom.retrieval.blocks import block_pairs

    kinds = (
        queries.schema["query_id"].dataType.simpleString(),
        documents.schema["doc_id"].dataType.simpleString(),
    )
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    queries = queries.select("query_id", "vector").filter("vector is not null")
    documents = documents.select("doc_id", "vector").filter("vector is not null")
    rows = small_rows(queries, max_rows=QUERY_BLOCK)
    if rows is not None:
        if not rows:
            return queries.sparkSession.createDataFrame([], schema)
        query_ids = np.array([r["query_id"] for r in rows])
        matrix = _matrix([r["vector"] for r in rows])

        def near(batches):
            for batch in batches:
                if len(batch):
                    yield _local_top(
                        query_ids, matrix, batch["doc_id"].to_numpy(), _matrix(batch["vector"]), top_k
                    )

        return documents.mapInPandas(near, schema)

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        return _local_top(
            a["query_id"].to_numpy(), _matrix(a["vector"]),
            b["doc_id"].to_numpy(), _matrix(b["vector"]), top_k,
        )

    return block_pairs(
        queries, documents, multiply, schema, "query_id", "doc_id", QUERY_BLOCK, DOC_BLOCK
    )


def search(queries: DataFrame, documents: DataFrame, top_k: int = 10, index_from: int = INDEX_FROM) -> DataFrame:
    """Exact top documents per query by dot product: (query_id, doc_id, score, rank).

    Many queries over ``index_from`` documents or more go through a clustered index, which skips what cannot be near.
    """
    from tabloom.retrieval import vector_index

    if small_rows(queries.filter("vector is not null").select("query_id", "vector"), max_rows=QUERY_BLOCK) is None:
        if documents.filter("vector is not null").count() >= index_from:
            return vector_index.search(queries, vector_index.build(documents), top_k)
    return keep_top(local_candidates(queries, documents, top_k), top_k)
