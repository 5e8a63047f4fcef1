"""Rank fusion of hit lists and the text block that is handed to a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom._columns import strip
from tabloom.retrieval.bm25 import TIE_DIGITS
from tabloom.session import broadcast_if_small, checkpointed

NO_RESULTS = "(No search results found)"


def with_text(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked documents with their text. Hits are few next to the texts, which stay where they are unless the hits are many."""
    return corpus.join(broadcast_if_small(checkpointed(ranked)), "doc_id")


def as_hits(ranked: DataFrame, corpus: DataFrame, source: str) -> DataFrame:
    """Ranked documents with their text in the common hit layout."""
    return with_text(ranked, corpus).select(
        "query_id", F.col("doc_id").cast("string").alias("doc_id"), "text", "score",
        F.lit(source).alias("source"), "rank",
        F.create_map(F.lit("row_index"), F.col("doc_id").cast("string")).alias("metadata"),
    )


def external_hits(hits: DataFrame, service: str, scored: bool = False) -> DataFrame:
    """Hits of an outside service (query_id, text, rank, url, title[, score]).

    Without its own score a hit counts 1/rank.
    """
    score = F.col("score").cast("double") if scored else F.lit(1.0) / F.col("rank")
    return hits.select(
        "query_id", F.lit(None).cast("string").alias("doc_id"), "text", score.alias("score"),
        F.lit(f"web:{service}").alias("source"), F.col("rank").cast("int").alias("rank"),
        F.create_map(
            F.lit("url"), F.coalesce("url", F.lit("")), F.lit("title"), F.coalesce("title", F.lit(""))
        ).alias("metadata"),
    )


def fuse(lists: list[DataFrame], k: int = 60, top_k: int = 10) -> DataFrame:
    """Reciprocal rank fusion keyed by the stripped text.

    Of equal texts the hit with most metadata is kept, the earliest on a tie;
    equal sums keep the order in which texts first appeared.
    """
    numbered = [hits.withColumn("_list", F.lit(i)) for i, hits in enumerate(lists)]
    hits = reduce(DataFrame.unionByName, numbered).withColumn("_key", strip(F.col("text")))
    first = F.struct("_list", "rank")
    # Higher is better: metadata size, then list and rank counted downwards.
    worth = F.struct(F.size("metadata"), -F.col("_list"), -F.col("rank"))
    fused = (
        hits.filter(F.col("_key") != "")
        .groupBy("query_id", "_key")
        .agg(
            F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"),
            F.max_by(F.struct("text", "source", "metadata", "doc_id"), worth).alias("_hit"),
            F.min(first).alias("_first"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", TIE_DIGITS).desc(), F.col("_first._list"), F.col("_first.rank")
    )
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .select(
            "query_id", F.col("_hit.doc_id").alias("doc_id"), F.col("_hit.text").alias("text"), "score",
            F.concat(F.lit("rrf("), F.col("_hit.source"), F.lit(")")).alias("source"),
            "rank", F.col("_hit.metadata").alias("metadata"),
        )
    )


def context_blocks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``context``: one numbered paragraph per hit, in rank order.

    A query has at most top_k hits, so its list is short by construction.
    """
    origin = F.coalesce(F.try_element_at("metadata", F.lit("url")), F.col("source"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), origin, F.lit(") "), "text")
    blocks = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda h: h["line"]),
            "\n\n",
        ).alias("context")
    )
    return queries.join(blocks, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_RESULTS))
    )
