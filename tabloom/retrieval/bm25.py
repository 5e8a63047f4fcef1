"""Okapi BM25 over an inverted index with block maxima.

Documents are dealt to blocks of bounded size by a hash of their id. The words of a document are counted inside its row and
written once; the index is a row per word and block: the documents of the block that hold the word with the word's
impact on their score, and the highest of these impacts. Rows lie in folders by a hash of the word, sorted by word.

A search reads the folders of its own words. First it reads their block maxima alone: the sum over a query's words bounds
the score of every document in a block. The few blocks with the highest bounds are scored, the k-th best score found there
is a floor, and of all other blocks only those are scored whose bound reaches it. Queries go in chunks, which like blocks
are data: a task scores the blocks of one number for one chunk, and reports the best of each query. So the plan
is the same for any number of queries, and pairs of queries and documents are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom._columns import words
from tabloom.session import checkpointed, spread_out, written

# Parameters of the Okapi formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a block, queries of a chunk, and blocks that are scored for a floor.
BLOCK_DOCS, CHUNK_QUERIES, FIRST_BLOCKS = 1024, 256, 2
#: Up to so many blocks, all are scored at once.
FEW_BLOCKS = 16
#: Word counts per folder of the index, about, and the most folders.
FOLDER_COUNTS, MOST_FOLDERS = 100_000, 4096


@dataclass
class Bm25Index:
    """The written index of a corpus: lists per word and block."""

    blocks: DataFrame  # folder, term, block, top, n, docs: array of (doc_id, impact)
    docs: int
    block_count: int
    folders: int
    floor: float  # weight of words that are in more than half of the documents

    @property
    def counts(self) -> DataFrame:
        """folder, term, df: documents that hold each word"""
        return self.blocks.groupBy("folder", "term").agg(F.sum("n").alias("df"))

    @property
    def terms(self) -> DataFrame:
        """folder, term, df, idf"""
        raw = _raw(F.lit(self.docs))
        return self.counts.select("folder", "term", "df", F.when(raw < 0, self.floor).otherwise(raw).alias("idf"))

    def folder(self, term: Column | str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.folders)).cast("int")


def _raw(docs: Column) -> Column:
    return F.log(docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _counted(corpus: DataFrame) -> DataFrame:
    """Words counted inside the row: sorted, equal words are neighbours, and a count is the distance of two starts."""
    tokens = corpus.select("doc_id", F.array_sort(words(F.lower(F.coalesce("text", F.lit(""))))).alias("w"))
    new = lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i)
    starts = tokens.select("doc_id", "w", F.filter(F.transform("w", new), lambda i: i.isNotNull()).alias("at"))
    terms = F.transform(
        "at", lambda i, j: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("at", j + 1), F.size("w")) - i).cast("long").alias("tf"))
    )
    return starts.select("doc_id", F.size("w").alias("length"), terms.alias("terms"))


def build_index(corpus: DataFrame) -> Bm25Index:
    """Index of (doc_id, text); ids are distinct. A null text has no words."""
    documents = written(_counted(spread_out(corpus)))
    totals = documents.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"), F.sum(F.size("terms")).alias("counts")
    ).first()
    docs, mean_length = totals["docs"], totals["mean_length"] or 1.0
    block_count = max(1, math.ceil(docs / BLOCK_DOCS))
    folders = min(MOST_FOLDERS, max(1, math.ceil((totals["counts"] or 0) / FOLDER_COUNTS)))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (1 - B + B * F.col("length") / F.lit(mean_length)))
    rows = documents.select("doc_id", block_of("doc_id", block_count).alias("block"), "length", F.inline("terms"))
    index = Bm25Index(rows, docs, block_count, folders, 0.0)
    # one shuffle places the counts where they are grouped, sorted and written; a word that many blocks hold has several tasks
    placed = rows.select(
        index.folder("term").alias("folder"), F.floor(F.col("block") / 64).alias("span"), "term", "block", "doc_id", impact.alias("impact")
    ).repartition("folder", "span")
    # the word comes first, so that rows are sorted by its beginning; rows of a folder keep that order
    lists = placed.groupBy("term", "block", "folder", "span").agg(
        F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("doc_id", "impact")).alias("docs")
    )
    index.blocks = written(lists.drop("span"), by="folder")
    index.floor = (index.counts.agg(F.avg(_raw(F.lit(docs)))).first()[0] or 0.0) * EPSILON
    return index


def block_of(doc_id: Column | str, block_count: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(block_count)).cast("int")


def query_weights(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, folder, term, weight): a repeated query word counts each time. Only the folders of these words are read."""
    terms = checkpointed(
        queries.select("query_id", F.explode(words(F.lower(F.coalesce("query", F.lit(""))))).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("folder", index.folder("term"))
    )
    return terms.join(_own_folders(index.terms, terms), ["folder", "term"]).select(
        "query_id", "folder", "term", (F.col("n") * F.col("idf")).alias("weight")
    )


def _own_folders(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The part of an index table that lies in the folders of the words asked for; there are MOST_FOLDERS at the most."""
    return table.where(F.col("folder").isin([r["folder"] for r in asked.select("folder").distinct().collect()]))


def chunk_of(query_id: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(query_id), F.lit(chunks)).cast("int")


# Scores that differ only by the order of summation count as equal.
TIE_DIGITS = 10


def keep_top(scored: DataFrame, top_k: int) -> DataFrame:
    """Rank by score, ties by document id; cut at top_k, then drop scores <= 0."""
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", TIE_DIGITS).desc(), F.col("doc_id")
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k).filter(F.col("score") > 0)
    )


class Lists:
    """The index rows (term, docs) of some blocks, ready to score queries over the documents ``ids``."""

    def __init__(self, rows: pa.Table, ids: pa.Array | None = None):
        docs = rows.column("docs").combine_chunks()
        flat = docs.flatten()
        own = flat.field("doc_id")
        self.ids = own.unique() if ids is None else ids
        self.place = pc.index_in(own, value_set=self.ids).to_numpy(zero_copy_only=False)
        self.impact = flat.field("impact").to_numpy(zero_copy_only=False)
        ends = np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        # a word of several blocks has several rows
        self.at: dict[str, list[tuple[int, int]]] = {}
        for term, first, last in zip(rows.column("term").to_pylist(), [0, *ends[:-1]], ends):
            self.at.setdefault(term, []).append((first, last))

    def scores(self, asked: list[dict]) -> np.ndarray:
        total = np.zeros(len(self.ids))
        for word in asked:
            for first, last in self.at.get(word["term"], ()):
                total[self.place[first:last]] += word["weight"] * self.impact[first:last]
        return total


def best_places(line: np.ndarray, order: np.ndarray, top_k: int) -> np.ndarray:
    """Places of the largest positive numbers, equal ones in the order of ids; ``order`` is each place's rank among ids."""
    some = np.flatnonzero(line > 0)
    rounded = line[some].round(TIE_DIGITS)
    if len(some) > top_k:
        reach = rounded >= np.partition(rounded, len(some) - top_k)[len(some) - top_k]
        some, rounded = some[reach], rounded[reach]
    return some[np.lexsort((order[some], -rounded))[:top_k]]


def id_ranks(ids: pa.Array) -> np.ndarray:
    ranks = np.empty(len(ids), np.int64)
    ranks[pc.sort_indices(ids).to_numpy(zero_copy_only=False)] = np.arange(len(ids))
    return ranks


def bounds(asked: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, block, bound): no document of the block scores higher. Reads the maxima of the words asked for, no list."""
    maxima = _own_folders(index.blocks.select("folder", "term", "block", "top"), asked)
    return maxima.join(asked, ["folder", "term"]).groupBy("query_id", "block").agg(
        F.sum(F.greatest("weight", F.lit(0.0)) * F.col("top")).alias("bound")
    )


def lists_of(asked: DataFrame, index: Bm25Index, chunks: int) -> DataFrame:
    """(chunk, term, block, docs): the index rows of the words that a chunk of queries asks for."""
    wanted = asked.select(chunk_of("query_id", chunks).alias("chunk"), "folder", "term").distinct()
    return _own_folders(index.blocks.select("folder", "term", "block", "docs"), asked).join(wanted, ["folder", "term"]).drop("folder")


def query_words(asked: DataFrame) -> DataFrame:
    return asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("words"))


def _scored(pairs: DataFrame, asked: DataFrame, index: Bm25Index, top_k: int, chunks: int) -> DataFrame:
    """(query_id, doc_id, score) of the best documents in every pair of query and block."""
    doc_kind = index.blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {doc_kind}, score double"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    dealt = pairs.select(chunk_of("query_id", chunks).alias("chunk"), "block", "query_id")
    lists = lists_of(asked, index, chunks).join(dealt.select("chunk", "block").distinct(), ["chunk", "block"], "left_semi")

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found_q, found_d, found_s = [], [], []
        if len(queries) and len(rows):
            lists = Lists(rows)
            ranks = id_ranks(lists.ids)
            for query, asked_words in zip(queries.column("query_id").to_pylist(), queries.column("words").to_pylist()):
                line = lists.scores(asked_words)
                best = best_places(line, ranks, top_k)
                found_q += [query] * len(best)
                found_d.append(lists.ids.take(pa.array(best)))
                found_s.append(line[best])
        columns = [found_q, pa.concat_arrays(found_d) if found_d else [], np.concatenate(found_s) if found_s else []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # both sides come from the index; new column identities keep them apart
    queries = dealt.join(query_words(asked), "query_id").select("chunk", "block", "query_id", "words").toDF("chunk", "block", "query_id", "words")
    lists = lists.select("chunk", "block", "term", "docs").toDF("chunk", "block", "term", "docs")
    return queries.groupBy("chunk", "block").cogroup(lists.groupBy("chunk", "block")).applyInArrow(score, kind)


def search(
    queries: DataFrame, corpus: DataFrame | None, top_k: int = 10, index: Bm25Index | None = None,
    chunk_queries: int = CHUNK_QUERIES, first_blocks: int = FIRST_BLOCKS, few_blocks: int = FEW_BLOCKS,
) -> DataFrame:
    """Top documents per query: (query_id, doc_id, score, rank). ``index`` saves building one from ``corpus``; without it few
    queries (measured) travel to the documents, which then are not indexed.

    Queries without known words have no rows; a null query has none either. Equal scores go by document id.
    """
    if index is None:
        from tabloom.retrieval import word_scan

        few = word_scan.few_words(queries)
        if few is not None:
            kind = queries.schema["query_id"].dataType.simpleString()
            return word_scan.best(word_scan.count_words(corpus, few), kind, top_k)
    index = index or build_index(corpus)
    return ranked(checkpointed(query_weights(queries, index)), index, top_k, chunk_queries, first_blocks, few_blocks)


def ranked(
    asked: DataFrame, index: Bm25Index, top_k: int, chunk_queries: int = CHUNK_QUERIES, first_blocks: int = FIRST_BLOCKS,
    few_blocks: int = FEW_BLOCKS,
) -> DataFrame:
    """The search for weighted words (query_id, folder, term, weight), a written table."""
    chunks = max(1, math.ceil(asked.select("query_id").distinct().count() / chunk_queries))
    if index.block_count <= few_blocks:
        pairs = asked.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(index.block_count - 1))).alias("block"))
        return keep_top(_scored(pairs, asked, index, top_k, chunks), top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = written(bounds(asked, index).withColumn("place", F.row_number().over(order)))
    first = checkpointed(_scored(placed.where(F.col("place") <= first_blocks), asked, index, top_k, chunks))
    rest = worth_reading(placed.where(F.col("place") > first_blocks), first, top_k)
    return keep_top(first.unionByName(_scored(rest, asked, index, top_k, chunks)), top_k)


def worth_reading(placed: DataFrame, found: DataFrame, top_k: int) -> DataFrame:
    """The pairs of query and block whose bound reaches the query's k-th best score so far, ties included."""
    kth = keep_top(found, top_k).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("kth"))
    reach = F.col("bound") * (1 + 1e-9) + 10.0 ** -(TIE_DIGITS - 1) >= F.coalesce("kth", F.lit(0.0))
    return placed.join(kth, "query_id", "left").where(reach).select("query_id", "block")
