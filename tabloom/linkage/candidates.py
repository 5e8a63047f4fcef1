"""Candidates of every right row: by key, within a key, or by fallback search.

The result of every function is (right_id, left_id, score, reason, cut).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom._columns import as_list, cell_text, col, strip, words
from tabloom.enrich.calls import ask
from tabloom.enrich.requests import pack_requests
from tabloom.enrich.responses import member, parse_responses, unpack_results
from tabloom.linkage.keys import (
    find_key_column, find_title_column, key_from_name, normalize_key, title_from_name,
)
from tabloom.linkage.scoring import block_candidates
from tabloom.retrieval import bm25, vectors, word_scan
from tabloom.retrieval.corpus import build_corpus
from tabloom.session import SMALL_ROWS, checkpointed, grown, small_rows

UNIQUE_KEY_SCORE = 0.95
COLLAPSED = " (dup-records auto-select)"
#: Vectors of a chunk of right rows, and of a span of left rows, in bytes at the most.
CHUNK_BYTES, SPAN_BYTES = 8 << 20, 64 << 20
W_VECTOR, W_KEYWORD = 0.70, 0.30
# Query words of the fallback search that match almost anything.
QUERY_STOP_WORDS = (
    "national", "geographic", "society", "map", "maps", "plan", "chart", "the", "of", "a",
    "an", "in", "on", "and", "to", "for", "by", "is", "at", "from", "with", "this", "that",
    "image", "shows", "showing", "visible", "text", "printed", "appears", "contains",
)
NOTE_COLUMNS = ("Description ", "Description", "description")


def prepare_left(left: DataFrame, left_id: str, match_columns, embedder) -> DataFrame:
    """(left_id, key, title, titled, note, text, vector); titled: the table has titles."""
    key, title = find_key_column(left), find_title_column(left)
    notes = [F.when(col(c).isNotNull(), cell_text(left, c)) for c in NOTE_COLUMNS if c in left.columns]
    named = left.select(
        col(left_id).alias("left_id"),
        (normalize_key(cell_text(left, key)) if key else F.lit(None).cast("string")).alias("key"),
        (F.when(col(title).isNotNull(), cell_text(left, title)) if title else F.lit(None).cast("string"))
        .alias("title"),
        F.lit(title is not None).alias("titled"),
        (F.coalesce(*notes, F.lit("")) if notes else F.lit("")).alias("note"),
        F.concat_ws(
            " ", *[F.when(col(c).isNotNull(), cell_text(left, c)) for c in match_columns]
        ).alias("text"),
    )
    return named.withColumn("vector", vectors.embed(F.col("text"), embedder))


def prepare_right(right: DataFrame, right_id: str, match_columns, embedder) -> DataFrame:
    """(right_id, key, name_title, seen, text, vector)."""
    name = cell_text(right, "filename") if "filename" in right.columns else F.lit("")
    raw_key = key_from_name(name)
    seen = strip(cell_text(right, "text_visible")) if "text_visible" in right.columns else F.lit("")
    cells = [F.when(strip(cell_text(right, c)) != "", cell_text(right, c)) for c in match_columns]
    named = right.select(
        col(right_id).alias("right_id"),
        normalize_key(raw_key).alias("key"),
        raw_key.alias("raw_key"),
        title_from_name(name, raw_key).alias("name_title"),
        seen.alias("seen"),
        F.concat_ws(" ", *cells).alias("text"),
    )
    return named.withColumn("vector", vectors.embed(F.col("text"), embedder))


def key_sizes(lefts: DataFrame) -> DataFrame:
    """Per key: number of left rows, one of them, and whether they share one title.

    Without a title column nothing is known to be the same. A blank title says nothing; a null one is a
    title of its own.
    """
    title = F.nullif(F.substring(F.lower(strip(F.coalesce("title", F.lit("nan")))), 1, 50), F.lit(""))
    return lefts.filter("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("left_id").alias("one_left"),
        (F.bool_and("titled") & F.min(title).eqNullSafe(F.max(title))).alias("same_title"),
    )


def _known_keys(lefts: DataFrame, rights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of the keys, counted before they are sent to tasks, and the right rows whose key is known."""
    sizes = checkpointed(key_sizes(lefts))
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL_ROWS else grown(sizes)
    return sizes, rights.join(sizes, "key")


def _alone(blocked: DataFrame) -> DataFrame:
    return blocked.filter("size = 1").select(
        "right_id", F.col("one_left").alias("left_id"), F.lit(UNIQUE_KEY_SCORE).alias("score"),
        F.concat(F.lit("Call Number match: "), "raw_key").alias("reason"), F.lit(False).alias("cut"),
    )


def by_unique_key(lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """The part of :func:`by_key` that needs no scores, and so no vectors: right rows whose key one left row has."""
    return _alone(_known_keys(lefts, rights)[1])


def by_key(lefts: DataFrame, rights: DataFrame, keep: float) -> DataFrame:
    """Candidates with the same key. A key of one left row needs no comparison."""
    sizes, blocked = _known_keys(lefts, rights)
    alone = _alone(blocked)
    shared_left = lefts.join(sizes.filter("size > 1").select("key"), "key", "left_semi")
    shared_right = blocked.filter("size > 1")
    scored = block_candidates(
        shared_left.select("left_id", "key", "title", "note", "vector"),
        shared_right.select("right_id", "key", "name_title", "seen", "vector"), keep,
    )
    collapse = shared_right.filter("same_title").select("right_id", F.lit(True).alias("_same"))
    marked = scored.join(grown(collapse), "right_id", "left")
    best = bm25.Window.partitionBy("right_id").orderBy(F.col("score").desc(), F.col("left_id"))
    single = (
        marked.filter("_same").withColumn("_rank", F.row_number().over(best)).filter("_rank <= 1")
        .select(
            "right_id", "left_id", "score",
            F.concat("reason", F.lit(COLLAPSED)).alias("reason"),
            F.lit(False).alias("cut"),
        )
    )
    several = marked.filter("_same is null").drop("_same")
    return alone.unionByName(single).unionByName(several)


def fallback(lefts: DataFrame, rights: DataFrame, top_k: int = 5, chunk_queries: int = 1024) -> DataFrame:
    """Best left rows over the whole table by 0.70 cosine + 0.30 scaled BM25.

    Right rows go in chunks and left rows in spans of index blocks; both numbers are columns, a task takes one chunk and one
    span, and only the best of each right row leave it. The highest BM25 score of a right row, by which its scores
    are scaled, comes from a search of the same index. The plan does not depend on the number of rows. Few right rows
    (measured) travel to the left rows instead, which then are neither indexed nor moved.
    """
    useful = F.filter(
        words(F.lower(F.col("text"))), lambda w: ~w.isin(*QUERY_STOP_WORDS) & (F.length(w) >= 2)
    )
    queries = rights.select(F.col("right_id").alias("query_id"), F.array_join(useful, " ").alias("query"), "vector")
    corpus = lefts.select(F.col("left_id").alias("doc_id"), "text", "vector")
    kinds = (
        rights.schema["right_id"].dataType.simpleString(),
        lefts.schema["left_id"].dataType.simpleString(),
    )
    kind = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, reason string"
    sent = small_rows(queries.select("query_id", "vector"), word_scan.FEW_QUERIES)
    few = word_scan.few_words(queries) if sent is not None else None
    if few is not None:
        return _named(bm25.keep_top(_scan(corpus, few, sent, kinds[0], kind, top_k), top_k))
    index = bm25.build_index(corpus.select("doc_id", "text"))
    asked = checkpointed(bm25.query_weights(queries, index))
    highest = bm25.ranked(asked, index, 1).select("query_id", F.col("score").alias("top"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    row_bytes = 8 * (size["width"] or 1)
    chunks = max(1, math.ceil(size["n"] / max(1, min(chunk_queries, CHUNK_BYTES // row_bytes))))
    # spans are large, because every chunk of queries is copied to each, but there is one for each core
    cores = lefts.sparkSession.sparkContext.defaultParallelism
    spans = min(index.block_count, max(math.ceil(index.docs * row_bytes / SPAN_BYTES), cores))

    def span(block) -> Column:
        return F.floor(block * spans / index.block_count).cast("int").alias("span")

    every_span = F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span")
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    sent = (
        queries.join(bm25.query_words(asked), "query_id", "left").join(highest, "query_id", "left")
        .select(bm25.chunk_of("query_id", chunks).alias("chunk"), every_span, "query_id", "vector", "words", "top")
    )
    rows = lefts.select(span(bm25.block_of("left_id", index.block_count)), every_chunk, F.col("left_id").alias("doc_id"), "vector")
    lists = bm25.lists_of(asked, index, chunks).select(span(F.col("block")), "chunk", "term", "docs")
    placed = rows.unionByName(lists, allowMissingColumns=True)
    scored = sent.groupBy("chunk", "span").cogroup(placed.groupBy("chunk", "span")).applyInArrow(_combine(kind, top_k), kind)
    return _named(bm25.keep_top(scored, top_k))


def _named(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("query_id").alias("right_id"), F.col("doc_id").alias("left_id"), "score", "reason",
        F.lit(False).alias("cut"),
    )


def _scan(corpus: DataFrame, few: dict, sent: list, query_kind: str, kind: str, top_k: int) -> DataFrame:
    """Best documents of a batch for each of few queries, whose words and vectors travel to the documents."""
    counted = word_scan.count_words(corpus, few, "vector")
    tops = {r["query_id"]: r["score"] for r in word_scan.best(counted, query_kind, 1).collect()}
    mean_length, terms, asked = counted.mean_length, counted.terms, counted.asked
    names, vectors_sent = [r["query_id"] for r in sent], [r["vector"] for r in sent]
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches):
        asked_vectors = np.array(vectors_sent, float)
        for batch in filter(len, batches if names else ()):
            ids = batch.column("doc_id")
            ranks, scores = bm25.id_ranks(ids), word_scan.Scores(batch, mean_length, terms)
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            cosine, found = asked_vectors @ flat.reshape(len(batch), -1).T, []
            for name, near in zip(names, cosine):
                keyword = scores.of(asked.get(name, ())) / (tops.get(name) or 1.0)
                found += _best_rows(name, ids, ranks, near, keyword, top_k)
            columns = zip(*found, strict=True) if found else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return counted.table.mapInArrow(run, kind)


def _best_rows(name, ids: pa.Array, ranks: np.ndarray, near: np.ndarray, keyword: np.ndarray, top_k: int) -> list[tuple]:
    total = (W_VECTOR * near + W_KEYWORD * keyword).round(bm25.TIE_DIGITS)
    return [
        (name, ids[j].as_py(), float(total[j]), f"Fallback (sem={near[j]:.2f}, bm25={keyword[j]:.2f})")
        for j in bm25.best_places(total, ranks, top_k).tolist()
    ]


def _combine(kind: str, top_k: int):
    """Best documents of a span for each query of a chunk; the span's rows are documents (doc_id, vector) and lists of words."""
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.vstack([np.asarray(v, float) for v in column.to_numpy()])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        is_list = pc.is_valid(rows.column("term"))
        documents = rows.filter(pc.invert(is_list))
        found = []
        if len(queries) and len(documents):
            ids = documents.column("doc_id").combine_chunks()
            ranks = bm25.id_ranks(ids)
            lists = bm25.Lists(rows.filter(is_list), ids)
            cosine = matrix(queries.column("vector")) @ matrix(documents.column("vector")).T
            names, tops, asked = (queries.column(c).to_pylist() for c in ("query_id", "top", "words"))
            for i, near in enumerate(cosine):
                keyword = lists.scores(asked[i] or ()) / (tops[i] or 1.0)
                found += _best_rows(names[i], ids, ranks, near, keyword, top_k)
        columns = zip(*found, strict=True) if found else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def searched(lefts: DataFrame, rights: DataFrame, top_k: int) -> DataFrame | None:
    """Fallback search for right rows whose key no left row has; None when there are none."""
    known = lefts.filter("key is not null").select("key").distinct()
    rest = checkpointed(rights.join(known, "key", "left_anti"))
    return None if rest.isEmpty() else fallback(lefts, rest, top_k)


def judged(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_columns,
    right_columns,
    top_k: int = 5,
    predict: Callable[[dict], object] | None = None,
    responses: DataFrame | None = None,
    batch_size: int = 5,
    max_tokens: int = 6000,
    system_prompt: str = "",
    **options,
) -> DataFrame:
    """BM25 candidates scored by a model: (candidate index, confidence, reason).

    ``responses`` is (row_id, response) with one JSON object per right row.
    """
    corpus = build_corpus(left, left_id, left_columns)
    described = [
        F.when(strip(cell_text(right, c)) != "", F.concat(F.lit(f"{c}: "), cell_text(right, c)))
        for c in right_columns
    ]
    if "filename" in right.columns and "filename" not in right_columns:
        described.insert(0, F.concat(F.lit("filename: "), col("filename")))
    cells = [F.when(strip(cell_text(right, c)) != "", cell_text(right, c)) for c in right_columns]
    queries = right.select(
        col(right_id).alias("query_id"), F.concat_ws(" ", *cells).alias("query"),
        F.concat_ws("\n", *described).alias("description"),
    )
    hits = bm25.search(queries, corpus, top_k).withColumn("index", F.col("rank") - 1)
    if responses is None:
        lines = [
            F.when(strip(cell_text(left, c)) != "", F.concat(F.lit(f"{c}: "), cell_text(left, c)))
            for c in left_columns
        ]
        records = left.select(col(left_id).alias("doc_id"), F.concat_ws(" | ", *lines).alias("line"))
        line = F.concat(F.lit("[C"), F.col("index").cast("string"), F.lit("] "), "line")
        listed = hits.join(records, "doc_id").groupBy("query_id").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))), lambda x: x["l"]),
                "\n",
            ).alias("candidates")
        )
        prompts = queries.join(listed, "query_id").select(
            "query_id",
            F.concat("description", F.lit("\nCandidates:\n"), "candidates").alias("prompt"),
        )
        requests, members = pack_requests(prompts, "query_id", "prompt", batch_size, max_tokens, title="Image")
        requests = requests.withColumn("system", F.lit(system_prompt))
        answered = ask(requests, predict, keep=["batch_id", "size"], **options)
        parsed = unpack_results(parse_responses(answered), members, index_key="image_index")
    else:
        parsed = parse_responses(responses).select("row_id", "json")
    matches = F.from_json(
        F.to_json(member(F.col("json"), "matches")),
        "array<struct<candidate_index: string, confidence: string, reason: string>>",
    )
    one = parsed.select(F.col("row_id").alias("query_id"), F.posexplode(matches).alias("_pos", "m"))
    chosen = one.select(
        "query_id", "_pos",
        F.coalesce(F.col("m.candidate_index").try_cast("double"), F.lit(-1.0)).cast("int").alias("index"),
        F.coalesce(F.col("m.confidence").try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce("m.reason", F.lit("")).alias("reason"),
    )
    return chosen.join(hits.select("query_id", "index", "doc_id"), ["query_id", "index"]).select(
        F.col("query_id").alias("right_id"), F.col("doc_id").alias("left_id"), "score", "reason",
        F.lit(False).alias("cut"),
    )


def match_columns(df: DataFrame, columns, side: str) -> list[str]:
    known = [c for c in as_list(columns) if c in df.columns]
    if not known:
        raise ValueError(f"none of the {side} match columns found: {columns}")
    return known
