"""Approximate nearest neighbours by an inverted multi-index over the two halves of a vector.

Each half is quantised on its own; a cell is a pair of centroids. For a query, pairs are popped from
a heap in the order of their summed nearness (here: inner products with the two centroids) until the cells
seen hold enough vectors; all vectors in them are reranked by the exact measure in double precision.
As pairs come in falling order, the cells seen are those whose sum reaches the last one popped: a query
carries that one number and not a list of cells.

Cells are laid out in order and cut into spans of bounded size, one to a task; a query goes once to each span that holds
cells it has seen, and there through blocks of the span with its best so far, so that only the best of a span leave
the task. Equal vectors are one entry with their smallest ids, as many as a result can show, so that a
vector that a third of all rows hold is one entry too. What the seen cells must hold is a share of the index, and the
cells grow with the square root of its entries, the sample for the codebook with its centroids; only these and the
sizes of the cells (at most the square of the centroids) pass through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import runs, sample_by_hash, sound_vector, spread, stored, vector_matrix

#: For up to EVEN entries; more have centroids by the fourth root, so that cells grow by the square root.
CENTROIDS = 128
EVEN = 51_200
SAMPLE = 20_000
#: Entries that the cells seen by a query must hold: this share of the index, and CANDIDATES at least. Vectors spread evenly
#: in 64 dimensions need about half of a small index, and less of a larger one; those in fewer dimensions need less.
SHARE = 0.5
CANDIDATES = 24_000
#: Entries and queries that are multiplied at a time.
BLOCK = 4096
_CHUNK = 512
#: Vectors of a span, and of the queries that meet it in one task, in bytes at the most (in double precision).
SPAN_BYTES = 32 << 20
#: Pairs of query and entry whose exact products are taken at a time.
_PAIRS = 16_384
_RESULT = "query_id long, rank int, vec_id long, score double"


def fit_half(sample: np.ndarray, centroids: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly chosen distinct starting points."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(centroids, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c**2).sum(1)
    parts = [(size - 2 * (x[at : at + BLOCK] @ c.T)).argmin(1) for at in range(0, len(x), BLOCK)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def budget(entries: int) -> tuple[int, int, int]:
    """Centroids a half, candidates a query and vectors to fit on for an index of that many entries."""
    centroids = int(CENTROIDS * max(1.0, entries / EVEN) ** 0.25)
    return centroids, max(CANDIDATES, int(SHARE * entries)), SAMPLE * centroids // CENTROIDS


def last_sum(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> float:
    """Pop centroid pairs by falling a[i] + b[j] until their cells hold ``enough`` entries; the last sum.
    Minus infinity when all cells were popped. Where most pairs would be popped, they are sorted at once: a heap takes
    many times as long for the same order."""
    if enough * 16 > counts.sum():
        sums = (a[:, None] + b).ravel()
        order = np.argsort(-sums)
        held = np.cumsum(counts.ravel()[order])
        place = int(np.searchsorted(held, enough))
        return float(sums[order[place]]) if place < len(held) else float("-inf")
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y = a[first].tolist(), b[second].tolist()
    held = counts[np.ix_(first, second)].tolist()
    heap, done, found = [(-(x[0] + y[0]), 0, 0)], [0] * len(x), 0
    while heap:
        total, i, j = heapq.heappop(heap)
        found += held[i][j]
        if found >= enough:
            return -total
        done[i] = j + 1
        # a pair enters the heap when both its predecessors have left it
        if i + 1 < len(x) and done[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
    return float("-inf")


def _slack(score: np.ndarray) -> np.ndarray:
    """A bound that no rounding of a product crosses; the lowest number for none."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(score), score - 1e-9 * (1 + np.abs(score)), np.finfo(float).min)


class _Best:
    """The k best of each query of a chunk: exact products, falling, ties to the smaller id; -inf where fewer were seen."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, near: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Entries of a block by their products ``near``, -inf for entries not seen."""
        low = _slack(self.scores[:, -1])
        short = np.flatnonzero(np.isneginf(self.scores[:, -1]))
        if len(short) and near.shape[1] > self.k:
            low[short] = _slack(np.partition(near[short], -self.k, axis=1)[:, -self.k])
        rows, places = np.nonzero(near >= low[:, None])
        if not len(rows):
            return
        exact = np.concatenate([
            (x[places[at : at + _PAIRS]] * self.queries[rows[at : at + _PAIRS]]).sum(1) for at in range(0, len(rows), _PAIRS)
        ])
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), rows])
        scores, ids = np.concatenate([self.scores.ravel(), exact]), np.concatenate([self.ids.ravel(), ids[places]])
        order = np.lexsort((ids, -scores, rows))
        n = np.bincount(rows, minlength=len(self.ids))
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < self.k]
        self.scores, self.ids = scores[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)


def laid_out(counts: np.ndarray, span_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each cell and the number of its spans: cells in order fill spans of at most ``span_rows`` entries, a
    larger cell gets spans of its own."""
    first, parts = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    span = filled = 0
    for c in np.flatnonzero(counts).tolist():
        n = int(counts[c])
        if filled and filled + n > span_rows:
            span, filled = span + 1, 0
        first[c], parts[c] = span, spread(n, span_rows)
        span, filled = span + int(parts[c]) - 1, (filled + n if parts[c] == 1 else span_rows)
    return first, parts


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(id, ids, vector): one row per distinct vector with its k + 1 smallest ids."""
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    numbered = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return numbered.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"),
        F.any_value("embedding").alias("vector"),
    ).drop("h1", "h2")


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, centroids: int | None = None, candidates: int | None = None,
    sample: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``.

    Nearness is the inner product. A query's own id is no candidate. Vectors that are null, empty, zero, or
    hold null or non-finite components, rows without id, and vectors of another length than most (the longer
    on a tie) take no part. Rows that share id and vector are one; a query id with several vectors gets the
    nearest of any of them. Ties go to the smaller id; where fewer candidates exist all are returned. Other columns are
    ignored; an empty table gives an empty result. ``centroids``, ``candidates`` and ``sample`` follow the number of
    distinct vectors (``budget``) where they are not given.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(
        sound_vector(v) & F.col("vec_id").isNotNull()
    )
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], _RESULT)
    dim = lengths["n"]
    rows = rows.where(F.size(v) == dim).select(
        "vec_id", F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"), v
    )
    entries = stored(_entries(rows.dropDuplicates(["vec_id", "h1", "h2"]), k))
    by_size = budget(entries.count())
    centroids, candidates, sample = (b if a is None else a for a, b in zip((centroids, candidates, sample), by_size))
    fitted = sample_by_hash(entries, sample, "id").select("vector").toArrow().column(0)
    points = vector_matrix(fitted)
    half = dim // 2
    books = [fit_half(points[:, :half], centroids), fit_half(points[:, half:], centroids)]
    return _reranked(spark, rows.where(F.col("vec_id") % every == 0), entries, books, dim, k, candidates)


def _reranked(
    spark: SparkSession, queries: DataFrame, entries: DataFrame, books: list[np.ndarray], dim: int, k: int, candidates: int
) -> DataFrame:
    half, wide = dim // 2, len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vector_matrix(batch.column(1))
            cell = nearest(x[:, :half], books[0]) * wide + nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32))], names=["id", "cell"])

    cells = stored(entries.select("id", "vector").mapInArrow(assign, "id long, cell int"))
    counts = np.zeros(len(books[0]) * wide, np.int64)
    sizes = cells.groupBy("cell").count().toArrow()
    counts[sizes.column("cell").to_numpy()] = sizes.column("count").to_numpy()
    n_queries, entries_n = queries.count(), int(counts.sum())
    # spans are large, because queries are copied to each, but there are some for each core
    cores, most = spark.sparkContext.defaultParallelism, max(BLOCK, SPAN_BYTES // (8 * dim))
    span_rows, sides = min(most, max(BLOCK, spread(entries_n, 3 * cores))), spread(n_queries, most)
    first, parts = laid_out(counts, span_rows)
    spans = int((first + parts).max())
    table = spark.sparkContext.broadcast((books, counts.reshape(-1, wide), first, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts, first, parts = table.value
        full = np.flatnonzero(counts.ravel())
        last = first + parts - 1
        for whole in batches:
            for batch in (whole.slice(start, _CHUNK) for start in range(0, len(whole), _CHUNK)):
                x = vector_matrix(batch.column(1))
                a, b = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
                low = np.array([last_sum(a[r], b[r], counts, candidates) for r in range(len(x))])
                low = np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(low)), low)
                at, to = [], []
                for r in range(len(x)):
                    seen = full[(a[r][:, None] + b[r]).ravel()[full] >= low[r]]
                    # spans of the cells seen: of each cell the first and the last, and all between
                    edges = np.zeros(int(last.max()) + 2, np.int64)
                    np.add.at(edges, first[seen], 1)
                    np.add.at(edges, last[seen] + 1, -1)
                    spans = np.flatnonzero(np.cumsum(edges))
                    at.append(np.full(len(spans), r))
                    to.append(spans)
                at, to = np.concatenate(at), np.concatenate(to).astype(np.int32)
                for start in range(0, len(at), BLOCK):
                    part = pa.array(at[start : start + BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(to[start : start + BLOCK]), batch.column(0).take(part),
                            pa.array(low[at[start : start + BLOCK]]), batch.column(1).take(part),
                        ],
                        names=["span", "id", "least", "vector"],
                    )

    kind = queries.schema["embedding"].dataType.simpleString()
    seekers = queries.select("vec_id", "embedding").mapInArrow(deal, f"span int, id long, least double, vector {kind}")
    full = np.flatnonzero(counts).astype(np.int32)
    layout = spark.createDataFrame(pa.table({"cell": full, "first": first[full], "parts": parts[full]}))
    members = cells.join(F.broadcast(layout), "cell").join(entries.select("id", "vector"), "id")
    members = members.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    columns = ["span", "side", "role", "id", "cell", "least", "vector"]
    dealt = members.select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("span"), "side",
        F.lit(0).cast("byte").alias("role"), "id", "cell", F.lit(None).cast("double").alias("least"), "vector",
    ).unionByName(
        seekers.withColumn("side", F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"))
        .withColumn("role", F.lit(1).cast("byte")).withColumn("cell", F.lit(None).cast("int")).select(columns)
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = table.value[0]
        for group in runs(batches, 2):
            role = group.column("role").to_numpy()
            m = int(np.searchsorted(role, 1))
            if m in (0, len(role)):
                continue
            ids, vectors = group.column("id").to_numpy(), group.column("vector")
            cell, least = group.column("cell").slice(0, m).to_numpy(), group.column("least").slice(m).to_numpy()
            x = vector_matrix(vectors.slice(0, m))
            blocks = [(at, *np.unique(cell[at : at + BLOCK], return_inverse=True)) for at in range(0, m, BLOCK)]
            for start in range(m, len(role), _CHUNK):
                q = vector_matrix(vectors.slice(start, _CHUNK))
                a, b = q[:, :half] @ books[0].T, q[:, half:] @ books[1].T
                low, best = least[start - m : start - m + len(q), None], _Best(q, k + 1)
                for at, own, place in blocks:
                    seen = a[:, own // wide] + b[:, own % wide] >= low
                    if seen.any():
                        near = q @ x[at : at + BLOCK].T
                        best.add(np.where(seen[:, place] & np.isfinite(near), near, -np.inf), ids[at : min(at + BLOCK, m)], x[at : at + BLOCK])
                found = np.isfinite(best.scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[start : start + len(q)], found.sum(1))), pa.array(best.ids[found]),
                        pa.array(best.scores[found]),
                    ],
                    names=["query_id", "id", "score"],
                )

    groups = dealt.repartition(max(cores, spans * sides), "span", "side")
    grouped = groups.sortWithinPartitions("span", "side", "role", "cell", "id")
    found = grouped.mapInArrow(rerank, "query_id long, id long, score double")
    by_entry = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= k + 1)
    opened = best.join(entries.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    opened = opened.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = opened.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
