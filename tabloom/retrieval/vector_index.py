"""Exact nearest vectors by dot product over vectors laid out by cluster; clusters out of reach are skipped.

For a query q, a cluster with centre c and radius r (the largest distance of a member from c) holds no product above
q·c + |q| r. A query first visits the clusters nearest to it until they hold ``top_k`` vectors; the k-th best product found
there is what every further cluster has to reach by its bound. Nothing is lost: where vectors have no clusters, all are visited.

Centres come from a sample of at most four rows a cluster (``SAMPLE_BYTES`` in all); every row is indexed. What travels to all
tasks is one centre, radius and count for each of at most ``MOST_CLUSTERS`` clusters. Rows of a cluster lie in pieces of
``BLOCK_ROWS``, and pieces in spans of ``SPAN_BYTES``; a query travels once to each span that holds one of its clusters, with
their list, and a span meets queries in parts of ``QUERY_BYTES``. So neither a large cluster nor a popular one fills a task, and
what is shuffled and reported follows the spans, not the clusters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.retrieval.bm25 import TIE_DIGITS, keep_top
from tabloom.retrieval.vectors import _matrix, top_positions
from tabloom.session import checkpointed, work_partitions

PER_CLUSTER = 2048
MOST_CLUSTERS = 4096
SAMPLE_BYTES = 32 * 1024 * 1024
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
#: Vectors of a span, and of the queries that meet it in one task; a part has ``QUERY_ROWS`` or more, fewer than these bytes
#: only where there would be too few tasks otherwise. Products of a task at a time.
SPAN_BYTES, QUERY_BYTES, PRODUCTS = 64 << 20, 32 << 20, 1 << 22
_HASHES = 1 << 30


def _centres(sample: np.ndarray, clusters: int, rounds: int = 4) -> np.ndarray:
    """A few rounds of means; a centre that loses all its rows stays where it was."""
    centres = sample[np.linspace(0, len(sample) - 1, min(clusters, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres * centres).sum(1) / 2, axis=1)


@dataclass
class VectorIndex:
    """``documents``: (cluster, piece, doc_id, vector); ``counts`` and ``radii`` are by cluster."""

    documents: DataFrame
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray

    def pieces(self) -> np.ndarray:
        return np.maximum(1, -(-self.counts // BLOCK_ROWS))


def build(documents: DataFrame, per_cluster: int = PER_CLUSTER) -> VectorIndex:
    """Index all rows of (doc_id, vector) whose vector is not null. An empty table gives an index without clusters."""
    # Read for the sample and for the layout: an embedding column must not run twice.
    rows = checkpointed(documents.select("doc_id", "vector").filter("vector is not null"))
    n = rows.count()
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, vector {kinds['vector']}, cluster int, distance double"
    if not n:
        empty = rows.withColumns({"cluster": F.lit(0), "piece": F.lit(0)})
        return VectorIndex(empty, np.zeros((0, 1)), np.zeros(0, int), np.zeros(0))
    width = rows.select(F.size("vector")).first()[0]
    most = max(4, SAMPLE_BYTES // (8 * max(1, width)))
    clusters = max(1, min(-(-n // per_cluster), MOST_CLUSTERS, most // 4))
    share = min(_HASHES, -(-4 * clusters * _HASHES // n))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)) < share).select("vector").collect()
    sample = _matrix([r[0] for r in picked] or [rows.select("vector").first()[0]])
    centres = _centres(sample, clusters)

    def assign(batches):
        for batch in batches:
            if len(batch):
                matrix = _matrix(batch["vector"])
                own = _nearest(matrix, centres)
                yield batch.assign(cluster=own.astype("int32"), distance=np.linalg.norm(matrix - centres[own], axis=1))

    laid = checkpointed(rows.mapInPandas(assign, schema))
    stats = laid.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    counts, radii = np.zeros(len(centres), int), np.zeros(len(centres))
    for r in stats:
        counts[r["cluster"]], radii[r["cluster"]] = r["n"], r["radius"]
    index = VectorIndex(laid, centres, counts, radii)
    index.documents = laid.withColumn("piece", _piece("doc_id", index.pieces())).drop("distance")
    return index


def _piece(row_id: str, pieces: np.ndarray):
    """Piece of a row within its cluster, by a hash of its id."""
    per_cluster = F.array(*[F.lit(int(p)) for p in pieces]) if len(set(pieces.tolist())) > 1 else None
    own = F.element_at(per_cluster, F.col("cluster") + 1) if per_cluster is not None else F.lit(int(pieces[0]))
    return F.pmod(F.xxhash64(row_id), own).cast("int")


def first_route(queries: DataFrame, index: VectorIndex, top_k: int) -> DataFrame:
    """(query_id, vector, clusters): the nearest clusters of each query that together hold ``top_k`` vectors."""
    centres, counts = index.centres, index.counts

    def choose(products: np.ndarray, _) -> list[list[int]]:
        order = np.argsort(-products, axis=1, kind="stable")
        full = np.cumsum(counts[order], axis=1) >= top_k
        ends = np.where(full.any(1), full.argmax(1), len(counts) - 1)
        return [o[: e + 1].tolist() for o, e in zip(order, ends)]

    return _routed(queries.select("query_id", "vector"), centres, choose)


def further_route(looked: DataFrame, index: VectorIndex) -> DataFrame:
    """(query_id, vector, clusters): those not visited yet whose bound reaches the product ``least`` of the query."""
    centres, counts, radii = index.centres, index.counts, index.radii

    def choose(products: np.ndarray, batch: pd.DataFrame) -> list[list[int]]:
        lengths = np.linalg.norm(_matrix(batch["vector"]), axis=1)
        # Room for the rounding of scores and of the sums behind the bound.
        room = 10.0**-TIE_DIGITS + 1e-9 * (np.abs(products) + lengths[:, None] * radii)
        wanted = (products + lengths[:, None] * radii + room >= batch["least"].to_numpy()[:, None]) & (counts > 0)
        for row, seen in enumerate(batch["clusters"]):
            wanted[row, np.asarray(seen, int)] = False
        return [np.flatnonzero(w).tolist() for w in wanted]

    return _routed(looked.select("query_id", "vector", "clusters", "least"), centres, choose)


def _routed(queries: DataFrame, centres: np.ndarray, choose) -> DataFrame:
    kinds = dict(queries.dtypes)

    def route(batches):
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                found = choose(_matrix(part["vector"]) @ centres.T, part)
                yield part[["query_id", "vector"]].assign(clusters=found)

    return queries.mapInPandas(route, f"query_id {kinds['query_id']}, vector {kinds['vector']}, clusters array<int>")


def _visited_top(a: pd.DataFrame, b: pd.DataFrame, known: np.ndarray, top_k: int) -> pd.DataFrame:
    """Best documents of a span, whose clusters are ``known``, for each query among those it is sent to, ties by document id."""
    b = b.sort_values("doc_id", kind="stable", ignore_index=True)
    doc_ids, matrix = b["doc_id"].to_numpy(), _matrix(b["vector"])
    own = np.searchsorted(known, b["cluster"].to_numpy())
    bits = np.frombuffer(b"".join(a["clusters"]), np.uint8).reshape(len(a), -1)
    wanted = np.unpackbits(bits, axis=1, count=len(known)).astype(bool)
    # Queries of like clusters go together, and documents that none of them is sent to are left out.
    order = np.argsort(wanted.argmax(1), kind="stable")
    query_ids, queries = a["query_id"].to_numpy(), _matrix(a["vector"])
    step = max(1, PRODUCTS // max(1, len(b)))
    found = []
    for start in range(0, len(a), step):
        some = order[start : start + step]
        docs = np.flatnonzero(wanted[some].any(0)[own])
        product = (queries[some] @ matrix[docs].T).round(TIE_DIGITS)
        product[~wanted[some][:, own[docs]]] = -np.inf
        for row, line in zip(some, product):
            chosen = top_positions(line, top_k)
            chosen = chosen[line[chosen] > -np.inf]
            found.append((np.repeat(query_ids[row], len(chosen)), doc_ids[docs[chosen]], line[chosen]))
    return pd.DataFrame({name: np.concatenate(column) for name, column in zip(("query_id", "doc_id", "score"), zip(*found))})


def visit(routed: DataFrame, index: VectorIndex, top_k: int) -> DataFrame:
    """(query_id, doc_id, score): the best of each span of the clusters that a query is sent to."""
    kinds = dict(routed.dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {dict(index.documents.dtypes)['doc_id']}, score double"
    spark = routed.sparkSession
    pieces = index.pieces()
    cluster = np.repeat(np.arange(len(pieces)), pieces)
    piece = np.concatenate([np.arange(p) for p in pieces]) if len(pieces) else cluster
    width = 8 * max(1, index.centres.shape[1])
    rows = np.cumsum((index.counts / pieces)[cluster])
    span = (np.maximum(rows - 1, 0) // max(1, SPAN_BYTES // width)).astype(int)
    known = {s: np.unique(cluster[span == s]) for s in np.unique(span).tolist()}

    def send(batches):
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                asked = np.zeros((len(part), len(pieces)), bool)
                for row, clusters in enumerate(part["clusters"]):
                    asked[row, np.asarray(clusters, int)] = True
                for s, own in known.items():
                    at = np.flatnonzero(asked[:, own].any(1))
                    if len(at):
                        bits = np.packbits(asked[np.ix_(at, own)], axis=1)
                        yield part[["query_id", "vector"]].iloc[at].assign(span=s, clusters=[b.tobytes() for b in bits])

    sent = routed.mapInPandas(send, f"query_id {kinds['query_id']}, vector {kinds['vector']}, span int, clusters binary")
    sent = checkpointed(sent)
    asked = {r["span"]: r["n"] for r in sent.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], schema)
    # Parts are as large as memory allows, since each takes a copy of its span, but there are some for each core.
    fair = -(-sum(asked.values()) // (2 * spark.sparkContext.defaultParallelism))
    most = max(1, min(max(QUERY_ROWS, fair), max(QUERY_ROWS, QUERY_BYTES // width)))
    # At most one row for each piece of a cluster.
    plan = F.broadcast(spark.createDataFrame(
        [(int(c), int(p), int(s), -(-asked[s] // most)) for c, p, s in zip(cluster, piece, span.tolist()) if s in asked],
        "cluster int, piece int, span int, parts int"))
    parts = F.broadcast(spark.createDataFrame([(s, -(-n // most)) for s, n in asked.items()], "span int, parts int"))
    one = sent.join(parts, "span").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).drop("parts")
    two = index.documents.join(plan, ["cluster", "piece"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "piece")
    tasks = max(work_partitions(spark), 2 * sum(-(-n // most) for n in asked.values()))
    one, two = one.repartition(tasks, "span", "part"), two.repartition(tasks, "span", "part")

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        return _visited_top(a, b, known[int(a["span"].iloc[0])], top_k)

    return one.groupBy("span", "part").cogroup(two.groupBy("span", "part")).applyInPandas(multiply, schema)


def search(queries: DataFrame, index: VectorIndex, top_k: int = 10) -> DataFrame:
    """Exact top documents per query: (query_id, doc_id, score, rank), ties by document id, products above 0 only.

    Query ids are distinct. Queries without a vector find nothing.
    """
    found = candidates(queries, index, top_k)[0]
    return keep_top(found, top_k)


def candidates(queries: DataFrame, index: VectorIndex, top_k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What both visits found, and both routes (for the share of vectors that were skipped)."""
    queries = queries.filter("vector is not null").select("query_id", "vector")
    if not len(index.counts):
        none = queries.limit(0).withColumn("clusters", F.array().cast("array<int>"))
        return visit(none, index, top_k), none, none
    near = checkpointed(first_route(queries, index, top_k))
    first = checkpointed(keep_top(visit(near, index, top_k), top_k))
    # Products of 0 and less are never reported, so no cluster needs to reach below 0.
    least = first.filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
    looked = near.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    far = checkpointed(further_route(looked, index).filter(F.size("clusters") > 0))
    found = first.drop("rank").unionByName(visit(far, index, top_k))
    return found, near, far
