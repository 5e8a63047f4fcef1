"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Shingle hashes lie in the universe [0, 2**32). One permutation, ``sigma``, shuffles it; a second,
``pi``, is shifted circularly by k to give the k-th hash function, so coordinate k of a signature is
``min(pi(sigma(x) - k))``. Both are invertible mixers, so no table of the universe is needed.
Bands of a signature are buckets.

Documents with the same set of shingles form one class and go on as one representative. Within a
bucket no pairs are listed: every member is compared with one hub, for a few hubs in turn, which
joins nearly every group; only buckets that still hold several components go on, cut into blocks, and
each pair of blocks tests its pairs of different components and reports links that join two. So no
component is missed that any pair of a bucket would join, and nothing grows with the square of a group
whose members are alike. All links are confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Remembered, stored, tidy
from tabloom.llm.components import components

ROWS = 5
#: Chance that a pair just at the threshold shares no band.
MISSED = 1e-4
HUB_ROUNDS = 3
#: Members of a bucket compared within one block.
BLOCK = 256
_CHUNK = 2048


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest)


def shingle_hashes(text: str | None, k: int, hashes: Remembered) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; all words as one when there are fewer. ``hashes`` gives a word's."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, min(k, len(h))):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: ``size`` coordinates from two permutations of [0, 2**32)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    shifts = np.arange(1, size + 1, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), _CHUNK):
        m = x[start : start + _CHUNK, None] - shifts
        other = m >> np.uint32(16)
        m ^= other
        m *= np.uint32(0x85EBCA6B)
        np.right_shift(m, np.uint32(13), out=other)
        m ^= other
        m *= np.uint32(0xC2B2AE35)
        np.minimum(least, m.min(0), out=least)
    return least


def band_count(share: float, rows: int = ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log(1 - share**rows))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, high and low (digest of the set), bands (one bucket number each, none without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64()))])
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for text in batch.column(1):
                own = shingle_hashes(text.as_py(), k, hashes)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                n.append(len(own))
                high.append(int.from_bytes(digest[:8], "big", signed=True))
                low.append(int.from_bytes(digest[8:], "big", signed=True))
                if not len(own):
                    keys.append([])
                    continue
                parts = signature(own, bands * rows).reshape(bands, rows).astype(np.uint64)
                bucket = salt.copy()
                for j in range(rows):
                    bucket ^= bucket >> np.uint64(29)
                    bucket *= np.uint64(0x9E3779B97F4A7C15)
                    bucket += parts[:, j]
                bucket ^= bucket >> np.uint64(32)
                bucket *= np.uint64(0xBF58476D1CE4E5B9)
                keys.append(_signed(bucket))
            columns = [batch.column(0), n, high, low, keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, high long, low long, bands array<long>"
    )


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles as sorted little-endian 64-bit numbers) of the documents in ``ids``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            own = [shingle_hashes(t.as_py(), k, hashes) for t in batch.column(1)]
            columns = [batch.column(0), [len(x) for x in own], [x.tobytes() for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return wanted.mapInArrow(cut, "id long, n long, shingles binary").where("n > 0")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * shared >= num * union. Each pair carries the two sets and nothing else."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    sizes = sets.select("id", "n")
    fit = (
        pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m_a")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("m_b")), "b")
        .where(den * F.least("m_a", "m_b") >= num * F.greatest("m_a", "m_b")).select("a", "b")
    )

    @F.pandas_udf("boolean")
    def alike(s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(s_a, s_b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = _shared(x, y)
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return fit.join(left, "a").join(right, "b").where(alike("s_a", "s_b")).select("a", "b")


def _hub(t: int) -> Column:
    return F.min("id") if t == 0 else F.min_by("id", F.xxhash64("id", F.lit(t)))


def _mixed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (key, id, root) of the buckets that still hold several components."""
    known = entries.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("root", F.coalesce("root", "id"))
    several = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return known.join(several, "key")


def _block_links(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of a bucket, from tasks over two blocks of it at a time."""
    counts = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    dealt = (
        mixed.join(counts, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root")
        .join(sets, "id")
    )

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        root = {r: r for r in pdf["root"]}

        def find(r: int) -> int:
            while root[r] != r:
                root[r] = root[root[r]]
                r = root[r]
            return r

        n, ids, roots = pdf["n"].tolist(), pdf["id"].tolist(), pdf["root"].tolist()
        sets_ = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        links = []
        for x in range(len(n)):
            for y in range(x + 1, len(n)):
                if den * n[x] < num * n[y]:
                    break
                p, q = find(roots[x]), find(roots[y])
                if p == q:
                    continue
                both = _shared(sets_[x], sets_[y])
                if den * both >= num * (n[x] + n[y] - both):
                    root[max(p, q)] = min(p, q)
                    links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("key", "i", "j").applyInPandas(test, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when den * shared >= num * union holds for their sets of k-word shingles; component_id is the
    smallest doc_id reachable. Texts without words (null, empty, white space) link with nothing. Rows that share an
    id count as one document, linked if any of its rows is; a row without id keeps a null component and is kept.
    Other columns of ``docs`` are ignored; an empty table gives an empty result; texts are read whole.
    """
    signed = stored(signatures(docs, k, band_count(num / den)))
    classes = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("high", "low")
        .agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"))
    )
    buckets = classes.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    entries = stored(buckets.join(shared, "key").select("key", "id"))
    sets = stored(_sets(docs, entries.select("id").distinct(), k))
    links = None
    left = entries.withColumn("root", F.col("id"))
    for t in range(HUB_ROUNDS):
        hubs = left.groupBy("key").agg(_hub(t).alias("hub"))
        roots_of = left.select("key", F.col("id").alias("hub"), F.col("root").alias("hub_root"))
        pairs = left.join(hubs.join(roots_of, ["key", "hub"]), "key").where("root <> hub_root")
        pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        found = stored(_confirmed(pairs, sets, num, den))
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        left = stored(_mixed(left, roots))
        if left.isEmpty():
            break
    else:
        links = links.unionByName(stored(_block_links(left, sets, num, den)))
        roots = components(links)
    of_class = classes.select("high", "low", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "high", "low", F.coalesce("root", "id").alias("component_id")
    )
    joined = signed.select("doc_id", "n_shingles", "high", "low").join(of_class, ["high", "low"], "left")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return joined.select(
        "doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce(own, "doc_id"), F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near-duplicates; columns as in ``docs``. A row without id stays, and of
    rows that share an id, each stays if the id does."""
    gone = near_duplicates(docs, k, num, den).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
