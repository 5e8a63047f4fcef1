"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice.

A unit vector is projected to eight dimensions, scaled, shifted and decoded to the nearest point of
E8; that point is its home cell. It also looks into the neighbouring cells that are nearest to it, of
the 240 points at minimal distance. Several tables with projections of their own raise the recall: at
the default setting a pair of cosine 0.9 is missed by one table with a chance of 0.38, by all eight with
one of 0.0005, and a pair of cosine 0.95 with less than 0.000001. Every pair found is verified by cosine
in double precision.

Equal vectors form one class with a count and go on once. A cell is cut into blocks of homes and blocks
of seekers, each pair of blocks being one bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import runs, sound_vector, stored, vector_matrix
from tabloom.llm.components import components

TABLES = 8
PROBES = 4
#: Length of the lattice's unit against distances of unit vectors in 64 dimensions.
SCALE = 5.0
BLOCK = 2048
_SEED = 20_240


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that all coordinates are whole."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the even points and the same moved by a half in all coordinates."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=64)
def _projection(table: int, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, table, dim])
    if dim >= 8:
        matrix = np.linalg.qr(rng.normal(size=(dim, 8)))[0] * np.sqrt(dim / 8)
    else:
        matrix = np.linalg.qr(rng.normal(size=(8, dim)))[0].T
    return matrix * (scale / np.sqrt(8)), rng.random(8)


def _names(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit number for each cell; points doubled, last axis 8."""
    out = np.full(points.shape[:-1], table * 4096 + dim, np.uint64)
    doubled = points.astype(np.int64).view(np.uint64)
    for i in range(8):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += doubled[..., i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out.view(np.int64)


def cells(units: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the cells it looks into besides."""
    matrix, shift = _projection(table, units.shape[1], scale)
    x = units @ matrix + shift
    home = decode(x)
    near = (x - home) @ minimal_vectors().T
    nearest = np.argpartition(-near, probes, axis=1)[:, :probes]
    doubled = home * 2
    return _names(doubled, table, units.shape[1]), _names(
        doubled[:, None, :] + minimal_vectors()[nearest], table, units.shape[1]
    )


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the hash of their vector, and one row (id, copies, vector) per distinct sound vector."""
    v = F.col("embedding")
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).withColumn(
        "ok", sound_vector(v) & F.col("vec_id").isNotNull()
    )
    marked = marked.withColumn("h1", F.when(F.col("ok"), F.xxhash64(F.lit(1), v))).withColumn(
        "h2", F.when(F.col("ok"), F.xxhash64(F.lit(2), v))
    )
    classes = marked.where("ok").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.any_value("embedding").alias("vector")
    )
    return marked.select("vec_id", "h1", "h2"), stored(classes)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by a power of two first, which is exact, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(classes: DataFrame, threshold: float, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(a, b), a < b, each once: distinct vectors found in one cell whose cosine reaches the threshold."""
    schema = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("id", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == dim))
                x = unit(vector_matrix(batch.column(1)))
                ids = batch.column(0).to_numpy()
                for table in range(tables):
                    home, look = cells(x, table, probes)
                    key = np.concatenate([home, home, look.ravel()])
                    role = np.repeat(np.array([0, 1, 2], np.int8), [len(x), len(x), look.size])
                    own = np.concatenate([ids, ids, np.repeat(ids, probes)])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(own)], schema=schema)

    entries = stored(classes.select("id", "vector").mapInArrow(place, "key long, role byte, id long"))
    home = F.col("role") == 0
    counts = entries.groupBy("key").agg(F.count_if(home).alias("homes"), F.count_if(~home).alias("seekers"))
    counts = counts.where("homes > 0 AND seekers > 1").select(
        "key", F.ceil(F.col("homes") / BLOCK).alias("h"), F.ceil(F.col("seekers") / BLOCK).alias("s")
    )
    own = F.pmod(F.xxhash64("id"), F.when(home, F.col("h")).otherwise(F.col("s")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(home, F.col("s")).otherwise(F.col("h")) - 1))
    dealt = (
        entries.join(counts, "key").withColumn("own", own).withColumn("other", others)
        .select(
            "key", F.when(home, F.col("own")).otherwise(F.col("other")).alias("hb"),
            F.when(home, F.col("other")).otherwise(F.col("own")).alias("sb"), "role", "id",
        )
        .join(classes.select("id", "vector"), "id").select("key", "hb", "sb", "role", "id", "vector")
    )
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, waiting = [], [], 0
        for group in runs(batches, 3):
            role, ids = group.column("role").to_numpy(), group.column("id").to_numpy()
            if role[0] != 0 or role[-1] == 0:
                continue
            x = unit(vector_matrix(group.column("vector")))
            h = np.searchsorted(role, 1)
            for start in range(h, len(x), BLOCK):
                s, t = np.nonzero(x[start : start + BLOCK] @ x[:h].T >= threshold)
                s += start
                a, b = ids[s], ids[t]
                keep = np.where(role[s] == 1, a < b, a != b)
                left.append(np.minimum(a, b)[keep])
                right.append(np.maximum(a, b)[keep])
                waiting += len(left[-1])
            if waiting > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=pair)
                left, right, waiting = [], [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=pair)

    parts = max(dealt.sparkSession.sparkContext.defaultParallelism, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = dealt.repartition(parts, "key", "hb", "sb").sortWithinPartitions("key", "hb", "sb", "role")
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without id, link with
    nothing. Vectors of different length never link. Equal vectors link with each other; rows that share id and
    vector are one. Ties do not occur: every pair found at or over the threshold counts. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows, classes = _classes(vectors)
    found = stored(links(classes, threshold, tables, probes))
    copies = classes.select("id", "copies")
    both = found.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        found.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    degree = both.join(copies.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("copies").alias("linked"))
    roots = components(found).withColumnRenamed("node", "id")
    per_class = (
        classes.select("h1", "h2", "id", "copies").join(degree, "id", "left").join(roots, "id", "left")
        .select(
            "h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        )
    )
    joined = rows.join(per_class, ["h1", "h2"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
