"""Written tables, word patterns and column helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters. ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends
    here, and a lost executor costs no more than the tasks it ran. The table goes with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """A function for ``mapInArrow`` whose worker, which later stages use again, gives freed memory back at the end of a
    partition: Arrow's pool and the C heap both keep what large batches needed."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


class Remembered(dict):
    """Results of a function of a word, kept for one partition. ``held`` bounds the bytes of words and results that are kept
    at a time (some 200 bytes of overhead each, included); words of over 64 bytes are not kept."""

    def __init__(self, of, held: int = 16 << 20):
        super().__init__()
        self.of, self.held, self.free = of, held, held

    def __missing__(self, word):
        value = self.of(word)
        if len(word) <= 64:
            self.free -= 264 + (len(value) if isinstance(value, bytes) else 0)
            if self.free < 0:
                self.clear()
                self.free = self.held
            self[word] = value
        return value


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_by_hash(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """About ``size`` rows of a written table, chosen by a hash of their keys: the same on every run, found without a
    sort, and not more than twice as many even where one key fills the table."""
    steps = 1 << 40
    share = min(1.0, size / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(steps)) < int(share * steps)).limit(2 * size)


def spread(n_rows: int, per_group: int) -> int:
    """How many groups ``n_rows`` are dealt to so that each stays near ``per_group`` rows."""
    return max(1, -(-n_rows // per_group))


def runs(batches, keys: int):
    """Cut sorted record batches into tables of equal values in the first ``keys`` columns; a run may cross batches."""
    open_parts: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and open_parts:
                yield pa.Table.from_batches(open_parts)
                open_parts = []
            open_parts.append(batch.slice(a, b - a))
            last = key
    if open_parts:
        yield pa.Table.from_batches(open_parts)


def sound_vector(vector: Column) -> Column:
    """Neither null nor zero nor with a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_matrix(column) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls, in double precision."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def text_bytes(column) -> list[bytes]:
    """The cells of a string or binary column as bytes, null as none."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_portions(batches, size: int):
    """Slices of record batches whose second column, the text, holds about ``size`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(1)).to_pylist()], np.int64)
        first, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(batch):
            yield batch.slice(first)
