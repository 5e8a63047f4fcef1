"""Importance resampling of documents toward the distribution of target texts, over hashed n-grams.

A document is normalised once: A-Z lower-cased, everything but digits, letters and characters beyond ASCII blank, runs of
blanks one space. The scan keeps the running CRC-32 at the end of every word, and nothing else is read again: CRCs are
linear over GF(2), so the checksum of any run of words is the running one at its end with the one before its start,
moved on by the run's length in zero bytes, cancelled out of it. Moving on by a length is a product of matrices for
its binary digits, held as tables and applied to whole arrays.

Buckets are the checksums modulo their number. Counts per bucket are summed in every task before the shuffle; the gains of
all buckets, a table of fixed size, are sent back to the documents. Documents are drawn by their mean gain plus Gumbel
noise from their id, the ``share`` highest without replacement. Noise and gains are bounded whole numbers, so the cut is found
in a histogram of scores, and only rows of one score are ordered against each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import in_portions, stored, text_bytes, tidy

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SALT = "2024:"
#: Bytes of text whose running checksums are held at a time.
PORTION = 4 << 20

_LETTERS = bytes(range(0x41, 0x5B))
_BLANKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NORMAL = bytes.maketrans(_LETTERS + _BLANKS, _LETTERS.lower() + b" " * len(_BLANKS))


def _byte_table() -> np.ndarray:
    """What one byte does to a checksum register (the reflected polynomial of zlib's CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


BYTE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as a table per byte of its argument."""
    out = tables[0][x & np.uint32(255)]
    for i in (1, 2, 3):
        out ^= tables[i][(x >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _zero_tables(digits: int = 32) -> list[np.ndarray]:
    """The maps that append 1, 2, 4, 8, ... zero bytes to a checksum."""
    places = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    maps = [BYTE[places & np.uint32(255)] ^ (places >> np.uint32(8))]
    while len(maps) < digits:
        maps.append(_apply(maps[-1], _apply(maps[-1], places)))
    return maps


ZEROS = _zero_tables()


def moved(checksums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums after ``lengths`` more zero bytes, without the register's initial and final inversion."""
    out = checksums.copy()
    for digit in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> digit) & 1)
        out[at] = _apply(ZEROS[digit], out[at])
    return out


def running(words: list[bytes]) -> list[int]:
    """The checksum of the normalised text, a space before each word, at the end of every word."""
    crc32, c = zlib.crc32, 0
    return [c := crc32(w, crc32(b" ", c)) for w in words]


def ngram_checksums(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, ..., ``longest``: the text number and the CRC-32 of every run of n words, in order."""
    words = [t.translate(NORMAL).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.array([c for own in words for c in running(own)], np.uint32)
    lengths = np.array([n for own in words for n in map(len, own)], np.int64)
    before = np.zeros_like(ends)
    before[1:] = ends[:-1]
    before[np.cumsum(sizes)[:-1][sizes[1:] > 0] if len(sizes) > 1 else []] = 0
    # one more space leads from the end of a word to the start of the next
    before = ~before
    before = ~(BYTE[(before ^ np.uint32(0x20)) & np.uint32(255)] ^ (before >> np.uint32(8)))
    upto = np.concatenate([[0], np.cumsum(lengths)])
    for n in range(1, longest + 1):
        starts = np.arange(max(0, len(ends) - n + 1))
        starts = starts[owner[starts] == owner[starts + n - 1]]
        span = upto[starts + n] - upto[starts] + (n - 1)
        yield owner[starts], ends[starts + n - 1] ^ moved(before[starts], span)


def features(docs: DataFrame, longest: int, buckets: int, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets): the bucket of every n-gram of a text, repeats included, as little-endian numbers of four
    bytes, or of two where that is enough."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_portions(batches, PORTION):
            texts = text_bytes(part.column(1))
            found = [*ngram_checksums(texts, longest)]
            n_words = np.bincount(found[0][0], minlength=len(texts))
            owner = np.concatenate([o for o, _ in found])
            values = (np.concatenate([c for _, c in found]) % np.uint32(buckets)).astype(kind)
            if longest > 1:
                values = values[np.argsort(owner, kind="stable")]
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            cells = [values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
            columns = [part.column(0), n_words, cells]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    own_id = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(own_id.alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        hashed, "doc_id long, n_words long, buckets binary"
    )


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row holds."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), kind), np.array([len(x) for x in cells], np.int64) // np.dtype(kind).itemsize


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds; a task sends one row per bucket at the most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = featured.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's target share to its source share, one added to every count."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, salt: str = SALT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    A null or empty text has no features and weight 0, as has one without words; texts are read whole. A null id has the
    noise of the empty text and comes last among equal scores. Rows that share an id are weighed and drawn one by one; equal
    rows take neighbouring ranks. Of ``target`` only ``text`` is read; without target texts all buckets are empty there. An
    empty ``docs`` gives an empty result. Other columns of both tables are ignored.
    """
    featured = stored(features(docs, longest, buckets))
    wanted = features(target, longest, buckets, id_col=None)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column(2), kind)
            ends = np.cumsum(sizes)
            upto = np.concatenate([[0], np.cumsum(gain[flat])])
            weight = (upto[ends] - upto[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight)], schema=schema)

    digits = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(
        featured.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
        .withColumn("score", F.col("weight") + noise)
    )
    return drawn(scored, F.col("n_words") >= least_words, percent)


def drawn(scored: DataFrame, may, percent: int) -> DataFrame:
    """Add ``rank`` to the ``percent`` of the rows that ``may`` be drawn with the highest scores.

    Scores are whole numbers between about -60,000 and 60,000 (gains are logarithms of 64-bit counts in thousandths, noise
    that of a 32-bit number), so their histogram is small whatever the table.
    """
    counts = {r["score"]: r["n"] for r in scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = percent * sum(counts.values()) // 100
    before, rows = 0, []
    for score in sorted(counts, reverse=True):
        if before >= take:
            break
        rows.append((score, before))
        before += counts[score]
    high = F.coalesce(may & (F.col("score") >= rows[-1][0]), F.lit(False)) if rows else F.lit(False)
    places = F.broadcast(scored.sparkSession.createDataFrame(rows, "score long, before long"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    place = F.col("before") + F.row_number().over(order)
    top = scored.where(high).join(places, "score").withColumn("rank", F.when(place <= take, place))
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return top.select(rest.columns).unionByName(rest)


def _sql() -> str:
    """The same over ``documents`` and ``benchmark``: checksums by half bytes, over distinct words (n-grams of one word)."""
    half = []
    for v in range(16):
        for _ in range(4):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        half.append(v)
    words = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    digit = "instr('0123456789ABCDEF', substr(h, {}, 1)) - 1"
    halves = f"flatten(list_transform(range(1, len(h) // 2 + 1), lambda i: [{digit.format('2 * i')}, {digit.format('2 * i - 1')}]))"
    step = f"xor(({half}::BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
own AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d), other AS (SELECT unnest(w) AS word FROM b),
hexed AS (SELECT word, hex(word) AS h FROM (SELECT word FROM own UNION SELECT word FROM other)),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform({halves}, lambda x: x::BIGINT), lambda c, x: {step}, 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM hexed),
s AS (SELECT bucket, count(*) AS n FROM own JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM other JOIN crc USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t),
gain AS MATERIALIZED (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + {BUCKETS}) / ((s.n + 1)::DOUBLE * (sums.t + {BUCKETS}))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {LEAST_WORDS}) THEN place END::BIGINT AS rank FROM ranked
"""


SQL = _sql()
