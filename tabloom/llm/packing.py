"""Pack tokenised documents into sequences of a fixed capacity by linear grouping.

Lengths are whole numbers up to the capacity, so the whole packing problem is a histogram
of at most ``capacity`` counts however many documents there are. The histogram is planned
on the driver; documents are only numbered within their length and looked up in the plan:

1. lengths over an eighth of the capacity are sorted and cut into groups of equal cardinality,
   each rounded up to the largest length in it;
2. configurations of these few rounded sizes are built one after the other: the largest size
   left, filled up to the capacity as well as a knapsack over the others allows, used as often
   as the counts permit;
3. actual lengths take the places of the rounded ones;
4. the short ones go, longest first, to the sequence with the least room that still takes them.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import spread, stored, tidy

CAPACITY = 1024
GROUPS = 128
#: Documents numbered together within one length.
PER_BUCKET = 20_000
#: Characters from which a text is encoded without a list of its ids.
LONG_TEXT = 1 << 20


class ByteBpe:
    """Token ids of a text, each text in one call: real texts hold so many rare words that looking words up one by one costs more."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers."""
        if len(text) > LONG_TEXT:  # four bytes a token; a list of numbers takes ten times that
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, ranks_path: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Cut every document's tokens (ids, then ``end_id``) into pieces of ``capacity``; only the first
    piece is shorter. Columns: doc_id, piece, start, length, ids_crc32 and, on request, ids."""
    path = ranks_path or default_ranks()
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py() or "") + end
                n = len(ids) // 4
                marks = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(marks, marks[1:])):
                    part = ids[4 * a : 4 * b]
                    row = (doc_id, piece, a, b - a, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").tolist()) if keep_ids else row)
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, kind)


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, Counter]]:
    """(times, {group: uses}) that place every item of the groups, sizes in falling order."""
    left, out = list(counts), []
    for head in range(len(sizes)):
        while left[head]:
            room = capacity - sizes[head]
            # last[r]: the group that first made the filling r reachable; used: how often it is in it
            last = np.full(room + 1, -1)
            last[0] = len(sizes)
            back = np.zeros(room + 1, int)
            for g in range(head, len(sizes)):
                size, free = sizes[g], left[g] - (g == head)
                if size > room or free <= 0:
                    continue
                known = np.flatnonzero(last >= 0)
                for k in range(1, min(free, room // size) + 1):
                    to = known + k * size
                    to = to[to <= room]
                    to = to[last[to] < 0]
                    last[to], back[to] = g, k
            fill, use = int(np.flatnonzero(last >= 0)[-1]), Counter({head: 1})
            while fill:
                g, k = int(last[fill]), int(back[fill])
                use[g] += k
                fill -= k * sizes[g]
            times = min(left[g] // k for g, k in use.items())
            for g, k in use.items():
                left[g] -= times * k
            out.append((times, use))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> pd.DataFrame:
    """Where the items of each length go: rows (length, rank, sequence, offset, items) say that the items
    numbered ``rank`` to ``rank + items`` of this length go, one each, to the sequences from ``sequence`` on."""
    rows: list[tuple[int, int, int, int, int]] = []
    numbered: dict[int, int] = defaultdict(int)
    room: dict[int, deque] = defaultdict(deque)  # room left -> runs (first sequence, sequences)
    opened = 0

    def put(length: int, items: int, sequence: int, offset: int) -> None:
        rows.append((length, numbered[length], sequence, offset, items))
        numbered[length] += items

    if full := histogram.get(capacity, 0):
        put(capacity, full, 0, 0)
        opened = full
    large = [s for s in sorted(histogram, reverse=True) if capacity // 8 < s < capacity and histogram[s]]
    total = sum(histogram[s] for s in large)
    queues: list[deque] = []
    per_group, free = max(1, -(-total // groups)), 0
    for s in large:
        items = histogram[s]
        while items:
            if not free:
                queues.append(deque())
                free = per_group
            n = min(items, free)
            queues[-1].append([s, n])
            items, free = items - n, free - n
    sizes, counts = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
    for times, use in _configurations(sizes, counts, capacity):
        runs = [(opened, times, 0)]  # first sequence, sequences, tokens placed
        opened += times
        for g, k in sorted(use.items()):
            for _ in range(k):
                grown = []
                for sequence, n, placed in runs:
                    while n:
                        s, have = queues[g][0]
                        m = min(n, have)
                        put(s, m, sequence, placed)
                        grown.append((sequence, m, placed + s))
                        sequence, n = sequence + m, n - m
                        queues[g][0][1] -= m
                        if not queues[g][0][1]:
                            queues[g].popleft()
                runs = grown
        for sequence, n, placed in runs:
            room[capacity - placed].append((sequence, n))
    for s in sorted((s for s in histogram if s <= capacity // 8), reverse=True):
        items = histogram[s]
        while items:
            r = next((r for r in range(s, capacity + 1) if room[r]), None)
            if r is None:
                n = -(-items // (capacity // s))
                room[capacity].append((opened, n))
                opened, r = opened + n, capacity
            sequence, n = room[r].popleft()
            m = min(items, n)
            put(s, m, sequence, capacity - r)
            if n > m:
                room[r].appendleft((sequence + m, n - m))
            room[r - s].append((sequence, m))
            items -= m
    out = pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset", "items"])
    return out.sort_values(["length", "rank"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``capacity`` tokens; other columns stay.

    Only the histogram of lengths (at most ``capacity`` rows) and the plan made from it, whose size
    depends on the capacity and not on the data, pass through the driver.
    """
    pieces = stored(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    placed = plan(counts, capacity, groups)
    buckets = spread(sum(counts.values()), PER_BUCKET)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    bases = bases.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_in"))
    lengths, ranks = placed["length"].to_numpy(np.int64), placed["rank"].to_numpy(np.int64)
    sequences, offsets = placed["sequence"].to_numpy(np.int64), placed["offset"].to_numpy(np.int64)
    step = int(max(counts.values(), default=0)) + 1
    starts = lengths * step + ranks

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy() * step + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - ranks[at], "offset": offsets[at]})

    return ranked.withColumn("_place", place("length", "_rank")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset"
    )


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``documents``; one row per piece.

    A null or empty text is the end token alone. Rows that share an id or a text are packed one by one; a null
    id stays null. Columns other than doc_id and text are ignored. An empty table gives an empty result. Any
    length of text is cut into whole sequences, nothing is left out.
    """
    return pack(token_pieces(docs, capacity, ranks_path=ranks_path, keep_ids=keep_ids), capacity)
