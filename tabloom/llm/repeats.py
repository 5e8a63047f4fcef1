"""Repeated passages over a corpus: a distributed, sampled enhanced suffix array.

Every string of ``least`` bytes has an anchor: the smallest of the hashes of its 40-byte substrings, the
leftmost on a tie. It depends on the string alone, so equal strings have equal anchors at the same place in
them, and consecutive strings of a text mostly share theirs. Suffixes are therefore sampled at anchors only.

1. Texts are cut into strings and anchors; anchors are dealt by their hash, and those met once are dropped.
2. The others are dealt back to their texts and fetch the bytes of all strings that have this anchor: up to
   ``least - 40`` before it and ``least`` from it on. Of anchors with equal bytes all round a task sends the earliest
   only; the others are repeats as they are.
3. Dealt by their hash again, the suffixes of one anchor are sorted, and the tree of their common-prefix intervals is
   scanned for maximal repeats. Each has all its occurrences; all but the earliest are repeats.
4. What is repeated goes back to the texts, which lose it.

Between tasks go packed blocks of anchors, bytes or spans, compressed, one for each target bucket, instead of a row
for each anchor. The number of buckets follows the number of input partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import runs, stored
from tabloom.llm.suffix_tree import maximal_repeats

LEAST = 100
ANCHOR = 40
#: Bytes hashed at a time; longer texts are cut into segments that overlap by ``least - 1``.
CHUNK = 1 << 20
FLUSH = 1 << 24
#: Of compression: what stands in the shuffle counts more than the time to press it.
LEVEL = 3
_NO_ID = -(2**63)
_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("data", pa.binary())])
_BLOCK_SQL = "bucket int, kind byte, n int, data binary"

_ANCHORS = np.dtype([("hash", "<u8"), ("row", "<i8"), ("at", "<i4"), ("before", "u1"), ("after", "u1")])
_SPANS = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])
_GROUPS = np.dtype([("group", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _suffixes(least: int) -> np.dtype:
    """An anchor with its document and bytes; before and after: how many of them count."""
    return np.dtype([*_ANCHORS.descr, ("doc", "<i8"), ("bytes", "u1", (2 * least - ANCHOR,))])


def _steps(records: np.ndarray, name: str) -> bytes:
    """The bytes of one field. Rows and documents mostly rise by little within a block, so they go as differences."""
    values = np.ascontiguousarray(records[name])
    return (np.diff(values, prepend=0) if name in ("row", "doc") else values).tobytes()


def _packed(records: np.ndarray, target: np.ndarray, kind: int, level: int = LEVEL) -> pa.RecordBatch:
    """Records as one compressed block per target bucket, field by field."""
    order = np.argsort(target, kind="stable")
    records, target = records[order], target[order]
    edges = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1).tolist(), len(target)]
    press = zstandard.ZstdCompressor(level=level)
    bucket, n, data = [], [], []
    for a, b in zip(edges, edges[1:]):
        if b > a:
            bucket.append(int(target[a]))
            n.append(b - a)
            data.append(press.compress(b"".join(_steps(records[a:b], name) for name in records.dtype.names)))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([kind] * len(n), pa.int8()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
        schema=_BLOCK,
    )


def _unpacked(data: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    raw, at = zstandard.ZstdDecompressor().decompress(data), 0
    out = np.empty(n, dtype)
    for name in dtype.names:
        kind = dtype[name]
        values = np.frombuffer(raw, kind.base, n * int(np.prod(kind.shape, dtype=int)), at).reshape(n, *kind.shape)
        out[name] = np.cumsum(values) if name in ("row", "doc") else values
        at += n * kind.itemsize
    return out


def _blocks(table: pa.Table, dtype: np.dtype, kind: int) -> np.ndarray:
    parts = [
        _unpacked(d, n, dtype)
        for k, n, d in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True)
        if k == kind
    ]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple] = {}


def _hash_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if n not in _tables:
        byte = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        _tables[n] = byte, _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    return _tables[n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def anchors(buffer: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``least`` bytes in segments laid end to end: hash, place in the buffer, and the
    first and last start of the strings that have it."""
    window = least - ANCHOR + 1
    n = len(buffer)
    if n < least:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    byte, up, down = _hash_tables(CHUNK + least)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[buffer] * up[:n], out=sums[1:])
    m = n - ANCHOR + 1
    hashes = _mixed((sums[ANCHOR:] - sums[:m]) * down[:m])
    keys = (hashes & ~np.uint64((1 << 21) - 1)) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = keys
    table = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - least + 1
    smallest = np.minimum(behind[:strings], ahead[window - 1 : window - 1 + strings])
    ends = np.cumsum(lengths)
    whole = np.zeros(strings, bool)
    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
        if b - a >= least:
            whole[a : b - least + 1] = True
    start = np.flatnonzero(whole)
    place = (smallest[start] & np.uint64((1 << 21) - 1)).astype(np.int64)
    if not len(start):
        return np.empty(0, np.uint64), place, start, start
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    at = place[new]
    return hashes[at] * np.uint64(_BASE), at, start[new], start[last]


def _segments(batch: pa.RecordBatch, least: int) -> Iterator[tuple[list, list, list]]:
    """Texts cut and gathered into chunks: (row, offset of the segment in its text), bytes."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - least + 1), CHUNK - least):
            part = data[at : at + CHUNK - 1]
            if len(part) < least:
                continue
            if size + len(part) > CHUNK:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row), offsets.append(at), parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _cut(buckets: int, least: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows, offsets, parts in _segments(batch, least):
                buffer, lengths = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
                hashes, at, first, last = anchors(buffer, lengths, least)
                starts = np.cumsum(lengths) - lengths
                segment = np.searchsorted(starts, at, "right") - 1
                out = np.empty(len(at), _ANCHORS)
                out["hash"], out["row"] = hashes, np.array(rows, np.int64)[segment]
                out["at"] = at - starts[segment] + np.array(offsets)[segment]
                out["before"], out["after"] = at - first, last + least - at
                held.append(out)
                size += len(buffer)
            if size > FLUSH:
                yield _by_hash(np.concatenate(held), buckets)
                held, size = [], 0
        if held:
            yield _by_hash(np.concatenate(held), buckets)

    return cut


def _by_hash(records: np.ndarray, buckets: int, kind: int = 0) -> pa.RecordBatch:
    return _packed(records, ((records["hash"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), kind)


def _by_row(records: np.ndarray, buckets: int, kind: int = 0) -> pa.RecordBatch:
    return _packed(records, (records["row"] % buckets).astype(np.int32), kind)


def _met_again(buckets: int) -> Callable:
    """Anchors whose hash is met more than once in its bucket. A bucket is read piece by piece: what stays are its
    distinct hashes, not their occurrences."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, size = None, 0
        met, once, held = np.empty(0, np.uint64), np.empty(0, _ANCHORS), []

        def sifted() -> Iterator[pa.RecordBatch]:
            nonlocal met, once
            found = np.concatenate([once, *held])
            order = np.argsort(found["hash"], kind="stable")
            h = found["hash"][order]
            same = np.concatenate([[False], h[1:] == h[:-1], [False]])
            again = same[1:] | same[:-1] | np.isin(h, met)
            met, once, found = np.union1d(met, h[again]), found[order[~again]], found[order[again]]
            if len(found):
                yield _by_row(found, buckets)

        for batch in batches:
            for b, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "data")), strict=True):
                if b != bucket:
                    if held:
                        yield from sifted()
                    bucket, size = b, 0
                    met, once, held = np.empty(0, np.uint64), np.empty(0, _ANCHORS), []
                held.append(_unpacked(data, n, _ANCHORS))
                size += held[-1].nbytes
                if size > max(4 * FLUSH, once.nbytes + met.nbytes):
                    yield from sifted()
                    held, size = [], 0
        if held:
            yield from sifted()

    return keep


def _texts(numbered: DataFrame, buckets: int) -> DataFrame:
    """Texts in compressed blocks of kind 1 by the bucket of their row: rows, documents, lengths, bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            target = rows % buckets
            order = np.argsort(target, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(target[order])) + 1).tolist(), len(order)]
            texts = batch.column(1)
            bucket, n, data = [], [], []
            for a, b in zip(edges, edges[1:]):
                own = order[a:b]
                if not len(own):
                    continue
                parts = [(texts[i].as_py() or "").encode("utf-8", "surrogatepass") for i in own.tolist()]
                head = rows[own].astype("<i8").tobytes() + docs[own].astype("<i8").tobytes()
                head += np.array([len(p) for p in parts], "<i8").tobytes()
                bucket.append(int(target[own[0]])), n.append(len(own)), data.append(press.compress(head + b"".join(parts)))
            columns = [pa.array(bucket, pa.int32()), pa.array([1] * len(n), pa.int8()), pa.array(n, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)

    return numbered.select("row", "text", "doc").mapInArrow(pack, _BLOCK_SQL)


def _open_texts(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, "<i8", 3 * n).reshape(3, n)
    return head[0], head[1], head[2], np.frombuffer(raw, np.uint8, offset=24 * n)


def _texts_with(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple]:
    """Per bucket: records of its rows (kind 0, sorted by row), then its blocks of texts, one at a time."""
    bucket, held, records = None, [], None
    for batch in batches:
        for b, kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "data")), strict=True):
            if b != bucket:
                bucket, held, records = b, [], None
            if kind == 0:
                held.append(_unpacked(data, n, dtype))
                continue
            if records is None:
                records = np.concatenate(held) if held else np.empty(0, dtype)
                records, held = records[np.argsort(records["row"], kind="stable")], []
            yield records, *_open_texts(data, n)


def _collapsed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest suffix of each context (anchor and bytes all round), and the spans of the others, which it makes
    repeats over all their bytes."""
    words = np.array(_words(s["bytes"]))
    odd = np.random.default_rng(12).integers(1, 2**63, len(words) + 2, dtype=np.uint64) | np.uint64(1)
    digest = s["hash"] + s["before"] * odd[0] + s["after"] * odd[1]
    for word, by in zip(words, odd[2:]):
        digest += _mixed(word * by)
    order = np.lexsort([s["at"], s["row"], s["doc"], digest])
    digest = digest[order]
    near = np.flatnonzero(digest[1:] == digest[:-1])
    a, b = order[near], order[near + 1]
    same = (s["bytes"][a] == s["bytes"][b]).all(1)
    for name in ("hash", "before", "after"):
        same &= s[name][a] == s[name][b]
    # in the order of the texts, which presses best
    later = np.zeros(len(s), bool)
    later[b[same]] = True
    spans = np.empty(int(later.sum()), _SPANS)
    own = s[later]
    spans["row"], spans["start"], spans["end"] = own["row"], own["at"] - own["before"], own["at"] + own["after"]
    return s[~later], spans


def _fetch(buckets: int, least: int, collapse: bool) -> Callable:
    """Anchors with the bytes around them, dealt by hash; with ``collapse`` the earliest of each context, and spans of the
    others (kind 1) dealt by row."""
    left, width, kind = least - ANCHOR, 2 * least - ANCHOR, _suffixes(least)
    reach = np.arange(width)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found, rows, docs, lengths, buffer in _texts_with(batches, _ANCHORS):
            order = np.argsort(rows)
            rows, docs, starts = rows[order], docs[order], (np.cumsum(lengths) - lengths)[order]
            own = found[np.isin(found["row"], rows)]
            if not len(own):
                continue
            text = np.searchsorted(rows, own["row"])
            padded = np.concatenate([np.zeros(left, np.uint8), buffer, np.zeros(least, np.uint8)])
            for a in range(0, len(own), 20_000):
                part, at = own[a : a + 20_000], text[a : a + 20_000]
                out = np.empty(len(part), kind)
                for name in _ANCHORS.names:
                    out[name] = part[name]
                out["doc"] = docs[at]
                near = padded[(starts[at] + part["at"])[:, None] + reach]
                near[(reach < left - part["before"][:, None]) | (reach >= left + part["after"][:, None])] = 0
                out["bytes"] = near
                held.append(out)
                size += near.nbytes
                if size > FLUSH:
                    whole = np.concatenate(held)
                    if collapse:
                        whole, spans = _collapsed(whole)
                        if len(spans):
                            yield _by_row(spans, buckets, 1)
                    held, size = [whole], whole["bytes"].nbytes
                    # contexts met again and again stay, so that they go out once
                    if not collapse or 2 * size > FLUSH:
                        yield _by_hash(whole, buckets)
                        held, size = [], 0
        if held:
            whole = np.concatenate(held)
            if collapse:
                whole, spans = _collapsed(whole)
                if len(spans):
                    yield _by_row(spans, buckets, 1)
            yield _by_hash(whole, buckets)

    return fetch


def _words(matrix: np.ndarray) -> list[np.ndarray]:
    """Bytes as big-endian 64-bit columns that sort as the bytes do."""
    n, w = matrix.shape
    wide = np.zeros((n, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = matrix
    return list(np.ascontiguousarray(wide).view(">u8").astype(np.uint64).T)


def _neighbours_share(matrix: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Leading bytes that rows i and i + 1 share, neither reaching past its limit."""
    differ = matrix[1:] != matrix[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return np.minimum(shared, np.minimum(limit[1:], limit[:-1]).astype(np.int64))


def _sorted_contexts(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and by the bytes from the anchor on; what neighbours share (0 across hashes); same context."""
    left = least - ANCHOR
    after, before = s["bytes"][:, left:], s["bytes"][:, :left][:, ::-1]
    keys = [s["at"], s["row"], s["doc"], *_words(before)[::-1], s["before"], s["after"], *_words(after)[::-1], s["hash"]]
    order = np.lexsort(keys)
    s = s[order]
    shared = _neighbours_share(s["bytes"][:, left:], s["after"])
    apart = s["hash"][1:] != s["hash"][:-1]
    same = ~apart & (s["before"][1:] == s["before"][:-1]) & (s["after"][1:] == s["after"][:-1])
    same &= (s["bytes"][1:] == s["bytes"][:-1]).all(1)
    shared[apart | (shared < ANCHOR)] = 0
    return order, shared, same


def _scan(s: np.ndarray, least: int, groups: list | None = None) -> np.ndarray:
    """Spans of all repeats among the suffixes of a bucket but for the earliest of each.

    Suffixes with the same bytes all round are one leaf of the tree, the earliest standing for them; the others are
    repeats as they are. ``groups``, if given, receives every maximal repeat with all its occurrences.
    """
    left = least - ANCHOR
    order, shared, same = _sorted_contexts(s, least)
    s = s[order]
    first = np.concatenate([[True], ~same])
    low, high = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    again = ~first
    low[again], high[again] = s["before"][again], s["after"][again]
    leaf = np.flatnonzero(first)
    size = np.diff(np.append(leaf, len(s)))
    between = shared[leaf[1:] - 1]
    cuts = np.flatnonzero(between == 0) + 1
    edges = np.concatenate([[0], cuts, [len(leaf)]])
    counts = np.diff(edges)

    def note(members: np.ndarray, l: int, r: int) -> None:
        own = np.concatenate([np.arange(leaf[i], leaf[i] + size[i]) for i in members])
        out = np.empty(len(own), _GROUPS)
        out["group"] = s["hash"][own[0]] + np.uint64(l * 256 + r + (int(leaf[members[0]]) << 20))
        out["doc"], out["row"] = s["doc"][own], s["row"][own]
        out["start"], out["end"] = s["at"][own] - l, s["at"][own] + r
        groups.append(out)

    if groups is not None:
        for i in np.flatnonzero(size > 1).tolist():
            note(np.array([i]), int(s["before"][leaf[i]]), int(s["after"][leaf[i]]))
    rank = np.empty(len(leaf), np.int64)
    rank[np.lexsort([s["at"][leaf], s["row"][leaf], s["doc"][leaf]])] = np.arange(len(leaf))
    # two leaves: the tree is one interval
    one = edges[:-1][counts == 2]
    if len(one):
        a, b = leaf[one], leaf[one + 1]
        backward = s["bytes"][:, :left][:, ::-1]
        differ = backward[a] != backward[b]
        l = np.where(differ.any(1), differ.argmax(1), left)
        l = np.minimum(l, np.minimum(s["before"][a], s["before"][b]))
        r = between[one]
        hit = l + r >= least
        later = np.where(rank[one] > rank[one + 1], a, b)[hit]
        low[later], high[later] = l[hit], r[hit]
        if groups is not None:
            for i, x, y in zip(one[hit].tolist(), l[hit].tolist(), r[hit].tolist()):
                note(np.array([i, i + 1]), x, y)
    for e in np.flatnonzero(counts > 2).tolist():
        a, b = edges[e], edges[e + 1]
        own = s[leaf[a:b]]
        backward = np.ascontiguousarray(own["bytes"][:, :left][:, ::-1])
        by_left = np.lexsort(_words(backward)[::-1])
        place = np.empty(b - a, np.int64)
        place[by_left] = np.arange(b - a)
        left_lcp = _neighbours_share(backward[by_left], own["before"][by_left])
        for members, l, r in maximal_repeats(between[a : b - 1], place, left_lcp, least):
            at = leaf[a + members]
            rest = at[rank[a + members] != rank[a + members].min()]
            low[rest] = np.maximum(low[rest], l)
            high[rest] = np.maximum(high[rest], r)
            if groups is not None:
                note(a + members, l, r)
    hit = low + high > 0
    out = np.empty(int(hit.sum()), _SPANS)
    out["row"], out["start"], out["end"] = s["row"][hit], s["at"][hit] - low[hit], s["at"][hit] + high[hit]
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
    )


def _buckets(docs: DataFrame) -> int:
    return max(8, 3 * docs.rdd.getNumPartitions())


def _grouped(blocks: DataFrame, buckets: int, *more: str) -> DataFrame:
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", *more)


def _all_suffixes(numbered: DataFrame, texts: DataFrame, buckets: int, least: int, collapse: bool = True) -> DataFrame:
    """Blocks of repeated anchors with their bytes, grouped by hash (kind 0); with ``collapse`` the earliest of each context
    a task met, and blocks of the others' spans by row (kind 1)."""
    found = numbered.select("row", "text").mapInArrow(_cut(buckets, least), _BLOCK_SQL)
    again = _grouped(found, buckets).mapInArrow(_met_again(buckets), _BLOCK_SQL)
    fetched = _grouped(again.unionByName(texts), buckets, "kind").mapInArrow(_fetch(buckets, least, collapse), _BLOCK_SQL)
    return _grouped(fetched, buckets)


def repeat_groups(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(group, doc_id, start, end): all occurrences of every maximal repeat of at least ``least`` bytes.

    A repeat is followed up to ``least - 40`` bytes before and ``least`` from the start of its anchor; a longer one comes
    as a chain of overlapping groups. An occurrence can belong to several groups. A null doc_id stays null.
    """
    schema = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    numbered, buckets, kind = _numbered(docs), _buckets(docs), _suffixes(least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 1):
            out: list[np.ndarray] = []
            _scan(_blocks(group, kind, 0), least, out)
            for g in out:
                ids = pa.array([None if d == _NO_ID else d for d in g["doc"].tolist()], pa.int64())
                columns = [pa.array(g["group"].view(np.int64)), ids, *(pa.array(g[c].astype(np.int64)) for c in ("start", "end"))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    suffixes = _all_suffixes(numbered, _texts(numbered, buckets), buckets, least, False)
    return suffixes.mapInArrow(scan, "group long, doc_id long, start long, end long")


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (binary).

    Every byte goes that a string of ``least`` bytes covers which also starts earlier: in a smaller doc_id, or before in the
    same document. Rows that share an id are documents one after the other; a null id comes first. A null text is empty;
    texts under ``least`` bytes stay whole. Texts of any length are read whole, in overlapping segments. Other columns are
    ignored; an empty table gives an empty result.
    """
    numbered, buckets, kind = _numbered(docs), _buckets(docs), _suffixes(least)
    texts = _texts(numbered, buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, most = None, [], 0, 4 * FLUSH
        for batch in batches:
            through = batch.filter(pa.array(batch.column(1).to_numpy() == 1))
            if through.num_rows:
                yield through.set_column(1, _BLOCK.field(1), pa.array(np.zeros(through.num_rows, np.int8)))
            for b, own, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "data")), strict=True):
                if own == 1:
                    continue
                if b != bucket:
                    if held and len(spans := _scan(np.concatenate(held), least)):
                        yield _by_row(spans, buckets)
                    bucket, held, size, most = b, [], 0, 4 * FLUSH
                held.append(_unpacked(data, n, kind))
                size += held[-1].nbytes
                if size > most:
                    whole, spans = _collapsed(np.concatenate(held))
                    if len(spans):
                        yield _by_row(spans, buckets)
                    held, size = [whole], whole.nbytes
                    most = max(4 * FLUSH, 2 * size)
        if held and len(spans := _scan(np.concatenate(held), least)):
            yield _by_row(spans, buckets)

    spans = stored(_all_suffixes(numbered, texts, buckets, least).mapInArrow(scan, _BLOCK_SQL))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *[("kept", pa.binary())] * keep_text])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, rows, docs_, lengths, buffer in _texts_with(batches, _SPANS):
            ends = np.cumsum(lengths)
            out = []
            for row, doc, a, b in zip(rows.tolist(), docs_.tolist(), (ends - lengths).tolist(), ends.tolist()):
                x, y = np.searchsorted(found["row"], [row, row + 1])
                own = np.sort(found[x:y], order=["start", "end"])
                kept, at, n_spans = [], 0, 0
                if len(own):
                    reach = np.maximum.accumulate(own["end"])
                    new = np.flatnonzero(np.concatenate([[True], own["start"][1:] > reach[:-1]]))
                    n_spans = len(new)
                    for s, e in zip(own["start"][new].tolist(), reach[np.append(new[1:] - 1, len(own) - 1)].tolist()):
                        kept.append(buffer[a + at : a + s])
                        at = e
                kept.append(buffer[a + at : b])
                left = b"".join(k.tobytes() for k in kept)
                line = (None if doc == _NO_ID else doc, b - a, b - a - len(left), n_spans, hashlib.sha256(left).hexdigest())
                out.append((*line, left) if keep_text else line)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema)], schema=schema)

    grouped = _grouped(spans.unionByName(texts), buckets, "kind")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return grouped.mapInArrow(remove, kinds)
