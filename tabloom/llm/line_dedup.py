"""Line dedup with sharded cuckoo filters in front of exact reference-count tables.

Each document gives one posting (key, doc_id) per distinct line key of at least ten code points.
The reference table counts the documents of a key and knows the smallest; a key is repeated when
two documents hold it. Repeated keys are also kept in cuckoo filters, one per shard of keys.
A posting first asks the filter of its shard; only those that it lets pass are joined with the
table, which decides. Adding or removing documents adds or passes over their postings, adjusts the
counts by the difference alone, and inserts into or deletes from the filters the keys that became or
ceased to be repeated. An index can be saved and loaded.

A line that a third of all documents share is summed before the shuffle; the join behind the
filter is an ordinary equi-join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom._columns import col
from tabloom.llm import cuckoo
from tabloom.llm.common import spread, stored, tidy
from tabloom.session import broadcast_if_small

LEAST = 10
#: Filters are sent to every task up to this many bytes in all; beyond it postings are brought to the filter of their shard.
FILTER_BYTES = 64 * 1024 * 1024
#: Postings that meet their filter in one task.
PIECE = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"
_NO_ID = -(2**63)
POSTING = "high long, low long, doc_id long"


def _key(line: str) -> bytes | None:
    line = line.strip(_SPACE)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= LEAST else None


def _halves(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _doc_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc_id")


def postings(docs: DataFrame) -> DataFrame:
    """(high, low, doc_id): one row per document and distinct line key; the key is a 128-bit digest."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64())])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for h, w in {_halves(k) for line in (text.as_py() or "").split("\n") if (k := _key(line)) is not None}:
                    high.append(h), low.append(w), ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (high, low, ids)], schema=schema)

    return docs.select(_doc_id(docs), "text").mapInArrow(cut, POSTING)


def references(rows: DataFrame) -> DataFrame:
    """Exact counts per key: postings, smallest and largest document. Two documents hold a key when these differ."""
    return rows.groupBy("high", "low").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


def _repeated(table: DataFrame) -> DataFrame:
    return table.where("last_doc > first_doc").select("high", "low", "first_doc")


def _shard(shards: int) -> Column:
    return F.pmod("high", F.lit(shards)).cast("int").alias("shard")


_FILTERS = "shard int, slots binary, waiting array<struct<high: long, low: long>>"


def _filter_row(shard: int, f: cuckoo.CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "slots": [f.slots.tobytes()], "waiting": [[{"high": h, "low": w} for h, w in f.waiting]]})


def _load(row) -> cuckoo.CuckooFilter:
    return cuckoo.CuckooFilter(bytes(row["slots"]), [(w["high"], w["low"]) for w in row["waiting"]])


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = cuckoo.CuckooFilter()
        f.insert(pdf["high"].to_numpy(), pdf["low"].to_numpy())
        return _filter_row(key[0], f)

    return keys.select("high", "low", _shard(shards)).groupBy("shard").applyInPandas(build, _FILTERS)


def adjust_filters(filters: DataFrame, became: DataFrame, ceased: DataFrame, shards: int) -> DataFrame:
    """Insert keys that became repeated and delete those that ceased to be, shard by shard."""

    def adjust(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        f = _load(old.iloc[0]) if len(old) else cuckoo.CuckooFilter()
        gone, new = changes[~changes["add"]], changes[changes["add"]]
        f.delete(gone["high"].to_numpy(), gone["low"].to_numpy())
        f.insert(new["high"].to_numpy(), new["low"].to_numpy())
        return _filter_row(key[0], f)

    changes = became.select("high", "low", F.lit(True).alias("add")).unionByName(
        ceased.select("high", "low", F.lit(False).alias("add"))
    ).withColumn("shard", _shard(shards))
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(adjust, _FILTERS)


@dataclass
class LineIndex:
    """Postings, reference table and filters of the documents taken in so far."""

    rows: DataFrame
    table: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def of(cls, docs: DataFrame) -> LineIndex:
        rows = stored(postings(docs))
        table = stored(references(rows))
        keys = _repeated(table)
        shards = spread(keys.count(), cuckoo.KEYS_PER_SHARD)
        return cls(rows, table, stored(build_filters(keys, shards)), shards)

    def _changed(self, rows: DataFrame, table: DataFrame, touched: DataFrame) -> LineIndex:
        """The index over ``rows`` and ``table``, in which only the keys of ``touched`` differ."""
        n = _repeated(table).count()
        if spread(n, cuckoo.KEYS_PER_SHARD) > self.shards:
            shards = 2 * spread(n, cuckoo.KEYS_PER_SHARD)
            return LineIndex(rows, table, stored(build_filters(_repeated(table), shards)), shards)
        before, after = (_repeated(t.join(touched, ["high", "low"], "left_semi")).drop("first_doc") for t in (self.table, table))
        became, ceased = after.join(before, ["high", "low"], "left_anti"), before.join(after, ["high", "low"], "left_anti")
        return LineIndex(rows, table, stored(adjust_filters(self.filters, became, ceased, self.shards)), self.shards)

    def add(self, docs: DataFrame) -> LineIndex:
        """Take documents in: their postings are written beside the others and their counts added to the table.

        An empty table changes nothing. A document that is there already gets further lines; a null id is one
        document. Columns other than doc_id and text are ignored.
        """
        new = stored(postings(docs))
        delta = stored(references(new))
        table = self.table.unionByName(delta).groupBy("high", "low").agg(
            F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")
        )
        return self._changed(self.rows.unionByName(new), stored(table), delta.select("high", "low"))

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (column doc_id) out again; ids that are not there, or named twice, change nothing more.

        Counts go down by the postings that leave. Only keys whose smallest or largest document leaves are
        counted anew. Older postings are not rewritten (``compacted`` does that), they are passed over.
        """
        ids = stored(doc_ids.select(_doc_id(doc_ids)).distinct())
        gone = stored(references(self.rows.join(ids, "doc_id", "left_semi")).withColumnsRenamed(
            {"n": "gone_n", "first_doc": "gone_first", "last_doc": "gone_last"}
        ))
        rows = self.rows.join(ids, "doc_id", "left_anti").select(*self.rows.columns)
        met = stored(self.table.join(gone, ["high", "low"]).where("n > gone_n").withColumn(
            "anew", F.expr("first_doc = gone_first OR last_doc = gone_last")
        ))
        anew = references(rows.join(met.where("anew").select("high", "low"), ["high", "low"], "left_semi"))
        less = met.where("NOT anew").withColumn("n", F.col("n") - F.col("gone_n")).select(*self.table.columns)
        touched = gone.select("high", "low")
        others = self.table.join(touched, ["high", "low"], "left_anti")
        return self._changed(rows, stored(others.unionByName(less).unionByName(anew)), touched)

    def compacted(self) -> LineIndex:
        """The same index with its postings in one table, after many additions and removals."""
        return LineIndex(stored(self.rows), self.table, self.filters, self.shards)

    def save(self, folder: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")
        self.table.write.mode("overwrite").parquet(f"{folder}/table")
        self.filters.withColumn("shards", F.lit(self.shards)).write.mode("overwrite").parquet(f"{folder}/filters")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineIndex:
        """An index that ``save`` wrote, in whatever session."""
        rows, table, filters = (spark.read.parquet(f"{folder}/{part}") for part in ("rows", "table", "filters"))
        first = filters.first()
        return cls(rows, table, filters.drop("shards"), first["shards"] if first else 1)

    def suspects(self, rows: DataFrame) -> DataFrame:
        """Postings whose key may be repeated, as the filters have it: none that is repeated is missing.

        Filters of up to ``FILTER_BYTES`` in all are sent to the postings; larger sets meet them shard by shard.
        """
        if self.shards * self.filters_bytes > FILTER_BYTES:
            return self._suspects_by_shard(rows)
        sent = rows.sparkSession.sparkContext.broadcast(
            {r["shard"]: (bytes(r["slots"]), [tuple(w) for w in r["waiting"]]) for r in self.filters.collect()}
        )
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: cuckoo.CuckooFilter(*v) for k, v in sent.value.items()}
            for batch in batches:
                high, low = batch.column("high").to_numpy(), batch.column("low").to_numpy()
                shard, hit = high % shards, np.zeros(len(high), bool)
                for k, f in filters.items():
                    own = np.flatnonzero(shard == k)
                    hit[own] = f.contains(high[own], low[own])
                yield batch.filter(pa.array(hit))

        return rows.mapInArrow(probe, POSTING)

    def _suspects_by_shard(self, rows: DataFrame) -> DataFrame:
        """A shard's postings are dealt by document over as many tasks as they need, each with a copy of its filter."""
        pieces = stored(self.table.groupBy(_shard(self.shards)).agg(
            F.ceil(F.sum("n") / F.lit(PIECE)).cast("int").alias("pieces")
        ))
        dealt = rows.withColumn("shard", _shard(self.shards)).join(broadcast_if_small(pieces), "shard")
        dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id"), "pieces").cast("int"))
        copies = self.filters.join(pieces, "shard").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))

        def probe(own: pa.Table, asked: pa.Table) -> pa.Table:
            asked = asked.select(["high", "low", "doc_id"])
            if not own.num_rows or not asked.num_rows:
                return asked.slice(0, 0)
            f = _load(own.to_pylist()[0])
            return asked.filter(pa.array(f.contains(asked["high"].to_numpy(), asked["low"].to_numpy())))

        return copies.drop("pieces").groupBy("shard", "piece").cogroup(
            dealt.drop("pieces").groupBy("shard", "piece")
        ).applyInArrow(probe, POSTING)

    filters_bytes = cuckoo.BUCKETS * cuckoo.SLOTS * 2

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, as digests."""
        found = self.suspects(self.rows).join(_repeated(self.table), ["high", "low"]).where("doc_id > first_doc")
        return found.groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias("keys"))


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """Documents with their repeated lines taken out: doc_id, n_lines, n_dropped, kept_text, kept_sha256.

    A null or empty text is one empty line. Lines whose key has fewer than ten code points stay. Rows that
    share an id are one document, a null id is one document and the smallest. Within the smallest document
    of a key all its lines stay. Columns other than doc_id and text are ignored; an empty table gives an
    empty result. Lines and texts of any length are compared whole.
    """
    index = index or LineIndex.of(docs)
    drops = index.drops()
    texts = docs.select(F.col("doc_id").alias("_own"), _doc_id(docs), "text").join(drops, "doc_id", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = (text.as_py() or "").split("\n")
                kept = lines
                if keys:
                    gone = {(k["high"], k["low"]) for k in keys}
                    kept = [x for x in lines if (k := _key(x)) is None or _halves(k) not in gone]
                left = "\n".join(kept)
                out.append((own, len(lines), len(lines) - len(kept), left, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return texts.select("_own", "text", "keys").mapInArrow(
        rebuild, "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``documents`` with the remaining texts; n_chars is counted anew, other columns stay. A null text stays null."""
    drops = LineIndex.of(docs).drops()
    whole = docs.select(F.struct(*map(col, docs.columns)).alias("own"), _doc_id(docs))

    @F.pandas_udf("string")
    def keep(text: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, keys, strict=True):
            if t and own is not None and len(own):
                gone = {(k["high"], k["low"]) for k in own}
                t = "\n".join(x for x in t.split("\n") if (k := _key(x)) is None or _halves(k) not in gone)
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = whole.join(drops, "doc_id", "left").select("own", keep("own.text", "keys").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.doc_id, line, i, coalesce(k.doc_id <> first_doc, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
