"""Language-model scores of texts: the marginal probability of a text over all segmentations into subword pieces.

The units are the pieces of an existing vocabulary. Half of a piece's weight is the share that the vocabulary's own scores
give it, at every size of the corpus; the other half is its share of the training text. A text is the lattice of all ways to
spell it in pieces. No piece reaches across the start of a word, so the forward recursion, in log space, runs word by word
and is shared by all texts that hold the word; the text's marginal is the product over its words and its end. Logarithms
are kept to the last sum, so words of any length count in full.

A second score gives each word of the training documents an arc of its own across its lattice, discounted by the share that
training leaves to new words.

Counts are kept in a table of all words. The most frequent words (a fixed number) are sent to all tasks;
the others are looked up by a join, so that nothing that grows with the corpus is sent.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored, tidy

#: Words sent to every task with their counts, at most; longer words are looked up by the join.
FREQUENT, FREQUENT_BYTES = 300_000, 64
#: Part of a piece's weight that the vocabulary's own scores give, whatever the size of the corpus.
OWN_SHARE = 0.5
_HELD = 500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id, modulus: int, held_out: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == held_out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and the distribution that the vocabulary's scores alone give (a score of -r is rank r)."""
    sp = _processor(path)
    ids = range(sp.get_piece_size())
    usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids])
    weight = usable / (10.0 - np.minimum([sp.get_score(i) for i in ids], 0.0))
    return [sp.id_to_piece(i) for i in ids], weight / weight.sum()


class PieceLattice:
    """Log probability of a word, summed over all segmentations of its characters into pieces."""

    def __init__(self, path: str, counts: np.ndarray):
        pieces, prior = _pieces(path)
        usable = counts * (prior > 0)
        seen = usable.sum()
        share = OWN_SHARE * prior + (1 - OWN_SHARE) * usable / seen if seen else prior
        self.log = {p: math.log(s) for p, s in zip(pieces, share) if s > 0}
        self.byte = [self.log.pop(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.log))

    def word(self, word: bytes) -> float:
        """Natural logarithm; characters that are no piece are spelled in byte pieces."""
        text = "▁" + word.decode("utf-8", "replace")
        get, longest = self.log.get, self.longest
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            paths = [
                alpha[start] + own
                for start in range(max(0, end - longest), end)
                if (own := get(text[start:end])) is not None
            ]
            if get(text[end - 1]) is None:
                paths.append(alpha[end - 1] + sum(self.byte[b] for b in text[end - 1].encode("utf-8", "replace")))
            top = max(paths)
            alpha.append(top if len(paths) == 1 else top + math.log(sum([math.exp(p - top) for p in paths])))
        return alpha[-1]


@lru_cache(maxsize=1)
def _lattice(path: str, counts: bytes) -> PieceLattice:
    return PieceLattice(path, np.frombuffer(counts, np.float64))


def word_counts(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """(word, c) over the training documents; each task sums its own words first."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([held[k] for k in part], pa.int64())], schema=schema
                )
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not is_held_out(doc_id, modulus, held_out):
                    held.update(words_of(text.as_py()))
                    if len(held) > _HELD:
                        yield from out()
        yield from out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each piece occurs in the training text, its words cut by the existing vocabulary; one number per piece."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            ids = sp.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(own) for own in ids])
            np.add.at(total, np.fromiter((i for own in ids for i in own), np.int64, len(times)), times)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=schema)

    rows = counts.select("word", "c").mapInArrow(cut, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    out = np.zeros(len(_pieces(path)[0]))
    for r in rows.collect():
        out[r["piece"]] = r["n"]
    return out


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts, as many whole classes of counts as hold at most ``most`` words. A class is an
    eighth of a power of two wide, so there are a few hundred of them and no word has to be sorted."""
    kind = F.floor(F.log2("c") * 8)
    found = 0
    for r in table.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect():
        found += r["count"]
        if found > most:
            return table.where(kind > r["kind"])
    return table


def score(
    docs: DataFrame, modulus: int = 7, held_out: int = 2, frequent: int = FREQUENT, vocabulary: str | None = None
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score.

    ``score`` is the log10 marginal of the text in the lattice, ``word_score`` with arcs for known words. Documents whose
    crc32(doc_id as text) mod ``modulus`` is ``held_out`` are scored but not learned from; a row without id is learned
    from. A null or empty text is the end token alone. Repeated rows are counted and scored one by one. Without training
    documents the base score is 0 per token, the end has probability a half, and the lattice has the vocabulary's own
    scores alone. Other columns are ignored; an empty table gives an empty result; texts are read whole.
    """
    path = vocabulary or default_vocabulary()
    counted = stored(word_counts(docs, modulus, held_out))
    sums = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"),
    ).first()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    ends = docs.where(~held).count()
    total, types = sums["n"] + ends, sums["v"] + (ends > 0)
    discount = min(max(sums["n1"] / (sums["n1"] + 2 * sums["n2"]), 0.1), 0.9) if sums["n1"] else 0.5
    # the part of the training words that is left to new ones
    new = discount * sums["v"] / sums["n"] if sums["n"] else 1.0
    end = (ends + 1) / (total + 2)
    log_end, log_word = math.log10(end), math.log10(1 - end)
    divisor = float(total + types + 1)
    pieces = piece_counts(counted, path).tobytes()

    @F.pandas_udf("double")
    def lattice(word: pd.Series) -> pd.Series:
        own = _lattice(path, pieces)
        return pd.Series([own.word(bytes(w)) / math.log(10) if w is not None else None for w in word], dtype="float64")

    # log10 of a word in the lattice, and with its own arc: log10(x + y) from their logarithms
    table = stored(counted.withColumn("lp", lattice("word")).withColumn("wp", _log_sum(F.log10((F.col("c") - discount) / max(sums["n"], 1)), F.col("lp") + math.log10(new))))
    top = _most_frequent(table.where(F.octet_length("word") <= FREQUENT_BYTES), frequent).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), *(top.column(x).to_numpy() for x in ("c", "lp", "wp"))))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, wp double, rare array<struct<word: binary, tf: long>>"
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("lp", pa.float64()), ("wp", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
    ])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, lp, wp = sent.value
        values = list(zip(np.log10((c + 1) / divisor).tolist(), lp.tolist(), wp.tolist()))
        known_words = dict(zip(words, values))
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch, rows = whole.slice(start, 1000), []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = words_of(text.as_py())
                    known, rare = int(ends > 0), []
                    base, lattice_sum = math.log10((ends + 1) / divisor), len(tokens) * log_word + log_end
                    word_sum = lattice_sum
                    for w, tf in Counter(tokens).items():
                        own = known_words.get(w)
                        if own is None:
                            rare.append({"word": w, "tf": tf})
                            continue
                        known += tf
                        base += tf * own[0]
                        lattice_sum += tf * own[1]
                        word_sum += tf * own[2]
                    rows.append((doc_id, is_held_out(doc_id, modulus, held_out), len(tokens) + 1, known, base, lattice_sum, word_sum, rare))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema)], schema=schema)

    partial = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(common), kind)
        .withColumn("row", F.monotonically_increasing_id())
    )
    rare = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    looked = rare.join(table, "word", "left")
    # a word that training does not hold is spelled here
    spelled = looked.withColumn("lp", F.coalesce("lp", lattice(F.when(F.col("c").isNull(), F.col("word")))))
    spelled = spelled.withColumn("wp", F.coalesce("wp", F.col("lp") + math.log10(new)))
    added = spelled.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(divisor))).alias("base_more"),
        F.sum(F.col("tf") * F.col("lp")).alias("lp_more"), F.sum(F.col("tf") * F.col("wp")).alias("wp_more"),
    )
    both = partial.drop("rare").join(added, "row", "left").na.fill(0, ["known", "base_more", "lp_more", "wp_more"])
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("base_more")).alias("base_score"),
        (F.col("lp") + F.col("lp_more")).alias("score"), (F.col("wp") + F.col("wp_more")).alias("word_score"),
    )


def _log_sum(x: Column, y: Column) -> Column:
    """log10(10**x + 10**y) without leaving the logarithms."""
    top = F.greatest(x, y)
    return top + F.log10(1 + F.pow(F.lit(10.0), F.least(x, y) - top))
