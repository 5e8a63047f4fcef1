"""Best fuzzy dictionary key for a text: difflib ratio above 0.7, earliest key on ties.

A ratio is 2 * matched / (both lengths), and what matches is at most what both have in common as bags of letters. So a text
meets only keys of lengths that can pass, which is a join on bands of lengths, and within a task one product over counted
letters bounds the ratios of a text with all keys at once, once for all texts and keys of the same letters. For those that can pass,
the longest common subsequence is a closer bound, found for many keys at once in the bits of a number. Keys are compared
from the highest bound downward until no bound reaches the best ratio found.

Texts that are a key, or a key with one letter more or less, need none of this: no other key can have their ratio, so
they find their keys by a join on texts without one letter (``near_keys``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import checkpointed, grown, work_partitions

LIMIT = 0.7
#: Lengths of a band grow by this factor.
BAND = 1.3
#: Letters are counted by their number modulo this; letters that share a slot can only raise a bound.
SLOTS = 64
#: Letters of a key whose common subsequences fit in the bits of a number.
BITS = 64
#: Matchers kept at once; each holds an index of its key.
MATCHERS = 5000
#: Texts of these lengths are looked up by their texts without one letter.
NEAR_LEAST, NEAR_MOST = 3, 128


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(codes % SLOTS, minlength=SLOTS).astype(np.int32)


def _by_letters(text: str) -> tuple[str, str]:
    """Order in which texts of the same letters follow each other, and among these texts of the same beginning."""
    return "".join(sorted(text)), text


class Keys:
    """Keys in the order that decides ties."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        profiles = dict.fromkeys("".join(sorted(k)) for k in self.keys)
        place = {p: i for i, p in enumerate(profiles)}
        self.profile = np.array([place["".join(sorted(k))] for k in self.keys], np.int64)
        self.letters = np.array([_letters(p) for p in profiles], np.int32).reshape(-1, SLOTS)
        self.totals = np.array([len(p) for p in profiles], np.int64)
        self.masks: dict[str, np.ndarray] = {}
        for i, key in enumerate(self.keys):
            if len(key) <= BITS:
                for j, letter in enumerate(key):
                    if letter not in self.masks:
                        self.masks[letter] = np.zeros(len(self.keys), np.uint64)
                    self.masks[letter][i] |= np.uint64(1 << j)
        self.passing: tuple[str, np.ndarray, np.ndarray] | None = None
        self.met: dict[str, np.ndarray | None] = {}
        self.steps: list[tuple[str, np.ndarray]] = []
        self.matchers: dict[int, SequenceMatcher] = {}
        self.compared = 0

    def bounds(self, text: str) -> np.ndarray:
        """No key's ratio with the text is larger; two empty texts are equal."""
        return self._profile_bounds(text)[self.profile]

    def _profile_bounds(self, text: str) -> np.ndarray:
        common, total = np.minimum(self.letters, _letters(text)).sum(1), self.totals + len(text)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def _able(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys that pass by their letters, with their bounds; remembered for texts of the same letters that follow."""
        letters = "".join(sorted(text))
        if self.passing is None or self.passing[0] != letters:
            bound = self._profile_bounds(text)
            some = np.flatnonzero((bound > LIMIT)[self.profile]) if (bound > LIMIT).any() else np.zeros(0, np.int64)
            self.passing = letters, some, bound[self.profile[some]]
            self.met, self.steps = {}, [("", np.full(len(some), np.uint64(2**64 - 1)))]
        return self.passing[1:]

    def _in_order(self, text: str, places: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of the text and each passing key; blocks that difflib finds are one.
        The beginning that a text shares with the text before is not gone through again."""
        same = 1
        while same < len(self.steps) and same <= len(text) and self.steps[same][0] == text[same - 1]:
            same += 1
        del self.steps[same:]
        free = self.steps[-1][1]
        for letter in text[same - 1 :]:
            if letter not in self.met:
                self.met[letter] = self.masks[letter][places] if letter in self.masks else None
            if self.met[letter] is not None:
                used = free & self.met[letter]
                free = (free + used) | (free - used)
            if len(self.steps) <= BITS:
                self.steps.append((letter, free))
        return np.where(self.sizes[places] <= BITS, np.bitwise_count(~free), self.sizes[places])

    def best(self, text: str) -> tuple[float, int] | None:
        """Highest ratio above the limit and the place of its first key."""
        some, bound = self._able(text)
        if len(some) and text:
            closer = 2.0 * self._in_order(text, some) / (self.sizes[some] + len(text))
            bound = np.minimum(bound, closer)
            some, bound = some[bound > LIMIT], bound[bound > LIMIT]
        best, found = LIMIT, None
        for place, most in ((int(some[i]), bound[i]) for i in np.argsort(-bound, kind="stable")):
            if most < best:
                break
            if found is not None and most == best and place > found:
                continue
            if place not in self.matchers:
                if len(self.matchers) >= MATCHERS:
                    self.matchers.clear()
                self.matchers[place] = SequenceMatcher(None, "", self.keys[place])
            self.matchers[place].set_seq1(text)
            self.compared += 1
            ratio = self.matchers[place].ratio()
            if ratio > best or (found is not None and ratio == best and place < found):
                best, found = ratio, place
        return None if found is None else (best, found)


def best_key(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Row-wise form for a small dictionary; equal texts in a batch are scored once."""
    table = list(pairs)

    @F.pandas_udf("string")
    def score(texts: pd.Series) -> pd.Series:
        keys = Keys([k for k, _ in table])
        known = {}
        for t in sorted(texts.dropna().unique(), key=_by_letters):
            found = keys.best(t)
            known[t] = None if found is None else table[found[1]][1]
        return texts.map(known)

    return score(text)


def _band(length: Column) -> Column:
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / math.log(BAND)).cast("int")


def reachable(texts: DataFrame) -> DataFrame:
    """(text, band): every band of key lengths that the limit leaves to a text; five or six of them."""
    n = F.length("text")
    shortest, longest = F.floor(n * (LIMIT / (2 - LIMIT))), F.ceil(n * ((2 - LIMIT) / LIMIT))
    return texts.select("text", F.explode(F.sequence(_band(shortest), _band(longest))).alias("band"))


def _blocks(rows: DataFrame, name: str, block_rows: int) -> DataFrame:
    """(band, number of blocks): one row per band, of which there are some eighty at the most."""
    return F.broadcast(rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name)))


def _letters_in_order(c: Column) -> Column:
    """The letters of a text, sorted: texts, or keys, of the same letters lie in one block."""
    return F.array_join(F.array_sort(F.split(c, "")), "")


def near_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, value) for texts that are a key, or a key with one letter more or less, where difflib finds all their letters.

    With n letters in the text such ratios are 1, 2n / (2n + 1) and 2(n - 1) / (2n - 1); from three letters on, any other key has
    less than the last. So the first key of the highest ratio is among those met by joins.
    """

    def own(name: str) -> Column:
        return F.xxhash64(name).alias("h")

    def fewer(name: str) -> Column:
        taken = f"xxhash64(concat(substr({name}, 1, p - 1), substr({name}, p + 1)))"
        return F.explode(F.expr(f"array_distinct(transform(sequence(1, length({name})), p -> {taken}))")).alias("h")

    some = texts.select("text").filter(F.length("text").between(NEAR_LEAST, NEAR_MOST))
    entries = keys.filter(F.length("key").between(NEAR_LEAST - 1, NEAR_MOST + 1)).select("key", "value", "ord")
    whole = entries.select(own("key"), "*")
    longer = whole.unionAll(entries.select(fewer("key"), "*"))
    met = some.select(own("text"), "text").join(grown(longer), "h").unionAll(
        some.select(fewer("text"), "text").join(grown(whole), "h")
    ).drop("h")

    @F.pandas_udf("struct<found: boolean, value: string>")
    def pick(texts: pd.Series, listed: pd.Series) -> pd.DataFrame:
        rows = []
        for text, entries in zip(texts, listed):
            # all letters matched: the longer of two keys has the higher ratio, unless the text is the key
            most = {len(text) + d: 2.0 * (len(text) + min(d, 0)) / (2 * len(text) + d) for d in (-1, 0, 1)}
            ranked = sorted((e for e in entries if len(e["key"]) in most), key=lambda e: -most[len(e["key"])])
            same = (e for e in ranked if SequenceMatcher(None, text, e["key"]).ratio() == most[len(e["key"])])
            rows.append((True, e["value"]) if (e := next(same, None)) is not None else (False, None))
        return pd.DataFrame(rows, columns=["found", "value"])

    listed = met.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))).alias("listed"))
    return listed.select("text", pick("text", "listed").alias("p")).filter("p.found").select("text", "p.value")


def best_keys(texts: DataFrame, dictionary: DataFrame, block_rows: int = 10_000) -> DataFrame:
    """(text, value) for a dictionary of any size: near keys by joins, other texts band by band and within a band block by block.

    Every pair of blocks reports only its best key per text; the best over blocks
    is a combining aggregate.
    """
    keys = dictionary.select(F.col("key").alias("key"), "value", "ord", _band(F.length("key")).alias("band"))
    near = checkpointed(near_keys(texts, keys))
    asked = reachable(texts.select("text").join(grown(near.select("text")), "text", "left_anti"))
    key_blocks, text_blocks = _blocks(keys, "key_blocks", block_rows), _blocks(asked, "text_blocks", block_rows)

    def own(column: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(_letters_in_order(F.col(column))), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    # a band without keys, or without texts, meets nothing
    left = asked.join(key_blocks, "band").join(text_blocks, "band").select(
        "band", own("text", "text_blocks").alias("i"), every("key_blocks").alias("j"), "text"
    )
    right = keys.join(text_blocks, "band").join(key_blocks, "band").select(
        "band", every("text_blocks").alias("i"), own("key", "key_blocks").alias("j"), "key", "value", "ord"
    ).toDF("band", "i", "j", "key", "value", "ord")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ord", ignore_index=True)
        table = Keys(right["key"])
        rows = []
        for text in sorted(left["text"], key=_by_letters):
            found = table.best(text)
            if found is not None:
                rows.append((text, found[0], right["value"][found[1]], right["ord"][found[1]]))
        return pd.DataFrame(rows, columns=["text", "ratio", "value", "ord"])

    kind = keys.schema["ord"].dataType.simpleString()
    # few bytes, much work: merging tasks by bytes would leave one or two
    tasks = work_partitions(texts.sparkSession)
    left, right = (side.repartition(tasks, "band", "i", "j") for side in (left, right))
    scored = left.groupBy("band", "i", "j").cogroup(right.groupBy("band", "i", "j")).applyInPandas(
        score, f"text string, ratio double, value string, ord {kind}"
    )
    best = F.min(F.struct((-F.col("ratio")).alias("r"), "ord", "value"))["value"]
    return near.unionAll(scored.groupBy("text").agg(best.alias("value")))
