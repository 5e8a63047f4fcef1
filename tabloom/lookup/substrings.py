"""Finding dictionary keys inside texts.

A small dictionary is matched inside each task (row-wise array functions for a
handful of keys, an Aho-Corasick automaton in Arrow batches beyond that). A
dictionary of any size is matched by an equi join on key beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import work_partitions

FEW_KEYS = 64
SEED = 6


def first_hit(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Value of the first key contained in the text, null when there is none."""
    if not pairs:
        return F.lit(None).cast("string")
    if len(pairs) <= FEW_KEYS:
        entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
        return F.try_element_at(F.filter(entries, lambda e: text.contains(e["k"])), F.lit(1))["v"]
    return _automaton(pairs, best="first")(text)


def longest_hit(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Value of the longest key contained in the text; ties go to the larger value."""
    if not pairs:
        return F.lit(None).cast("string")
    if len(pairs) <= FEW_KEYS:
        entries = F.array(
            *[
                F.struct(F.lit(len(k)).alias("n"), F.lit(v).alias("v"), F.lit(k).alias("k"))
                for k, v in pairs
            ]
        )
        return F.array_max(F.filter(entries, lambda e: text.contains(e["k"])))["v"]
    return _automaton(pairs, best="longest")(text)


def _automaton(pairs: Sequence[tuple[str, str]], best: str):
    table = list(pairs)

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        ranks: dict[str, tuple] = {}
        for position, (key, value) in enumerate(table):
            rank = (-position,) if best == "first" else (len(key), value is not None, value or "")
            if key not in ranks or rank > ranks[key][0]:
                ranks[key] = (rank, value)
        for key, entry in ranks.items():
            if key:
                machine.add_word(key, entry)
        empty = ranks.get("")
        ready = len(machine) > 0
        if ready:
            machine.make_automaton()

        def pick(text):
            hits = [entry for _, entry in machine.iter(text)] if ready and text else []
            if empty:
                hits.append(empty)
            return max(hits)[1] if hits else None

        for texts in batches:
            yield texts.map(pick, na_action="ignore")

    return scan


def hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(digest, key, value, ord) for every dictionary key inside a text.

    ``texts`` has one column ``text`` (distinct values). The distinct beginnings of
    keys, at most SEED characters, are looked for among all pieces of that length of a
    text; only (digest, piece) is exploded and joined. A key whose beginning is met is
    then compared with the text itself.
    """
    keys = dictionary.withColumn("width", F.least(F.length("key"), F.lit(SEED)))
    keys = keys.filter("width > 0").withColumn("seed", F.substring("key", 1, SEED))
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())
    named = texts.select(F.md5("text").alias("digest"), "text")

    def pieces(width: int) -> Column:
        every = F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{width}}}))"), F.lit(1))
        return F.array_distinct(every)

    # Cutting multiplies the rows about a hundredfold, so spread the texts first.
    spread = named.repartition(work_partitions(texts.sparkSession))
    found = F.array_distinct(F.flatten(F.array(*[pieces(w) for w in widths]))) if widths else F.array().cast("array<string>")
    cuts = spread.select("digest", F.explode(found).alias("seed"))
    met = cuts.join(keys.drop("width"), "seed").drop("seed").distinct()
    return met.join(named, "digest").filter(F.col("text").contains(F.col("key"))).select("digest", "key", "value", "ord").distinct()
