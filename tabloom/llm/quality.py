"""Document quality by hierarchical empirical Bayes.

A classifier fitted on labelled documents gives each text its evidence: the logarithm of how much likelier
its statistics are for a good document than for a bad one. How good documents of a site are in general is
learned from all documents: the sums of the classifier's probabilities per host and per path (a part of a
host) are Beta counts. A path's rate is shrunk toward its host's, a host's toward the global rate; how
strongly is estimated from how much hosts, and paths within hosts, differ. The posterior of a document is its
evidence plus the log odds of its path, from which the document itself is left out.

All counts are grouped sums, combined before the shuffle, so a host with a third of all rows is one row per task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import sample_by_hash, stored, tidy
from tabloom.session import broadcast_if_small

#: About how many labelled documents the classifier is fitted on, chosen by a hash of their id.
SAMPLE = 20_000
BINS = 16
RIDGE = 1.0
_SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")

STATISTICS = (
    "words", "word_length", "distinct", "top_word", "top_pair", "repeat_next", "upper", "digit", "mark", "symbol",
    "stop_end", "capital_words", "long_word", "lines", "line_length", "same_lines", "squeeze", "letters", "spread",
)


def statistics(text: str | None) -> list[float]:
    """Numbers that describe how a text is written; all 0 for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, bare = len(words), text.translate(_SPACE)
    m = max(1, len(bare))
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = Counter(bare)
    upper = digit = letters = mark = symbol = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
        elif c.isdigit():
            digit += k
        elif c in ".,;:?'\"-()":
            mark += k
        else:
            symbol += k
    head = text.encode("utf-8", "replace")
    return [
        math.log(n), len(bare) / n, len(counts) / n**0.9, max(counts.values()) / n, max(pairs.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, upper / m, digit / m, mark / m, symbol / m,
        sum(w[-1] in ".!?" for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
        math.log(max(map(len, words))), math.log(len(lines)), math.log(m / len(lines)), 1 - len(set(lines)) / len(lines),
        len(zlib.compress(head, 1)) / len(head), letters / m, len(chars) / m**0.5,
    ]


def _design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column per bin of each statistic, and a constant."""
    parts = [np.eye(BINS)[np.searchsorted(edges[j], x[:, j], "right")] for j in range(x.shape[1])]
    return np.hstack([*parts, np.ones((len(x), 1))])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Bin edges, weights of a ridge-penalised logistic regression, and the log odds of the sample."""
    if not len(y) or y.min() == y.max():
        return np.zeros((len(STATISTICS), BINS - 1)), np.zeros(len(STATISTICS) * BINS + 1), 0.0
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    z, w = _design(x, edges), np.zeros(len(STATISTICS) * BINS + 1)
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    return edges, w, math.log(share / (1 - share))


def _moments(groups: DataFrame, rate: Column, good: str = "good", n: str = "n") -> float:
    """Strength of a Beta prior, in documents, from how far group rates lie from ``rate`` beyond chance."""
    s = groups.agg(
        F.sum(F.col(n) * (F.col(good) / F.col(n) - rate) ** 2).alias("between"), F.sum(rate * (1 - rate)).alias("chance"),
        F.sum(F.col(n) * rate * (1 - rate)).alias("whole"),
    ).first()
    if not s["whole"]:
        return 1.0
    # E[between] = chance + (whole - chance) / (strength + 1)
    extra = (s["between"] - s["chance"]) / max(s["whole"] - s["chance"], 1e-9)
    return float(min(max(1 / max(extra, 1e-6) - 1, 1.0), 1e6))


def classify(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = 0.5,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_rate, path_rate, quality, kept.

    ``labels`` has doc_id and quality (1 good, 0 bad); labels that are null or name no document are not used, a document
    labelled twice counts twice. A null host or path is a group of its own. Null and empty texts have all statistics 0.
    Without labels of both kinds all evidence is 0, the global rate is a half, and documents are kept. Rows that share an id
    are classified one by one. Other columns are ignored; an empty table gives an empty result; texts are read whole.
    """
    kind = "doc_id long, host string, path string, x array<double>"
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("x", pa.list_(pa.float64()))])

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema.field(i).type) for i in range(3)), pa.array(x, schema.field(3).type)], schema=schema)

    measured = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
            F.col(path_col).cast("string").alias("path"), F.col("text"),
        ).mapInArrow(measure, kind)
    )
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.where("y IS NOT NULL AND doc_id IS NOT NULL")
    some = sample_by_hash(known, sample, "doc_id")
    rows = some.join(measured.select("doc_id", "x"), "doc_id").select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort([rows["y"].to_numpy(), *x.T])  # the sums of the fit do not depend on how rows arrive
    x, rows = x[order], rows.iloc[order]
    edges, weights, odds = fit(x, rows["y"].to_numpy(float))

    @F.pandas_udf("double")
    def weigh(x: pd.Series) -> pd.Series:
        values = np.array(x.tolist(), float).reshape(-1, len(STATISTICS))
        return pd.Series(np.clip(_design(values, edges) @ weights - odds, -30, 30))

    scored = stored(measured.select("doc_id", "host", "path", weigh("x").alias("evidence")))
    # rows whose group is null meet through a flag beside the name
    keys = ["host", "host_null", "path", "path_null"]
    named = scored.select(
        "doc_id", "evidence", (1 / (1 + F.exp(-(F.col("evidence") + odds)))).alias("p"),
        F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("host_null"),
        F.coalesce("path", F.lit("")).alias("path"), F.col("path").isNull().alias("path_null"),
    )
    paths = stored(named.groupBy(*keys).agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = stored(paths.groupBy("host", "host_null").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")))
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    rate = min(max(whole["good"] / whole["n"], 1e-6), 1 - 1e-6) if whole["n"] else 0.5
    host_strength = _moments(hosts, F.lit(rate), "host_good", "host_n")
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + host_strength * rate) / (F.col("host_n") + host_strength))
    sites = stored(paths.join(hosts, ["host", "host_null"]))
    path_strength = _moments(sites, F.col("host_rate"))
    joined = named.join(broadcast_if_small(sites.drop("host_good", "host_n")), keys)
    path_rate = (F.col("good") - F.col("p") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    bounded = F.greatest(F.least(path_rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return joined.withColumn("path_rate", bounded).withColumn("quality", posterior).select(
        "doc_id", F.when(~F.col("host_null"), F.col("host")).alias("host"), F.when(~F.col("path_null"), F.col("path")).alias("path"),
        "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold - 1e-12).alias("kept"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are not rejected; columns as in ``docs``. A row without id stays; of rows that share an id
    all stay if one of them is kept."""
    verdicts = classify(docs, labels, **settings).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = verdicts.where("NOT kept").select("doc_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti").select(*docs.columns)
