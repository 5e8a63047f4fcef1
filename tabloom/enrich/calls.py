"""Model calls over a table of requests.

``predict`` takes one request (a dict of the row) and returns the response text
or a dict with ``text``, ``input_tokens`` and ``output_tokens``. Parallelism is
partitions times ``concurrency`` threads per task.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message parts of errors that are worth another attempt.
TRANSIENT_MARKERS = (
    "connection error", "connection reset", "connection aborted",
    "timeout", "timed out", "deadline exceeded",
    "429", "503", "502", "504", "529",
    "rate limit", "rate-limit", "ratelimit", "too many requests",
    "temporarily unavailable", "service unavailable",
    "upstream", "bad gateway", "overloaded",
)
MAX_ATTEMPTS = 4
BASE_DELAY = 2.0

_ANSWER = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)


def is_transient(message: Column) -> Column:
    """The error message names a passing condition."""
    low, hit = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for marker in TRANSIENT_MARKERS:
        hit = hit | low.contains(marker)
    return hit


def _transient(message: str) -> bool:
    return any(marker in message.lower() for marker in TRANSIENT_MARKERS)


def _call(predict: Callable, request: dict, max_attempts: int, base_delay: float) -> tuple:
    for attempt in range(1, max_attempts + 1):
        try:
            answer = predict(request)
            if isinstance(answer, dict):
                return (
                    answer.get("text"), None, attempt,
                    int(answer.get("input_tokens", 0)), int(answer.get("output_tokens", 0)),
                )
            return answer, None, attempt, 0, 0
        except Exception as failure:  # a failed call is a row with an error, not a failed job
            if attempt == max_attempts or not _transient(str(failure)):
                return None, str(failure) or type(failure).__name__, attempt, 0, 0
            time.sleep(base_delay * 2 ** (attempt - 1))
    raise AssertionError("unreachable")


def _paced(predict: Callable, per_minute: float) -> Callable:
    """Calls start at least 60 / ``per_minute`` seconds after one another, whichever thread makes them."""
    lock, free = threading.Lock(), [time.monotonic()]

    def send(request: dict):
        with lock:
            wait = free[0] - time.monotonic()
            free[0] = max(free[0], time.monotonic()) + 60 / per_minute
        if wait > 0:
            time.sleep(wait)
        return predict(request)

    return send


def infer(
    requests: DataFrame,
    predict: Callable[[dict], object],
    concurrency: int = 8,
    max_attempts: int = MAX_ATTEMPTS,
    base_delay: float = BASE_DELAY,
    keep: list[str] | None = None,
    per_minute: float | None = None,
) -> DataFrame:
    """One call per request row; adds response, error, attempts and token counts.

    ``keep`` names the request columns of the result (default all); leave large
    ones such as image bytes out. ``per_minute`` spaces the calls of one task,
    further attempts included; tasks run side by side, so a service's own limit
    is to be divided by the cores of the cluster. The result is lazy: reading it
    twice calls twice, :func:`ask` with a store does not.
    """
    kept = keep or requests.columns
    schema = T.StructType([requests.schema[c] for c in kept] + _ANSWER.fields)

    def run(batches):
        send = _paced(predict, per_minute) if per_minute else predict
        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for batch in batches:
                rows = batch.to_dict("records")
                answers = list(pool.map(lambda r: _call(send, r, max_attempts, base_delay), rows))
                extra = pd.DataFrame(answers, columns=_ANSWER.names, index=batch.index)
                yield pd.concat([batch[kept], extra], axis=1)

    return requests.mapInPandas(run, schema)


def request_hash(requests: DataFrame, columns: list[str]) -> DataFrame:
    """Add the digest of a request's content; bytes count by their own digest."""
    kinds = dict(requests.dtypes)
    cells = [
        F.coalesce(F.sha2(F.col(f"`{c}`"), 256) if kinds[c] == "binary" else F.col(f"`{c}`").cast("string"), F.lit(""))
        for c in columns
    ]
    return requests.withColumn("request_hash", F.sha2(F.concat_ws("\u0001", *cells), 256))


def infer_stored(
    requests: DataFrame, predict: Callable[[dict], object], store: str, columns: list[str], **options
) -> DataFrame:
    """Like :func:`infer`, but answers live in a parquet table keyed by request.

    Equal requests are called once, and a rerun calls only what the table does
    not hold yet, so a lost executor or a repeated job does not repeat paid calls
    of finished runs.
    """
    spark = requests.sparkSession
    keyed = request_hash(requests, columns)
    schema = T.StructType([T.StructField("request_hash", T.StringType())] + _ANSWER.fields)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = keyed.select("request_hash", *[F.col(f"`{c}`") for c in columns]).dropDuplicates(["request_hash"])
    if files.exists(path):
        done = spark.read.schema(schema).parquet(store).filter("error is null")
        todo = todo.join(done, "request_hash", "left_anti")
    answers = infer(todo, predict, keep=["request_hash"], **options)
    answers.write.mode("append").parquet(store)
    known = spark.read.schema(schema).parquet(store)
    # A later success replaces an earlier failure of the same request.
    best = known.groupBy("request_hash").agg(
        F.min_by(F.struct(*_ANSWER.names), F.col("error").isNotNull()).alias("_answer")
    )
    joined = keyed.join(best, "request_hash", "left")
    return joined.select(*requests.columns, "request_hash", "_answer.*")


def ask(
    requests: DataFrame, predict: Callable[[dict], object], keep: list[str], store: str | None = None, **options
) -> DataFrame:
    """The ``keep`` columns of each request with its answer: how every model operator calls.

    With ``store`` (a folder that all executors share) the answers are committed there before this returns, keyed by
    what is sent, that is, all columns but ``keep``. The result only reads them, so any number of sinks, a recomputed
    partition or a rerun costs no further call; equal requests are sent once, and failed ones again on the next run.
    """
    if store is None:
        return infer(requests, predict, keep=keep, **options)
    content = [c for c in requests.columns if c not in keep]
    answered = infer_stored(requests, predict, store, content, **options)
    return answered.select(*[F.col(f"`{c}`") for c in keep], *_ANSWER.names)
