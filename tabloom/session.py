"""Session settings and the two scale helpers every operator may need:
reliable checkpoints and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# A table may be shipped to every task only below both bounds.
SMALL_ROWS = 20_000
SMALL_BYTES = 16 * 1024 * 1024


def build_session(app_name: str = "tabloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew splitting and Arrow switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_partitions(spark: SparkSession) -> int:
    """Partitions for steps that multiply their input; adaptive merging by input
    size would leave such steps with too few tasks."""
    return max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def spread_out(df: DataFrame) -> DataFrame:
    """Deal an input to all cores where it comes in fewer partitions, as one file does. Inputs of many partitions, that
    is, all large ones, stay where they are read. Measured without reading any column."""
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if have >= want else df.repartition(want)


#: Rows of one task of ``dealt``.
DEALT_ROWS = 20_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Deal a table by keys over tasks of about ``rows`` rows each (``DEALT_ROWS``), for steps that multiply their rows: a file of a few
    megabytes can hold millions of rows, so what a task then holds must follow from the rows, not from bytes. Counted
    without reading other columns than the keys."""
    return df.repartition(row_tasks(df.select(*keys), rows or DEALT_ROWS), *keys)


def row_tasks(df: DataFrame, rows: int) -> int:
    """Tasks of about ``rows`` rows each for a table, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with its table, which is never to be sent whole. Spark's estimate follows the bytes of the
    file and leaves out what ``explode`` adds, so that it would broadcast millions of rows through the driver."""
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    temporary folder is used only where that is unset on a local master (tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-tabloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table to the checkpoint folder as Parquet and read it back; unlike a checkpoint it keeps its
    columns apart, so later steps read what they need. ``by`` names a column whose values become folders, so that a filter
    on it leaves out the others. The files go with the session."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(
    df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES
) -> list[Row] | None:
    """The rows of ``df`` when it is provably small, otherwise ``None``.

    The size is measured by one aggregate first, so at most ``max_bytes`` ever
    reach the driver.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    if size["n"] > max_rows or (size["b"] or 0) > max_bytes:
        return None
    return df.collect()


def broadcast_if_small(
    df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Add a broadcast hint after measuring the table; leave it as it is otherwise."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df
