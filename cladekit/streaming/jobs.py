"""Continuous ingest of tree files and running topology frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_newick
from ..operators.quartets import tree_records
from ..sources.files import block_columns, numbered, tree_rows
from ..sources.sinks import append_new


def tree_file_stream(
    spark: SparkSession, path: str, max_age: str = "180d", files_per_trigger: int = 1000,
) -> DataFrame:
    """Lines of new newick files as they arrive; files older than ``max_age`` are ignored.

    A batch holds whole files, each read in blocks, so a file may be larger than a task's memory.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFileAge", max_age).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    return block_columns(lines).drop("_bytes")


def arrived_trees(batch: DataFrame) -> DataFrame:
    """Tree records of a batch of lines; the kept lines of a file are numbered over its blocks.

    The numbering leaves the lines of a block in one task, so they are dealt over the cluster before they are parsed.
    """
    lines = batch.withColumn("_row", F.monotonically_increasing_id()).where(is_newick(F.col("line")))
    tasks = batch.sparkSession.sparkContext.defaultParallelism
    return tree_records(tree_rows(numbered(lines)), partitions=tasks)


def store_new_trees(
    stream: DataFrame, target: str, checkpoint: str,
    key: Sequence[str] = ("file_path", "tree_no"),
):
    """Append unseen trees, batch by batch. A repeated batch adds nothing."""
    def write(batch: DataFrame, _: int) -> None:
        append_new(arrived_trees(batch), target, key)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_topology_counts(stream: DataFrame, key: str = "sid", tid: str = "tid") -> DataFrame:
    """Counts per species tree and topology; state holds one number per pair."""
    return stream.groupBy(key, tid).agg(F.count(F.lit(1)).alias("n"))


COMPACT = 32  # batches of changes before the totals are written whole


def store_totals(counts: DataFrame, target: str, checkpoint: str, value: str = "n"):
    """Keep the changed totals of every batch; each ``COMPACT`` batches all of them are written once and older ones go.

    The totals themselves are state in the checkpoint. A batch writes a folder of its own, again if it is repeated.
    """
    keys = [c for c in counts.columns if c != value]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, whole = batch, batch_id % COMPACT == COMPACT - 1
        if whole:
            before = _changes(batch.sparkSession, target, batch_id)
            if before is not None:
                rows = _newest(before.unionByName(batch.withColumn("batch", F.lit(batch_id))), keys, value)
        rows.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if whole:
            # the last full table before this one is kept: a repeat of this batch starts from it
            _drop_batches(batch.sparkSession, target, batch_id - COMPACT)

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _changes(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Stored changes from the last full table on, of batches below ``before``."""
    try:
        df = spark.read.parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    df = df if before is None else df.where(F.col("batch") < before)
    start = df.where("whole").agg(F.max("batch")).first()[0]
    df = df if start is None else df.where(F.col("batch") >= start)
    return df.drop("whole")


def _newest(changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def _drop_batches(spark: SparkSession, target: str, below: int) -> None:
    """Remove the folders of batches below a number."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < below:
            fs.delete(status.getPath(), True)


def latest_totals(spark: SparkSession, target: str, value: str = "n") -> DataFrame:
    """The current totals: of each key the newest change since the last full table."""
    changes = _changes(spark, target)
    return _newest(changes, [c for c in changes.columns if c not in (value, "batch")], value)


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str] = (), width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Rows per tumbling window and key: ``start``, keys, ``n``.

    A row counts as long as its window has not ended ``late`` before the latest time seen in earlier batches; state of
    older windows is dropped.
    """
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_w.start").alias("start"), *keys, "n")
