"""Helpers shared by the operators: stored tables, files, ranks and connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path

ROWS_PER_SALT = 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that outlive executors.

    The write's shuffle files go as soon as it has ended, so they don't add up over the steps of an operator.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; NULL becomes the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str) -> str:
    """A name no other attempt of the same task uses; only a finished attempt's name reaches the manifest."""
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}.bin"


def make_folder(folder: str) -> str:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return folder


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def numbered(df: DataFrame, *order: Column, label: str) -> DataFrame:
    """Global row numbers ``row`` (0, 1, ...) in the given order, stored in the shared folder.

    Rows are range-partitioned and sorted, so no task holds more than its range; one total per
    partition (not per row) is scanned to give each partition its first number.
    """
    place = F.monotonically_increasing_id()
    laid = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1)),
        label)
    totals = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    first = totals.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_first"))
    # one row for each partition: far below any broadcast limit
    return (laid.join(F.broadcast(first), "_part")
            .withColumn("row", F.coalesce("_first", F.lit(0)) + F.col("_at")).drop("_part", "_at", "_first"))


def spread_rank(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """Number the rows of each key from 0 (``rank``) without bringing a key's rows into one task.

    Rows of a key are dealt into ``salts`` parts by a hash of ``order``, numbered inside each part,
    and moved up by the sizes of the parts before.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return (salted.withColumn("_in", inside).join(before, [key, "_salt"])
            .withColumn("rank", F.col("_in") + F.col("_before")).drop("_salt", "_in", "_before"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of (``a``, ``b``) links: one row (``id``, ``component``) for each linked id.

    The component is the smallest id reachable. Each round every node goes to the smallest of its neighbours and itself
    and on to where that one goes; then the links are drawn between these nodes only. So at least
    half of the linked nodes go in each round, and the links shrink with them. Every round is a stored table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where(F.col("a") != F.col("b")).distinct(), f"{label}-links")
    found = both.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    turn = 0
    while both.limit(1).count():
        turn += 1
        step = stored(both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("to")), f"{label}-step-{turn}")
        on = step.select(F.col("a").alias("to"), F.col("to").alias("_on"))
        goes = stored(step.join(on, "to").select(F.col("a").alias("node"), F.col("_on").alias("at")), f"{label}-goes-{turn}")
        to_a, to_b = (goes.select(F.col("node").alias(x), F.col("at").alias(f"_{x}")) for x in "ab")
        both = stored(both.join(to_a, "a").join(to_b, "b").where("_a != _b")
                      .select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), f"{label}-links-{turn}")
        found = stored(found.join(goes, found["component"] == goes["node"], "left")
                       .select("id", F.coalesce("at", "component").alias("component")), f"{label}-{turn}")
    return found
