"""Writers. None of them gathers rows on the driver."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.summary import sorted_matrix


def new_rows(batch: DataFrame, stored: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is neither stored nor repeated; NULL equals NULL."""
    fresh = batch.dropDuplicates(list(key))
    if stored is None:
        return fresh
    old = stored.select(*[F.col(k).alias(f"_s_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & fresh[k].eqNullSafe(old[f"_s_{k}"])
    return fresh.join(old, same, "left_anti")


def append_new(batch: DataFrame, path: str, key: Sequence[str], partition_by: Sequence[str] = ()):
    """Append rows whose key is not stored yet. Running it twice adds nothing.

    Duplicates are skipped row by row rather than batch by batch. Of the store only files are read
    that can hold a key of the batch, by what ``_keys`` beside the data says of each file.
    """
    files = files_with_keys(batch, path, key)
    stored = batch.sparkSession.read.option("basePath", path).parquet(*files) if files else None
    new_rows(batch, stored, key).write.mode("append").partitionBy(*partition_by).parquet(path)


# ---- many small text files ---------------------------------------------------------------

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_text_folders(lines: DataFrame, path: str, folder: str, value: str = "value") -> None:
    """Lines as text files, one folder ``<folder>=<value>`` per value of a whole-number column, as ``partitionBy(folder).text`` lays them out.

    For very many folders: a task writes its files itself, so none is made under one name and moved to another by the driver.
    A file holds the lines of one task that follow each other; it gets its name when it is whole, and another attempt of the
    task gives it the same name.
    """
    if dict(lines.dtypes)[folder] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{folder} is not a whole number")
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    rows = lines.select(F.coalesce(F.col(folder).cast("string"), F.lit(NO_VALUE)).alias("folder"), F.coalesce(value, F.lit("")).alias("value"))
    done = rows.mapInArrow(lambda batches: _written(batches, path, folder), "files long")
    done.agg(F.sum("files")).collect()


def _written(batches, path: str, name: str):
    """Write each run of rows of one folder; yields the number of files."""
    fs, root = pafs.FileSystem.from_uri(path)
    part, files, open_now, out, at = TaskContext.get().partitionId(), 0, None, None, None

    def close():
        out.close()
        fs.move(at[0], at[1])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column("folder"))
        start = 0
        for key, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
            if key != open_now:
                if out is not None:
                    close()
                where = f"{root}/{name}={key}"
                fs.create_dir(where, recursive=True)
                at = f"{where}/_{uuid.uuid4().hex}", f"{where}/part-{part:05d}-{files:06d}.txt"
                out, open_now, files = fs.open_output_stream(at[0], buffer_size=1 << 16), key, files + 1
            out.write(("\n".join(batch.column("value").slice(start, end - start).to_pylist()) + "\n").encode())
            start = end
    if out is not None:
        close()
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


# ---- which files can hold a key ----------------------------------------------------------

WORDS = 1024  # 64-bit words of a file's Bloom filter
FEW = 10_000  # first key values of a batch that are looked up one by one; beyond, their range counts


def _stored_files(spark, path: str) -> list[str]:
    """The data files of a store, none if it is not there yet; no data is read."""
    try:
        return [re.sub("^file:/+", "file:/", f) for f in spark.read.parquet(path).inputFiles()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return []


def _bits(value) -> list[Column]:
    """Two places in the Bloom filter."""
    return [F.pmod(F.xxhash64(F.lit(k), value), F.lit(64 * WORDS)).cast("int") for k in (1, 2)]


def key_index(rows: DataFrame, first: str) -> DataFrame:
    """One row per data file: range and Bloom filter of its ``first`` key column (as text), and whether it has NULLs."""
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    values = rows.select(file.alias("file"), F.col(first).cast("string").alias("v")).distinct()
    spans = values.groupBy("file").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bool_or(F.col("v").isNull()).alias("nulls"))
    places = values.where("v IS NOT NULL").select("file", F.explode(F.array(*_bits(F.col("v")))).alias("at"))
    words = places.groupBy("file", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
    filters = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bloom"))
    return spans.join(filters, "file", "left")


def _index(spark, path: str, first: str) -> DataFrame | None:
    """The index of a store, after files that it lacks (new ones, or those of a run that was cut off) were added."""
    files = _stored_files(spark, path)
    if not files:
        return None
    where, known = f"{path}/_keys", set()
    if _stored_files(spark, where):
        known = {r["file"] for r in spark.read.parquet(where).select("file").collect()}  # names alone
    lacking = [f for f in files if f not in known]
    if lacking:
        rows = spark.read.option("basePath", path).parquet(*lacking)
        key_index(rows, first).coalesce(1).write.mode("append").parquet(where)
    return spark.read.parquet(where).where(F.col("file").isin(files)) if len(files) < len(known) else spark.read.parquet(where)


def files_with_keys(batch: DataFrame, path: str, key: Sequence[str]) -> list[str]:
    """Data files of the store that can hold a key of the batch."""
    spark, first = batch.sparkSession, key[0]
    index = _index(spark, path, first)
    if index is None:
        return []
    wanted = batch.select(F.col(first).cast("string").alias("v")).distinct()
    few = [r["v"] for r in wanted.limit(FEW + 1).collect()]
    if len(few) > FEW:
        ends = wanted.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.bool_or(F.col("v").isNull()).alias("n")).first()
        hit = (F.col("low") <= ends["b"]) & (F.col("high") >= ends["a"])
        hit = hit | F.col("nulls") if ends["n"] else hit
    else:
        asked = spark.createDataFrame([(v,) for v in few if v is not None], "v string").select(
            F.struct("v", *[b.alias(f"b{k}") for k, b in enumerate(_bits(F.col("v")))]).alias("q"))
        index = index.withColumn("_asked", asked.agg(F.collect_list("q")).scalar())

        def held(q, at):
            word = F.coalesce(F.try_element_at("bloom", F.shiftright(q[at], 6)), F.lit(0).cast("long"))
            return F.getbit(word, q[at].bitwiseAND(63)) == 1

        hit = F.exists("_asked", lambda q: (F.col("low") <= q["v"]) & (q["v"] <= F.col("high")) & held(q, "b0") & held(q, "b1"))
        hit = hit | F.col("nulls") if None in few else hit
    return [r["file"] for r in index.where(hit).select("file").distinct().collect()]


def bulk_load(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_matrix(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> None:
    """Genome matrix with sorted rows and columns; fails if it exists unless told otherwise."""
    mode = "overwrite" if overwrite else "errorifexists"
    sorted_matrix(df, keys).orderBy(*keys).write.mode(mode).parquet(path)


def write_keyed(df: DataFrame, path: str, key: str = "matrix", overwrite: bool = False) -> None:
    """One folder per data matrix. Rows of a large matrix stay spread over tasks."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = True, overwrite: bool = False) -> None:
    out = df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True)
    out = out.option("compression", "gzip") if gzip else out
    out.csv(path)


def append_array(df: DataFrame, path: str, fill_missing: bool = False) -> None:
    """Grow a stored array table; missing numbers may be stored as 0."""
    if fill_missing:
        numbers = [c for c, t in df.dtypes if t in ("float", "double")]
        df = df.withColumns({c: F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)) for c in numbers})
        df = df.na.fill(0)
    df.write.mode("append").parquet(path)


def export_view(spark, sql: str, path: str, **args) -> None:
    """Write a parameterised query to CSV with a header."""
    write_csv(spark.sql(sql, args=args or None), path, gzip=False)
