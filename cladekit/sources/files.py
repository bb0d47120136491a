"""Readers for tree, site-count, quartet, alignment, prediction and matrix files."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import trees as T
from ..functions.scalars import is_newick
from .names import base_name, file_name, folder_name

MIN_BYTES = 2048


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               view: str | None = None) -> DataFrame:
    """A Parquet table, narrowed to the columns asked for."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if view:
        df.createOrReplaceTempView(view)
    return df


LISTING_TASKS = 64


@contextmanager
def _listing(spark: SparkSession):
    """Folders are listed by so many tasks while a reader is made; the default is a task a folder, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTING_TASKS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _whole_files(spark: SparkSession, path, modified_after: str | None, min_bytes: int | None):
    reader = spark.read.option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    with _listing(spark):
        files = reader.text(path, wholetext=True)
    df = files.select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
    )
    if min_bytes is not None:
        df = df.where(F.col("file_size") > min_bytes)
    return df.drop("file_size")


def _lines(value="value") -> Column:
    return F.split(value, r"\r?\n")


_FILE_BLOCK = ["file_path", "_block"]


def _blocks_before():
    return Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _in_block():
    return Window.partitionBy(*_FILE_BLOCK).orderBy("_row")


def block_columns(lines: DataFrame) -> DataFrame:
    """Lines of text files with file, block and order: ``line, file_path, _block, _row, _bytes``. For batch and stream readers."""
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_bytes"))


def block_lines(
    spark: SparkSession, path, modified_after: str | None = None, min_bytes: int | None = None,
) -> DataFrame:
    """Lines of files of any size, read block by block. ``_row`` orders the lines of a block.

    What a line means may depend on lines of blocks before (a header, an open section, a count). The readers below sum up
    each block in one row, carry these rows along the file, and join them to the lines by file and block. So no file has
    to fit in one row or one task.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    with _listing(spark):
        lines = block_columns(reader.text(path))
    if min_bytes is not None:
        lines = lines.where(F.col("_bytes") > min_bytes)
    return lines.drop("_bytes").withColumn("_row", F.monotonically_increasing_id())


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``pos``, their 0-based place among the lines of their file."""
    sizes = lines.groupBy(*_FILE_BLOCK).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*_FILE_BLOCK, F.coalesce(F.sum("_size").over(_blocks_before()), F.lit(0)).alias("_before"))
    return lines.join(offsets, _FILE_BLOCK).withColumn(
        "pos", (F.col("_before") + F.row_number().over(_in_block()) - 1).cast("long")).drop("_before", "_block", "_row")


def numbered_lines(
    spark: SparkSession, path, keep, modified_after: str | None = None,
    min_bytes: int | None = None,
) -> DataFrame:
    """Kept lines of files of any size with their 0-based place in the file: ``pos, line``.

    The kept lines of the blocks before give the offset of a block.
    """
    return numbered(block_lines(spark, path, modified_after, min_bytes).where(keep(F.col("line"))))


def _carried(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """``lines`` with ``name``: whether ``flag`` holds on an earlier line of the file."""
    blocks = lines.groupBy(*_FILE_BLOCK).agg(F.bool_or(flag).alias("_any"))
    before = blocks.select(*_FILE_BLOCK, F.coalesce(F.bool_or("_any").over(_blocks_before()), F.lit(False)).alias("_carry"))
    here = F.coalesce(F.bool_or(flag).over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return lines.join(before, _FILE_BLOCK).withColumn(name, F.col("_carry") | here).drop("_carry")


def tree_lines(files: DataFrame) -> DataFrame:
    """Newick rows of whole-file text; numbers count the kept lines unless a line has its own."""
    kept = F.filter(_lines(), is_newick)
    return tree_rows(files.select("file_path", F.posexplode(kept).alias("pos", "line")))


def tree_rows(rows: DataFrame) -> DataFrame:
    words = F.split(F.trim("line"), r"\s+")
    own = F.when(F.size(words) == 2, words[0].try_cast("long"))
    return rows.select(
        "file_path", F.element_at(words, -1).alias("newick"),
        F.coalesce(own, F.col("pos")).alias("tree_no"),
    )


def read_tree_files(
    spark: SparkSession, path, modified_after: str | None = None, min_bytes: int | None = None,
    large: bool = False,
) -> DataFrame:
    """Newick files, plain or gzipped: ``file_path, tree_no, newick``.

    ``modified_after`` (a timestamp text) and ``min_bytes`` skip old and near-empty files.
    Small files are read whole; ``large`` reads in blocks and costs one shuffle.
    """
    if large:
        return tree_rows(numbered_lines(spark, path, is_newick, modified_after, min_bytes))
    return tree_lines(_whole_files(spark, path, modified_after, min_bytes))


def read_trees(spark: SparkSession, path, outgroup: str | None = None) -> DataFrame:
    """Every line that ends in a semicolon, in file order; rooted on ``outgroup`` (NULL in trees that lack it)."""
    rows = numbered_lines(spark, path, lambda s: s.endswith(";"))
    rows = rows.select("file_path", F.col("pos").alias("tree_no"), F.col("line").alias("newick"))
    if outgroup is None:
        return rows
    return rows.withColumn("newick", T.text(T.reroot(T.parse("newick"), outgroup)))


def _filled(line) -> Column:
    return F.length(F.trim(line)) > 0


def read_site_counts(spark: SparkSession, path, min_bytes: int | None = None,
                     large: bool = False) -> DataFrame:
    """Headerless tab-separated files; columns 2-5 are the counts, the line number the tree."""
    if large:
        df = numbered_lines(spark, path, _filled, None, min_bytes)
        df = df.withColumnRenamed("pos", "tree_no")
    else:
        df = _whole_files(spark, path, None, min_bytes).select(
            "file_path", F.posexplode(F.filter(_lines(), _filled)).alias("tree_no", "line"))
    cells = F.split("line", "\t")
    names = ("top_1", "top_2", "top_3", "nsites")
    return df.select(
        "file_path", "tree_no",
        *[F.get(cells, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


QUARTET_COLUMNS = ("Seq1", "Seq2", "Seq3", "Seq4", "qCF", "qDF1", "qDF2", "qN")


WHOLE_BYTES = 4 << 20  # quartet files up to this size are read as one row


def read_quartets(spark: SparkSession, path) -> DataFrame:
    """Whitespace-separated quartet files with a header line; rows with a gap are dropped.

    The first line of a file names the columns of all its blocks. As a row it has gaps, and so drops out.
    Files of up to ``WHOLE_BYTES`` are read whole, which needs no shuffle. Of larger ones the headers, at most one row
    for so many bytes of input, are gathered first and broadcast to the blocks.
    """
    with _listing(spark):
        reader = spark.read.option("recursiveFileLookup", True)
        whole, blocks = reader.text(path, wholetext=True), reader.text(path)
    size = F.col("_metadata.file_size")
    small = whole.where(size <= WHOLE_BYTES).select("value", F.col("_metadata.file_path").alias("file_path"))
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r\n|\r|\n"), _filled)
    # outer: or the size of the list would be asked for before it is made, which makes it twice
    small = small.select("file_path", lines.alias("_lines")).withColumn("_at", _places(F.get("_lines", F.lit(0)))).select(
        "file_path", "_at", F.explode_outer("_lines").alias("line"))
    large = block_columns(blocks.where(size > WHOLE_BYTES)).where(_filled("line")).drop("_bytes")
    first = large.withColumn("_row", F.monotonically_increasing_id()).groupBy("file_path").agg(
        F.min(F.struct("_block", "_row", "line"))["line"].alias("_first"))
    heads = F.broadcast(first.select("file_path", _places("_first").alias("_at")))
    rows = small.unionByName(large.drop("_block").join(heads, "file_path"))
    # generators of one row: filters above are not worked out from the steps below them
    split = rows.select("file_path", "_at", F.explode(F.array(F.split(F.trim("line"), r"\s+"))).alias("_cells"))
    cells = [F.get("_cells", F.get("_at", F.lit(i))).try_cast("int" if c.startswith("Seq") else "double").alias(c)
             for i, c in enumerate(QUARTET_COLUMNS)]
    out = split.select("file_path", F.explode(F.array(F.struct(*cells))).alias("_q")).select("file_path", "_q.*")
    return out.na.drop(subset=list(QUARTET_COLUMNS))


def _places(head) -> Column:
    """Where each of ``QUARTET_COLUMNS`` stands in a header line; -1 for one it lacks."""
    names = F.split(F.trim(head), r"\s+")
    return F.array(*[(F.array_position(names, F.lit(c)) - 1).cast("int") for c in QUARTET_COLUMNS])


def clean_quartet_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw quartet output without its second column, comments, headers and repeats."""
    body = lines.where(~F.col(column).startswith("#") & ~F.lower(F.col(column)).startswith("id\t"))
    cells = F.split(column, "\t")
    rest = F.concat(F.slice(cells, F.lit(1), F.lit(1)), F.slice(cells, F.lit(3), F.size(cells)))
    return body.select(F.array_join(rest, "\t").alias(column)).distinct()


def alignment_rows(files: DataFrame) -> DataFrame:
    """Taxa of NEXUS text held in a column: ``gene, ix, name, seq, seq_length``."""
    block = F.regexp_extract("value", r"(?is)matrix\s*(.*?);", 1)
    lines = F.filter(F.split(block, r"\r?\n"), _is_taxon)
    return _taxa(files.select("file_path", F.posexplode(lines).alias("pos", "line")))


def _is_taxon(line) -> Column:
    return F.trim(line).rlike(r"^\S+\s+\S")


def _taxa(rows: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.trim("line"), r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_extract(F.trim("line"), r"^\S+\s+(.*)$", 1), r"\s", "")
    return rows.select(
        "file_path", F.regexp_replace(file_name("file_path"), r"\.nex$", "").alias("gene"),
        (F.col("pos") + 1).alias("ix"), F.regexp_replace(name, "@", "_").alias("name"),
        seq.alias("seq"), F.length(seq).alias("seq_length"))


def read_alignments(spark: SparkSession, path) -> DataFrame:
    """Taxa of NEXUS files of any size, numbered from 1: the lines behind the first ``matrix`` up to the next semicolon."""
    lines = block_lines(spark, path)
    opens = F.lower("line").contains("matrix")
    lines = _carried(lines, opens, "_begun").where(F.col("_begun") | opens)
    lines = lines.withColumn("line", F.when(~F.col("_begun"), F.regexp_replace("line", r"(?i)^.*?matrix\s*", "")).otherwise(F.col("line")))
    lines = _carried(lines, F.col("line").contains(";"), "_ended").where(~F.col("_ended"))
    lines = lines.withColumn("line", F.substring_index("line", ";", 1))
    return _taxa(numbered(lines.where(_is_taxon("line")).drop("_begun", "_ended")))


def read_matrices(spark: SparkSession, paths: Sequence[str], dropna: bool = True) -> DataFrame:
    """Genome matrices from several places as one table."""
    df = spark.read.option("mergeSchema", True).parquet(*paths).drop("randomcolumn")
    return df.na.drop("any") if dropna else df


def read_keyed(spark: SparkSession, path: str, key: str = "matrix") -> DataFrame:
    """Every data matrix of a keyed store; its key is a column and prunes folders."""
    df = spark.read.parquet(path)
    if key not in df.columns:
        raise ValueError(f"{path} is not partitioned by {key}")
    return df.drop("randomcolumn")


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction CSV files with the folder name that holds their condition."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumn("folder", folder_name(F.col("_metadata.file_path")))


def read_by_gene(spark: SparkSession, path: str) -> DataFrame:
    """Quartet tables, one Parquet file or folder per gene, with the gene name as a column."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    where = F.col("_metadata.file_path")
    own = F.when(base_name(where).startswith("part-"), folder_name(where)).otherwise(base_name(where))
    return df.withColumn("gene", F.regexp_extract(own, r"^([^.]*)", 1))


TASK_ROWS = 1_000_000  # rows of a partition after a read


def read_repartitioned(spark: SparkSession, path: str, partitions: int) -> DataFrame:
    """A stored table in ``partitions`` parts; in more where they would hold over ``TASK_ROWS`` rows. Files tell their rows without a scan."""
    df = spark.read.parquet(path)
    return df.repartition(max(partitions, -(-df.count() // TASK_ROWS)))
