"""Token counts by separator scan: documents of flat token files are found from their end ids alone.

A flat file is nothing but fixed-width ids. It is cut into blocks that are searched one by one; a document that runs
over block borders is put together by a prefix scan over one summary row for each block.

Cases: NULL text is empty and counts 0 ids; ids after a file's last separator form one more document, marked
``ended`` false; an empty file or table gives no rows; repeated and NULL doc_ids keep one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import batch_of, file_system, make_folder, new_file, stored, text_bytes
from .encoding import WORD_BPE, encoder

BLOCK_IDS = 1 << 20
_SIDE = "file_no int, path string, ordinal long, doc_id long, file_bytes long"
_SIDE_ARROW = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("ordinal", pa.int64()),
                         ("doc_id", pa.int64()), ("file_bytes", pa.int64())])
_ENDS = "file_no int, block long, k int, n long, size long"
_ENDS_ARROW = pa.schema([("file_no", pa.int32()), ("block", pa.int64()), ("k", pa.int32()), ("n", pa.int64()),
                         ("size", pa.int64())])


def write_flat(docs: DataFrame, folder: str, end_id: int, tokenizer: str = WORD_BPE, width: int = 2) -> DataFrame:
    """Write each partition's documents as one flat file of ``width``-byte ids; nothing is shuffled.

    Returns one row per document: its file, place in the file and doc_id, and the file's size. Strings of special tokens
    in a text count as ordinary text, so the end id occurs only between documents.
    """
    make_folder(folder)
    kind = f"<u{width}"

    def write(batches):
        enc, out, n, ids = encoder(tokenizer, True), None, 0, []
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    path = new_file(folder, f"flat-{part:06d}")
                    fs, name = file_system(path)
                    out = fs.open_output_stream(name)
                found = np.frombuffer(enc.ids(text.as_py()), "<u4")
                out.write(np.append(found, np.uint32(end_id)).astype(kind).tobytes())
                ids.append(doc)
        if out:
            size = out.tell()
            out.close()
            n = len(ids)
            for at in range(0, n, 10_000):
                some = ids[at : at + 10_000]
                m = len(some)
                yield batch_of(_SIDE_ARROW, [[part] * m, [path] * m, range(at, at + m), some, [size] * m])

    return stored(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(write, _SIDE),
                  "flat-side")


def scan_flat(files: DataFrame, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of flat files (``file_no``, ``path``, ``file_bytes``): file_no, ordinal, n_tokens, ended.

    n_tokens leaves the separator out.
    """
    kind, step = f"<u{width}", block_ids * width

    def search(batches):
        for batch in batches:
            for file_no, path, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(step), kind)
                ends = np.flatnonzero(ids == end_id)
                # k -1: the ids after the last separator; 0: those up to the first one; then whole documents
                lengths = np.diff(np.concatenate(([-1], ends))) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                n = np.concatenate(([tail], lengths))
                m = len(n)
                yield batch_of(_ENDS_ARROW, [[file_no] * m, [block] * m, np.arange(-1, m - 1), n, [len(ends)] * m])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.greatest(F.floor((F.col("file_bytes") - 1) / step), F.lit(0)).cast("long")
    blocks = (files.where("file_bytes > 0").select("file_no", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
              .repartition(tasks))
    found = stored(blocks.mapInArrow(search, _ENDS), "separators")

    # the prefix scan: one row for each block
    order = Window.partitionBy("file_no").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tails = (found.where("k = -1").select("file_no", "block", F.col("n").alias("tail"), "size")
             .withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
             .withColumn("run", F.coalesce(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).over(before), F.lit(0))))
    in_run = Window.partitionBy("file_no", "run").orderBy("block")
    # all tails of a run but its first block's come from blocks without separator
    carried = tails.withColumn("_tail_before", F.lag("tail", 1, 0).over(order)).withColumn(
        "carry", F.sum("_tail_before").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    ended = (found.where("k >= 0").join(carried.select("file_no", "block", "first", "carry"), ["file_no", "block"])
             .select("file_no", (F.col("first") + F.col("k")).alias("ordinal"),
                     (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
                     F.lit(True).alias("ended")))
    rest = (carried.groupBy("file_no").agg(
                F.max_by(F.struct((F.col("first") + F.col("size")).alias("ordinal"),
                                  (F.col("tail") + F.when(F.col("size") == 0, F.col("carry")).otherwise(0)).alias("n")),
                         "block").alias("x"))
            .where("x.n > 0").select("file_no", "x.ordinal", F.col("x.n").alias("n_tokens"), F.lit(False).alias("ended")))
    return ended.unionByName(rest)


def document_counts(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 49407) -> DataFrame:
    """Write ``docs`` as flat files and count each document's ids by scanning them: doc_id, n_tokens."""
    spark: SparkSession = docs.sparkSession
    side = write_flat(docs, work_path(spark, "flat"), end_id, tokenizer)
    files = side.where("ordinal = 0").select("file_no", "path", "file_bytes")
    return (scan_flat(files, end_id).join(side.select("file_no", "ordinal", "doc_id"), ["file_no", "ordinal"])
            .select("doc_id", "n_tokens"))
