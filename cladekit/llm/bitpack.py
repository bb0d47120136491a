"""Token ids in fixed-width bit-packed files, with block offsets for random access.

A file holds, one after the other: packed blocks of ``BLOCK`` ids (each starts at a byte), the documents'
ids and first positions, the blocks' byte offsets, and a fixed footer. Every id takes the bits that the vocabulary
needs. Files are written by tasks straight to the shared folder; a manifest table names the finished ones.

Cases: NULL text is the empty text and has the end id alone; NULL doc_id sorts first and is returned as NULL;
repeated doc_ids are ordered by their text; an empty table gives no file; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import batch_of, file_system, make_folder, new_file, stored, text_bytes
from .encoding import WORD_BPE, encoder, vocabulary_size

BLOCK = 1 << 16
_FOOTER = struct.Struct("<4sBQQQ")  # mark, bits, ids, documents, where the document table starts
_MARK = b"CKT1"
_READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit string of ``bits`` each."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return ids.view("u1").reshape(-1, 4)[:, : bits // 8].tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype="u4")) & 1
    return np.packbits(spread.astype("u1").ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(packed, "u1")
    if bits % 8 == 0:
        out = np.zeros((count, 4), "u1")
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
        return out.view("<u4").ravel()
    spread = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
    return (spread.astype("u4") << np.arange(bits, dtype="u4")).sum(axis=1, dtype="u4")


class PackedWriter:
    def __init__(self, path: str, bits: int):
        fs, self._name = file_system(path)
        self._out = fs.open_output_stream(self._name)
        self.path, self.bits, self.count, self._rest, self._held = path, bits, 0, [], 0
        self._blocks, self._docs, self._starts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._starts.append(self.count)
        self.count += len(ids) // 4
        self._rest.append(ids)
        self._held += len(ids) // 4
        if self._held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._rest), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, whole, BLOCK):
            self._blocks.append(self._out.tell())
            self._out.write(pack(ids[at : min(at + BLOCK, whole)], self.bits))
        self._rest, self._held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        table = self._out.tell()
        known = np.array([x is not None for x in self._docs], "u1")
        self._out.write(np.array([x or 0 for x in self._docs], "<i8").tobytes())
        self._out.write(known.tobytes())
        self._out.write(np.array(self._starts, "<u8").tobytes())
        self._out.write(np.array(self._blocks, "<u8").tobytes())
        self._out.write(_FOOTER.pack(_MARK, self.bits, self.count, len(self._docs), table))
        self._out.close()


class PackedReader:
    def __init__(self, path: str):
        fs, name = file_system(path)
        self._in = fs.open_input_file(name)
        size = self._in.size()
        mark, self.bits, self.count, n, table = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if mark != _MARK:
            raise ValueError(f"not a packed token file: {path}")
        ids = np.frombuffer(self._at(table, 8 * n), "<i8")
        known = np.frombuffer(self._at(table + 8 * n, n), "u1")
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.starts = np.append(np.frombuffer(self._at(table + 9 * n, 8 * n), "<u8").astype("i8"), self.count)
        at = table + 17 * n
        self.blocks = np.frombuffer(self._at(at, size - _FOOTER.size - at), "<u8")

    def _at(self, offset: int, size: int) -> bytes:
        self._in.seek(offset)
        return self._in.read(size)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive): only the blocks that hold them are read."""
        if last <= first:
            return np.empty(0, "<u4")
        parts = []
        for b in range(first // BLOCK, (last - 1) // BLOCK + 1):
            count = min(BLOCK, self.count - b * BLOCK)
            parts.append(unpack(self._at(int(self.blocks[b]), (count * self.bits + 7) // 8), self.bits, count))
        base = first // BLOCK * BLOCK
        return np.concatenate(parts)[first - base : last - base]

    def documents(self):
        """Each document's id, first position, length and checksum, read in bounded pieces."""
        held, base = np.empty(0, "<u4"), 0
        for k, doc in enumerate(self.doc_ids):
            first, last = int(self.starts[k]), int(self.starts[k + 1])
            crc, at = 0, first
            while at < last:
                if at >= base + len(held):
                    base = at // BLOCK * BLOCK
                    held = self.ids(base, min(self.count, base + _READ_IDS))
                upto = min(last, base + len(held))
                crc = zlib.crc32(held[at - base : upto - base].astype("<u4").tobytes(), crc)
                at = upto
            yield doc, first, last - first, crc


_FILES = "file_no int, path string, n_docs long, n_tokens long"
_FILES_ARROW = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_packed(docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, end_id: int = 2,
                 bits: int | None = None) -> DataFrame:
    """Write every document's ids, in doc_id order over all files; returns the manifest of the files.

    Texts are range-partitioned by doc_id (equal ids by a hash of their text, so a repeated id spreads).
    """
    bits = bits or bits_for(max(vocabulary_size(tokenizer), end_id + 1))
    make_folder(folder)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        enc, out, n = encoder(tokenizer), None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = out or PackedWriter(new_file(folder, f"part-{part:06d}"), bits)
                out.add(doc, enc.ids(text.as_py()) + end)
                n += 1
        if out:
            out.close()
            yield batch_of(_FILES_ARROW, [[part], [out.path], [n], [out.count]])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = (docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
            .repartitionByRange(*order).sortWithinPartitions(order[0], "text"))
    return stored(laid.mapInArrow(write, _FILES), "packed-manifest")


def read_packed(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, first, n, crc in PackedReader(path).documents():
                    rows.append((doc, base + first, n, crc))
                    if len(rows) == 4096:
                        yield batch_of(_DOCS_ARROW, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield batch_of(_DOCS_ARROW, list(zip(*rows, strict=True)))

    # one row for each file, not for each document
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks).mapInArrow(read, _DOCS)


def packed_round_trip(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    folder = work_path(docs.sparkSession, "packed")
    return read_packed(write_packed(docs, folder, tokenizer, end_id))
