"""Shuffled shards by a keyed permutation of row numbers.

Rows get global numbers in doc_id order. A four-round Feistel network permutes the smallest power of four that
holds them; a number that leaves the table walks on along its cycle until it is back inside. The permuted number
p gives shard p mod n and slot p div n, so shard sizes differ by one at most, slots have no gaps, and both a row's
place and a place's row can be computed without any table.

Cases: NULL text counts no bytes; NULL doc_ids are numbered first; rows alike in doc_id and text may change places among
themselves; an empty table gives no rows; further columns are ignored. Rows with equal texts are dealt like any others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

ROUNDS = 4


class Permutation:
    """A keyed permutation of 0 .. n-1 over numpy arrays, with its inverse."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (int(max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.shift = np.uint64(self.half)
        self.keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
                     for k in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.shift, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return (left << self.shift) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.shift, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._mix(left, key), left
        return (left << self.shift) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while (out := x >= self.n).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self._once)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self._back)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = 0) -> int:
    """The row number that stands in a slot."""
    return int(Permutation(n, seed).inverse(np.array([slot * shards + shard]))[0])


def _slim(text: Column) -> list[Column]:
    return [(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")]


def _placed(slim: DataFrame, shards: int, seed: int) -> DataFrame:
    rows = numbered(slim, F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), label="rows")
    n = rows.count()

    @F.pandas_udf("long")
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(row.to_numpy()))

    return (rows.withColumn("_p", permuted("row"))
            .withColumn("shard", (F.col("_p") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("_p") / shards).cast("long")).drop("_p"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot: each document's place. Only these narrow columns are moved."""
    return _placed(docs.select(F.col("doc_id").cast("long"), *_slim(F.col("text"))), shards, seed)


def write_shards(docs: DataFrame, folder: str, shards: int = 16, seed: int = 0, rows_per_file: int = 1_000_000) -> None:
    """Write whole rows as one folder per shard, in slot order inside files of a bounded number of rows.

    Rows get a key in a stored copy of the table, so repeated rows, and rows alike in id and checksum, keep apart. The files
    hold the table's columns and ``slot``; the shard is the folder's name.
    """
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("columns shard and slot are taken")
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"),
                               F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")), "shard-rows")
    places = _placed(keyed.select("key", F.col("whole.doc_id").cast("long").alias("doc_id"), *_slim(F.col("whole.text"))), shards, seed)
    part = F.floor(F.col("slot") / rows_per_file)
    (keyed.join(places.select("key", "shard", "slot"), "key").repartition("shard", part).sortWithinPartitions("shard", "slot")
     .select("whole.*", "shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder))
