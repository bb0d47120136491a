"""Best-fit packing of token pieces into sequences by linear grouping.

A plan is made from the piece lengths alone (at most ``capacity`` of them, with their counts, so its size does not depend
on the number of documents):

1. large lengths are sorted and cut into groups of equal cardinality, and each is rounded up to its group's largest;
2. a configuration program over these few sizes is solved by column generation, and its whole parts are taken;
3. the real lengths of each group are put in the places of its rounded size, which frees what rounding took;
4. what is left of the large ones, then the small ones, goes where it fits best, longest first.

Equal bins stay together as runs, so a step handles a length, not a document. Pieces then find their place by their
rank among the pieces of their length.

Cases: an empty or NULL text has its end id alone; a document longer than the capacity is cut; repeated rows and equal
lengths are packed one by one; an empty table packs to no sequence; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_SALT, batch_of, spread_rank, stored, text_bytes
from .encoding import WORD_BPE, encoder

CAPACITY = 4096
LARGE_SHARE = 8  # lengths over capacity / LARGE_SHARE are large
GROUPS = (12, 24, 48)  # more groups round less, fewer leave less over from whole configurations: the best plan counts

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Ids of each whole text and the end id, cut into pieces of at most ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc, rows = encoder(tokenizer), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if len(rows) == 8192:
                        yield batch_of(_PIECES_ARROW, list(zip(*rows, strict=True)))
                        rows = []
        if rows:
            yield batch_of(_PIECES_ARROW, list(zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(cut, _PIECES)


def group_sizes(counts: np.ndarray, large_from: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality of the large lengths, longest first: (rounded size, [(length, count)])."""
    total = int(counts[large_from:].sum())
    out, at, held, members = [], 0, 0, []
    room = lambda k: total * (k + 1) // groups - total * k // groups
    for length in range(len(counts) - 1, large_from - 1, -1):
        left = int(counts[length])
        while left:
            while at < groups - 1 and room(at) == 0:
                at += 1
            take = min(left, room(at) - held)
            members.append((length, take))
            held, left = held + take, left - take
            if held == room(at):
                out.append((members[0][0], members))
                at, held, members = at + 1, 0, []
    # groups that round to one size are one group
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, inside in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(inside)
        else:
            merged.append((size, inside))
    return merged


def best_column(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest price that fits: an unbounded knapsack over few sizes."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    most = capacity // min(sizes)
    for _ in range(most):  # each pass allows one item more
        better, which = value.copy(), last.copy()
        for k, s in enumerate(sizes):
            if prices[k] > 1e-12:
                new = value[:-s] + prices[k] if s <= capacity else value[:0]
                up = new > better[s:] + 1e-12
                better[s:][up], which[s:][up] = new[up], k
        if np.array_equal(better, value):
            break
        value, last = better, which
    pattern, at = np.zeros(len(sizes), int), capacity
    while at > 0:
        k = last[at]
        if k < 0:
            break
        pattern[k] += 1
        at -= sizes[k]
    return float(pattern @ prices), pattern


def solve_configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fewest bins that hold ``demand`` of each size, in fractions: (pattern, how many)."""
    n = len(sizes)
    basis = np.zeros((n, n))
    for k, s in enumerate(sizes):
        basis[k, k] = capacity // s
    amount = demand / np.diag(basis)
    for _ in range(60 * n):
        prices = np.linalg.solve(basis.T, np.ones(n))
        gain, pattern = best_column(sizes, np.maximum(prices, 0), capacity)
        if gain <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = pattern
    return [(basis[:, k].astype(int), float(amount[k])) for k in range(n)]


class Bins:
    """Runs of bins with equal room: (first sequence, how many, used), found by room."""

    def __init__(self, capacity: int, next_rank: np.ndarray):
        self.capacity, self.next_rank, self.next_bin = capacity, next_rank, 0
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def keep(self, first: int, n: int, used: int) -> None:
        if n and used < self.capacity:
            self.by_room[self.capacity - used].append((first, n))
            self.open[self.capacity - used] = True

    def put(self, length: int, first: int, n: int, used: int, each: int) -> None:
        """``each`` pieces of one length in each of ``n`` bins, from place ``used``."""
        rank = int(self.next_rank[length])
        self.rows.append((length, rank, rank + n * each, first, each, used))
        self.next_rank[length] += n * each

    def best_fit(self, length: int, count: int) -> None:
        while count:
            rooms = np.flatnonzero(self.open[length:])
            if len(rooms):
                room = length + int(rooms[0])
                first, n = self.by_room[room].pop()
                self.open[room] = bool(self.by_room[room])
            else:
                room, first, n = self.capacity, self.next_bin, -(-count // (self.capacity // length))
                self.next_bin += n
            used, each = self.capacity - room, room // length
            full = min(n, count // each)
            if full:
                self.put(length, first, full, used, each)
                self.keep(first, full, used + each * length)
                count -= full * each
            if full < n and count:
                self.put(length, first + full, 1, used, count)
                self.keep(first + full, 1, used + count * length)
                full, count = full + 1, 0
            self.keep(first + full, n - full, used)


def plan(counts: np.ndarray, capacity: int = CAPACITY, large_share: int = LARGE_SHARE, groups: tuple[int, ...] = GROUPS) -> np.ndarray:
    """Where the pieces of each length go, from ``counts[length]``: of one plan for each number of groups, the one with
    the fewest sequences.

    Rows (length, from rank, to rank, first sequence, pieces in each, place): pieces of this length with these ranks go, so
    many in each, into the sequences from the first one on, one after the other from this place.
    """
    made = [_plan(counts.astype(np.int64), capacity, large_share, n) for n in groups]
    return np.array(min(made, key=lambda b: b.next_bin).rows, np.int64).reshape(-1, 6)


def _plan(counts: np.ndarray, capacity: int, large_share: int, groups: int) -> Bins:
    counts = counts.copy()
    bins = Bins(capacity, np.zeros(capacity + 1, np.int64))
    large_from = capacity // large_share + 1
    grouped = group_sizes(counts, large_from, groups)
    if grouped:
        sizes, waiting = [s for s, _ in grouped], [list(m) for _, m in grouped]
        demand = np.array([sum(n for _, n in m) for m in waiting], float)
        for pattern, amount in solve_configurations(sizes, demand, capacity):
            n = int(amount + 1e-9)
            if not n or not pattern.any():
                continue
            runs = [(bins.next_bin, n, 0)]
            bins.next_bin += n
            for k in np.flatnonzero(pattern):
                for _ in range(pattern[k]):
                    runs = _substitute(bins, runs, waiting[k], counts)
            for first, m, used in runs:
                bins.keep(first, m, used)
    for length in range(capacity, 0, -1):
        if counts[length]:
            bins.best_fit(length, int(counts[length]))
    return bins


def _substitute(bins: Bins, runs: list, waiting: list, counts: np.ndarray) -> list:
    """Put one real piece of a group into every bin of the runs; bins stay short when the group runs out."""
    out = []
    for first, n, used in runs:
        while n and waiting:
            length, left = waiting[-1]
            take = min(n, left)
            bins.put(length, first, take, used, 1)
            counts[length] -= take
            out.append((first, take, used + length))
            first, n = first + take, n - take
            if take == left:
                waiting.pop()
            else:
                waiting[-1] = (length, left - take)
        if n:
            out.append((first, n, used))
    return out


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    rows = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # the plan is bounded by the capacity, not by the documents: some runs for each length
    shared = spark.sparkContext.broadcast(rows)
    key = lambda length, rank: (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64)

    def place(batches):
        table = shared.value
        starts = key(table[:, 0], table[:, 1])
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(starts, key(length, rank), side="right") - 1]
            at = rank - row[:, 1]
            yield batch_of(placed, [*(batch.column(i) for i in range(5)), row[:, 3] + at // row[:, 4],
                                    row[:, 5] + at % row[:, 4] * length])

    placed = _PIECES_ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
    salts = max(1, -(-int(counts.max()) // ROWS_PER_SALT))
    ranked = spread_rank(pieces, "length", ["doc_id", "piece", "ids_crc32", "start"], max(16, salts))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, _PIECES + ", sequence_id long, offset long")
