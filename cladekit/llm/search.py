"""Exact top-k by inner product, block at a time.

Vectors become whole numbers. Rows are laid out so that like vectors stand together, and each range of them is a block: its
vectors (the forward index) and, for each term, that is a dimension with a sign, the largest value in the block. A query's
summed term maxima bound every score in the block. A task holds the blocks of one group, and the queries pass it as a
stream. For each query the blocks are ordered by bound and scored, the best first, until a bound falls below the k-th best
score; a query starts with the k-th score of its own block. So every score that can count is computed, in whole numbers.

Queries are shuffled to every group of blocks and nothing else moves; a group holds about ``GROUP_NUMBERS`` numbers, a query
has k results in each, and the best k of these are taken in the end. Queries need not fit in a task or in the driver.

The layout follows pivots fitted on at most ``SAMPLE`` rows (those with the least hash). It changes what is skipped, not what
is found.

Cases: NULL and empty vectors, those with NULL or non-finite entries, and those of another length than the commonest are
left out; a NULL id is no query and stands behind all others in ties; every repeated row is a query and a candidate of its
own, and leaves out only itself; fewer rows than k give fewer results; entries beyond 2^62 count as 2^62, and scores beyond
a long as the nearest long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, usable

SCALE, TOP = 256, 5
BLOCK_ROWS = 256
GROUP_NUMBERS = 1 << 22  # numbers in a group of blocks: 65,536 vectors of length 64
GROUPS_PER_CORE = 4
SAMPLE, PIVOTS, ROUNDS = 1024, 64, 4
CHUNK = 256  # queries scored at once
NOTHING = -(1 << 200)  # below any score
LAST = (1 << 63) - 1  # largest long; stands for a NULL id in the order of ties

_BLOCKS = "block long, rows int, ids array<long>, vectors binary, asked array<int>, least array<double>"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
                           ("asked", pa.list_(pa.int32())), ("least", pa.list_(pa.float64()))])
_FOUND = "block long, slot int, query_id long, vec_id long, score long, place long"
_FOUND_ARROW = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                          ("score", pa.int64()), ("place", pa.int64())])


def pivots(rows: DataFrame, size: int) -> np.ndarray:
    """Centres of a bounded sample: the order of rows follows the nearest one."""
    sample = rows.select("x", F.xxhash64("id", "x").alias("_h")).orderBy("_h", "x").limit(SAMPLE).collect()
    x = np.array([r["x"] for r in sample], float).reshape(-1, size)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = x[:PIVOTS]
    for _ in range(ROUNDS):
        at = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[at == k].sum(0) if (at == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def _fits(*arrays: np.ndarray) -> bool:
    """Whether the sum of products of two such vectors is exact in doubles."""
    most = 1.0
    for a in arrays:
        most *= max(1.0, float(np.abs(a.astype(float)).max(initial=0.0)))
    return most * arrays[0].shape[-1] < 2.0**53


def scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where they hold every sum, whole numbers within a long's range elsewhere."""
    if _fits(queries, block):
        return queries.astype(float) @ block.astype(float).T
    return np.minimum(np.maximum(queries.astype(object) @ block.astype(object).T, -LAST - 1), LAST)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Summed term maxima of every query and block; never below a score in the block."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    if _fits(queries, most) and _fits(queries, least):
        return up.astype(float) @ most.astype(float).T + down.astype(float) @ least.astype(float).T
    return up.astype(object) @ most.astype(object).T + down.astype(object) @ least.astype(object).T


def _sort_key(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, ~known))


def _block_rows(batches, size: int, every: int, top: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one task's rows: at most BLOCK_ROWS rows of one pivot, sorted by id (NULL last)."""
    part, number = TaskContext.get().partitionId(), 0

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        order = _sort_key(values, known)
        ids, x, values, known = ids.take(pa.array(order)), x[order], values[order], known[order]
        asked = np.flatnonzero(known & (values % every == 0))
        floor = np.full(len(asked), -np.inf)
        if len(asked) and len(x) > top:
            own = scores(x[asked], x).astype(float)  # rounded down far enough below: only a start
            own[np.arange(len(asked)), asked] = -np.inf
            kth = np.sort(own, axis=1)[:, -top]
            floor = kth - np.abs(kth) * 1e-9
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number - 1]), pa.array([len(x)], pa.int32()),
             pa.array([ids], pa.list_(pa.int64())), pa.array([_narrow(x)], pa.binary()),
             pa.array([asked.astype(np.int32)], pa.list_(pa.int32())), pa.array([floor], pa.list_(pa.float64()))],
            schema=_BLOCKS_ARROW)

    pivot, held = None, []
    for batch in batches:
        x, near = matrix(batch.column(1), size), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(near)) + 1).tolist(), len(near)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and near[a] != pivot:
                    yield block(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
                pivot = near[a]
                room = min(b, a + BLOCK_ROWS - sum(len(h[1]) for h in held))
                held.append((batch.column(0)[a:room], x[a:room]))
                a = room
                if sum(len(h[1]) for h in held) == BLOCK_ROWS:
                    yield block(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
    if held:
        yield block(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def _narrow(x: np.ndarray) -> bytes:
    """One byte for the width, then the numbers at the least width that holds them."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, size)


class Group:
    """Blocks that one task holds, and the search in them."""

    def __init__(self, size: int, top: int):
        self.size, self.top = size, top
        self.numbers: list[int] = []
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.scored = 0  # pairs of query and block
        self.closed = False

    def add(self, number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.numbers.append(number)
        self.ids.append(ids)
        self.vectors.append(vectors)

    def close(self) -> None:
        """Take the term maxima: all blocks of the group are here."""
        self.closed = True
        self.most = np.array([v.max(0) for v in self.vectors])
        self.least = np.array([v.min(0) for v in self.vectors])

    def search(self, queries: np.ndarray, block: np.ndarray, slot: np.ndarray, floor: np.ndarray):
        """For each query at most ``top`` (score, id, block * BLOCK_ROWS + slot), and which of them are real."""
        n, top = len(queries), self.top
        upper = bounds(queries, self.most, self.least)
        order = np.argsort(-upper, axis=1, kind="stable")
        best = np.full((n, top), NOTHING, object) if upper.dtype == object else np.full((n, top), -np.inf)
        ids = np.zeros((n, top), np.int64)
        places = np.full((n, top), -1, np.int64)
        active = np.arange(n)
        for turn in range(len(self.numbers)):
            at = order[active, turn]
            go = (upper[active, at] >= best[active, -1]) & (upper[active, at] >= floor[active])
            active, at = active[go], at[go]
            if not len(active):
                break
            for b in np.unique(at):
                rows = active[at == b]
                self._score(int(b), rows, queries, block, slot, best, ids, places)
        return best, ids, places

    def _score(self, b, rows, queries, block, slot, best, ids, places) -> None:
        self.scored += len(rows)
        found = scores(queries[rows], self.vectors[b])
        none = NOTHING if best.dtype == object else -np.inf
        if best.dtype == object and found.dtype != object:
            found = found.astype(np.int64).astype(object)
        own = block[rows] == self.numbers[b]
        found[own, slot[rows][own]] = none
        better = found.max(axis=1) >= best[rows, -1]
        rows, found = rows[better], found[better]
        if not len(rows):
            return
        # rows of a block stand by id, so a stable sort keeps the smaller ids first
        first = np.argsort(-found, axis=1, kind="stable")[:, : self.top]
        score = np.concatenate([best[rows], np.take_along_axis(found, first, 1)], 1)
        place = np.concatenate([places[rows], self.numbers[b] * BLOCK_ROWS + first], 1)
        name = np.concatenate([ids[rows], self.ids[b][first]], 1)
        place[score == none] = -1
        order = np.lexsort((place, name, -score), axis=1) if score.dtype != object else np.array(
            [sorted(range(score.shape[1]), key=lambda k, r=r: (-score[r, k], name[r, k], place[r, k]))
             for r in range(len(rows))])
        order = order[:, : self.top]
        best[rows], ids[rows], places[rows] = (np.take_along_axis(v, order, 1) for v in (score, name, place))


def _search_stream(batches, size: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows come by group, the blocks of a group (kind 0) before its queries (kind 1)."""
    group, number, held = Group(size, top), None, []

    def flush():
        nonlocal held
        if not held or not group.numbers:
            held = []
            return
        block = np.array([h[0] for h in held])
        slot, query, floor = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        block = np.repeat(block, [len(h[1]) for h in held])
        x = np.concatenate([h[4] for h in held])
        held = []
        best, ids, places = group.search(x, block, slot, floor)
        r, c = np.nonzero(places >= 0)
        score = [int(v) for v in best[r, c]]
        found = ids[r, c]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[r]), pa.array(slot[r].astype(np.int32)), pa.array(query[r]),
             pa.array(found, mask=found == LAST), pa.array(score, pa.int64()), pa.array(places[r, c])], schema=_FOUND_ARROW)

    for batch in batches:
        for row in batch.to_pylist():
            if row["_group"] != number:
                yield from flush()
                group, number = Group(size, top), row["_group"]
            x = _wide(row["vectors"], size)
            if row["_kind"] == 0:
                group.add(row["block"], np.array([LAST if v is None else v for v in row["ids"]], np.int64), x)
                continue
            if not group.closed:
                group.close()
            held.append((row["block"], np.array(row["asked"], np.int64), np.array(row["ids"], np.int64),
                         np.array(row["least"], float), x))
            if sum(len(h[1]) for h in held) >= CHUNK:
                yield from flush()
    yield from flush()


def _queries(blocks: DataFrame, size: int) -> DataFrame:
    """Rows like those of ``blocks`` that hold the queries only."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = _wide(r["vectors"], size)[r["asked"]]
                rows.append(r | {"rows": len(x), "ids": [r["ids"][k] for k in r["asked"]], "vectors": _narrow(x)})
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCKS_ARROW)

    return blocks.where(F.size("asked") > 0).mapInArrow(run, _BLOCKS)


def index(rows: DataFrame, size: int, every: int, top: int = TOP) -> DataFrame:
    """The blocks of all rows, stored; those whose id is divisible by ``every`` are marked as queries."""
    centres = pivots(rows, size)

    def nearest(batches):
        for batch in batches:
            x = matrix(batch.column(1), size)
            near = np.argmax(x.astype(float) @ centres.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["id", "x", "near"])

    laid = rows.mapInArrow(nearest, "id long, x array<long>, near int")
    key = F.xxhash64("x")  # rows alike in pivot and id spread as well
    laid = laid.withColumn("_h", key).repartitionByRange("near", "id", "_h").sortWithinPartitions("near", "id", "_h")
    return stored(laid.select("id", "x", "near").mapInArrow(lambda b: _block_rows(b, size, every, top), _BLOCKS), "search-blocks")


def nearest_rows(df: DataFrame, every: int, id_col: str = "vec_id", vector: str = "embedding", top: int = TOP,
                 scale: int = SCALE, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """The ``top`` best rows of every row whose id (a whole number) is divisible by ``every``: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id. ``group_numbers`` is what a task holds; less where that gives every core some groups.
    """
    rows, size = usable(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector, scale)
    spark = df.sparkSession
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = index(rows, size, every, top)
    n, count = blocks.agg(F.sum("rows"), F.count("*")).first()
    groups = max(1, -(-(n or 0) * size // group_numbers), min(count, GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))
    held = blocks.withColumn("_group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("_kind", F.lit(0))
    asked = _queries(blocks, size).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "_kind", F.lit(1))
    dealt = held.unionByName(asked).repartition(groups, "_group").sortWithinPartitions("_group", "_kind", "block")
    found = dealt.mapInArrow(lambda b: _search_stream(b, size, top), _FOUND)
    best = Window.partitionBy("block", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "place")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score
FROM (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, d.x) DESC, d.vec_id) AS rn
    FROM v q JOIN v d ON d.vec_id <> q.vec_id
    WHERE q.vec_id % 50 = 0
)
WHERE rn <= 5
"""
