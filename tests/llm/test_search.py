import math
import random

import numpy as np

from cladekit.llm import search
from cladekit.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, block long, score long, id string, rank int, near int"
EXTRA = (1, -1, -1, "i", -1, -1)


def held(score):
    return max(-(1 << 63), min((1 << 63) - 1, score))


def plain(vectors, every, top=5):
    """Every query against every other row, in whole numbers."""
    rows = [(i, [max(-(1 << 62), min(1 << 62, math.floor(256 * float(c)))) for c in v]) for i, v in vectors]
    out = []
    for at, (q, x) in enumerate(rows):
        if q is None or q % every:
            continue
        found = [(-held(sum(a * b for a, b in zip(x, y, strict=True))), i is None, i or 0) for k, (i, y) in enumerate(rows) if k != at]
        for rank, (score, none, i) in enumerate(sorted(found)[:top]):
            out.append((q, rank + 1, None if none else i, -score))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def stored_vectors(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_query(spark, folder):
    vectors = stored_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    assert rows_of(QUERIES["op13_exact_top_k"](spark, folder)) == plain(vectors, 50)
    assert "op13_exact_top_k" in ORACLES


def test_odd_rows_ties_and_repeats(spark):
    pick = random.Random(7)
    fine = [(k, [pick.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for k in range(700)]  # many ties
    fine += [(0, fine[0][1]), (10, fine[10][1]), (10, [1.0, 1.0, 1.0]), (None, [-1.0, 0.5, 0.5]), (None, [0.0, 0.0, 0.0]), (-10, [9.0, -9.0, 9.0])]
    odd = [(800, None), (810, []), (820, [1.0, None, 2.0]), (830, [float("nan"), 0.0, 0.0]), (840, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in fine + odd], SCHEMA).repartition(6)
    assert rows_of(search.nearest_rows(df, 10, group_numbers=600)) == plain(fine, 10)


def test_few_rows_and_none(spark):
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-3.0, 0.0])]
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in few], SCHEMA)
    assert rows_of(search.nearest_rows(df, 2)) == plain(few, 2)
    assert rows_of(search.nearest_rows(df.limit(1), 1)) == []
    assert search.nearest_rows(df.limit(0), 2).collect() == []


def test_large_numbers(spark):
    few = [(k, [float(np.float32(3e15 + k * 2**30)), float(np.float32(-1e15 + k)), 1.0 + k]) for k in range(12)] + [(20, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in few], SCHEMA)
    assert rows_of(search.nearest_rows(df, 2)) == plain(stored_vectors(df), 2)


def test_blocks_below_the_kth_score_are_not_scored():
    draw = np.random.default_rng(1)
    group = search.Group(8, 5)
    centres = draw.integers(-300, 300, (20, 8))
    for b, c in enumerate(centres):
        group.add(b, np.arange(b * 100, b * 100 + 100), c + draw.integers(-20, 20, (100, 8)))
    group.close()
    queries = centres + draw.integers(-20, 20, (20, 8))
    best, ids, _ = group.search(queries, np.full(20, -1), np.zeros(20, int), np.full(20, -np.inf))
    whole = np.concatenate(group.vectors)
    for q, b, i in zip(queries, best, ids, strict=True):
        order = np.lexsort((np.arange(len(whole)), -(whole @ q)))[:5]
        assert order.tolist() == i.tolist() and (whole @ q)[order].tolist() == b.tolist()
    assert group.scored < 20 * 20 / 2
