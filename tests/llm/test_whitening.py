import math
import random

import numpy as np
import pytest

from cladekit.llm import whitening
from cladekit.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, deviation long, component int, state string"
EXTRA = (1, 2, "x", 3, 4, "s")


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_updates_give_the_eigendecomposition(size):
    draw = np.random.default_rng(size)
    x = np.floor(8 * draw.normal(size=(300, size)))
    x[:40] = x[0]  # repeats, and so equal eigenvalues at first
    scatter = np.cov(x.T, bias=True).reshape(size, size) * len(x)
    state, other = whitening.Spectrum(size), whitening.Spectrum(size)
    for at in range(0, 200, 23):
        state.add_block(x[at : min(at + 23, 200)])
    other.add_block(x[200:])
    state.add(whitening.Spectrum.from_bytes(other.to_bytes(), size))
    assert state.n == 300 and np.allclose(state.mean, x.mean(0))
    assert np.allclose(state.vectors.T @ state.vectors, np.eye(size), atol=1e-12)
    assert np.allclose(state.vectors * state.values @ state.vectors.T, scatter, atol=1e-10 * abs(scatter).max())
    assert np.allclose(state.values, np.linalg.eigvalsh(scatter), atol=1e-10 * abs(scatter).max())


def test_secular_roots_interlace():
    d, z = np.array([0.0, 1e-9, 1.0, 5.0]), np.array([0.1, 1e-5, 3.0, 0.7])
    roots, diff = whitening.secular_roots(d, z, 2.0)
    assert ((roots >= d) & (roots <= np.append(d[1:], d[-1] + 2 * (z @ z)))).all()
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + 2 * np.outer(z, z))), roots, rtol=1e-13, atol=1e-13)
    assert diff.shape == (4, 4)


def plain(vectors, components=16):
    """By numpy over all rows: id -> (deviation, whitened), the shares, n."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors]
    listed = sorted({tuple(x) for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in listed])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in kept:
        delta = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out.append((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), delta @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-30))))
    return out, values[order] / np.trace(cov), n


def check(rows, vectors, components=16):
    want, shares, n = plain(vectors, components)
    assert len(rows) == len(want) * len(shares) and {r["n"] for r in rows} == {n}
    assert max(r["identity_error"] for r in rows) <= 1e-4 and len({r["identity_error"] for r in rows}) == 1
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = [None] * len(shares)
    for i, deviation, white in want:
        for k, w in enumerate(white):
            r = got[i][k + 1]
            assert r["deviation"] == deviation and abs(r["explained"] - shares[k]) <= 1e-9
            if abs(w) > 1e-3:
                signs[k] = signs[k] or (1 if r["whitened"] * w > 0 else -1)
            assert abs(r["whitened"] - (signs[k] or 1) * w) < 1e-6 * max(1, abs(w))


def test_query_against_numpy(spark, folder):
    rows = QUERIES["op11_embedding_whitening"](spark, folder).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, vectors)


def test_odd_rows(spark):
    pick = random.Random(2)
    fine = [(k, [pick.gauss(0, 1) for _ in range(3)]) for k in range(60)]
    fine += [(60, fine[0][1]), (61, fine[0][1])]
    odd = [(70, None), (71, []), (72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 2.0]), (74, [float("inf"), 0.0, 0.0]), (75, [1.0])]
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in fine + odd], SCHEMA).repartition(5)
    vectors = [(r["vec_id"], r["embedding"]) for r in df.where("vec_id < 70").collect()]
    check(whitening.whiten(df).collect(), vectors)
    rows = whitening.whiten(df, components=2).collect()
    assert {r["component"] for r in rows} == {1, 2}


def test_flat_and_empty_tables(spark):
    one = spark.createDataFrame([(1, [0.5, 0.5], *EXTRA), (None, [0.5, 0.5], *EXTRA)], SCHEMA)
    rows = whitening.whiten(one).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["n"]) for r in rows] == [(0, None, None, 1)] * 4
    line = spark.createDataFrame([(k, [float(k), 0.0], *EXTRA) for k in range(4)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert {(r["component"], round(r["explained"], 12), r["whitened"] is None) for r in rows} == {(1, 1.0, False), (2, 0.0, True)}
    assert whitening.whiten(one.limit(0)).collect() == []
    large = spark.createDataFrame([(1, [3e38, 0.0], *EXTRA), (2, [-3e38, 1.0], *EXTRA)], SCHEMA)
    assert {r["deviation"] for r in whitening.whiten(large).collect()} == {None}
