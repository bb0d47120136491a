import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladekit.functions import scalars as S
from cladekit.operators import linear
from cladekit.operators import aggregates as A
from cladekit.operators import evaluate as E
from cladekit.operators import models as M
from cladekit.operators import rank_tests as T
from cladekit.operators import targets as G


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 3)) + [0, 0.1, 0.4], 2)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, a double, b double, c double")


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_tails(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", S.erfc("x").alias("e")).collect():
        assert abs(r.e / math.erfc(r.x) - 1) < 2e-7
    # known chi-square tails
    got = spark.range(1).select(*[S.chi2_tail(F.lit(3.0), d) for d in (1, 2, 3, 4, 5)]).first()
    assert np.allclose(list(got), [0.0832645, 0.2231302, 0.3916252, 0.5578254, 0.6999858], atol=1e-6)


def test_kruskal(noise):
    x, df = noise
    r = ranks(x.T.ravel())
    n = len(r)
    k = len(x)
    h = 12 / (n * (n + 1)) * sum(r[i * k:(i + 1) * k].sum() ** 2 / k for i in range(3)) - 3 * (n + 1)
    _, t = np.unique(x, return_counts=True)
    h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    got = T.kruskal_wallis(df, ["a", "b", "c"]).first()
    assert abs(got.stat - h) < 1e-9 and abs(got.pval - math.exp(-h / 2)) < 1e-9


def test_signed_rank_and_holm(noise):
    x, df = noise
    out = {r.pair: r for r in T.holm(
        T.signed_rank(df, T.all_pairs(["a", "b", "c"])), alpha=0.05).collect()}
    d = x[:, 2] - x[:, 0]
    d = d[d != 0]
    w = ranks(np.round(np.abs(d), 12))[d > 0].sum()
    assert out["c>a"].n == len(d) and abs(out["c>a"].wplus - w) < len(d)
    assert out["c>a"].rejected and not out["a>c"].rejected
    ps = sorted(r.pval for r in out.values())
    want = np.minimum(np.maximum.accumulate([p * (6 - i) for i, p in enumerate(ps)]), 1)
    assert np.allclose(sorted(r.corrected for r in out.values()), sorted(want))


def test_interpolation_and_nearest(spark):
    pts = [(1.0, 10.0), (2.0, 0.0), (5.0, 6.0), (100.0, 7.0)]
    asked = [0.5, 1.0, 1.5, 2.0, 4.0, 5.0, 50.0, 500.0, 4.0]
    table = spark.createDataFrame(pts, "x double, y double")
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, q double")
    got = [r.y for r in E.interpolate(df, "q", table, "x", "y", "y").orderBy("i").collect()]
    assert np.allclose(got, np.interp(asked, *zip(*pts)))
    rng = np.random.default_rng(0)
    c = rng.random((600, 3)) * 100
    cond = spark.createDataFrame([tuple(map(float, r)) for r in c], "ebl double, ibl double, z double")
    grid = E.nearest_on_grid(cond.repartition(5), "z", steps=12, scale=1.0).collect()
    assert len(grid) == 144
    for r in grid:
        d = (c[:, 0] - r.gx) ** 2 + (c[:, 1] - r.gy) ** 2
        assert r.value == c[d.argmin(), 2]


def test_bounds_and_half_even(spark):
    df = spark.createDataFrame([(p / 20, q / 20) for p in range(21) for q in range(21)], "p double, q double")
    rows = df.select("p", "q", S.hellinger("p", "q").alias("h"), S.kl_bernoulli("p", "q").alias("k"),
                     S.rounds_alike("p", "q").alias("a")).collect()
    for r in rows:
        assert -1e-12 <= r.h <= 1 + 1e-12 and (r.h == 0 or r.p != r.q)
        assert math.isinf(r.k) == (r.q in (0, 1) and r.p != r.q)
        assert r.a == int(round(r.p) == round(r.q))


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 17).cast("double").alias("v"))
    for r in A.bootstrap_means(df, ["g"], "v", ["id"], 100).collect():
        assert r.low < r.mean < r.high and r.high - r.low < 1
        assert 0.3 < r.high - r.low  # about 4.1 standard errors of 0.11


def test_scaling_matches_numpy(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 7), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, x double, q double")
    out = G.apply_scaling(df, G.fit_scaling(df, ["x", "q"]), ["x", "q"]).orderBy("i").collect()
    x = np.array([np.nan if r[1] is None else r[1] for r in rows])
    f = np.where(np.isnan(x), np.nanmedian(x), x)
    m = np.isnan(x).astype(float)
    assert np.allclose([r.x for r in out], (f - f.mean()) / f.std())
    assert np.allclose([r.missing__x for r in out], (m - m.mean()) / m.std())


def test_anova_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(200), rng.random(200)
    y = 1 + 2 * a - b + 3 * a * b + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b)], "y double, a double, b double")
    got = {r.term: r for r in linear.interaction_anova(df, "y", ["a", "b"]).collect()}

    def rss(*cols):
        x = np.column_stack([np.ones(200), *cols])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    full = rss(a, b, a * b)
    assert np.isclose(got["a:b"].sum_sq, rss(a, b) - full)
    assert np.isclose(got["a"].sum_sq, rss(b) - rss(a, b))
    assert np.isclose(got["b"].f, (rss(a) - rss(a, b)) / (full / 196))


def test_learners_beat_the_mean(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.range(600).select("id", F.rand(1).alias("x")).withColumn("y", 3 * F.col("x") + F.rand(2))
    df = df.cache()
    summary, preds = M.cross_validate(df, ["x"], {"L": LinearRegression(labelCol="y")}, ["id"], folds=3)
    assert preds.count() == 600
    got = {(r.part, r.metric): r.mean for r in summary.collect()}
    assert got["test", "EV"] > 0.7 and got["test", "MSE"] < 0.2


def test_labels_flip_at_the_stated_rate(spark):
    df = spark.range(4000).select("id", F.lit(0).alias("c"))
    flipped = G.flip_classes(df, "c", 0.1, 3, ["id"]).agg(F.avg("c")).first()[0]
    assert 0.07 < flipped < 0.13


def test_chained_conditions():
    assert S.chain(".1<ibl<10 and ebl==5") == "(.1 < ibl) AND (ibl < 10) AND (ebl = 5)"


@pytest.mark.parametrize("shape", ["spread", "sparse", "line", "one", "corner"])
def test_nearest_condition_on_a_grid(spark, shape):
    """Equal to looking at all conditions from every point, for dense, sparse and degenerate places."""
    rng = np.random.default_rng(3)
    places = {"spread": rng.random((400, 2)) * [300, 2], "sparse": rng.random((5, 2)) * [300, 2], "one": np.array([[3.0, 4.0]]),
              "line": np.column_stack([rng.random(30) * 9, np.full(30, 2.0)]), "corner": np.vstack([rng.random((50, 2)) * 1e-3, [[10, 10]]])}[shape]
    places = np.vstack([places, places[:3]])  # ties
    z = rng.random(len(places))
    df = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(places, z, strict=True)] + [(None, 1.0, 5.0)], "ebl double, ibl double, v double")
    got = {(r.i, r.j): (r.gx, r.gy, r.value) for r in E.nearest_on_grid(df, "v", steps=20).collect()}
    assert len(got) == 400
    p = places * 0.01
    low, high = p.min(0), p.max(0)
    for (i, j), (gx, gy, value) in got.items():
        want = low + np.array([i, j]) * (high - low) / 19
        assert np.allclose([gx, gy], want)
        d = (gx - p[:, 0]) ** 2 + (gy - p[:, 1]) ** 2
        assert value == min(zip(d, p[:, 0], p[:, 1], z, strict=True))[3]
    assert E.nearest_on_grid(df.where("false"), "v").collect() == []
