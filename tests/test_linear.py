import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladekit.operators import linear as L
from cladekit.operators import targets as G


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [1, 10, 0.1, 1] + [0, 1000, 5, -3]
    x[:, 3] = 0.5 * x[:, 0] + 0.01 * x[:, 3]  # nearly a copy
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=400)
    return x, y


@pytest.fixture(scope="module")
def df(spark, rows):
    x, y = rows
    data = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    data += [(900, None, 1.0, 1.0, 1.0, 1.0), (901, 1.0, float("nan"), 1.0, 1.0, 1.0)]  # left out
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y double").repartition(5)


def folds(df, name, seed, n):
    tagged = G.with_fold(df.where("id < 900"), ["id"], n, seed, name)
    return np.array([r[name] for r in tagged.orderBy("id").select(name).collect()])


def test_moments_of_cells(df, rows):
    x, y = rows
    z = np.column_stack([x, y])
    fold = folds(df, "k", 5, 3)
    got = L.moments(G.with_fold(df, ["id"], 3, 5, "k"), [*"abcd", "y"], ["k"])
    assert set(got) == {(k,) for k in set(fold.tolist())}
    for (k,), m in got.items():
        part = z[fold == k]
        assert m.n == len(part) and np.allclose(m.mean, part.mean(0))
        assert np.allclose(m.cross, (part - part.mean(0)).T @ (part - part.mean(0)))
    whole = L.total(got.values(), 5)
    assert np.allclose(whole.cross, (z - z.mean(0)).T @ (z - z.mean(0)))
    assert L.moments(df.where("false"), ["a"]) == {}


def objective(x, y, beta, penalty, mix):
    e = y - y.mean() - (x - x.mean(0)) @ beta
    return (e @ e) / (2 * len(y)) + penalty * (mix * abs(beta).sum() + (1 - mix) / 2 * beta @ beta)


def test_elastic_net_reaches_the_least_objective(df, rows):
    x, y = rows
    inner = folds(df, "_inner", "9-inner", 5)
    cells = {j: m for (j,), m in L.moments(G.with_fold(df, ["id"], 5, "9-inner", "_inner"), [*"abcd", "y"], ["_inner"]).items()}
    beta, intercept, penalty = L.elastic_net(cells, range(4), 4)
    sd = x.std(0)
    z, scaled = x / sd, beta * sd
    best = objective(z, y, scaled, penalty, 0.5)
    rng = np.random.default_rng(1)
    for _ in range(300):
        assert objective(z, y, scaled + rng.normal(size=4) * 10.0 ** rng.integers(-6, 0), penalty, 0.5) >= best - 1e-9
    assert np.isclose(intercept, y.mean() - x.mean(0) @ beta)
    # the chosen penalty has the least mean error over the inner folds, by rows
    top = abs((z - z.mean(0)).T @ (y - y.mean())).max() / len(y) / 0.5
    grid = [top * 1e-3 ** (i / 49) for i in range(50)]
    errors = []
    for p in grid:
        e = 0.0
        for j in range(5):
            train = inner != j
            m = L.Moments.of(np.column_stack([z, y])[train])
            b = L.penalised(m.cross[:4, :4] / m.n, m.cross[:4, 4] / m.n, p, 0.5, np.zeros(4))
            e += ((y[~train] - (m.mean[4] - m.mean[:4] @ b) - z[~train] @ b) ** 2).mean() / 5
        errors.append(e)
    assert np.isclose(penalty, grid[int(np.argmin(errors))])


def test_cross_validation_against_rows(df, rows):
    x, y = rows
    fold = folds(df, "fold", 123456, 10)
    summary, preds = L.cross_validate(df, list("abcd"), ["id"])
    got = {(r["learner"], r["part"], r["metric"]): (r["mean"], r["std"]) for r in summary.collect()}
    out = {"test": [], "train": []}
    held = np.zeros(len(y))
    for k in range(10):
        train = fold != k
        a = np.column_stack([np.ones(train.sum()), x[train]])
        b = np.linalg.lstsq(a, y[train], rcond=None)[0]
        p = b[0] + x @ b[1:]
        held[~train] = p[~train]
        for part, at in (("test", ~train), ("train", train)):
            e = y[at] - p[at]
            out[part].append(((e**2).mean(), abs(e).mean(), 1 - e.var() / y[at].var()))
    for part, values in out.items():
        for i, metric in enumerate(("MSE", "MAE", "EV")):
            v = [r[i] for r in values]
            assert np.allclose(got["Linear", part, metric], (np.mean(v), np.std(v)), rtol=1e-6)
    assert {k[0] for k in got} == set(L.LEARNERS)
    assert got["ElasticNet", "test", "EV"][0] > 0.8 > 0.1 > got["Mean", "test", "EV"][0]
    rows_back = {r["id"]: r["preds"] for r in preds.where("learner = 'Linear'").collect()}
    assert len(rows_back) == 400 and np.allclose([rows_back[i] for i in range(400)], held, rtol=1e-6)


def test_chosen_models_and_prediction(df, rows):
    x, y = rows
    fitted = L.fit(df, list("abcd"), ["id"])
    beta, intercept = fitted["Linear"]
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([intercept, *beta], want, rtol=1e-5)
    p = df.where("id < 400").select("id", L.predicted("abcd", beta, intercept).alias("p")).orderBy("id").collect()
    assert np.allclose([r["p"] for r in p], want[0] + x @ want[1:], rtol=1e-6)
    assert L.fit(df.where("false"), ["a"], ["id"]) == {}


def test_four_factor_table(spark):
    rng = np.random.default_rng(6)
    z = rng.random((300, 4))
    y = 1 + z[:, 0] - z[:, 1] * z[:, 2] + rng.normal(size=300) * 0.2
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, z, strict=True)], "y double, g double, b double, e double, i double")
    got = {r.term: r for r in L.interaction_anova(df, "y", ["g", "b", "e", "i"]).collect()}
    assert len(got) == 16 and got["Residual"].df == 300 - 16
    at = dict(zip("gbei", z.T, strict=True))

    def rss(terms):
        a = np.column_stack([np.ones(300), *[np.prod([at[c] for c in t], axis=0) for t in terms]])
        return ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()

    terms = [frozenset(t.split(":")) for t in got if t != "Residual"]
    full = rss(terms)
    for name, r in got.items():
        if name == "Residual":
            assert np.isclose(r.sum_sq, full)
            continue
        others = [u for u in terms if not frozenset(name.split(":")) <= u]
        gain = rss(others) - rss([*others, frozenset(name.split(":"))])
        assert np.isclose(r.sum_sq, gain, rtol=1e-6, atol=1e-9) and np.isclose(r.f, gain / (full / 284), rtol=1e-6, atol=1e-7)
        assert 0 <= r.pval <= 1
    assert got["g"].pval < 1e-6 and got["b:e"].pval < 0.01
    twin = L.interaction_anova(df.withColumn("h", F.col("g") * 2), "y", ["g", "h"]).collect()
    assert {r.term: r.df for r in twin}["h"] == 0 and len(twin) == 4


def test_f_tail():
    """Against the cases that have a closed form, and the normal limit."""
    for f in (0.01, 0.5, 1.0, 3.0, 40.0):
        assert np.isclose(L.f_tail(f, 1, 1), 1 - 2 / math.pi * math.atan(math.sqrt(f)), rtol=1e-12)
        for n in (1, 2, 7, 300, 60_000):
            assert np.isclose(L.f_tail(f, 2, n), (1 + 2 * f / n) ** (-n / 2), rtol=1e-9)
            assert np.isclose(L.f_tail(f, n, 2), 1 - (1 + 2 / (n * f)) ** (-n / 2), rtol=1e-9)
        assert np.isclose(L.f_tail(f, 1, 10**8), math.erfc(math.sqrt(f / 2)), rtol=1e-5)
    assert np.isclose(L.f_tail(4.0, 1, 10), 0.0734, atol=1e-4)
    assert L.f_tail(0.0, 1, 5) == 1.0
