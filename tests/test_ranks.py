import random

import numpy as np
import pytest

from cladekit.operators import ranks as K
from cladekit.operators import sampling as L


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows; values carry many ties, signs and scales."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        g = 0 if i % 3 == 0 else rng.randrange(1, 40)
        v = rng.choice([0.0, -1.5, 2.25, rng.gauss(0, 1), rng.random() * 1e-9, rng.expovariate(1e-5)])
        rows.append((i, g, v, rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, "id int, g int, v double, y boolean").repartition(7)


def by_group(rows):
    out = {}
    for _, g, v, y in rows:
        out.setdefault(g, []).append((v, y))
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_row_numbers(skewed, digits):
    rows, df = skewed
    df = df.withColumn("k", K.hash_key(1, "id"))
    got = K.number_rows(df, ["g"], "k", ["id"], digits=digits).collect()
    assert len(got) == len(rows)
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.id))
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
    cut = K.number_rows(df, ["g"], "k", ["id"], limit=5, digits=digits).collect()
    assert {(r.g, r.id) for r in cut} == {(r.g, r.id) for r in got if r.rn <= 5}


@pytest.fixture(params=[K.SPLIT_ROWS, 50])
def split(request, monkeypatch):
    """Groups left whole, and groups cut into buckets."""
    monkeypatch.setattr(K, "SPLIT_ROWS", request.param)


def test_bucket_never_falls(spark, monkeypatch):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1e300, -1e300, 1.0, 1.0000001, 2.0]
                    + [random.Random(3).gauss(0, 10) for _ in range(500)]) + [float("nan")]
    monkeypatch.setattr(K, "SPLIT_ROWS", 100)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r._bucket for r in K.with_bucket(df, [], "v").orderBy("i").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == K.BUCKETS - 1


@pytest.mark.parametrize("value", ["id / 1e6", "0.95 + id / 2e6", "1.7e9 + 9.5 * id", "exp(id / 1000 - 50)", "-id * id"])
def test_buckets_are_even(spark, monkeypatch, value):
    """No bucket holds more than 1 % of a group of distinct values, wherever they lie."""
    monkeypatch.setattr(K, "SPLIT_ROWS", 1000)
    df = spark.range(100_000).selectExpr(f"cast({value} as double) as v", "if(id % 3 = 0, NULL, id % 2) as g")
    for group in ([], ["g"]):
        sizes = K.with_bucket(df, group, "v").groupBy(*group, "_bucket").count().groupBy(*group).agg({"count": "max"})
        for r in sizes.collect():
            assert r[-1] <= 0.01 * (100_000 if not group else 33_333)


def test_rows_move_twice_at_most(spark, monkeypatch):
    """Once to add up equal values, once to their buckets; all other exchanges carry sums or sketches."""
    monkeypatch.setattr(K, "SPLIT_ROWS", 100)
    df = spark.range(1000).selectExpr("cast(id as double) as v", "id % 3 as g")
    plan = K.value_positions(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_bucket" in line]
    assert len(moved) == 3  # the third holds bucket totals
    monkeypatch.setattr(K, "SPLIT_ROWS", 10_000)
    whole = K.value_positions(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange ") == 2 and "percentile" not in whole and "Join" not in whole
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_positions_and_quantiles(skewed, split):
    rows, df = skewed
    groups = by_group(rows)
    probs = {"a": 0.05, "b": 0.5, "c": 0.77, "d": 1.0}
    for r in K.group_quantiles(df, ["g"], "v", probs).collect():
        want = np.quantile([v for v, _ in groups[r.g]], list(probs.values()))
        assert np.allclose([r[k] for k in probs], want, rtol=1e-12, atol=0)
    whole = K.group_quantiles(df, [], "v", probs).first()
    assert np.allclose(list(whole), np.quantile([r[2] for r in rows], list(probs.values())))
    for r in K.value_positions(df, ["g"], "v").collect():
        mine = [v for v, _ in groups[r.g]]
        assert r.before == sum(v < r.v for v in mine)
        assert r.n == mine.count(r.v) and r.total == len(mine)


@pytest.mark.parametrize("block", [4, 1 << 20])
@pytest.mark.parametrize("share", [0.5, 0.8])
def test_shortest_interval(skewed, split, monkeypatch, block, share):
    monkeypatch.setattr(K, "BLOCK", block)
    rows, df = skewed
    groups = by_group(rows)
    got = K.shortest_interval(df, ["g"], "v", share).collect()
    assert len(got) == len(groups)
    for r in got:
        x = np.sort([v for v, _ in groups[r.g]])
        k = int(np.floor(share * len(x)))
        width = x[k:] - x[:len(x) - k]
        i = int(np.argmin(width))
        assert (r.low, r.high) == (x[i], x[i + k])


def test_positions_beside_a_label(skewed, split):
    rows, df = skewed
    groups = by_group(rows)
    for r in K.value_positions(df, ["g"], "v", by=["y"]).collect():
        mine = [v for v, _ in groups[r.g]]
        assert r.before == sum(v < r.v for v in mine) and r.here == mine.count(r.v) and r.total == len(mine)
        assert r.n == groups[r.g].count((r.v, r.y))


def test_null_groups_and_nan(spark, split):
    rows = [(None, float(k % 7)) for k in range(80)] + [(1, float("nan"))] * 60 + [(1, float(k)) for k in range(60)] + [(2, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, str(r.v)): (r.n, r.before, r.total) for r in K.value_positions(df, ["g"], "v").collect()}
    assert got[1, "nan"] == (60, 60, 120) and got[1, "59.0"] == (1, 59, 120) and len(got) == 68
    assert got[None, "6.0"][1] + got[None, "6.0"][0] == 80


def test_cumulative_counts(skewed, split):
    rows, df = skewed
    groups = by_group(rows)
    for r in K.cumulative_counts(df, ["g"], "v", df.y).collect():
        mine = groups[r.g]
        assert r.tp == sum(y for v, y in mine if v >= r.v)
        assert r.fp == sum(not y for v, y in mine if v >= r.v)
        assert r.pos == sum(y for _, y in mine) and r.neg == sum(not y for _, y in mine)


def test_mixed_genomes_have_the_right_shares(spark):
    rows = [(s, i, i % 2) for s in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "sid int, id int, rec int").withColumn(
        "k", K.hash_key(2, "sid", "id"))
    out = L.mixed_genomes(df.where("rec = 0"), df.where("rec = 1"), ["sid"], 20, 0.25, 4, "k", ["id"])
    got = out.groupBy("sid").pivot("rec", [0, 1]).count().collect()
    assert all((r["0"], r["1"]) == (60, 20) for r in got) and len(got) == 3
    sizes = out.groupBy("sid", "dset_no").count().collect()
    assert {r["count"] for r in sizes} == {20} and len(sizes) == 12
