import random

from pyspark.sql import functions as F

from cladekit.llm import common


def test_components(spark):
    pick = random.Random(7)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)] + [(7, 7)]
    up = {}

    def top(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in common.components(df, "t").collect()} == {a: top(a) for a in up}
    assert common.components(df.where("false"), "t").collect() == []


def test_ranks_and_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    ranks = {}
    for r in common.spread_rank(df, "k", ["id"], 16).collect():
        ranks.setdefault(r["k"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    got = common.numbered(df, F.col("k"), F.col("id"), label="n").orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
