"""Large, infinite, NaN and NULL values, large ids and long labels."""

import math

from pyspark.sql import functions as F

from cladekit.functions import scalars as S
from cladekit.operators import quartets as Q
from cladekit.operators import ranks as R
from cladekit.functions.draws import poisson_one
from cladekit.operators.sampling import shuffled_genomes
from cladekit.plans.registry import rounded, tidy


def test_shown_values_pass_through(spark):
    import duckdb

    values = [1e14, 3e18, -1e300, math.inf, -math.inf, math.nan, 0.1234567, -2.5, None]
    rows = [r["x"] for r in tidy(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    theirs = [r[0] for r in con.execute(rounded("SELECT x FROM t", "x")).fetchall()]
    assert [repr(v) for v in rows] == [repr(v) for v in theirs]
    assert rows[:5] == values[:5] and math.isnan(rows[5]) and rows[6:8] == [0.123457, -2.5]


def test_nan_stands_last(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 1.0, math.nan, 2.0, 3.0, math.inf)], "x double")
    at = {repr(r["x"]): r["before"] for r in R.value_positions(df, [], "x").collect()}
    assert at == {"-5.0": 0, "1.0": 1, "2.0": 2, "3.0": 3, "inf": 4, "nan": 5}


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, "a1", 1.0), (None, "b2", 2.0), (1, "c3", 3.0)], "g int, k string, v double")
    for limit in (None, 5, 5000):
        got = sorted(((r["g"] or 0, r["rn"]) for r in R.number_rows(df, ["g"], "k", limit=limit).collect()))
        assert got == [(0, 1), (0, 2), (1, 1)]
    assert {r["g"]: r["m"] for r in R.group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 1.5, 1: 3.0}
    counts = R.cumulative_counts(df, ["g"], "v", F.col("v") > 1.5).collect()
    assert sorted((r["g"] or 0, r["v"], r["tp"], r["fp"]) for r in counts) == [(0, 1.0, 1, 1), (0, 2.0, 1, 0), (1, 3.0, 1, 0)]


def test_short_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    plan = R.number_rows(df, ["g"], "k", limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_tree_counts(spark):
    got = [r["t"] for r in spark.range(1, 16).select(S.rooted_tree_count("id").alias("t")).collect()]
    expected = [math.prod(range(1, 2 * n - 2, 2)) for n in range(1, 16)]
    assert got == expected and got[-1] == 213458046676875


def test_labels_swap(spark):
    rows = spark.createDataFrame([("ab##cd.e",), ("cdab",), ("xx",), ("",)], "s string")
    assert [r[0] for r in rows.select(S.swap_labels("s", "ab", "cd")).collect()] == ["cd##ab.e", "abcd", "xx", ""]


def test_large_tree_numbers(spark):
    big = 1 << 40
    rows = spark.createDataFrame([("t", "WAG", 0, big + 1)], "stree string, sim_model string, ds_no int, tree_no long")
    recmap = spark.createDataFrame([("t", "WAG", 0, 0, big, big + 7)],
                                   "stree string, sim_model string, ds_no int, block long, tree_ix long, source long")
    assert Q.recombined_trees(rows, recmap).collect()[0]["tree_no"] == [big + 7]


def test_any_clade_order_is_placed(spark):
    import itertools

    orders = ["".join(p) for p in itertools.permutations("1234")]
    df = spark.createDataFrame([(o, 1.0, 2.0, 3.0) for o in orders], "order string, qCF double, qDF1 double, qDF2 double")
    for r in Q.remapped_sites(df).collect():
        assert sorted([r["qCF"], r["qDF1"], r["qDF2"]]) == [1.0, 2.0, 3.0]
        if r["order"] in ("1234", "2143", "3412"):
            assert r["qCF"] == 1.0


def test_poisson_tail():
    chances = poisson_one()
    assert chances[-1] >= 1 - 1e-15 and all(a < b for a, b in zip(chances, chances[1:]))
    assert abs(chances[3] - 0.98101184312) < 1e-10
