"""Rank tests on distributed ranks, and the step-down correction of their p-values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import chi2_tail, normal_tail
from .ranks import shared_rank, unpivot, value_positions


def tied_cubes() -> Column:
    """t^3 - t of the t equal values, dealt over their rows of ``value_positions`` with ``by``."""
    t = F.col("here").cast("double")
    return F.col("n") * (t * t - 1)


def kruskal_wallis(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """H and p over the samples held in ``columns``, per group of ``keys``."""
    long = unpivot(df, keys, columns, "_sample", "_x")
    ranks = value_positions(long, keys, "_x", by=["_sample"]).withColumn("_r", shared_rank())
    aggs = [F.sum(tied_cubes()).alias("_ties"), F.max("total").cast("double").alias("_N")]
    for i, c in enumerate(columns):
        mine = F.col("_sample") == c
        aggs += [F.sum(F.when(mine, F.col("n") * F.col("_r")).otherwise(0.0)).alias(f"_R{i}"),
                 F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"_c{i}")]
    per = ranks.groupBy(*keys).agg(*aggs)
    big = F.col("_N")
    spread = sum(F.try_divide(F.col(f"_R{i}") * F.col(f"_R{i}"), f"_c{i}")
                 for i in range(len(columns)))
    h = 12 / (big * (big + 1)) * spread - 3 * (big + 1)
    h = F.try_divide(h, 1 - F.try_divide(F.col("_ties"), big * big * big - big))
    return per.select(*keys, h.alias("stat")).withColumn(
        "pval", chi2_tail("stat", len(columns) - 1))


def signed_rank(
    df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = (),
    alternative: str = "greater",
) -> DataFrame:
    """Paired signed-rank test of ``a > b`` for each pair of columns (normal approximation)."""
    diffs = [F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d"))
             for a, b in pairs]
    long = (
        df.select(*keys, F.explode(F.array(*diffs)).alias("_x"))
        .select(*keys, "_x.pair", F.col("_x.d").alias("_d"))
        .where(F.col("_d") != 0)
        .withColumn("_a", F.abs("_d"))
    )
    ranks = value_positions(
        long.withColumn("_up", F.col("_d") > 0), [*keys, "pair"], "_a", by=["_up"]
    ).withColumn("_r", shared_rank())
    per = ranks.groupBy(*keys, "pair").agg(
        F.sum(F.when(F.col("_up"), F.col("n") * F.col("_r")).otherwise(0.0)).alias("wplus"),
        F.max("total").cast("double").alias("_n"),
        F.sum(tied_cubes()).alias("_ties"),
    )
    n = F.col("_n")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.try_divide(F.col("wplus") - mean, F.sqrt(var))
    out = per.select(*keys, "pair", "wplus", F.col("_n").cast("long").alias("n"), z.alias("z"))
    if alternative == "greater":
        return out.withColumn("pval", normal_tail("z"))
    return out.withColumn("pval", F.least(2 * normal_tail(F.abs("z")), F.lit(1.0)))


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(permutations(columns, 2))


def mann_whitney(df: DataFrame, columns: Sequence[str], first: Column) -> DataFrame:
    """U of the ``first`` rows against the others, and its two-sided p, per column."""
    long = unpivot(df.withColumn("_g", first.cast("int")), ["_g"], columns, "variable", "_x")
    ranks = value_positions(long, ["variable"], "_x", by=["_g"]).withColumn("_r", shared_rank())
    ones = F.col("_g") * F.col("n")
    per = ranks.groupBy("variable").agg(
        F.sum(ones * F.col("_r")).alias("_R1"), F.sum(ones).cast("double").alias("_a"),
        F.max("total").cast("double").alias("_N"), F.sum(tied_cubes()).alias("_ties"),
    )
    a, big = F.col("_a"), F.col("_N")
    b = big - a
    u = F.col("_R1") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((big + 1) - F.try_divide(F.col("_ties"), big * (big - 1))))
    z = F.try_divide(F.abs(u - a * b / 2) - 0.5, sd)
    return per.select("variable", u.alias("u"), z.alias("z")).withColumn(
        "pval", F.least(2 * normal_tail("z"), F.lit(1.0)))


def holm(df: DataFrame, pval: str = "pval", family: Sequence[str] = (), alpha: float = 0.01,
         sidak: bool = False) -> DataFrame:
    """Step-down corrected p and the decision. A family is a short list of tests."""
    order = Window.partitionBy(*family).orderBy(pval)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    left = m - F.row_number().over(order) + 1
    raw = 1 - F.pow(1 - F.col(pval), left) if sidak else F.col(pval) * left
    stepped = df.withColumn("_raw", raw)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        stepped.withColumn("corrected", F.least(F.max("_raw").over(upto), F.lit(1.0)))
        .withColumn("rejected", F.col("corrected") <= alpha)
        .drop("_raw")
    )


def edges(df: DataFrame, pair: str = "pair") -> DataFrame:
    """Directed edges of the significant ``a>b`` pairs."""
    ends = F.split(pair, ">")
    return df.where("rejected").select(ends[0].alias("src"), ends[1].alias("dst"))
