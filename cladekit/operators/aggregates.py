"""Counts, shares, grids and descriptive statistics by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import four_uniforms, poisson_count
from ..functions.labels import TIDS
from .ranks import group_quantiles, join_groups, unpivot, value_positions
from .relational import with_group, with_totals


def topology_counts(df: DataFrame, key: str = "sid", tid: str = "tid") -> DataFrame:
    """Topology counts per species tree, one column per topology; absent ones are NULL."""
    cells = [F.count(F.when(F.col(tid) == t, 1)) for t in TIDS]
    return df.groupBy(key).agg(
        *[F.when(c > 0, c).alias(f"n_{t}") for t, c in zip(TIDS, cells)]
    )


def share_of(count: Column, wanted: Column) -> Column:
    """Aggregate: part of ``count`` that falls on the wanted rows."""
    return F.try_divide(F.sum(F.when(wanted, count)), F.sum(count))


def shares_within(df: DataFrame, keys: Sequence[str], count: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's total."""
    out = with_group(df, keys, F.sum(count).alias("_sum"))
    return out.withColumn(name, F.try_divide(count, "_sum")).drop("_sum")


def cross_counts(df: DataFrame, a: str, b: str, name: str = "c") -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias(name))


def split_counts(df: DataFrame, keys: Sequence[str], agrees: Column) -> DataFrame:
    """Concordant and discordant counts; a group without any is NULL on that side."""
    return df.groupBy(*keys).agg(
        F.sum(F.when(agrees, 1)).alias("concordant"),
        F.sum(F.when(~agrees, 1)).alias("discordant"),
    )


def group_stats(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Mean, spread, range, sum and the first and last value in a stated order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"),
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
    )


def balance(df: DataFrame, keys: Sequence[str], count: str, tol: float, least: int = 3) -> DataFrame:
    """Groups whose counts are nearly equal: (max - min) / sum below ``tol``."""
    ratio = F.try_divide(F.max(count) - F.min(count), F.sum(count))
    return (
        df.groupBy(*keys)
        .agg(ratio.alias("diff"), F.count(count).alias("n"))
        .where((F.col("n") >= least) & (F.col("diff") < tol))
    )


def modes(df: DataFrame, key: str, value: str, last: str = "*", name: str = "modes") -> DataFrame:
    """Most frequent values of each group joined by ``/``, ``last`` put at the end."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(key).agg(F.max("_n").alias("_n"))
    ordered = F.array_sort(F.collect_list(
        F.struct((F.col(value) == last).alias("z"), F.col(value).alias("v"))))
    return counts.join(top, [key, "_n"]).groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["v"]), "/").alias(name))


def mean_table(df: DataFrame, index: Sequence[str], column: str, value: str, levels: Sequence):
    """Means spread over one column per level; levels are stated, so no extra job runs."""
    return df.groupBy(*index).pivot(column, list(levels)).agg(F.avg(value))


GRID_BLOCK = 4096


def filled_grid(df: DataFrame, x: str, y: str, value: str, name: str = "filled") -> DataFrame:
    """Means on an x/y grid with gaps along x filled linearly, held flat at the ends.

    Every y row gets every x that occurs anywhere: the x values are numbered as a table and
    joined by number. Gaps are filled in blocks of ``GRID_BLOCK`` cells, and the nearest value
    before and after a block is carried in from one row per block.
    """
    grid = df.groupBy(y, x).agg(F.avg(value).alias(value))
    axis = value_positions(grid.select(x).distinct(), [], x).select(x, F.col("before").cast("long").alias("_i"))
    size = axis.agg(F.count("*")).scalar()
    numbers = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    rows = grid.select(y).distinct().withColumn("_n", size).where("_n > 0").select(y, F.explode(numbers).alias("_i"))
    cells = rows.join(axis, "_i").join(grid, [y, x], "left").withColumn("_b", F.floor(F.col("_i") / GRID_BLOCK))
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("_i"), F.col(value).alias("v")))
    blocks = cells.groupBy(y, "_b").agg(F.min(seen).alias("_first"), F.max(seen).alias("_last"))
    order = Window.partitionBy(y).orderBy("_b")
    carry = blocks.select(
        y, "_b", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    inside = Window.partitionBy(y, "_b").orderBy("_i")
    cells = join_groups(cells, carry, [y, "_b"]).withColumns({
        "_lo": F.coalesce(F.max(seen).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_below"),
        "_hi": F.coalesce(F.min(seen).over(inside.rowsBetween(0, Window.unboundedFollowing)), "_above"),
    })
    span = F.col("_hi._i") - F.col("_lo._i")
    line = F.when(span == 0, F.col("_lo.v")).otherwise(
        F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col("_i") - F.col("_lo._i")) / span
    )
    # equally spaced by column position, as a table interpolation is
    return cells.select(
        x, y, value, F.coalesce(line, F.col("_lo.v"), F.col("_hi.v")).alias(name)
    )


def describe(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Count, mean, sample spread, range, quartiles and IQR of each column."""
    long = unpivot(df, keys, values, "variable", "value").where(F.col("value").isNotNull())
    ids = [*keys, "variable"]
    basic = long.groupBy(*ids).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarts = group_quantiles(long, ids, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quarts, ids).withColumn("iqr", F.col("q75") - F.col("q25"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Whiskers at 5 and 95 %, quartiles and median."""
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    return group_quantiles(df, keys, value, probs)


def below_quantile(df: DataFrame, value: str, p: float, below: bool = True) -> DataFrame:
    """Rows beyond the table-wide quantile ``p``."""
    edge = group_quantiles(df, [], value, {"q": p}).scalar()
    return df.where(F.col(value) < edge) if below else df.where(F.col(value) > edge)


def quantile_bin(df: DataFrame, value: str, bins: int = 4, name: str = "bin") -> DataFrame:
    """0-based bin by equal-count edges, right edges included; tied values share a bin."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    edges = group_quantiles(df, [], value, probs)
    edges = edges.select(F.array(*probs).alias("e")).scalar()
    above = F.size(F.filter("_edges", lambda e: F.col(value) > e))
    return (
        df.withColumn("_edges", edges)
        .withColumn(name, F.when(F.col(value).isNotNull(), above))
        .drop("_edges")
    )


def rate_label(df: DataFrame, key: str, hit: Column) -> DataFrame:
    """Rate, and its ``k / n`` text."""
    k, n = F.count_if(hit), F.count(F.lit(1))
    return df.groupBy(key).agg(
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate"),
        F.concat(k.cast("string"), F.lit(" / "), n.cast("string")).alias("label"),
    )


def variance_to_mean(value: str) -> Column:
    return F.try_divide(F.var_pop(value), F.avg(value))


def array_variance_to_mean(values) -> Column:
    """Row-wise variance-to-mean ratio of an array, NULLs skipped."""
    values = F.filter(values, lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.try_divide(F.try_divide(squares, n), mean)


def total_length(covariance) -> Column:
    """(2 x diagonal - the rest) / 2 of a square matrix column."""
    matrix = F.col(covariance) if isinstance(covariance, str) else covariance
    rows = F.transform(
        matrix,
        lambda row, i: F.aggregate(
            F.transform(row, lambda x, j: F.when(i == j, 2 * x).otherwise(-x)),
            F.lit(0.0), lambda a, x: a + x,
        ),
    )
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x) / 2


def reduction_table(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row holding mean, spread and range of every column."""
    aggs = []
    for c in values:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def correlations(df: DataFrame, target: str, values: Sequence[str], keys: Sequence[str] = ()):
    """Pearson correlation of each column with the target, as rows; undefined ones drop out."""
    wide = df.groupBy(*keys).agg(*[F.corr(c, target).alias(c) for c in values])
    return unpivot(wide, keys, values, "variable", "corr").where(
        F.col("corr").isNotNull() & ~F.isnan("corr"))


def branch_estimate() -> Column:
    """Internal branch from distances: mean of (d14 + d13 - d12 - d34) / 2."""
    d = {k: F.col(f"`{k}`") for k in ("1_4", "1_3", "1_2", "3_4")}
    return F.avg(d["1_4"] + d["1_3"] - d["1_2"] - d["3_4"]) / 2


def counts_for(df: DataFrame, wanted: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Counts for a list of keys, 0 where a key never occurs."""
    return wanted.join(df, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def nested_to_long(df: DataFrame, key: str, lists: str, names=("ix1", "ix2")) -> DataFrame:
    """A column of lists as rows ``(ix1, ix2, value)``."""
    return df.select(F.col(key).alias(names[0]), F.posexplode(lists).alias(names[1], "value"))


def line_summary(
    df: DataFrame, keys: Sequence[str], value: str, z: float = 2.0537489106318225
) -> DataFrame:
    """Mean with a normal interval (96 % by default) per x position and line."""
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"),
        (F.avg(value) + half).alias("high"),
    )


def bootstrap_means(
    df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], replicates: int = 200,
    seed: int = 0, low: float = 0.02, high: float = 0.98,
) -> DataFrame:
    """Bootstrap interval of the group mean.

    Every row gets a Poisson(1) weight per replicate, drawn from its ids. Four replicates share a
    digest; a task adds up the weights of its own rows and passes on one row per group and digest.
    """
    keys, each = list(keys), 4
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, *ids, F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // each) - 1))).alias("_r"))
    drawn = rows.select(*keys, "_v", "_r", F.array(*[
        poisson_count(u).cast("double") for u in four_uniforms(seed, F.col("_r"), *ids)]).alias("_w"))
    sums = drawn.groupBy(*keys, "_r").agg(F.array(*[
        F.struct(F.sum(F.get("_w", F.lit(k)) * F.col("_v")).alias("a"), F.sum(F.get("_w", F.lit(k))).alias("b"))
        for k in range(each)]).alias("_s"))
    slots = sums.select(*keys, "_r", F.posexplode("_s").alias("_k", "_s")).where(F.col("_r") * each + F.col("_k") < replicates)
    means = slots.select(*keys, (F.col("_s.a") / F.nullif(F.col("_s.b"), F.lit(0.0))).alias("_m"))
    ordered = F.array_sort(F.collect_list("_m"))

    def pick(p: float) -> Column:
        return F.get("_ms", F.floor((F.size("_ms") - 1) * p).cast("int"))

    spread = means.groupBy(*keys).agg(ordered.alias("_ms")).select(
        *keys, pick(low).alias("low"), pick(high).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(spread, keys)


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """First central moment (always 0), variance and skewness."""
    return df.groupBy(*keys).agg(
        F.when(F.count(value) > 0, F.lit(0.0)).alias("moment1"),
        F.var_pop(value).alias("moment2"), F.skewness(value).alias("skew"),
        F.avg(value).alias("mean"),
    )


def row_shares(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Each count column divided by the row's sum."""
    total = sum(F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in counts)
    return df.withColumns({f"{c}_share": F.try_divide(F.col(f"`{c}`"), total) for c in counts})


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 200) -> DataFrame:
    """Counts in equal-width bins over the table-wide range; the top edge is inside."""
    spread = with_totals(df, {"_lo": F.min(value), "_hi": F.max(value)})
    place = F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(place, F.lit(bins - 1)))
    return (
        spread.where(F.col(value).isNotNull()).withColumn("bin", place.cast("long"))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def rolling_pair_mean(df: DataFrame, keys: Sequence[str], order: str, value: str) -> Column:
    """Mean with the previous row of a small, already aggregated series; NULL on its first row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 0)
    return F.when(F.count(F.lit(1)).over(w) == 2, F.avg(value).over(w))
