"""Filters, joins, unions and projections shared by all jobs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain
from .ranks import join_groups


# ---- filters -----------------------------------------------------------------------------

def where_equal(df: DataFrame, **values) -> DataFrame:
    """Keep rows whose columns equal the given values."""
    return functools.reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), values.items(), df)


def where_matched_model(df: DataFrame, simulated="sim_model", inferred="infer_model") -> DataFrame:
    """Keep trees inferred with the model they were simulated with."""
    return df.where(F.col(inferred).contains(F.col(simulated)))


def where_blocks(df: DataFrame, blocks: int, array: str = "tree_no") -> DataFrame:
    """Keep rows whose array has ``blocks`` elements; an empty array never qualifies."""
    size = F.array_size(array)
    return df.where((size > 0) & (size == blocks))


def where_query(df: DataFrame, query: str) -> DataFrame:
    """Filter by condition text, chained comparisons allowed."""
    return df.where(chain(query))


def where_extreme(df: DataFrame, y: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(y) < low) | (F.col(y) > high))


def where_known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep rows without a NULL key; NaN is a key."""
    return functools.reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)


def where_group_size(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Keep groups with at least ``least`` rows; a counted semi join, not a window. Rows with a NULL key drop out."""
    if least <= 1:  # every group has a row
        return where_known(df, keys)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(big.select(*keys), list(keys), "left_semi")


def without_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(~F.col(column).startswith(prefix))


def some_of_each_clade(clades: Column, needed: Sequence[str] = ("1", "2", "3", "4")) -> Column:
    each = [F.array_contains(clades, k) for k in needed]
    return functools.reduce(lambda a, b: a & b, each)


# ---- projections -------------------------------------------------------------------------

def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def columns_starting(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    wanted = [c for c in df.columns if c in keep or any(c.startswith(p) for p in prefixes)]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def scaled(df: DataFrame, columns: Sequence[str], by: float) -> DataFrame:
    return df.withColumns({c: F.col(c) / by for c in columns})


def lookup(df: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """Add ``value`` by key; rows whose key is unknown drop out.

    No broadcast is forced: the adaptive planner picks one when the table is measured small.
    """
    return df.join(table.select(on, value), on)


def lookup_list(array: Column, mapping: dict) -> Column:
    """Translate every element of an array by a fixed, short mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.transform(array, lambda x: F.element_at(F.create_map(*pairs), x))


# ---- joins -------------------------------------------------------------------------------

def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column both sides share."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("the two sides share no column")
    return left.join(right, shared, how)


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of each group to its rows.

    The aggregate combines before its shuffle and the adaptive join splits hot keys, so no
    task sees a whole group as a window would.
    """
    return join_groups(df, df.groupBy(*keys).agg(*aggs), list(keys))


def with_totals(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Attach whole-table aggregates, computed once, as one scalar struct."""
    one = df.agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("_t"))
    out = df.withColumn("_t", one.scalar())
    return out.withColumns({k: F.col(f"_t.{k}") for k in aggs}).drop("_t")


def aligned(rows: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels in the shape of ``rows``: missing keys give NULL."""
    return rows.join(labels, list(keys), "left")


def eligible_ids(trees: DataFrame, species: DataFrame, least: int, key: str = "sid") -> DataFrame:
    """Species trees that have at least ``least`` gene trees."""
    enough = trees.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return species.join(enough.select(key), key, "left_semi")


def trees_with_sites(
    trees: DataFrame, sites: DataFrame, keys: Sequence[str], matched_model: bool = True
) -> DataFrame:
    """Gene trees with their site counts, NULL where a tree has none."""
    if matched_model:
        trees = where_matched_model(trees)
    return trees.join(sites, list(keys), "left")


def star_views(
    true_trees: DataFrame, generated: DataFrame, species: DataFrame, inferred: DataFrame,
    pairs: Sequence[tuple[str, str]],
) -> DataFrame:
    """Inferred, true and species measures of each gene tree, for several pairs of models.

    Inputs carry already prefixed measures: true trees key ``gid``; ``generated`` maps
    ``gid`` to ``sid``; inferred rows point to ``gid``. The pairs share one pass and are told
    apart by ``view``, ``simulated/inferred``.
    """
    view = F.concat_ws("/", "sim_model", "infer_model")
    chosen = inferred.withColumn("view", view).where(
        F.col("view").isin([f"{s}/{i}" for s, i in pairs]))
    return (
        true_trees.join(generated, "gid")
        .join(species, "sid", "left")
        .join(chosen, "gid")
        .withColumns({"ibl": F.col("s_1_2") - F.col("s_1_3"), "ebl": F.col("s_1_1") - F.col("s_1_2")})
    )


def outer_fraction(concordant: DataFrame, discordant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of concordant counts; NULL when either side is missing."""
    a = concordant.withColumnRenamed("c", "c_x")
    b = discordant.withColumnRenamed("c", "c_y")
    return a.join(b, list(keys), "full").withColumn(
        "n", F.try_divide(F.col("c_x"), F.col("c_x") + F.col("c_y"))
    )


# ---- sets --------------------------------------------------------------------------------

def union_rows(*frames: DataFrame, common_only: bool = False) -> DataFrame:
    """Stack frames; keep only shared columns, or fill the missing ones with NULL."""
    if common_only:
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
        frames = tuple(f.select(*shared) for f in frames)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame, once each."""
    first, *rest = [f.select(*keys) for f in frames]
    return functools.reduce(lambda a, b: a.intersect(b), rest, first) if rest else first.distinct()


def balanced_rows(
    df: DataFrame, within: Sequence[str], level: str, keys: Sequence[str]
) -> DataFrame:
    """Per ``within`` group, keep rows whose key occurs at every level of that group."""
    seen = df.select(*within, level, *keys).distinct()
    levels = seen.select(*within, level).distinct().groupBy(*within).agg(
        F.count(F.lit(1)).alias("_levels"))
    full = (
        seen.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("_n"))
        .join(levels, list(within))
        .where(F.col("_n") == F.col("_levels"))
        .select(*within, *keys)
    )
    return df.join(full, [*within, *keys], "left_semi")
