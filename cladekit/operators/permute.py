"""Exchange of ingroup labels over the columns of a genome matrix.

Only three leaves can trade places, so there are four column mappings: none, and one per
pair. Which one a row takes is decided by a hash of its key, so labels made later from the
same key always match the features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Swaps in order, topology ids after each swap, species topology per swap.
SWAPS = ((None, None), ("1", "2"), ("1", "3"), ("2", "3"))
TOPOLOGY_AFTER = (
    {1: 1, 2: 2, 3: 3},
    {1: 1, 2: 3, 3: 2},
    {1: 3, 2: 2, 3: 1},
    {1: 2, 2: 1, 3: 3},
)
SPECIES_LABEL = {0: 0, 1: 0, 2: 2, 3: 1}


def renamed(column: str, swap: int) -> str:
    """Name a ``feature__stat__tid`` column takes under a swap; swaps undo themselves."""
    if swap == 0 or "__" not in column:
        return column
    feature, stat, tid = column.split("__")
    tids = TOPOLOGY_AFTER[swap]
    a, b = SWAPS[swap]
    if feature.startswith("top_"):
        feature = f"top_{tids[int(feature[4:])]}"
    elif len(feature) == 3 and feature[1] == "_":
        ends = [{a: b, b: a}.get(x, x) for x in feature.split("_")]
        feature = "_".join(sorted(ends))
    return f"{feature}__{stat}__{tids[int(tid)]}"


def swap_index(keys: Sequence[str], seed=0, swaps: int = 4) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(swaps)).cast("int")


def permuted(df: DataFrame, index: str | Column) -> DataFrame:
    """Move every matrix column to its place under the row's swap."""
    index = F.col(index) if isinstance(index, str) else index
    names = set(df.columns)
    moved = {}
    for c in df.columns:
        sources = [renamed(c, k) for k in range(4)]
        if len(set(sources)) == 1:
            continue
        absent = [s for s in sources if s not in names]
        if absent:
            raise ValueError(f"column {c} trades places with missing {absent[0]}")
        out = F.col(f"`{c}`")
        for k in range(1, 4):
            if sources[k] != c:
                out = F.when(index == k, F.col(f"`{sources[k]}`")).otherwise(out)
        moved[c] = out
    return df.select(*[moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns])


def random_labels(df: DataFrame, keys: Sequence[str], seed=0, topology: bool = False) -> DataFrame:
    """Permute each row by its own swap; optionally add the resulting species topology."""
    tagged = df.withColumn("_swap", swap_index(keys, seed))
    out = permuted(tagged, "_swap")
    if topology:
        out = out.withColumn("species_topology", species_label(F.col("_swap")))
    return out.drop("_swap")


def species_label(swap: Column) -> Column:
    pairs = [F.lit(x) for kv in SPECIES_LABEL.items() for x in kv]
    return F.element_at(F.create_map(*pairs), swap)


def scoring_set(df: DataFrame, swaps: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One copy of every row per swap, infinities replaced by 0."""
    kinds = dict(df.dtypes)
    copies = df.withColumn("Permutation", F.explode(F.array(*[F.lit(s) for s in swaps])))
    out = permuted(copies, "Permutation")
    inf = float("inf")
    return out.withColumns({
        c: F.when(F.col(f"`{c}`") == inf, 0.0).otherwise(F.col(f"`{c}`"))
        for c in df.columns if kinds[c] in ("double", "float") and "__" in c
    })
