"""Names of leaf pairs, features and taxon subsets."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAVES = ("1", "2", "3", "4")
STATS = ("mean", "std", "min", "max", "median")
TIDS = (1, 2, 3)
SITE_FEATURES = ("top_1", "top_2", "top_3", "nsites")


def pair_labels(leaves=LEAVES, diag: bool = False) -> list[str]:
    """Lower-triangle order: 1_2, 1_3, 2_3, 1_4, 2_4, 3_4."""
    pick = combinations_with_replacement if diag else combinations
    pairs = sorted(pick(list(leaves), 2), key=lambda p: (p[1], p[0]))
    return ["_".join(p) for p in pairs]


def subsets(leaves, size: int) -> list[tuple[str, ...]]:
    return list(combinations(leaves, size))


def flatten_pairs(matrix, leaves=LEAVES, diag: bool = False, exclude=()) -> list[Column]:
    """Columns for the lower triangle of a square array-of-arrays column."""
    matrix = F.col(matrix) if isinstance(matrix, str) else matrix
    n = len(leaves)
    out = []
    for i in range(n):
        for j in range(i + 1 if diag else i):
            name = f"{leaves[j]}_{leaves[i]}"
            if name not in exclude:
                out.append(F.get(F.get(matrix, F.lit(i)), F.lit(j)).alias(name))
    return out


def feature_name(feature: str, stat: str, tid: int) -> str:
    return f"{feature}__{stat}__{tid}"


def genome_features() -> tuple[str, ...]:
    """The 11 per-gene measurements that a genome row summarises."""
    return (*pair_labels(), *SITE_FEATURES, "seq_length")


def genome_columns() -> list[str]:
    """The 168 columns of a genome row."""
    wide = [feature_name(f, s, t) for f in genome_features() for s in STATS for t in TIDS]
    return wide + [feature_name("counts", "", t) for t in TIDS]
