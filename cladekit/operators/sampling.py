"""Random but repeatable samples, shuffles and fixed-size genomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .ranks import hash_key, number_rows


def first_by_key(
    df: DataFrame, group: Sequence[str], n: int, key: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` rows of every group with the smallest random key."""
    return number_rows(df, group, key, tiebreak, name="_rn", limit=n).drop("_rn")


def sample_rows(df: DataFrame, n: int, seed, ids: Sequence[str]) -> DataFrame:
    """``n`` rows drawn by a hash of their ids; a top-n, not a global sort of the table."""
    return df.withColumn("_key", hash_key(seed, *ids)).orderBy("_key", *ids).limit(n).drop("_key")


def sample_blocks(df: DataFrame, fraction: float, seed: int, key: str, size: int) -> DataFrame:
    """Whole blocks of ``size`` neighbouring keys, each drawn with the same chance."""
    return df.where(uniform(seed, 0, F.floor(F.col(key) / size)) < fraction)


def shuffled_genomes(
    df: DataFrame, group: Sequence[str], size: int, key: str, tiebreak: Sequence[str] = (),
    limit: int | None = None, name: str = "dset_no",
) -> DataFrame:
    """Deal the rows of each group, in key order, into genomes of ``size``; the last may be short."""
    dealt = number_rows(df, group, key, tiebreak, name="_rn", limit=limit)
    return dealt.withColumn(name, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def data_set_number(row_number: Column, size: int = 15) -> Column:
    """Data set of a 0-based row number."""
    return F.floor(row_number / size).cast("long")


def mixed_genomes(
    plain: DataFrame, recombined: DataFrame, group: Sequence[str], genes: int, share: float,
    genomes: int, key: str, tiebreak: Sequence[str] = (), seed=0,
) -> DataFrame:
    """Genomes in which ``share`` of the genes come from recombined trees.

    Both parts are drawn by their stored key; the union is reordered by a seeded hash of
    that key before it is dealt.
    """
    genes_r = int(genes * share)
    part_r = first_by_key(recombined, group, genes_r * genomes, key, tiebreak)
    part_p = first_by_key(plain, group, (genes - genes_r) * genomes, key, tiebreak)
    both = part_p.withColumn("_src", F.lit("p")).unionByName(
        part_r.withColumn("_src", F.lit("r"))
    )
    both = both.withColumn("_mix", F.md5(F.concat_ws("|", F.lit(str(seed)), "_src", key)))
    return shuffled_genomes(both, group, genes, "_mix", ["_src", *tiebreak]).drop("_mix", "_src")


def replicate_samples(
    df: DataFrame, fraction: float, replicates: int, seed, ids: Sequence[str],
    name: str = "replicate",
) -> DataFrame:
    """Independent samples 1..replicates in one pass; a row is copied only where it is drawn."""
    draws = [
        F.when(
            F.conv(F.substring(hash_key(f"{seed}:{r}", *ids), 1, 8), 16, 10).cast("long")
            < int(fraction * 16**8),
            F.lit(r),
        )
        for r in range(1, replicates + 1)
    ]
    hits = F.array_compact(F.array(*draws))
    return df.withColumn(name, F.explode(hits))


def largest(df: DataFrame, by: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *tiebreak).limit(n)


def smallest(df: DataFrame, by: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.asc(by), *tiebreak).limit(n)


def order_position(column: str, order: Sequence) -> Column:
    """Sort key that follows a given list of values."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
