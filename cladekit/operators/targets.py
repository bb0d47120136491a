"""Targets, splits, noise and preprocessing of the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregates import shares_within
from ..functions.draws import normal, uniform
from .ranks import quantiles_long


def with_targets(df: DataFrame, gene_tree_counts: DataFrame | None = None) -> DataFrame:
    """Log odds of the expected concordance, and of the counted one where counts exist."""
    out = df.withColumn("y_prob", S.log_odds(S.expected_concordance("ibl"), 1e-11))
    if gene_tree_counts is None:
        return out
    first = shares_within(gene_tree_counts, ["ebl", "ibl"], "count", "_f").where("tid = 1")
    first = first.select("ebl", "ibl", S.log_odds("_f").alias("y_true"))
    return out.join(first, ["ebl", "ibl"], "left")


def class_target(df: DataFrame, tol: float = 0.1, low: float | None = None,
                 high: float | None = None, y_prob: str = "y_prob") -> DataFrame:
    """Concordance class: above 1 - tol, or the rows beyond the two limits with their share."""
    y = S.sigmoid(y_prob)
    if low is not None and high is not None:
        return df.withColumn("y", y).where((F.col("y") < low) | (F.col("y") > high))
    return df.withColumn("y", (y > 1 - tol).cast("int"))


def regression_target(df: DataFrame, log: bool = False, y_prob: str = "y_prob") -> DataFrame:
    y = S.sigmoid(y_prob)
    return df.withColumn("y", F.log(y) if log else y)


def key_bucket(keys: Sequence[str], seed, buckets: int = 1000) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def train_test(df: DataFrame, keys: Sequence[str], test_share: float = 0.1, seed=123454):
    """Split by a hash of the key: repeatable, and the same however the data is laid out."""
    tagged = df.withColumn("_b", key_bucket(keys, seed))
    cut = int(round(test_share * 1000))
    return tagged.where(F.col("_b") >= cut).drop("_b"), tagged.where(F.col("_b") < cut).drop("_b")


def with_fold(df: DataFrame, keys: Sequence[str], folds: int = 10, seed=123456,
              name: str = "fold") -> DataFrame:
    return df.withColumn(name, key_bucket(keys, seed, folds).cast("int"))


def label_noise(df: DataFrame, y: str, scale: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """Gaussian noise on a target, drawn from each row's keys."""
    return df.withColumn(y, F.col(y) + scale * normal(seed, *keys))


def flip_classes(df: DataFrame, y: str, share: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """Flip a ``share`` of 0/1 labels, drawn from each row's keys."""
    return df.withColumn(y, F.when(uniform(seed, 0, *keys) < share, 1 - F.col(y)).otherwise(F.col(y)))


def column_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of exact medians; a column without values gives 0."""
    med = quantiles_long(train, [], columns, {"m": 0.5})
    return med.agg(*[
        F.coalesce(F.max(F.when(F.col("variable") == c, F.col("m"))), F.lit(0.0)).alias(c)
        for c in columns])


def fit_scaling(train: DataFrame, columns: Sequence[str], impute: bool = True) -> DataFrame:
    """One row of medians, means and spreads of the training rows, as a table that can be saved.

    The spread is the population one and is taken after imputing; 0 becomes 1. Missing flags
    are scaled like any feature.
    """
    if impute:
        med = column_medians(train, columns).select(F.struct(*columns)).scalar()
        train = train.withColumn("_m", med)
    aggs = []
    for c in columns:
        x = F.col(f"`{c}`")
        filled = F.coalesce(x, F.col(f"_m.`{c}`")) if impute else x
        parts = [F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("std")]
        if impute:
            flag = x.isNull().cast("double")
            parts += [F.max(F.col(f"_m.`{c}`")).alias("median"), F.avg(flag).alias("flag_mean"),
                      F.stddev_pop(flag).alias("flag_std")]
        aggs.append(F.struct(*parts).alias(c))
    return train.agg(*aggs)


def apply_scaling(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaled features, and a scaled ``missing__`` flag per column if the fit has medians."""
    impute = "median" in fitted.schema[columns[0]].dataType.names
    rows = df.withColumn("_f", fitted.select(F.struct(*[f"`{c}`" for c in columns])).scalar())
    out = {}
    for c in columns:
        f = F.col("_f")[c]
        x = F.col(f"`{c}`")
        filled = F.coalesce(x, f["median"]) if impute else x
        out[c] = (filled - f["mean"]) / F.when(f["std"] == 0, 1.0).otherwise(f["std"])
        if impute:
            spread = F.when(f["flag_std"] == 0, 1.0).otherwise(f["flag_std"])
            out[f"missing__{c}"] = (x.isNull().cast("double") - f["flag_mean"]) / spread
    return rows.withColumns(out).drop("_f")


def vector_pipeline(columns: Sequence[str], scale: bool = True) -> Pipeline:
    """Assembler and scaler for the learners; rows with a gap must be imputed before."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw_features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features",
                                     withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    return Pipeline(stages=stages)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def z_normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample spread, over the whole table."""
    parts = [F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]
    rows = df.withColumn("_z", df.agg(F.struct(*parts)).scalar())
    return rows.withColumns({
        c: F.try_divide(F.col(c) - F.col("_z")[c]["m"], F.col("_z")[c]["s"]) for c in columns}).drop("_z")
