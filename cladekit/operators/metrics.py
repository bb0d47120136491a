"""Registries of model scores; each entry is an aggregate column, so all share one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import auc_by_truth_cut


def _cells(y, p) -> tuple[Column, Column, Column, Column]:
    y, p = F.col(y) == 1, F.col(p) == 1
    return (F.count_if(y & p).cast("double"), F.count_if(~y & ~p).cast("double"),
            F.count_if(~y & p).cast("double"), F.count_if(y & ~p).cast("double"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def accuracy(y, p) -> Column:
    tp, tn, fp, fn = _cells(y, p)
    return F.try_divide(tp + tn, tp + tn + fp + fn)


def precision(y, p) -> Column:
    tp, _, fp, _ = _cells(y, p)
    return _ratio(tp, tp + fp)


def recall(y, p) -> Column:
    tp, _, _, fn = _cells(y, p)
    return _ratio(tp, tp + fn)


def f1(y, p) -> Column:
    tp, _, fp, fn = _cells(y, p)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def mcc(y, p) -> Column:
    tp, tn, fp, fn = _cells(y, p)
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def mse(y, p) -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def mae(y, p) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def explained_variance(y, p) -> Column:
    return 1 - F.try_divide(F.var_pop(F.col(y) - F.col(p)), F.var_pop(y))


REGRESSION = {"MSE": mse, "MAE": mae, "EV": explained_variance}
CLASSIFICATION = {"Acc": accuracy, "F1": f1, "Prec": precision, "Recall": recall, "MCC": mcc}


def score(df: DataFrame, y: str, p: str, table: dict, keys: Sequence[str] = (),
          names: Sequence[str] | None = None) -> DataFrame:
    """The chosen scores per group."""
    chosen = {k: table[k] for k in (names or table)}
    return df.groupBy(*keys).agg(*[f(y, p).alias(k) for k, f in chosen.items()])


def class_scores(df: DataFrame, y: str, p: str, proba: str | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """All class scores, with the rank AUC of ``proba`` (or of the hard class)."""
    out = score(df, y, p, CLASSIFICATION, keys)
    auc = auc_by_truth_cut(
        df.withColumn("_s", F.col(proba or p).cast("double")), [0.5], y, "_s", keys
    ).select(*keys, F.col("auc").alias("AUC"))
    if keys:
        return out.join(auc, list(keys))
    return out.withColumn("AUC", auc.scalar())
