"""Scores of predictions: per condition, per threshold and over rank orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .aggregates import rolling_pair_mean
from .ranks import (
    cumulative_counts,
    group_quantiles,
    shared_rank,
    shortest_interval,
    unpivot,
    value_positions,
    with_bucket,
)
from .relational import union_rows

CONDITION = ("ebl", "ibl")


def error_columns(p: str, q: str) -> dict[str, Column]:
    """Divergences and errors of a predicted share ``q`` against the true share ``p``."""
    p, q = F.col(p), F.col(q)
    return {
        "dH": S.hellinger(p, q), "dKL": S.kl_bernoulli(p, q), "dTV": S.total_variation(p, q),
        "ERROR": q - p, "REL_ERR": F.try_divide(q - p, p), "ACC": S.rounds_alike(p, q),
    }


def interval_hits(
    df: DataFrame, keys: Sequence[str] = CONDITION, y="y_true", preds="preds",
    share: float = 0.8, strict: bool = False,
) -> DataFrame:
    """+1 where the mean truth lies in the highest-density interval of the predictions, else -1.

    ``strict`` excludes the ends and leaves the low end uncapped.
    """
    spans = shortest_interval(df, keys, preds, share)
    truth = df.groupBy(*keys).agg(F.avg(y).alias("_p"))
    p = F.col("_p")
    if strict:
        inside = (F.col("low") < p) & (p < F.col("high"))
    else:
        inside = (F.least("low", F.lit(1.0)) <= p) & (p <= F.col("high"))
    return truth.join(spans, list(keys)).select(
        *keys, "low", "high", F.when(inside, 1).otherwise(-1).alias("HDI"))


def condition_errors(
    df: DataFrame, keys: Sequence[str] = CONDITION, y="y_true", preds="preds",
    share: float = 0.8, with_interval: bool = True,
) -> DataFrame:
    """Regression summary per condition."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("p"), F.avg(preds).alias("q"))
    out = means.withColumns(error_columns("p", "q"))
    if with_interval:
        hits = interval_hits(df, keys, y, preds, share).select(*keys, "HDI")
        out = out.join(hits, list(keys))
    return out.drop("p", "q")


def class_from_scores(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predicted class and score, from two class columns or from one score column."""
    if {"0", "1"} <= set(df.columns):
        return df.withColumns({"pred": S.argmax(["`0`", "`1`"]), "pred_proba": F.col("`1`")})
    return df.withColumns({
        "pred": (F.col("preds") >= threshold).cast("int"), "pred_proba": F.col("preds")})


def log_loss(y: Column, score: Column, eps: float = 2.220446049250313e-16) -> Column:
    """Aggregate: mean negative log likelihood of a binary score."""
    p = S.clip(score, eps, 1 - eps)
    return -F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))


def binary_summary(df: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    """Error shares (of all rows), accuracy, F1 and log loss per condition."""
    pred, y = F.col("pred"), F.col("y_true")

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    tp = F.count_if((pred == 1) & (y == 1))
    wrong = F.count_if(pred != y)
    f1 = F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(0.0)
    return df.groupBy(*keys).agg(
        share((pred == 0) & (y == 1)).alias("fnr"), share((pred == 1) & (y == 0)).alias("fpr"),
        share(pred == y).alias("accuracy"), f1.alias("f1"),
        log_loss(y, F.col("pred_proba")).alias("cross_entropy"),
    )


def topology_summary(
    df: DataFrame, classes: Sequence[str], keys: Sequence[str] = CONDITION,
    eps: float = 2.220446049250313e-16,
) -> DataFrame:
    """Accuracy and cross-entropy of class log-probabilities (rows are rescaled to sum to 1)."""
    probs = [F.exp(F.col(f"`{c}`")) for c in classes]
    whole = sum(probs)
    truth = F.lit(None).cast("double")
    for i, p in enumerate(probs):
        truth = F.when(F.col("y_true") == i, F.try_divide(p, whole)).otherwise(truth)
    hit = (S.argmax(probs) == F.col("y_true")).cast("double")
    return df.groupBy(*keys).agg(
        F.avg(hit).alias("accuracy"),
        (-F.avg(F.log(S.clip(truth, eps, 1 - eps)))).alias("cross_entropy"),
    )


def binned_rates(
    df: DataFrame, cut: float, truth_cut: float = 0.9, width: float = 10, x: str = "ebl",
    keys: Sequence[str] = (), first: float | None = None, last: float | None = None,
) -> DataFrame:
    """False negative and positive rates per bin of ``x``, with their two-bin rolling means.

    The rates divide by the predicted negatives and positives and are 0 where there are none.
    Bins holding only one class of truth and prediction are left out.
    """
    y, p = F.col("y_true") > truth_cut, F.col("preds") > cut
    start = F.floor(F.col(x) / width) * width
    rows = df.withColumn("bin", start.cast("double"))
    if first is not None:
        rows = rows.where(F.col("bin") >= first)
    if last is not None:
        rows = rows.where(F.col("bin") <= last)
    per = rows.groupBy(*keys, "bin").agg(
        F.count_if(~y & ~p).alias("_tn"), F.count_if(~y & p).alias("_fp"),
        F.count_if(y & ~p).alias("_fn"), F.count_if(y & p).alias("_tp"),
    )
    one_class = ((F.col("_tp") + F.col("_fn") == 0) & (F.col("_fp") == 0)) | (
        (F.col("_tn") + F.col("_fp") == 0) & (F.col("_fn") == 0))
    fnr = F.when(F.col("_tn") + F.col("_fn") == 0, 0.0).otherwise(
        F.col("_fn") / (F.col("_tn") + F.col("_fn")))
    fpr = F.when(F.col("_tp") + F.col("_fp") == 0, 0.0).otherwise(
        F.col("_fp") / (F.col("_tp") + F.col("_fp")))
    out = per.where(~one_class).select(*keys, "bin", fnr.alias("fnr"), fpr.alias("fpr"))
    return out.withColumns({
        "fnr_2": rolling_pair_mean(out, keys, "bin", "fnr"),
        "fpr_2": rolling_pair_mean(out, keys, "bin", "fpr"),
    })


def threshold_grid(low: float = 0.4, high: float = 0.999, n: int = 50) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def auc_by_truth_cut(
    df: DataFrame, cuts: Sequence[float], y: str = "y_true", score: str = "preds",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rank AUC of the score for each way of cutting the truth; NULL when one class is empty.

    The scores are ranked once; beside each stands how many cuts the truth is above, so ranks are summed by that number.
    """
    above = sum(F.when(F.col(y) > c, 1).otherwise(0) for c in cuts)
    known = df.where(F.col(y).isNotNull()).withColumn("_above", above)
    ranks = value_positions(known, keys, score, by=["_above"])
    few = ranks.groupBy(*keys, "_above").agg(
        F.sum(F.col("n") * shared_rank()).alias("_r"), F.sum("n").cast("double").alias("_c"),
        F.max("total").cast("double").alias("_N"))
    order = {c: i for i, c in enumerate(sorted(cuts))}
    aggs = [F.max("_N").alias("_N")]
    for i, c in enumerate(cuts):
        # a truth above this cut is above all lower ones too
        mine = F.col("_above") > order[c]
        aggs += [F.sum(F.when(mine, F.col("_r")).otherwise(0.0)).alias(f"_R{i}"),
                 F.sum(F.when(mine, F.col("_c")).otherwise(0.0)).alias(f"_c{i}")]
    wide = few.groupBy(*keys).agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(float(c)).alias("t"), F.col(f"_R{i}").alias("r"), F.col(f"_c{i}").alias("c"))
        for i, c in enumerate(cuts)
    ])
    c = F.col("e.c")
    u = F.col("e.r") - c * (c + 1) / 2
    area = F.when((c > 0) & (c < F.col("_N")), u / (c * (F.col("_N") - c)))
    return wide.select(*keys, "_N", F.explode(entries).alias("e")).select(
        *keys, F.col("e.t").alias("t"), area.alias("auc"))


def best_gmean(
    df: DataFrame, truth_cut: float = 0.9, y="y_true", score="preds", keys: Sequence[str] = (),
) -> DataFrame:
    """Threshold with the largest sqrt(tpr (1 - fpr)); of equals, the highest threshold."""
    roc = roc_points(df, F.col(y) > truth_cut, score, keys)
    g = F.sqrt(F.col("tpr") * (1 - F.col("fpr")))
    best = F.max(F.struct(g.alias("g"), F.col("threshold"), "fpr", "tpr"))
    return roc.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.round("b.threshold", 4).alias("threshold"), F.round("b.g", 4).alias("gmean"),
        F.round("b.fpr", 4).alias("fpr"), F.round("b.tpr", 4).alias("tpr"))


def roc_points(df: DataFrame, positive: Column, score="preds", keys: Sequence[str] = ()):
    """One ROC point per distinct score."""
    cum = cumulative_counts(df, keys, score, positive)
    return cum.select(
        *keys, F.col(score).alias("threshold"), F.try_divide("tp", "pos").alias("tpr"),
        F.try_divide("fp", "neg").alias("fpr"))


def confusion_shares(
    df: DataFrame, cut: float, truth_cut: float = 0.9, keys: Sequence[str] = (),
) -> DataFrame:
    """Confusion cells as shares of their true class."""
    y = (F.col("y_true") > truth_cut).cast("int").alias("truth")
    p = (F.col("preds") > cut).cast("int").alias("pred")
    cells = df.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(*keys, "truth").agg(F.sum("n").alias("_all"))
    return cells.join(whole, [*keys, "truth"]).select(
        *keys, "truth", "pred", "n", (F.col("n") / F.col("_all")).alias("share"))


# ---- comparisons of variables ------------------------------------------------------------

def tail_z_scores(
    df: DataFrame, variables: Sequence[str], score: str, tail: float = 0.05,
    cutoff: float | None = None,
) -> DataFrame:
    """Standardised means of each variable in the low and high tail of a score."""
    edges = group_quantiles(df, [], score, {"lo": tail, "hi": 1 - tail})
    edges = edges.select(F.struct("lo", "hi")).scalar()
    rows = df.withColumn("_e", edges)
    tails = {
        "low": F.col(score) < F.col("_e.lo"),
        "high": F.col(score) >= F.col("_e.hi"),
    }
    aggs = []
    for v in variables:
        x = F.col(f"`{v}`")
        aggs.append(F.struct(
            F.lit(v).alias("variable"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"),
            F.avg(F.when(tails["low"], x)).alias("lo"), F.avg(F.when(tails["high"], x)).alias("hi"),
        ))
    long = rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("v")).select("v.*")
    out = long.select(
        "variable", F.try_divide(F.col("lo") - F.col("m"), "s").alias("z_low"),
        F.try_divide(F.col("hi") - F.col("m"), "s").alias("z_high"),
    ).withColumn("low_minus_high", F.col("z_low") - F.col("z_high"))
    if cutoff is None:
        return out
    return out.where((F.abs("z_low") > cutoff) | (F.abs("z_high") > cutoff))


def interval_z_scores(
    df: DataFrame, variables: Sequence[str], score: str,
    intervals: Sequence[tuple[float, float]] = ((0.4, 0.5), (0.85, 0.95), (0.95, 1.0)),
) -> DataFrame:
    """Standardised means of each variable inside open score intervals, and first minus second."""
    aggs = []
    for v in variables:
        x = F.col(f"`{v}`")
        inside = [
            F.try_divide(
                F.avg(F.when((F.col(score) > lo) & (F.col(score) < hi), x)) - F.avg(x),
                F.stddev_samp(x)).alias(f"z{i}")
            for i, (lo, hi) in enumerate(intervals)
        ]
        aggs.append(F.struct(F.lit(v).alias("variable"), *inside))
    long = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("v")).select("v.*")
    return long.withColumn("low_minus_high", F.col("z0") - F.col("z1"))


def supporting_quartets(df: DataFrame, matrix: str, topo: str, extra: Sequence[str] = ()):
    return df.groupBy(matrix, *extra, topo).agg(F.count(F.lit(1)).alias("quartets"))


def average_topology(
    df: DataFrame, keys: Sequence[str], logp: Sequence[str], names: Sequence[str],
) -> DataFrame:
    """Topology with the largest mean probability over the rows of each group."""
    means = [F.avg(F.exp(F.col(c))).alias(f"_m{i}") for i, c in enumerate(logp)]
    labels = F.array(*[F.lit(n) for n in names])
    best = F.get(labels, S.argmax([f"_m{i}" for i in range(len(logp))]))
    return df.groupBy(*keys).agg(*means).select(*keys, best.alias("avg_topo"))


def compare_conditions(
    frames: dict[str, DataFrame], keys: Sequence[str] = CONDITION, name: str = "Condition",
) -> DataFrame:
    """Condition errors of several prediction sets, on the keys they all share.

    The sets are scored together with their name in the key; the result has one row per
    condition and set, so counting the sets of a condition is a small window.
    """
    rows = union_rows(*[f.withColumn(name, F.lit(k)) for k, f in frames.items()])
    scored = condition_errors(rows, [*keys, name])
    sets = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return scored.withColumn("_sets", sets).where(F.col("_sets") == len(frames)).drop("_sets")


def prediction_rows(df: DataFrame, y="y_true", preds="preds") -> DataFrame:
    """Row-level errors used to compare recombination fractions and block counts."""
    y, q = F.col(y), F.col(preds)
    return df.withColumns({
        "dH": S.hellinger(y, q), "ERROR": q - y, "abs_err": F.abs(q - y),
        "accuracy": S.rounds_alike(y, q),
    })


def learner_errors(
    df: DataFrame, learners: Sequence[str], y: str = "y_true", ids: Sequence[str] = CONDITION,
    kind: str = "error",
) -> DataFrame:
    """Mean error per condition and learner, long; ``kind`` is error, absolute or relative."""
    def one(c: str) -> Column:
        e = F.col(c) - F.col(y)
        if kind == "absolute":
            return F.abs(e)
        return F.try_divide(e, F.col(y)) if kind == "relative" else e

    means = df.groupBy(*ids).agg(*[F.avg(one(c)).alias(c) for c in learners])
    return unpivot(means, ids, learners, "Algorithm", "preds").where(F.col("preds").isNotNull())


def model_maps(
    df: DataFrame, models: Sequence[str], p: str, keys: Sequence[str] = CONDITION,
) -> DataFrame:
    """Spread, mean, relative error and divergences of every model by condition."""
    long = unpivot(df.withColumn("_p", F.col(p)), [*keys, "_p"], models, "model", "value")
    q, true = F.col("value"), F.col("_p")
    out = long.groupBy(*keys, "model").agg(
        F.stddev_samp(q).alias("std"), F.avg(q).alias("mean"),
        F.avg(F.try_divide(q - true, true)).alias("rel_err"),
        F.avg(S.kl_bernoulli(true, q)).alias("kl"), F.max(S.kl_bernoulli(true, q)).alias("max_kl"),
        F.avg(S.hellinger(true, q)).alias("hellinger"),
        F.max(S.hellinger(true, q)).alias("max_hellinger"),
    )
    return out.withColumn("log_ibl", F.log10("ibl")) if "ibl" in keys else out


def model_hits(df: DataFrame, models: Sequence[str], p: str, keys: Sequence[str] = CONDITION, share: float = 0.8) -> DataFrame:
    """Interval hits of every model by condition."""
    long = unpivot(df.withColumn("_p", F.col(p)), [*keys, "_p"], models, "model", "value")
    return interval_hits(long, [*keys, "model"], "_p", "value", share)


def nearest_on_grid(
    conditions: DataFrame, value: str, steps: int = 100, scale: float = 0.01,
    x: str = "ebl", y: str = "ibl",
) -> DataFrame:
    """Value of the nearest condition at each point of a ``steps`` x ``steps`` grid.

    Conditions and points fall into square cells. A point looks at its own and the eight cells around it; what it finds
    there is final if it is nearer than one cell is wide. The points left look again with cells twice as wide. The grid has a
    fixed size, so the points of a round are broadcast, and a round returns one row a point at most.

    Of equally near conditions the one with the least x, y and value counts. Conditions without a place are left out.
    """
    spark = conditions.sparkSession
    cond = conditions.select(
        (F.col(x) * scale).alias("x"), (F.col(y) * scale).alias("y"),
        F.col(value).cast("double").alias("z")).where("x IS NOT NULL AND y IS NOT NULL")
    box = cond.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    schema = "i int, j int, gx double, gy double, value double"
    if box["x0"] is None:
        return spark.createDataFrame([], schema)
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    cells = cond.withColumns({
        "_a": _cell(F.col("x"), box["x0"], wide, steps), "_b": _cell(F.col("y"), box["y0"], high, steps)})
    points = spark.range(steps * steps).select(
        (F.col("id") % steps).cast("int").alias("i"), F.floor(F.col("id") / steps).cast("int").alias("j"))
    found: dict[tuple[int, int], float] = {}
    # on a line of conditions the cells of the other axis have no width
    side, step = 1, min([v for v in (wide, high) if v > 0], default=0.0) / (steps - 1)
    while True:
        around = [F.lit(k) for k in (-1, 0, 1)]
        near = points.select(
            "i", "j", (F.lit(box["x0"]) + F.col("i") * wide / (steps - 1)).alias("gx"),
            (F.lit(box["y0"]) + F.col("j") * high / (steps - 1)).alias("gy"), F.explode(F.array(*around)).alias("_da")).select(
            "*", F.explode(F.array(*around)).alias("_db")).select(
            "i", "j", "gx", "gy", (F.floor(F.col("i") / side) + F.col("_da")).alias("_a"),
            (F.floor(F.col("j") / side) + F.col("_db")).alias("_b"))
        coarse = cells.withColumns({"_a": F.floor(F.col("_a") / side), "_b": F.floor(F.col("_b") / side)})
        gap_x, gap_y = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
        seen = coarse.join(F.broadcast(near), ["_a", "_b"]).groupBy("i", "j").agg(
            F.min(F.struct((gap_x * gap_x + gap_y * gap_y).alias("d"), "x", "y", "z")).alias("best"))
        whole = side >= steps
        sure = (1 - 1e-9) * side * step
        done = {(r["i"], r["j"]): r["best"]["z"] for r in seen.collect() if whole or r["best"]["d"] < sure * sure}
        found |= done
        if whole or len(found) == steps * steps:
            break
        left = [(i, j) for i in range(steps) for j in range(steps) if (i, j) not in found]
        points, side = spark.createDataFrame(left, "i int, j int"), side * 2
    rows = [(i, j, box["x0"] + i * wide / (steps - 1), box["y0"] + j * high / (steps - 1), z) for (i, j), z in found.items()]
    return spark.createDataFrame(rows, schema)


def _cell(at: Column, low: float, width: float, steps: int) -> Column:
    place = F.floor((at - low) / width * (steps - 1)) if width > 0 else F.lit(0)
    return F.least(F.greatest(place, F.lit(0)), F.lit(steps - 1))


def interpolate(df: DataFrame, at: str, table: DataFrame, tx: str, ty: str, name: str):
    """Piecewise-linear lookup of ``at`` in a table of points; flat beyond its ends.

    Only distinct lookups are placed among the points, bucket by bucket, and joined back.
    """
    points = table.select(
        F.col(tx).cast("double").alias("_x"), F.struct(
            F.col(tx).cast("double").alias("x"), F.col(ty).cast("double").alias("y")).alias("_p"))
    asked = df.select(F.col(at).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    both = with_bucket(points.where("_x IS NOT NULL").unionByName(asked, allowMissingColumns=True), [], "_x")
    ends = both.groupBy("_bucket").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    # buckets are few, whatever the rows are: their ends fit in one array
    line_up = ends.agg(F.sort_array(F.collect_list(F.struct("_bucket", "_first", "_last"))).alias("_e"))
    carry = F.broadcast(line_up.select("_e", F.posexplode("_e").alias("_k", "_one")).select(
        F.col("_one._bucket").alias("_bucket"),
        F.array_max(F.transform(F.slice("_e", F.lit(1), F.col("_k")), lambda e: e["_last"])).alias("_below"),
        F.array_min(F.transform(F.slice("_e", F.col("_k") + 2, F.size("_e")), lambda e: e["_first"])).alias("_above")))
    inside = Window.partitionBy("_bucket").orderBy("_x")
    placed = both.join(carry, "_bucket").select(
        "_x", "_p",
        F.coalesce(
            F.max("_p").over(inside.rangeBetween(Window.unboundedPreceding, 0)), "_below"
        ).alias("lo"),
        F.coalesce(
            F.min("_p").over(inside.rangeBetween(0, Window.unboundedFollowing)), "_above"
        ).alias("hi"),
    ).where(F.col("_p").isNull())
    gap = F.col("hi.x") - F.col("lo.x")
    line = F.when(gap == 0, F.col("lo.y")).otherwise(
        F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (F.col("_x") - F.col("lo.x")) / gap)
    found = placed.select("_x", F.coalesce(line, "lo.y", "hi.y").alias(name))
    return df.withColumn("_x", F.col(at).cast("double")).join(found, "_x", "left").drop("_x")


def scale_table(pairs: DataFrame, length: str = "coal_units", div: str = "seq_div") -> DataFrame:
    """Mean divergence per coalescent length."""
    return pairs.where(F.col(length).isNotNull() & F.col(div).isNotNull()).groupBy(length).agg(
        F.avg(div).alias(div))
