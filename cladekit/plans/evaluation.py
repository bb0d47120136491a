"""Queries that score predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..jobs import error_table
from ..operators import evaluate as E
from ..operators import rank_tests as T
from .registry import query, rounded, tidy
from .tables import (
    LEARNER_TABLE,
    LEARNERS,
    PREDICTIONS,
    learner_table,
    predictions,
    table,
)

_KL = """{p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q}))"""
_DH = "sqrt(((sqrt({p}) - sqrt({q})) ** 2 + (sqrt(1 - {p}) - sqrt(1 - {q})) ** 2) / 2)"


def hdi_sql(source: str, share: float, x: str = "preds", keys: str = "ebl, ibl") -> str:
    """Narrowest interval by self join on positions."""
    return f"""(WITH s AS (SELECT {keys}, {x} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {x})
 - 1 AS i, CAST(floor({share} * count(*) OVER (PARTITION BY {keys})) AS BIGINT) AS k FROM {source} src),
 w AS (SELECT {", ".join("a." + c.strip() for c in keys.split(","))}, a.x AS low, b.x AS high, b.x - a.x
 AS width FROM s a JOIN s b ON {" AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(","))}
 AND b.i = a.i + a.k) SELECT {keys}, arg_min(low, (width, low)) AS low, arg_min(high, (width, low)) AS
 high FROM w GROUP BY {keys})"""


def errors_sql(source: str, share: float = 0.8) -> str:
    return f"""SELECT ebl, ibl, {_DH.format(p='p', q='q')} AS "dH", {_KL.format(p='p', q='q')} AS "dKL",
 abs(p - q) AS "dTV", q - p AS "ERROR", (q - p) / p AS "REL_ERR",
 CAST(round_even(p, 0) = round_even(q, 0) AS BIGINT) AS "ACC",
 CASE WHEN least(low, 1) <= p AND p <= high THEN 1 ELSE -1 END AS "HDI" FROM (SELECT ebl, ibl,
 avg(y_true) AS p, avg(preds) AS q FROM {source} t GROUP BY ebl, ibl) m JOIN {hdi_sql(source, share)} h
 USING (ebl, ibl)"""


_ERR = "dH dKL dTV ERROR REL_ERR"


@query("condition_error", rounded(errors_sql(PREDICTIONS), _ERR))
def condition_error(spark, sf):
    return tidy(error_table(predictions(spark, sf)))


@query("condition_error_half", rounded(errors_sql(PREDICTIONS, 0.5), _ERR))
def condition_error_half(spark, sf):
    return tidy(E.condition_errors(predictions(spark, sf), share=0.5))


@query("hdi_hits", rounded(f"""SELECT ebl, ibl, low, high, CASE WHEN low < p AND p < high THEN 1 ELSE -1
 END AS "HDI" FROM {hdi_sql(PREDICTIONS, 0.8)} h JOIN (SELECT ebl, ibl, avg(y_true) AS p FROM
 {PREDICTIONS} t GROUP BY 1, 2) m USING (ebl, ibl)""", "low high"))
def hdi_hits(spark, sf):
    return tidy(E.interval_hits(predictions(spark, sf), strict=True))


@query("range_hits", rounded(f"""SELECT ebl, ibl, min(preds) AS low, max(preds) AS high,
 CASE WHEN least(min(preds), 1) <= avg(y_true) AND avg(y_true) <= max(preds) THEN 1 ELSE -1 END AS "HDI"
 FROM {PREDICTIONS} t GROUP BY 1, 2""", "low high"))
def range_hits(spark, sf):
    """Interval hits when the interval is the whole range."""
    return tidy(E.interval_hits(predictions(spark, sf), share=1))


@query("hdi_order_prices", rounded(hdi_sql(
    "(SELECT l_returnflag, l_extendedprice AS preds FROM lineitem)", 0.8, keys="l_returnflag")[1:-1],
    "low high"))
def hdi_order_prices(spark, sf):
    """Narrowest interval of few, very large groups."""
    from ..operators.ranks import shortest_interval

    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return tidy(shortest_interval(rows, ["l_returnflag"], "l_extendedprice", 0.8))


@query("binary_summary", rounded(f"""WITH b AS (SELECT ebl, ibl, CAST(preds >= 0.5 AS INT) AS p,
 CAST(y_true > 0.5 AS INT) AS y, preds FROM {PREDICTIONS} q) SELECT ebl, ibl,
 avg(CASE WHEN p = 0 AND y = 1 THEN 1.0 ELSE 0 END) AS fnr,
 avg(CASE WHEN p = 1 AND y = 0 THEN 1.0 ELSE 0 END) AS fpr,
 avg(CASE WHEN p = y THEN 1.0 ELSE 0 END) AS accuracy,
 CASE WHEN sum(p + y) > 0 THEN 2 * CAST(sum(p * y) AS DOUBLE) / CAST(sum(p + y) AS DOUBLE) ELSE 0 END
 AS f1, -avg(CASE WHEN y = 1 THEN ln(preds) ELSE ln(1 - preds) END) AS cross_entropy
 FROM b GROUP BY 1, 2""", "fnr fpr accuracy f1 cross_entropy"))
def binary_summary(spark, sf):
    rows = E.class_from_scores(predictions(spark, sf), 0.5).withColumn(
        "y_true", (F.col("y_true") > 0.5).cast("int"))
    return tidy(E.binary_summary(rows))


@query("topology_entropy", rounded(f"""WITH b AS (SELECT ebl, ibl, preds AS a, y_true AS b, abs(preds -
 y_true) AS c, CAST(floor(y_true * 3) AS INT) AS y FROM {PREDICTIONS} q) SELECT ebl, ibl,
 avg(CASE WHEN CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END = y THEN 1.0 ELSE 0 END)
 AS accuracy, -avg(ln(greatest(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c),
 2.220446049250313e-16))) AS cross_entropy FROM b GROUP BY 1, 2""", "accuracy cross_entropy"))
def topology_entropy(spark, sf):
    p, y = F.col("preds"), F.col("y_true")
    rows = predictions(spark, sf).select(
        "ebl", "ibl", F.log(p).alias("0"), F.log(y).alias("1"), F.log(F.abs(p - y)).alias("2"),
        F.floor(y * 3).cast("int").alias("y_true"))
    return tidy(E.topology_summary(rows, ["0", "1", "2"]))


@query("binned_rates", rounded(f"""WITH c AS (SELECT matrix, floor(ibl * 10 / 10) * 10 / 10 AS bin,
 CAST(count(*) FILTER (WHERE y_true <= 0.9 AND preds <= 0.8) AS DOUBLE) AS tn,
 CAST(count(*) FILTER (WHERE y_true <= 0.9 AND preds > 0.8) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (WHERE y_true > 0.9 AND preds <= 0.8) AS DOUBLE) AS fn,
 CAST(count(*) FILTER (WHERE y_true > 0.9 AND preds > 0.8) AS DOUBLE) AS tp FROM {PREDICTIONS} p
 GROUP BY 1, 2), r AS (SELECT matrix, bin, CASE WHEN tn + fn = 0 THEN 0 ELSE fn / (tn + fn) END AS fnr,
 CASE WHEN tp + fp = 0 THEN 0 ELSE fp / (tp + fp) END AS fpr FROM c WHERE NOT (fp = 0 AND fn = 0 AND
 (tp = 0 OR tn = 0))) SELECT matrix, bin, fnr, fpr,
 CASE WHEN count(*) OVER w = 2 THEN avg(fnr) OVER w END AS fnr_2,
 CASE WHEN count(*) OVER w = 2 THEN avg(fpr) OVER w END AS fpr_2 FROM r
 WINDOW w AS (PARTITION BY matrix ORDER BY bin ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
                               "bin fnr fpr fnr_2 fpr_2"))
def binned_rates(spark, sf):
    return tidy(E.binned_rates(
        predictions(spark, sf), cut=0.8, width=1, x="ibl", keys=["matrix"]))


_CUTS = E.threshold_grid(0.4, 0.999, 50)


@query("auc_thresholds", rounded(f"""WITH t AS (SELECT unnest([{", ".join(map(repr, _CUTS))}]::DOUBLE[])
 AS t), r AS (SELECT matrix, y_true, rank() OVER (PARTITION BY matrix ORDER BY preds) + (count(*) OVER
 (PARTITION BY matrix, preds) - 1) / CAST(2 AS DOUBLE) AS k FROM {PREDICTIONS} p),
 c AS (SELECT matrix, t, CAST(count(*) FILTER (WHERE y_true > t) AS DOUBLE) AS a,
 CAST(count(*) FILTER (WHERE y_true <= t) AS DOUBLE) AS b, sum(k) FILTER (WHERE y_true > t) AS s
 FROM r CROSS JOIN t GROUP BY 1, 2) SELECT matrix, t, CASE WHEN a > 0 AND b > 0 THEN
 (s - a * (a + 1) / 2) / (a * b) END AS auc FROM c""", "t auc"))
def auc_thresholds(spark, sf):
    return tidy(E.auc_by_truth_cut(predictions(spark, sf), _CUTS, keys=["matrix"]))


_ROC = f"""(SELECT DISTINCT matrix, preds AS threshold,
 CAST(count(*) FILTER (WHERE y_true > 0.9) OVER w AS DOUBLE) / nullif(count(*) FILTER (WHERE y_true > 0.9) OVER
 (PARTITION BY matrix), 0) AS tpr, CAST(count(*) FILTER (WHERE y_true <= 0.9) OVER w AS DOUBLE) / nullif(count(*)
 FILTER (WHERE y_true <= 0.9) OVER (PARTITION BY matrix), 0) AS fpr FROM {PREDICTIONS} p
 WINDOW w AS (PARTITION BY matrix ORDER BY preds DESC RANGE BETWEEN UNBOUNDED PRECEDING AND
 CURRENT ROW))"""


@query("roc_points", rounded(f"SELECT * FROM {_ROC} r", "threshold tpr fpr"))
def roc_points(spark, sf):
    return tidy(E.roc_points(predictions(spark, sf), F.col("y_true") > 0.9, keys=["matrix"]))


@query("best_gmean", f"""WITH g AS (SELECT *, sqrt(tpr * (1 - fpr)) AS g FROM {_ROC} r), b AS (SELECT *,
 row_number() OVER (PARTITION BY matrix ORDER BY g DESC, threshold DESC) AS k FROM g) SELECT matrix,
 round(threshold, 4) AS threshold, round(g, 4) AS gmean, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr
 FROM b WHERE k = 1""")
def best_gmean(spark, sf):
    return E.best_gmean(predictions(spark, sf), keys=["matrix"])


@query("confusion_norm", rounded(f"""SELECT matrix, CAST(y_true > 0.9 AS BIGINT) AS truth,
 CAST(preds > 0.7 AS BIGINT) AS pred, count(*) AS n, count(*) / sum(CAST(count(*) AS DOUBLE)) OVER
 (PARTITION BY matrix, y_true > 0.9) AS share FROM {PREDICTIONS} p GROUP BY matrix, y_true > 0.9,
 preds > 0.7""", "share"))
def confusion_norm(spark, sf):
    return tidy(E.confusion_shares(predictions(spark, sf), 0.7, keys=["matrix"]))


_LONG = f"""(SELECT ebl, dset_no, a, v - y_true AS d FROM (UNPIVOT {LEARNER_TABLE} ON "RF", "GradBoost",
 "ElasticNet" INTO NAME a VALUE v))"""
_RANKED = f"""(SELECT ebl, a, rank() OVER (PARTITION BY ebl ORDER BY d) + (count(*) OVER (PARTITION BY
 ebl, d) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY ebl, d) AS t FROM {_LONG} l)"""


@query("kruskal", rounded(f"""WITH s AS (SELECT ebl, a, sum(r) AS rs, CAST(count(*) AS DOUBLE) AS n FROM
 {_RANKED} k GROUP BY 1, 2), h AS (SELECT ebl, sum(n) AS m, sum(rs * rs / n) AS q FROM s GROUP BY 1),
 t AS (SELECT ebl, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM {_RANKED} k GROUP BY 1), v AS (SELECT ebl,
 (12 / (m * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (m * m * m - m)) AS stat FROM h JOIN t USING (ebl))
 SELECT ebl, stat, exp(-stat / 2) AS pval FROM v""", "stat pval"))
def kruskal(spark, sf):
    """Do the errors of three learners differ, per condition?"""
    rows = learner_table(spark, sf)
    for c in LEARNERS[:3]:
        rows = rows.withColumn(c, F.col(c) - F.col("y_true"))
    return tidy(T.kruskal_wallis(rows, LEARNERS[:3], ["ebl"]))


def erfc_sql(x: str) -> str:
    """The same fit as in the library, written out."""
    t = f"(1 / (1 + CAST(0.5 AS DOUBLE) * abs({x})))"
    poly = f"CAST({S.ERFC_FIT[-1]} AS DOUBLE)"
    for k in reversed(S.ERFC_FIT[:-1]):
        poly = f"(CAST({k} AS DOUBLE) + {t} * {poly})"
    tail = f"{t} * exp(-({x}) * ({x}) + {poly})"
    return f"CASE WHEN ({x}) >= 0 THEN {tail} ELSE 2 - {tail} END"


_PAIRS = T.all_pairs(LEARNERS[:3])
_DIFFS = " UNION ALL ".join(
    f"""SELECT ebl, '{a}>{b}' AS pair, abs("{a}" - y_true) - abs("{b}" - y_true) AS d FROM
 {LEARNER_TABLE} t""" for a, b in _PAIRS)
_SIGNED = f"""(WITH d AS ({_DIFFS}), r AS (SELECT ebl, pair, d, rank() OVER (PARTITION BY ebl, pair ORDER
 BY abs(d)) + (count(*) OVER (PARTITION BY ebl, pair, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER
 (PARTITION BY ebl, pair, abs(d)) AS t FROM d WHERE d <> 0), s AS (SELECT ebl, pair, coalesce(sum(r) FILTER
 (WHERE d > 0), 0) AS wplus, count(*) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1, 2)
 SELECT ebl, pair, wplus, n, (wplus - n * (n + CAST(1 AS DOUBLE)) / 4) / sqrt(n * (n + CAST(1 AS DOUBLE))
 * (2 * n + 1) / 24 - ties / 48) AS z FROM s)"""


def _signed_rows(spark, sf):
    rows = learner_table(spark, sf)
    for c in LEARNERS[:3]:
        rows = rows.withColumn(c, F.abs(F.col(c) - F.col("y_true")))
    return T.signed_rank(rows, _PAIRS, ["ebl"])


_HALF = "CAST(0.5 AS DOUBLE)"
_PVAL = f"{_HALF} * ({erfc_sql('z / sqrt(CAST(2 AS DOUBLE))')})"


@query("signed_rank", rounded(f"SELECT ebl, pair, wplus, n, z, {_PVAL} AS pval FROM {_SIGNED} w",
                              "wplus z pval"))
def signed_rank(spark, sf):
    """Is one learner's absolute error larger than another's? All ordered pairs."""
    return tidy(_signed_rows(spark, sf))


@query("holm", rounded(f"""WITH p AS (SELECT ebl, pair, {_PVAL} AS pval FROM {_SIGNED} w), o AS (SELECT *,
 pval * (count(*) OVER (PARTITION BY ebl) - row_number() OVER (PARTITION BY ebl ORDER BY pval, pair) + 1)
 AS raw FROM p), c AS (SELECT ebl, pair, pval, least(max(raw) OVER (PARTITION BY ebl ORDER BY pval, pair
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS corrected FROM o) SELECT *, corrected <= 0.01 AS
 rejected FROM c""", "pval corrected"))
def holm(spark, sf):
    """Step-down corrected p-values within each condition."""
    tests = _signed_rows(spark, sf).select("ebl", "pair", "pval")
    return tidy(T.holm(tests, family=["ebl"]))


@query("significant_edges", f"""WITH p AS (SELECT ebl, pair, {_PVAL} AS pval FROM {_SIGNED} w), o AS
 (SELECT *, pval * (count(*) OVER (PARTITION BY ebl) - row_number() OVER (PARTITION BY ebl ORDER BY pval,
 pair) + 1) AS raw FROM p), c AS (SELECT pair, max(raw) OVER (PARTITION BY ebl ORDER BY pval, pair ROWS
 BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS corrected FROM o) SELECT split_part(pair, '>', 1) AS src,
 split_part(pair, '>', 2) AS dst FROM c WHERE corrected <= 0.01""")
def significant_edges(spark, sf):
    return T.edges(T.holm(_signed_rows(spark, sf), family=["ebl"]))


@query("two_sided_vs_mean", rounded(f"""WITH d AS (SELECT 'RF>Mean' AS pair, abs("RF" - y_true) -
 abs("Mean" - y_true) AS d FROM {LEARNER_TABLE} t UNION ALL SELECT 'GradBoost>Mean', abs("GradBoost" -
 y_true) - abs("Mean" - y_true) FROM {LEARNER_TABLE} t), r AS (SELECT pair, d, rank() OVER (PARTITION BY
 pair ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pair, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*)
 OVER (PARTITION BY pair, abs(d)) AS t FROM d WHERE d <> 0), s AS (SELECT pair, sum(r) FILTER (WHERE d > 0)
 AS wplus, count(*) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1) SELECT pair, wplus, n,
 (wplus - n * (n + CAST(1 AS DOUBLE)) / 4) / sqrt(n * (n + CAST(1 AS DOUBLE)) * (2 * n + 1) / 24 -
 ties / 48) AS z FROM s""", "wplus z", 4))
def two_sided_vs_mean(spark, sf):
    rows = learner_table(spark, sf)
    for c in LEARNERS:
        rows = rows.withColumn(c, F.abs(F.col(c) - F.col("y_true")))
    out = T.signed_rank(rows, [("RF", "Mean"), ("GradBoost", "Mean")], alternative="two-sided")
    return tidy(out.drop("pval"), 4)


@query("mann_whitney", rounded("""WITH l AS (SELECT variable, v, g FROM (UNPIVOT (SELECT l_returnflag = 'A'
 AS g, l_quantity, l_extendedprice FROM lineitem) ON l_quantity, l_extendedprice INTO NAME variable VALUE
 v)), r AS (SELECT variable, g, rank() OVER (PARTITION BY variable ORDER BY v) + (count(*) OVER (PARTITION
 BY variable, v) - 1) / CAST(2 AS DOUBLE) AS k, count(*) OVER (PARTITION BY variable, v) AS t FROM l),
 s AS (SELECT variable, sum(k) FILTER (WHERE g) AS r1, CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS a,
 CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS b, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r
 GROUP BY 1), u AS (SELECT *, r1 - a * (a + 1) / 2 AS u, a + b AS n FROM s) SELECT variable, u,
 (abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u""", "u z", 4))
def mann_whitney(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = T.mann_whitney(rows, ["l_quantity", "l_extendedprice"], F.col("l_returnflag") == "A")
    return tidy(out.drop("pval"), 4)


_VARS = ["l_quantity", "l_discount", "l_tax"]


def _tail_sql(v: str) -> str:
    return f"""SELECT '{v}' AS variable, (avg({v}) FILTER (WHERE s < lo) - avg({v})) / stddev_samp({v}) AS
 z_low, (avg({v}) FILTER (WHERE s >= hi) - avg({v})) / stddev_samp({v}) AS z_high FROM r"""


@query("tail_z", rounded(f"""WITH e AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo,
 quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem), r AS (SELECT l_extendedprice AS s, * FROM
 lineitem, e) SELECT *, z_low - z_high AS low_minus_high FROM ({" UNION ALL ".join(map(_tail_sql, _VARS))})""",
                         "z_low z_high low_minus_high"))
def tail_z(spark, sf):
    return tidy(E.tail_z_scores(table(spark, sf, "lineitem"), _VARS, "l_extendedprice"))


@query("interval_z", rounded(" UNION ALL ".join(f"""SELECT '{v}' AS variable, z0, z1, z2, z0 - z1 AS
 low_minus_high FROM (SELECT {", ".join(f"(avg({v}) FILTER (WHERE preds > {a} AND preds < {b}) - avg({v})) / stddev_samp({v}) AS z{i}" for i, (a, b) in enumerate([(0.4, 0.5), (0.85, 0.95), (0.95, 1.0)]))}
 FROM {PREDICTIONS} p)""" for v in ("y_true", "value", "ibl")), "z0 z1 z2 low_minus_high"))
def interval_z(spark, sf):
    return tidy(E.interval_z_scores(predictions(spark, sf), ["y_true", "value", "ibl"], "preds"))


@query("supporting_quartets", """SELECT l_partkey AS matrix, l_linenumber % 3 AS perm, l_returnflag AS topo,
 count(*) AS quartets FROM lineitem GROUP BY 1, 2, 3""")
def supporting_quartets(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("matrix"), (F.col("l_linenumber") % 3).alias("perm"),
        F.col("l_returnflag").alias("topo"))
    return tidy(E.supporting_quartets(rows, "matrix", "topo", ["perm"]))


def _cond(i: int) -> str:
    return f"(SELECT * FROM {PREDICTIONS} p WHERE user_id % 3 = {i} AND ebl <= 100 AND NOT (ibl < {i}))"


@query("compare_conditions", rounded("WITH " + ", ".join(
    f"c{i} AS ({errors_sql(_cond(i))})" for i in range(3)) + " " + " UNION ALL ".join(
    f"""SELECT *, '{n}' AS "Condition" FROM c{i} WHERE (ebl, ibl) IN (SELECT (ebl, ibl) FROM c0) AND
 (ebl, ibl) IN (SELECT (ebl, ibl) FROM c1) AND (ebl, ibl) IN (SELECT (ebl, ibl) FROM c2)""" for i, n in enumerate(("-", "Site", "Site+Lineage"))),
    _ERR))
def compare_conditions(spark, sf):
    """Condition errors of three sets on the conditions they share."""
    rows = predictions(spark, sf).where("ebl <= 100")
    frames = {
        name: rows.where((F.col("user_id") % 3 == i) & ~(F.col("ibl") < i))
        for i, name in enumerate(("-", "Site", "Site+Lineage"))}
    return tidy(E.compare_conditions(frames))


_MAPS = ["RF", "GradBoost"]


@query("model_maps", rounded(" UNION ALL ".join(f"""SELECT ebl, ibl, '{m}' AS model, stddev_samp(q) AS std,
 avg(q) AS mean, avg((q - p) / p) AS rel_err, avg({_KL.format(p='p', q='q')}) AS kl,
 max({_KL.format(p='p', q='q')}) AS max_kl, avg({_DH.format(p='p', q='q')}) AS hellinger,
 max({_DH.format(p='p', q='q')}) AS max_hellinger, log10(ibl) AS log_ibl FROM (SELECT ebl, ibl, "{m}" AS q,
 y_true AS p FROM {LEARNER_TABLE} t) GROUP BY ebl, ibl""" for m in _MAPS),
    "std mean rel_err kl max_kl hellinger max_hellinger log_ibl"))
def model_maps(spark, sf):
    return tidy(E.model_maps(learner_table(spark, sf), _MAPS, "y_true"))


@query("error_surface", rounded(f"""WITH c AS (SELECT ebl * 0.01 AS x, ibl * 0.01 AS y, avg(preds - y_true)
 AS z FROM {PREDICTIONS} p GROUP BY ebl, ibl), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y)
 AS y1 FROM c), g AS (SELECT i, j, x0 + i * (x1 - x0) / 99 AS gx, y0 + j * (y1 - y0) / 99 AS gy FROM b,
 range(100) AS r(i), range(100) AS s(j)) SELECT i, j, gx, gy, arg_min(z, ((gx - x) ** 2 + (gy - y) ** 2,
 x, y)) AS value FROM g, c GROUP BY ALL""", "gx gy value"))
def error_surface(spark, sf):
    """Mean error of the nearest condition over a 100 x 100 grid."""
    cond = predictions(spark, sf).groupBy("ebl", "ibl").agg(
        F.avg(F.col("preds") - F.col("y_true")).alias("z"))
    return tidy(E.nearest_on_grid(cond, "z"))


@query("divergence_scale", rounded("""WITH s AS (SELECT l_quantity AS x, avg(l_extendedprice) AS y FROM
 lineitem WHERE l_quantity % 3 = 0 GROUP BY 1) SELECT o.l_orderkey, o.l_partkey, o.l_suppkey,
 o.l_linenumber, o.l_quantity AS q, CASE WHEN a.y IS NULL THEN b.y WHEN b.y IS NULL OR a.x = b.x THEN a.y
 ELSE a.y + (b.y - a.y) * (o.l_quantity - a.x) / (b.x - a.x) END AS seq_div FROM lineitem o
 ASOF LEFT JOIN s a ON o.l_quantity >= a.x ASOF LEFT JOIN s b ON o.l_quantity <= b.x""", "q seq_div", 4))
def divergence_scale(spark, sf):
    """Mean divergence per length, looked up between its points."""
    from ..operators.quartets import stem_pairs

    lines = table(spark, sf, "lineitem")
    stem = F.col("l_orderkey").alias("stem")
    place = F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber").alias("ord")
    pairs = stem_pairs(
        lines.select(stem, place, F.col("l_quantity").alias("coal_units")),
        lines.select(stem, place, F.col("l_extendedprice").alias("seq_div")))
    points = E.scale_table(pairs.where("coal_units % 3 = 0"))
    asked = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         F.col("l_quantity").alias("q"))
    return tidy(E.interpolate(asked, "q", points, "coal_units", "seq_div", "seq_div"), 4)
