"""Queries on counts, shares, grids and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import poisson_one
from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import metrics, models, targets
from ..operators.relational import balanced_rows, where_query
from .registry import query, rounded, tidy
from .tables import (
    INFERRED,
    LEARNER_TABLE,
    PREDICTIONS,
    SPECIES,
    inferred,
    learner_table,
    predictions,
    species,
    table,
)


@query("topology_pivot", f"""SELECT sid, nullif(count(*) FILTER (WHERE tid = 1), 0) AS n_1,
 nullif(count(*) FILTER (WHERE tid = 2), 0) AS n_2, nullif(count(*) FILTER (WHERE tid = 3), 0) AS n_3
 FROM {INFERRED} i GROUP BY sid""")
def topology_pivot(spark, sf):
    return A.topology_counts(inferred(spark, sf))


@query("normalised_counts", rounded("""SELECT l_partkey AS sid, l_linenumber AS tid, count(*) AS c,
 count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY l_partkey) AS share
 FROM lineitem GROUP BY 1, 2""", "share"))
def normalised_counts(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("tid")).agg(
        F.count("*").alias("c"))
    return tidy(A.shares_within(counts, ["sid"], "c"))


@query("species_share", rounded(f"""SELECT ebl, sum(CASE WHEN tid = 1 THEN n ELSE 0 END) / sum(n)
 AS share FROM (SELECT ebl, tid, CAST(count(*) AS DOUBLE) AS n FROM {INFERRED} i JOIN {SPECIES} s
 USING (sid) GROUP BY ALL) GROUP BY ebl""", "share"))
def species_share(spark, sf):
    rows = inferred(spark, sf).join(species(spark, sf), "sid").groupBy("ebl", "tid").agg(
        F.count("*").alias("n"))
    return tidy(rows.groupBy("ebl").agg(A.share_of(F.col("n"), F.col("tid") == 1).alias("share")))


@query("confusion_topology", """SELECT l_linenumber % 3 + 1 AS truth, l_suppkey % 3 + 1 AS found,
 count(*) AS c FROM lineitem GROUP BY 1, 2""")
def confusion_topology(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3 + 1).alias("truth"), (F.col("l_suppkey") % 3 + 1).alias("found"))
    return tidy(A.cross_counts(rows, "truth", "found"))


@query("recombination_counts", """SELECT l_suppkey AS b, l_linenumber AS g,
 nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS concordant,
 nullif(count(*) FILTER (WHERE l_returnflag <> 'A'), 0) AS discordant
 FROM lineitem GROUP BY 1, 2""")
def recombination_counts(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("g"), "l_returnflag")
    return tidy(A.split_counts(rows, ["b", "g"], F.col("l_returnflag") == "A"))


@query("group_statistics", rounded("""SELECT l_partkey AS sid, avg(l_extendedprice) AS mean,
 stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 sum(l_extendedprice) AS sum,
 min_by(l_extendedprice, (l_orderkey, l_suppkey, l_linenumber)) AS first,
 max_by(l_extendedprice, (l_orderkey, l_suppkey, l_linenumber)) AS last FROM lineitem GROUP BY 1""",
                                   "mean std min max sum first last", 4))
def group_statistics(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "sid")
    return tidy(A.group_stats(rows, ["sid"], "l_extendedprice",
                              ["l_orderkey", "l_suppkey", "l_linenumber"]), 4)


@query("count_balance", rounded("""SELECT sid, (max(c) - min(c)) / CAST(sum(c) AS DOUBLE) AS diff,
 count(*) AS n FROM (SELECT l_partkey AS sid, l_linenumber % 3 AS tid, count(*) AS c FROM lineitem
 GROUP BY 1, 2) GROUP BY sid HAVING count(*) >= 3 AND (max(c) - min(c)) / CAST(sum(c) AS DOUBLE) < 0.1""", "diff"))
def count_balance(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("sid"), (F.col("l_linenumber") % 3).alias("tid")).agg(
        F.count("*").alias("c"))
    return tidy(A.balance(counts, ["sid"], "c", 0.1))


@query("mode_join", """WITH c AS (SELECT l_partkey AS matrix, CASE l_returnflag WHEN 'A' THEN '*' ELSE
 l_returnflag END AS result, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER
 (PARTITION BY matrix ORDER BY n DESC) AS k FROM c) SELECT matrix, string_agg(result, '/' ORDER BY
 result = '*', result) AS modes FROM r WHERE k = 1 GROUP BY matrix""")
def mode_join(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("matrix"),
        F.when(F.col("l_returnflag") == "A", "*").otherwise(F.col("l_returnflag")).alias("result"))
    return A.modes(rows, "matrix", "result")


@query("melt_errors", rounded(f"""WITH m AS (SELECT ebl, ibl, avg("RF" - y_true) AS "RF",
 avg("GradBoost" - y_true) AS "GradBoost", avg("ElasticNet" - y_true) AS "ElasticNet",
 avg("Mean" - y_true) AS "Mean" FROM {LEARNER_TABLE} t GROUP BY ebl, ibl)
 SELECT ebl, ibl, "Algorithm", preds FROM (UNPIVOT m ON "RF", "GradBoost", "ElasticNet", "Mean"
 INTO NAME "Algorithm" VALUE preds)""", "preds"))
def melt_errors(spark, sf):
    return tidy(E.learner_errors(
        learner_table(spark, sf), ["RF", "GradBoost", "ElasticNet", "Mean"]))


@query("relative_errors", rounded(f"""WITH m AS (SELECT ebl, ibl, avg(abs("RF" - y_true)) AS ra,
 avg(("RF" - y_true) / y_true) AS rr FROM {LEARNER_TABLE} t GROUP BY ebl, ibl)
 SELECT ebl, ibl, ra, rr FROM m""", "ra rr"))
def relative_errors(spark, sf):
    rows = learner_table(spark, sf)
    a = E.learner_errors(rows, ["RF"], kind="absolute").withColumnRenamed("preds", "ra")
    b = E.learner_errors(rows, ["RF"], kind="relative").withColumnRenamed("preds", "rr")
    return tidy(a.drop("Algorithm").join(b.drop("Algorithm"), ["ebl", "ibl"]))


@query("mean_table", rounded("""SELECT l_linenumber AS k, avg(l_extendedprice) FILTER (WHERE
 l_returnflag = 'A') AS "A", avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS "N",
 avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""",
                             "A N R", 4))
def mean_table(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "k")
    return tidy(A.mean_table(rows, ["k"], "l_returnflag", "l_extendedprice", ["A", "N", "R"]), 4)


@query("grid_pivot", rounded("""WITH g AS (SELECT n_chars // 100 AS ebl, lang AS ibl,
 avg(doc_id % 97) AS v FROM documents GROUP BY 1, 2),
 x AS (SELECT DISTINCT ebl FROM g), y AS (SELECT DISTINCT ibl FROM g),
 c AS (SELECT y.ibl, x.ebl, dense_rank() OVER (ORDER BY x.ebl) AS i, g.v FROM y CROSS JOIN x
 LEFT JOIN g ON g.ibl = y.ibl AND g.ebl = x.ebl),
 w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li,
 last_value(v IGNORE NULLS) OVER b AS lv,
 first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS hi,
 first_value(v IGNORE NULLS) OVER a AS hv FROM c
 WINDOW b AS (PARTITION BY ibl ORDER BY ebl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 a AS (PARTITION BY ibl ORDER BY ebl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT ebl, ibl, v, CASE WHEN li IS NULL THEN hv WHEN hi IS NULL OR li = hi THEN lv
 ELSE lv + (hv - lv) * (i - li) / (hi - li) END AS filled FROM w""", "v filled"))
def grid_pivot(spark, sf):
    """Means on a grid of conditions, gaps along one axis filled."""
    rows = table(spark, sf, "documents").select(
        F.floor(F.col("n_chars") / 100).alias("ebl"), F.col("lang").alias("ibl"),
        (F.col("doc_id") % 97).cast("double").alias("v"))
    return tidy(A.filled_grid(rows, "ebl", "ibl", "v"))


@query("describe_iqr", rounded("""WITH l AS (SELECT event_type AS kind, 'value' AS variable, value AS v
 FROM events UNION ALL SELECT event_type, 'user_id', CAST(user_id AS DOUBLE) FROM events)
 SELECT kind, variable, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
 max(v) AS max, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
 quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
 FROM l GROUP BY 1, 2""", "mean std min max q25 q50 q75 iqr"))
def describe_iqr(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "kind")
    return tidy(A.describe(rows, ["kind"], ["value", "user_id"]))


@query("quantile_bins", """WITH e AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)
 SELECT event_id, CAST(value > q[1] AS BIGINT) + CAST(value > q[2] AS BIGINT)
 + CAST(value > q[3] AS BIGINT) AS bin FROM events, e""")
def quantile_bins(spark, sf):
    return tidy(A.quantile_bin(table(spark, sf, "events"), "value").select("event_id", "bin"))


@query("below_quantile", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <
 (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)""")
def below_quantile(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.below_quantile(rows, "o_totalprice", 0.01)


@query("avg_topology", f"""WITH m AS (SELECT matrix, ibl, avg(preds) AS a, avg(y_true) AS b,
 avg(1 - preds) AS c FROM {PREDICTIONS} p GROUP BY 1, 2) SELECT matrix, ibl, CASE WHEN a >= b AND a >= c
 THEN 'P' WHEN b >= c THEN 'C' ELSE 'Pa' END AS avg_topo FROM m""")
def avg_topology(spark, sf):
    """Most likely topology by mean probability over the rows of each group."""
    rows = predictions(spark, sf).select(
        "matrix", "ibl", F.log("preds").alias("preds0"), F.log("y_true").alias("preds1"),
        F.log(1 - F.col("preds")).alias("preds2"))
    return tidy(E.average_topology(
        rows, ["matrix", "ibl"], ["preds0", "preds1", "preds2"], ["P", "C", "Pa"]))


@query("group_mean_rows", rounded("""SELECT event_id, value, avg(value) OVER (PARTITION BY event_type,
 user_id) AS avg_p FROM events""", "value avg_p"))
def group_mean_rows(spark, sf):
    from ..operators.relational import with_group

    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    out = with_group(rows, ["event_type", "user_id"], F.avg("value").alias("avg_p"))
    return tidy(out.select("event_id", "value", "avg_p"))


@query("rate_labels", rounded(f"""SELECT matrix, avg(CASE WHEN preds > 0.9511 THEN 1.0 ELSE 0 END) AS
 rate, count(*) FILTER (WHERE preds > 0.9511) || ' / ' || count(*) AS label FROM {PREDICTIONS} p
 GROUP BY matrix""", "rate"))
def rate_labels(spark, sf):
    return tidy(A.rate_label(predictions(spark, sf), "matrix", F.col("preds") > 0.9511))


@query("length_and_spread", rounded("""SELECT vec_id,
 (3 * (e[1] + e[10] + e[19] + e[28] + e[37] + e[46] + e[55] + e[64]) - list_sum(e)) / 2 AS length,
 list_var_pop(e) / list_avg(e) AS vmr FROM (SELECT vec_id, list_transform(embedding,
 lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings)""", "length vmr"))
def length_and_spread(spark, sf):
    """Total length of an 8 x 8 matrix and the variance-to-mean ratio of its entries."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    matrix = F.array(*[F.slice("e", 8 * i + 1, 8) for i in range(8)])
    return tidy(rows.select("vec_id", A.total_length(matrix).alias("length"),
                            A.array_variance_to_mean(F.col("e")).alias("vmr")))


@query("column_dispersion", rounded("""SELECT l_returnflag, var_pop(l_quantity) / avg(l_quantity) AS
 vmr FROM lineitem GROUP BY 1""", "vmr"))
def column_dispersion(spark, sf):
    return tidy(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        A.variance_to_mean("l_quantity").alias("vmr")))


_RED = ["l_quantity", "l_discount", "l_tax"]


@query("reduction_table", rounded("SELECT " + ", ".join(
    f"{f}({c}) AS {c}_{s}" for c in _RED for f, s in
    (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + " FROM lineitem",
    [f"{c}_{s}" for c in _RED for s in ("mean", "std", "min", "max")]))
def reduction_table(spark, sf):
    return tidy(A.reduction_table(table(spark, sf, "lineitem"), _RED))


@query("correlations", rounded("""SELECT variable, corr FROM (UNPIVOT (SELECT
 corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount,
 corr(l_tax, l_extendedprice) AS l_tax FROM lineitem) ON l_quantity, l_discount, l_tax
 INTO NAME variable VALUE corr)""", "corr"))
def correlations(spark, sf):
    return tidy(A.correlations(table(spark, sf, "lineitem"), "l_extendedprice", _RED))


@query("branch_estimate", rounded(f"""SELECT ebl, ibl, avg("1_4" + "1_3" - "1_2" - "3_4") / 2 AS est
 FROM {INFERRED} i JOIN {SPECIES} s USING (sid) GROUP BY ebl, ibl""", "ibl est", 4))
def branch_estimate(spark, sf):
    rows = inferred(spark, sf).join(species(spark, sf), "sid")
    return tidy(rows.groupBy("ebl", "ibl").agg(A.branch_estimate().alias("est")), 4)


@query("counts_for_keys", """SELECT d.doc_id AS sid, count(l.doc_id) AS count FROM documents d
 LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def counts_for_keys(spark, sf):
    found = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("sid")).agg(F.count("*").alias("count"))
    return A.counts_for(found, table(spark, sf, "documents").select(F.col("doc_id").alias("sid")), "sid")


@query("nested_to_long", rounded("""SELECT vec_id AS ix1, i - 1 AS ix2, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i
 FROM embeddings)""", "value"))
def nested_to_long(spark, sf):
    return tidy(A.nested_to_long(table(spark, sf, "embeddings"), "vec_id", "embedding"))


@query("box_stats", rounded("""SELECT l_linenumber AS k, quantile_cont(l_extendedprice, 0.05) AS q05,
 quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
 quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.95) AS q95
 FROM lineitem GROUP BY 1""", "q05 q25 q50 q75 q95", 4))
def box_stats(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "k")
    return tidy(A.box_summary(rows, ["k"], "l_extendedprice"), 4)


@query("line_summary", rounded(f"""SELECT ibl, matrix, avg(v) AS mean, avg(v) - 2.0537489106318225 *
 stddev_samp(v) / sqrt(count(v)) AS low, avg(v) + 2.0537489106318225 * stddev_samp(v) / sqrt(count(v))
 AS high FROM (SELECT ibl, matrix, abs(preds - y_true) AS v FROM {PREDICTIONS} p) GROUP BY 1, 2""",
                               "mean low high"))
def line_summary(spark, sf):
    rows = E.prediction_rows(predictions(spark, sf))
    return tidy(A.line_summary(rows, ["ibl", "matrix"], "abs_err"))


_TIMES = " + ".join(f"CASE WHEN u >= CAST('{c!r}' AS DOUBLE) THEN 1 ELSE 0 END" for c in poisson_one())


@query("bootstrap_lines", rounded(f"""WITH p AS (SELECT matrix, dset_no, abs(preds - y_true) AS v FROM {PREDICTIONS} p), g AS (SELECT matrix, dset_no, v, r,
 md5(concat_ws('|', 0, r, dset_no)) AS h FROM p, (SELECT unnest(range(50)) AS r)), d AS (SELECT matrix, v, r, k,
 CAST('0x' || substr(h, CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT) / CAST(16 AS DOUBLE) ** 8 AS u FROM g, (SELECT unnest(range(4)) AS k)),
 m AS (SELECT matrix, r, k, sum(({_TIMES}) * v) / sum({_TIMES}) AS m FROM d GROUP BY ALL), l AS (SELECT matrix, list_sort(list(m)) AS ms FROM m GROUP BY 1)
 SELECT matrix, avg(v) AS mean, any_value(ms[CAST(floor(199 * 0.02) AS BIGINT) + 1]) AS low, any_value(ms[CAST(floor(199 * 0.98) AS BIGINT) + 1]) AS high
 FROM p JOIN l USING (matrix) GROUP BY 1""", "mean low high"))
def bootstrap_lines(spark, sf):
    """Bootstrap interval of the mean over 200 replicates, drawn from the rows' numbers."""
    rows = E.prediction_rows(predictions(spark, sf))
    return tidy(A.bootstrap_means(rows, ["matrix"], "abs_err", ["dset_no"]))


@query("gene_histogram", """WITH r AS (SELECT event_type AS matrix, value AS v, min(value) OVER () AS lo,
 max(value) OVER () AS hi FROM events) SELECT matrix, CAST(least(floor((v - lo) * 200 / (hi - lo)), 199)
 AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2""")
def gene_histogram(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "matrix")
    return A.histogram(rows, ["matrix"], "value", 200)


@query("moments", rounded("""WITH m AS (SELECT l_returnflag, l_quantity AS x, avg(l_quantity) OVER
 (PARTITION BY l_returnflag) AS u FROM lineitem) SELECT l_returnflag, 0.0 AS moment1,
 var_pop(x) AS moment2, avg((x - u) ** 3) / var_pop(x) ** 1.5 AS skew, avg(x) AS mean
 FROM m GROUP BY 1""", "moment1 moment2 skew mean"))
def moments(spark, sf):
    return tidy(A.moments(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity"))


@query("row_shares", rounded(f"""WITH c AS (SELECT sid, CAST(count(*) FILTER (WHERE tid = 1) AS DOUBLE) AS a,
 CAST(count(*) FILTER (WHERE tid = 2) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE tid = 3) AS DOUBLE)
 AS c FROM {INFERRED} i GROUP BY sid) SELECT sid, a / (a + b + c) AS n_1_share, b / (a + b + c) AS
 n_2_share, c / (a + b + c) AS n_3_share FROM c""", "n_1_share n_2_share n_3_share"))
def row_shares(spark, sf):
    counts = A.topology_counts(inferred(spark, sf)).na.fill(0)
    out = A.row_shares(counts, ["n_1", "n_2", "n_3"])
    return tidy(out.select("sid", "n_1_share", "n_2_share", "n_3_share"))


@query("recombination_rows", rounded(f"""WITH t AS (SELECT dset_no, matrix AS "Length",
 CAST(user_id % 3 AS BIGINT) AS "Fraction", ebl, ibl, y_true, preds FROM {PREDICTIONS} p
 WHERE 6 > ibl AND ibl > 0.1 AND 110 >= ebl AND ebl > 30), n AS (SELECT "Length", count(DISTINCT "Fraction")
 AS n FROM t GROUP BY 1), f AS (SELECT "Length", ebl, ibl FROM t JOIN n USING ("Length")
 GROUP BY "Length", ebl, ibl HAVING count(DISTINCT "Fraction") = max(n)) SELECT dset_no, "Length", "Fraction", preds - y_true AS "ERROR",
 abs(preds - y_true) AS abs_err, CAST(round_even(y_true, 0) = round_even(preds, 0) AS BIGINT) AS
 accuracy, sqrt(((sqrt(y_true) - sqrt(preds)) ** 2 + (sqrt(1 - y_true) - sqrt(1 - preds)) ** 2) / 2)
 AS "dH" FROM t SEMI JOIN f USING ("Length", ebl, ibl)""", "ERROR abs_err dH"))
def recombination_rows(spark, sf):
    """Row errors on the conditions that every recombination fraction covers."""
    rows = predictions(spark, sf).withColumn("Length", F.col("matrix")).withColumn(
        "Fraction", F.col("user_id") % 3)
    rows = where_query(E.prediction_rows(rows), "6>ibl>.1 & 110>=ebl>30")
    out = balanced_rows(rows, ["Length"], "Fraction", ["ebl", "ibl"])
    return tidy(out.select("dset_no", "Length", "Fraction", "ERROR", "abs_err", "accuracy", "dH"))


@query("ols_fit", rounded("""SELECT l_returnflag AS k, regr_slope(l_extendedprice, l_quantity) AS slope,
 regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
 regr_r2(l_extendedprice, l_quantity) / (1 - regr_r2(l_extendedprice, l_quantity)) *
 (regr_count(l_extendedprice, l_quantity) - 2) AS f, CAST(regr_count(l_extendedprice, l_quantity)
 AS BIGINT) AS n FROM lineitem GROUP BY 1""", "slope intercept r2 f", 4))
def ols_fit(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k")
    return tidy(models.linear_fit(rows, "l_extendedprice", "l_quantity", ["k"]), 4)


@query("z_normalised", rounded("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS q,
 (l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER () AS t FROM lineitem""", "q t"))
def z_normalised(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("q"),
        F.col("l_tax").alias("t"))
    return tidy(targets.z_normalised(rows, ["q", "t"]))


@query("regression_metrics", rounded(f"""SELECT matrix, avg((y_true - preds) ** 2) AS "MSE",
 avg(abs(y_true - preds)) AS "MAE", 1 - var_pop(y_true - preds) / var_pop(y_true) AS "EV"
 FROM {PREDICTIONS} p GROUP BY 1""", "MSE MAE EV"))
def regression_metrics(spark, sf):
    return tidy(metrics.score(
        predictions(spark, sf), "y_true", "preds", metrics.REGRESSION, ["matrix"]))


@query("class_metrics", rounded(f"""WITH b AS (SELECT matrix, y_true > 0.5 AS y, preds > 0.5 AS p, preds
 FROM {PREDICTIONS} q), r AS (SELECT *, rank() OVER (PARTITION BY matrix ORDER BY preds) + (count(*)
 OVER (PARTITION BY matrix, preds) - 1) / 2.0 AS k FROM b), c AS (SELECT matrix,
 CAST(count(*) FILTER (WHERE y AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT y AND NOT p)
 AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE NOT y AND p) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (WHERE y AND NOT p) AS DOUBLE) AS fn, CAST(sum(k) FILTER (WHERE y) AS DOUBLE)
 AS rs FROM r GROUP BY 1)
 SELECT matrix, (tp + tn) / (tp + tn + fp + fn) AS "Acc", coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)
 AS "F1", coalesce(tp / nullif(tp + fp, 0), 0) AS "Prec", coalesce(tp / nullif(tp + fn, 0), 0) AS "Recall",
 coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS "MCC",
 (rs - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (tn + fp), 0) AS "AUC" FROM c""",
                                "Acc F1 Prec Recall MCC AUC"))
def class_metrics(spark, sf):
    rows = predictions(spark, sf).select(
        "matrix", (F.col("y_true") > 0.5).cast("int").alias("y"),
        (F.col("preds") > 0.5).cast("int").alias("p"), "preds")
    return tidy(metrics.class_scores(rows, "y", "p", "preds", ["matrix"]))
