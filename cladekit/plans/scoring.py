"""Queries on targets, preprocessing, learners and model analysis."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import linear as L
from ..operators import models as M
from ..operators import targets as T
from ..operators.relational import union_rows
from .registry import query, rounded, tidy
from .tables import SPECIES, species, table


def _lineitem_key(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")


_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEYS = ", ".join(_KEY)

_ODDS = "ln(greatest(least({y}, 1 - {e}), {e}) / (1 - greatest(least({y}, 1 - {e}), {e})))"
_P = "1 - 2 * exp(-2 * ibl) / 3"


@query("log_odds_labels", rounded(f"""WITH c AS (SELECT ebl, ibl, tid, count(*) AS n FROM (SELECT l_partkey
 AS sid, l_linenumber % 3 + 1 AS tid FROM lineitem) JOIN {SPECIES} s USING (sid) GROUP BY ALL), f AS (SELECT
 ebl, ibl, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY ebl, ibl) AS f, tid FROM c), t AS (SELECT * FROM f
 WHERE tid = 1) SELECT sid, {_ODDS.format(y=f'({_P})', e='1e-11')} AS y_prob, CASE WHEN f IS NOT NULL THEN
 {_ODDS.format(y='f', e='1e-10')} END AS y_true, 1 / (1 + exp(-{_ODDS.format(y=f'({_P})', e='1e-11')})) AS y FROM {SPECIES} s LEFT JOIN t
 USING (ebl, ibl)""", "y_prob y_true y"))
def log_odds_labels(spark, sf):
    """Log odds of the expected and of the counted concordance, and the regression target."""
    trees = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sid"), (F.col("l_linenumber") % 3 + 1).alias("tid"))
    strees = species(spark, sf)
    counts = trees.join(strees, "sid").groupBy("ebl", "ibl", "tid").agg(F.count("*").alias("count"))
    rows = T.regression_target(T.with_targets(strees, counts))
    return tidy(rows.select("sid", "y_prob", "y_true", "y"))


@query("class_labels", f"""WITH p AS (SELECT sid, ebl, {_P} AS p FROM (SELECT sid, ebl, ebl / 20 AS ibl FROM
 {SPECIES} s)) SELECT sid, CAST(p > 0.9 AS BIGINT) AS y, CASE WHEN p < 0.4 + CAST(1 AS DOUBLE) / 3 THEN 1 WHEN
 p > 0.6 THEN 0 ELSE -1 END AS ils, CASE WHEN p - 0.5 < 0.2 THEN 1 WHEN p - 0.5 > 0.8 THEN 0 ELSE -1 END AS
 old FROM p""")
def class_labels(spark, sf):
    rows = species(spark, sf).withColumn("ibl", F.col("ebl") / 20)
    rows = T.class_target(T.with_targets(rows), 0.1)
    p = S.expected_concordance("ibl")
    return tidy(rows.select(
        "sid", "y", S.extremes(p, 0.4).alias("ils"),
        S.extremes_of_difference(p, F.lit(0.5)).alias("old")))


@query("limit_labels", rounded(f"""WITH p AS (SELECT sid, {_P} AS y FROM (SELECT sid, ebl / 20 AS ibl FROM
 {SPECIES} s)) SELECT sid, y FROM p WHERE y < 0.45 OR y > 0.9""", "y"))
def limit_labels(spark, sf):
    """Only the rows whose share lies beyond two limits."""
    rows = species(spark, sf).withColumn("ibl", F.col("ebl") / 20)
    return tidy(T.class_target(T.with_targets(rows), low=0.45, high=0.9).select("sid", "y"))


@query("scalar_checks", rounded("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 CASE WHEN l_discount = 0 THEN 0 ELSE l_discount * ln(l_discount / 0.05) END + (1 - l_discount) * ln((1 -
 l_discount) / 0.95) AS kl, greatest(l_discount, 0.03) AS shown, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1
 THEN 3 ELSE 15 END AS trees, '((1_' || l_quantity || ',2_' || l_quantity || ')_' || (1.0) || ',3_' ||
 (l_quantity + 1) || ');' AS unused FROM lineitem""", "kl shown").replace(
    "SELECT * REPLACE", "SELECT * EXCLUDE (unused) REPLACE"))
def scalar_checks(spark, sf):
    """Divergence with empty cells, display floor and tree counts."""
    rows = _lineitem_key(spark, sf)
    return tidy(rows.select(
        *_KEY, S.kl_bernoulli("l_discount", F.lit(0.05)).alias("kl"),
        S.floor_for_display("l_discount", 0.03).alias("shown"),
        S.rooted_tree_count(F.col("l_linenumber") % 3 + 2).cast("long").alias("trees")))


@query("ladder_trees", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '((1_' || (l_linenumber +
 0.0) || ',2_' || (l_linenumber + 0.0) || ')_'  AS head FROM lineitem""".replace(
    "'((1_' || (l_linenumber +\n 0.0) || ',2_' || (l_linenumber + 0.0) || ')_'",
    """'((1_' || l_linenumber || '.0,2_' || l_linenumber || '.0)_' || (CAST(l_quantity AS BIGINT) + 7 -
 l_linenumber) || '.0,3_' || (CAST(l_quantity AS BIGINT) + 7) || '.0);'""").replace("AS head", "AS newick"))
def ladder_trees(spark, sf):
    """Ladder trees from join times."""
    times = F.array(F.col("l_quantity") + 7, F.col("l_linenumber").cast("double"))
    return tidy(_lineitem_key(spark, sf).select(*_KEY, S.ladder_newick(times).alias("newick")))


_B = "CAST('0x' || substr(md5(concat_ws('|', '{s}', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8) AS BIGINT)"


@query("train_test_split", f"""SELECT {_KEYS}, CASE WHEN {_B.format(s=123454)} % 1000 < 100 THEN 'test' ELSE
 'train' END AS part, {_B.format(s=123456)} % 10 AS fold FROM lineitem""")
def train_test_split(spark, sf):
    rows = T.with_fold(_lineitem_key(spark, sf).select(*_KEY), _KEY, 10)
    train, test = T.train_test(rows, _KEY, 0.1)
    return tidy(train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))))


_TRAIN = f"{_B.format(s=123454)} % 1000 >= 200"


@query("impute_scale", rounded(f"""WITH b AS (SELECT {_KEYS}, nullif(l_tax, 0.05) AS x, l_quantity AS q,
 {_TRAIN} AS tr FROM lineitem), m AS (SELECT median(x) AS mx, median(q) AS mq FROM b WHERE tr), f AS (SELECT
 avg(coalesce(x, mx)) AS ax, stddev_pop(coalesce(x, mx)) AS sx, avg(CAST(x IS NULL AS INT)) AS fx,
 stddev_pop(CAST(x IS NULL AS INT)) AS gx, avg(q) AS aq, stddev_pop(q) AS sq FROM b, m WHERE tr)
 SELECT {_KEYS}, (coalesce(x, mx) - ax) / sx AS x, (CAST(x IS NULL AS INT) - fx) / gx AS missing__x,
 (q - aq) / sq AS q, 0 AS missing__q FROM b, m, f""", "x missing__x q missing__q"))
def impute_scale(spark, sf):
    """Median imputing, missing flags and scaling fitted on the training rows only."""
    rows = _lineitem_key(spark, sf).select(
        *_KEY, F.nullif("l_tax", F.lit(0.05)).alias("x"), F.col("l_quantity").alias("q"))
    train, _ = T.train_test(rows, _KEY, 0.2)
    return tidy(T.apply_scaling(rows, T.fit_scaling(train, ["x", "q"]), ["x", "q"]))


@query("baselines", rounded(f"""WITH b AS (SELECT {_KEYS}, l_quantity AS y, {_TRAIN} AS tr FROM lineitem)
 SELECT {_KEYS}, (SELECT avg(y) FROM b WHERE tr) AS "Mean", (SELECT median(y) FROM b WHERE tr) AS "Median"
 FROM b WHERE NOT tr""", "Mean Median"))
def baselines(spark, sf):
    rows = _lineitem_key(spark, sf).select(*_KEY, F.col("l_quantity").alias("y"))
    train, test = T.train_test(rows, _KEY, 0.2)
    return tidy(M.baselines(train, test).drop("y"))


_FOLD = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8) AS BIGINT) % {n}"
_U = "CAST('0x' || substr(md5(concat_ws('|', {seed}, {k}, l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 13) AS BIGINT) / CAST(16 AS DOUBLE) ** 13"


@query("class_baselines", rounded(f"""WITH d AS (SELECT *, CAST(l_returnflag = 'A' AS BIGINT) AS y, {_FOLD.format(seed=123454, n=1000)} AS b FROM lineitem)
 SELECT {_KEYS}, y, p AS "Trivial", CAST({_U.format(seed=0, k=0)} < p AS BIGINT) AS "Random" FROM d, (SELECT avg(y) AS p FROM d WHERE b >= 200)
 WHERE b < 200""", "Trivial"))
def class_baselines(spark, sf):
    """Class prior and a stratified random class."""
    rows = _lineitem_key(spark, sf).select(
        *_KEY, (F.col("l_returnflag") == "A").cast("int").alias("y"))
    train, test = T.train_test(rows, _KEY, 0.2)
    return tidy(M.class_baselines(train, test, "y", _KEY))


@query("noisy_labels", rounded(f"""SELECT {_KEYS}, l_quantity + 0.1 * sqrt(-2 * ln(1 - {_U.format(seed=1, k=1)})) * cos(2 * pi() * {_U.format(seed=1, k=2)})
 AS y, CAST(CASE WHEN {_U.format(seed=2, k=0)} < 0.05 THEN 1 - (l_returnflag = 'A')::INT ELSE (l_returnflag = 'A')::INT END AS BIGINT) AS c
 FROM lineitem""", "y"))
def noisy_labels(spark, sf):
    """Gaussian noise on a regression target and flips on a class."""
    rows = _lineitem_key(spark, sf).select(
        *_KEY, F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "A").cast("int").alias("c"))
    return tidy(T.flip_classes(T.label_noise(rows, "y", 0.1, 1, _KEY), "c", 0.05, 2, _KEY))


# ---- learners ----------------------------------------------------------------------------

_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _regression_rows(spark, sf):
    return _lineitem_key(spark, sf).withColumn("y", F.log(F.col("l_extendedprice")))


def _class_rows(spark, sf):
    return _lineitem_key(spark, sf).withColumn(
        "y", (F.col("l_extendedprice") > 25000).cast("double"))


@query("regression_scores")
def regression_scores(spark, sf):
    """Held-out scores of the regression learners and the baselines."""
    rows = _regression_rows(spark, sf)
    train, test = T.train_test(rows, _KEY, 0.2)

    def scored(done, column, name):
        return M.metrics.score(done, "y", column, M.metrics.REGRESSION).withColumn("learner", F.lit(name))

    with M.prepared_parts(rows, _KEY, _X, impute=False) as (ptrain, ptest):
        n = ptrain.count()
        out = [M.small_rows(scored(M.for_rows(learner, n).fit(ptrain).transform(ptest), "prediction", name))
               for name, learner in M.regression_learners().items()]
    for name, (beta, intercept) in L.fit(train, _X, _KEY).items():
        out.append(scored(test.withColumn("_p", L.predicted(_X, beta, intercept)), "_p", name))
    out.append(scored(M.baselines(train, test), "Median", "Median"))
    return tidy(union_rows(*out))


@query("class_scores")
def class_scores(spark, sf):
    """Held-out scores of the classification learners, classes balanced by weight."""
    rows = M.balanced_weights(_class_rows(spark, sf))
    out = []
    with M.prepared_parts(rows, _KEY, _X, impute=True, others=["y", "weight"]) as (train, test):
        n = train.count()
        for name, learner in M.classification_learners(weight="weight").items():
            done = M.positive_score(M.for_rows(learner, n).fit(train).transform(test)).select("y", "prediction", "preds")
            with M.kept(done):
                scores = M.metrics.class_scores(done, "y", "prediction", "preds")
                out.append(M.small_rows(scores.withColumn("learner", F.lit(name))))
    return tidy(union_rows(*out))


@query("topology_predictions")
def topology_predictions(spark, sf):
    """Three-class feed-forward scores of held-out rows as a prediction table."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 3).cast("double").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    cols = [f"x{i}" for i in range(64)]
    prepared = M.prepare(T.train_test(rows, ["vec_id"], 0.2)[0], rows, cols, impute=False)
    train, test = T.train_test(prepared, ["vec_id"], 0.2)
    model = M.topology_learner(64).fit(train)
    return tidy(M.score_rows(model, test, ["vec_id"], "y", classes=3))


_SUMS = """count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy"""


@query("cross_validation")
def cross_validation(spark, sf):
    """Mean and spread of the linear learners' scores over hash folds: 10 folds, 50 penalties, two scans."""
    summary, _ = L.cross_validate(_regression_rows(spark, sf), _X, _KEY)
    return tidy(summary)


@query("fold_predictions")
def fold_predictions(spark, sf):
    """Out-of-fold predictions, one column per linear learner."""
    _, preds = L.cross_validate(_regression_rows(spark, sf), _X, _KEY)
    return tidy(M.predictions_wide(preds, _KEY, list(L.LEARNERS)))


@query("one_feature_validation", rounded(f"""WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, ln(CAST(l_extendedprice AS DOUBLE)) AS y,
 {_FOLD.format(seed=123456, n=10)} AS fold, {_FOLD.format(seed='123456-inner', n=5)} AS inr FROM lineitem), k AS (SELECT DISTINCT fold AS k FROM d),
 j AS (SELECT DISTINCT inr AS j FROM d), w AS (SELECT k, {_SUMS}, sqrt(var_pop(x)) AS sd FROM k JOIN d ON fold <> k GROUP BY k),
 rest AS (SELECT k, j, {_SUMS} FROM k JOIN d ON fold <> k JOIN j ON inr <> j GROUP BY ALL),
 held AS (SELECT k, j, {_SUMS}, var_pop(y) * count(*) AS yy FROM k JOIN d ON fold <> k JOIN j ON inr = j GROUP BY ALL),
 grid AS (SELECT k, i, abs(xy / sd / n) / 0.5 * pow(0.001, i / 49.0) AS p FROM w, (SELECT unnest(range(50)) AS i)),
 path AS (SELECT k, j, i, sign(r.xy) * greatest(abs(r.xy / sd / r.n) - p * 0.5, 0) / (r.xx / sd / sd / r.n + p * 0.5) / sd AS b, r.mx, r.my
 FROM rest r JOIN grid USING (k) JOIN (SELECT k, sd FROM w) USING (k)),
 err AS (SELECT k, i, avg((h.yy - 2 * b * h.xy + b * b * h.xx) / h.n + pow(h.my - (path.my - path.mx * b) - h.mx * b, 2)) AS e
 FROM path JOIN held h USING (k, j) GROUP BY 1, 2), pick AS (SELECT k, arg_min(i, (e, i)) AS i FROM err GROUP BY 1),
 models AS (SELECT k, 'Mean' AS learner, 0.0 AS b, my AS a FROM w UNION ALL SELECT k, 'Linear', xy / xx, my - mx * xy / xx FROM w UNION ALL
 SELECT k, 'ElasticNet', b, my - mx * b FROM (SELECT w.*, sign(xy) * greatest(abs(xy / sd / n) - p * 0.5, 0) / (xx / sd / sd / n + p * 0.5) / sd
 AS b FROM w JOIN pick USING (k) JOIN grid USING (k, i))),
 s AS (SELECT learner, k, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS part, avg(pow(y - a - b * x, 2)) AS mse, avg(abs(y - a - b * x)) AS mae,
 1 - var_pop(y - a - b * x) / var_pop(y) AS ev FROM models, d GROUP BY ALL), long AS (SELECT learner, part, 'MSE' AS metric, mse AS v FROM s UNION ALL
 SELECT learner, part, 'MAE', mae FROM s UNION ALL SELECT learner, part, 'EV', ev FROM s) SELECT learner, part, metric, avg(v) AS mean,
 stddev_pop(v) AS std FROM long GROUP BY 1, 2, 3""", "mean std"))
def one_feature_validation(spark, sf):
    """The same for one feature, where every step has a closed form."""
    summary, _ = L.cross_validate(_regression_rows(spark, sf), ["l_quantity"], _KEY)
    return tidy(summary)


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    """A pipeline fitted, stored, loaded again and applied, with a class threshold."""
    from pyspark.ml.classification import LogisticRegression

    from ..session import work_path

    folder = work_path(spark, "models")
    rows = _class_rows(spark, sf)
    M.fit_and_save(rows, _X, {"Logistic": LogisticRegression(labelCol="y")}, folder)
    model = T.load_pipeline(f"{folder}/Logistic")
    return tidy(M.score_rows(model, rows, _KEY, "y", threshold=0.9511))


@query("tuned_settings")
def tuned_settings(spark, sf):
    """Held-out error of each setting of a small grid."""
    from pyspark.ml.regression import LinearRegression

    rows = _regression_rows(spark, sf)
    prepared = M.prepare(rows, rows, _X, impute=False)
    grid = [{"regParam": r} for r in (0.0, 0.1, 1.0)]
    _, found = M.tune(prepared, LinearRegression(labelCol="y"), grid,
                      RegressionEvaluator(labelCol="y", metricName="rmse"))
    return tidy(spark.createDataFrame(
        [(g["regParam"], float(v)) for g, v in found], "reg_param double, rmse double"))


@query("importances")
def importances(spark, sf):
    """Importance of every feature in a forest fitted on all rows."""
    rows = _regression_rows(spark, sf)
    prepared = M.prepare(rows, rows, _X, impute=False)
    model = M.regression_learners()["RF"].fit(prepared)
    return tidy(M.importance_table(model, _X, spark))


# ---- analysis ----------------------------------------------------------------------------

_TRIALS = """(SELECT p_partkey AS trial, p_retailprice / (1 + p_size % 7) AS loss, CASE WHEN p_size % 3 = 0
 THEN [168, p_size + 10, 3] WHEN p_size % 3 = 1 THEN [168, p_size + 20, p_size, 3] ELSE [168, 3] END AS layers
 FROM part)"""


def _trials(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("trial"), (F.col("p_retailprice") / (1 + s % 7)).alias("loss"),
        F.when(s % 3 == 0, F.array(F.lit(168), s + 10, F.lit(3)))
        .when(s % 3 == 1, F.array(F.lit(168), s + 20, s, F.lit(3)))
        .otherwise(F.array(F.lit(168), F.lit(3))).alias("layers"))


@query("trial_analysis", rounded(f"""SELECT trial, loss, CAST(list_sum(list_transform(range(1, len(layers)),
 lambda i: layers[i] * layers[i + 1])) AS BIGINT) AS n_params, coalesce(layers[1], 0) AS layer_0,
 coalesce(layers[2], 0) AS layer_1, coalesce(layers[3], 0) AS layer_2, coalesce(layers[4], 0) AS layer_3
 FROM {_TRIALS} t""", "loss"))
def trial_analysis(spark, sf):
    return tidy(M.trial_table(_trials(spark, sf), width=4).drop("layers"))


@query("best_trial", rounded(f"""WITH t AS (SELECT trial, loss, CAST(list_sum(list_transform(range(1,
 len(layers)), lambda i: layers[i] * layers[i + 1])) AS BIGINT) AS n_params FROM {_TRIALS} t) SELECT * FROM t
 WHERE loss < (SELECT quantile_cont(loss, 0.01) FROM t) ORDER BY n_params, loss LIMIT 1""", "loss"))
def best_trial(spark, sf):
    """Smallest network among the best percent of trials."""
    out = M.best_small_trial(M.trial_table(_trials(spark, sf)), "loss")
    return tidy(out.select("trial", "loss", "n_params"))


def _attributions(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("feature", "value")).withColumn(
        "value", F.col("value").cast("double"))


_ATTR = """(SELECT vec_id AS row, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS value, label FROM
 (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


@query("grouped_attribution", rounded(f"""SELECT row, feature // 8 AS "group", sum(value) AS value FROM
 {_ATTR} a GROUP BY 1, 2""", "value"))
def grouped_attribution(spark, sf):
    """Attributions summed by feature group."""
    long = _attributions(spark, sf)
    groups = long.select("feature").distinct().withColumn(
        "group", F.floor(F.col("feature") / 8).cast("long"))
    return tidy(M.grouped_attribution(long, groups))


@query("attribution_strength", rounded(f"""SELECT feature, avg(abs(value)) AS mean_abs,
 stddev_pop(abs(value)) AS stdev_abs FROM {_ATTR} a GROUP BY 1""", "mean_abs stdev_abs"))
def attribution_strength(spark, sf):
    return tidy(M.attribution_summary(_attributions(spark, sf)))


_SLICES = ["ebl<8", "2<ebl<9 and ibl<.1"]
_SLICE_SQL = ["label < 8", "label > 2 AND label < 9 AND embedding[1] < 0.1"]


@query("attribution_slices", rounded(" UNION ALL ".join(f"""SELECT '{name}' AS condition, quartile, feature,
 avg(abs(value)) AS mean_abs, stddev_pop(abs(value)) AS stdev_abs FROM {_ATTR} a JOIN (WITH p AS (SELECT vec_id,
 CAST(embedding[2] AS DOUBLE) AS t FROM embeddings WHERE {cond}), e AS (SELECT quantile_cont(t, [0.25, 0.5, 0.75])
 AS q FROM p) SELECT vec_id AS row, CAST(t > q[1] AS BIGINT) + CAST(t > q[2] AS BIGINT) + CAST(t > q[3] AS
 BIGINT) AS quartile FROM p, e) s USING (row) GROUP BY quartile, feature""" for name, cond in
    zip(_SLICES, _SLICE_SQL)), "mean_abs stdev_abs"))
def attribution_slices(spark, sf):
    """Attribution strength by condition slice and target quartile."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"), F.col("label").alias("ebl"),
        F.col("embedding")[0].alias("ibl"), F.col("embedding")[1].cast("double").alias("t"))
    return tidy(M.attribution_slices(_attributions(spark, sf), rows, _SLICES, "t"))


_GRID = [0.0, 5.0, 10.0, 20.0, 40.0]


@query("partial_dependence", rounded(f"""WITH g AS (SELECT unnest({_GRID}::DOUBLE[]) AS grid), v AS (SELECT
 grid, avg(grid * l_discount * 3 + l_tax * grid * grid) AS value FROM lineitem, g GROUP BY 1) SELECT grid,
 value - (SELECT value FROM v WHERE grid = 0) AS value FROM v""", "grid value"))
def partial_dependence(spark, sf):
    """Mean response to one feature over a grid, for a model with a known formula."""
    def predict(d):
        x = F.col("l_quantity")
        return d.withColumn("prediction", x * F.col("l_discount") * 3 + F.col("l_tax") * x * x)

    return tidy(M.partial_dependence(_lineitem_key(spark, sf), "l_quantity", _GRID, predict))


@query("response_curves", rounded(f"""WITH g AS (SELECT unnest({_GRID}::DOUBLE[]) AS grid), v AS (SELECT
 l_linenumber, grid, avg(grid * l_discount * 3) AS value FROM lineitem, g GROUP BY 1, 2) SELECT l_linenumber,
 grid, value FROM v""", "grid value"))
def response_curves(spark, sf):
    """The same by row group, not centred."""
    def predict(d):
        return d.withColumn("prediction", F.col("l_quantity") * F.col("l_discount") * 3)

    return tidy(M.partial_dependence(
        _lineitem_key(spark, sf), "l_quantity", _GRID, predict, ids=["l_linenumber"],
        centered=False))


_FACTORS = {"l_quantity": "g", "l_discount": "b", "l_tax": "ebl", "l_linenumber": "ibl"}


@query("interaction_anova")
def interaction_anova(spark, sf):
    """Type 2 table of the full interaction model of four factors, with p-values."""
    rows = _regression_rows(spark, sf).withColumnsRenamed(_FACTORS)
    return tidy(L.interaction_anova(rows, "y", list(_FACTORS.values())))


@query("interaction_pair", rounded("""WITH d AS (SELECT ln(CAST(l_extendedprice AS DOUBLE)) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE)
 AS b, CAST(l_quantity AS DOUBLE) * CAST(l_discount AS DOUBLE) AS w FROM lineitem), s AS (SELECT count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb,
 var_pop(w) AS ww, covar_pop(a, b) AS ab, covar_pop(a, w) AS aw, covar_pop(b, w) AS bw, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb,
 covar_pop(y, w) AS yw, var_pop(y) AS yy FROM d), t AS (SELECT *, aa * bb - ab * ab AS det FROM s), u AS (SELECT *,
 n * pow(ya - ab * yb / bb, 2) / (aa - ab * ab / bb) AS sa, n * pow(yb - ab * ya / aa, 2) / (bb - ab * ab / aa) AS sb,
 n * pow(yw - ((bb * ya - ab * yb) * aw + (aa * yb - ab * ya) * bw) / det, 2) / (ww - (bb * aw * aw - 2 * ab * aw * bw + aa * bw * bw) / det) AS sw,
 n * (yy - (bb * ya * ya - 2 * ab * ya * yb + aa * yb * yb) / det) AS two FROM t), v AS (SELECT *, two - sw AS rss, n - 4 AS dof FROM u)
 SELECT 'g' AS term, sa AS sum_sq, CAST(1 AS BIGINT) AS df, sa / (rss / dof) AS f FROM v UNION ALL SELECT 'b', sb, 1, sb / (rss / dof) FROM v UNION ALL
 SELECT 'b:g', sw, 1, sw / (rss / dof) FROM v UNION ALL SELECT 'Residual', rss, dof, NULL FROM v""", "sum_sq f", 3))
def interaction_pair(spark, sf):
    """The same table for two factors, where each sum of squares has a closed form."""
    rows = _regression_rows(spark, sf).withColumnsRenamed(_FACTORS)
    return tidy(L.interaction_anova(rows, "y", ["g", "b"]).drop("pval"), 3)
