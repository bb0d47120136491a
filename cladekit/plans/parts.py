"""Queries on single steps of the jobs: names, lists, stored statistics, sinks, and the largest differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import quartets as Q
from ..operators import relational as R
from ..operators import sampling as L
from ..operators import summary as G
from ..operators import targets as T
from ..session import work_path
from ..sources import names, sinks
from .evaluation import hdi_sql
from .registry import ORACLES, query, rounded, tidy
from .scoring import _KEY, _lineitem_key
from .tables import LEARNER_TABLE, LEARNERS, learner_table, table


@query("looser_clades", """SELECT o_orderkey FROM orders WHERE (SELECT count(DISTINCT (o_orderkey // CAST(pow(4, i) AS BIGINT)) % 4) FROM range(6) r(i)) = 4""")
def looser_clades(spark, sf):
    """Sets of six taxa in which each of the four clades occurs, once or more."""
    digits = F.array(*[(F.floor(F.col("o_orderkey") / 4**i) % 4 + 1).cast("string") for i in range(6)])
    return table(spark, sf, "orders").where(R.some_of_each_clade(digits)).select("o_orderkey")


_LETTERS = {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "f", 7: "g"}


@query("list_lookup", """SELECT l_orderkey, string_agg(substr('abcdefg', l_linenumber, 1), '' ORDER BY l_linenumber) AS letters FROM lineitem
 GROUP BY 1""")
def list_lookup(spark, sf):
    """Every number of a list looked up in a short dictionary."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    letters = R.lookup_list(F.transform("n", lambda x: x.cast("int")), _LETTERS)
    return lists.select("l_orderkey", F.array_join(letters, "").alias("letters"))


@query("site_run_names", """SELECT o_orderkey, 't_' || o_custkey || '_' || (o_custkey + 5) || '.5_90' AS stree, CASE WHEN o_orderkey % 2 = 0 THEN 'LG' ELSE
 'WAG' END AS sim_model, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS ds_no FROM orders""")
def site_run_names(spark, sf):
    """Run parameters from the names of site-count files; some have no data set."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(
        F.lit("t_"), c.cast("string"), F.lit("_"), (c + 5).cast("string"), F.lit(".5_90_"), F.when(k % 2 == 0, "LG").otherwise("WAG"),
        F.when(k % 3 == 0, F.lit(".scf")).otherwise(F.concat(F.lit(".ds"), (k % 7 + 1).cast("string"), F.lit(".scf"))))
    rows = names.site_run_parameters(table(spark, sf, "orders").select("o_orderkey", name.alias("f")), "f")
    return tidy(rows.select("o_orderkey", "stree", "sim_model", "ds_no"))


@query("single_count_columns", rounded("""SELECT l_suppkey AS sid, avg(l_quantity) AS "1_2__mean__1", count(*) AS "count__mean__1" FROM lineitem GROUP BY 1""",
                                       "1_2__mean__1"))
def single_count_columns(spark, sf):
    """Of the statistics of a count, which are all one number, a single column stays."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sid")).agg(
        F.avg("l_quantity").alias("1_2__mean__1"), *[F.count("*").alias(f"count__{s}__1") for s in ("mean", "min", "max", "median")])
    return tidy(G.drop_repeated_counts(rows))


@query("bulk_loaded", """SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def bulk_loaded(spark, sf):
    """Rows loaded in two runs into one store, a folder per status."""
    path = work_path(spark, "bulk")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for part in (0, 1):
        sinks.bulk_load(orders.where(F.col("o_orderkey") % 2 == part), path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


_BANDS = [(0.4, 0.5), (0.85, 0.95), (0.95, 1.0)]


@query("largest_differences", rounded(f"""WITH e AS (SELECT vec_id % 100 / CAST(100 AS DOUBLE) AS s, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v
 FROM embeddings), z AS (SELECT i, {", ".join(f"(avg(v) FILTER (WHERE s > {a} AND s < {b}) - avg(v)) / stddev_samp(v) AS z{k}" for k, (a, b) in enumerate(_BANDS))}
 FROM e GROUP BY 1) SELECT 'v' || i AS variable, z0, z1, z2, z0 - z1 AS low_minus_high FROM z ORDER BY abs(z0 - z1) DESC, variable LIMIT 20""",
                                      "z0 z1 z2 low_minus_high"))
def largest_differences(spark, sf):
    """The 20 variables whose means differ most between two score intervals."""
    names_ = [f"v{i}" for i in range(64)]
    rows = table(spark, sf, "embeddings").select(
        ((F.col("vec_id") % 100) / F.lit(100.0)).alias("s"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names_)])
    found = E.interval_z_scores(rows, names_, "s", _BANDS).withColumn("_d", F.abs("low_minus_high"))
    return tidy(L.largest(found, "_d", 20, ["variable"]).drop("_d"))


_LONG = " UNION ALL ".join(f"""SELECT ebl, ibl, '{m}' AS model, "{m}" AS preds, y_true FROM {LEARNER_TABLE} t""" for m in LEARNERS)


@query("model_interval_hits", rounded(f"""WITH l AS ({_LONG}) SELECT ebl, ibl, model, low, high, CASE WHEN least(low, 1) <= p AND p <= high THEN 1 ELSE -1
 END AS "HDI" FROM {hdi_sql("l", 0.8, keys="ebl, ibl, model")} h JOIN (SELECT ebl, ibl, model, avg(y_true) AS p FROM l GROUP BY ALL) m
 USING (ebl, ibl, model)""", "low high"))
def model_interval_hits(spark, sf):
    """Whether the mean truth lies in each model's highest-density interval, by condition."""
    return tidy(E.model_hits(learner_table(spark, sf), LEARNERS, "y_true"))


@query("finite_values", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 WHEN l_tax = 0 THEN 0 WHEN l_linenumber = 7 THEN 0 ELSE
 l_quantity END AS x FROM lineitem""")
def finite_values(spark, sf):
    """Infinite values of both signs and NaN count as 0."""
    x = F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("-inf")).when(
        F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity"))
    return tidy(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.finite_or_zero(x).alias("x")))


@query("quartet_sequences", """SELECT a.s_suppkey AS q1, substr(a.s_name, 1, 18) AS s1, substr(d.s_name, 1, 18) AS s4 FROM supplier a JOIN supplier b ON b.s_suppkey
 = a.s_suppkey + 5 JOIN supplier c ON c.s_suppkey = a.s_suppkey + 10 JOIN supplier d ON d.s_suppkey = a.s_suppkey + 15""")
def quartet_sequences(spark, sf):
    """The sequences of four taxa of a gene side by side; quartets that lack one drop out."""
    s = F.col("s_suppkey")
    taxa = table(spark, sf, "supplier").select((s % 5).alias("gene"), s.alias("name"), F.substring("s_name", 1, 18).alias("seq"))
    quartets = taxa.select("gene", *[(F.col("name") + 5 * i).alias(f"q{i + 1}") for i in range(4)])
    return Q.quartet_sequences(quartets, taxa).select("q1", "s1", "s4")


@query("stored_scaling", ORACLES["impute_scale"])
def stored_scaling(spark, sf):
    """Medians, missing flags and scales fitted once, stored, read back and applied."""
    rows = _lineitem_key(spark, sf).select(*_KEY, F.nullif("l_tax", F.lit(0.05)).alias("x"), F.col("l_quantity").alias("q"))
    train, _ = T.train_test(rows, _KEY, 0.2)
    path = work_path(spark, "scaling")
    T.fit_scaling(train, ["x", "q"]).write.parquet(path)
    return tidy(T.apply_scaling(rows, spark.read.parquet(path), ["x", "q"]))
