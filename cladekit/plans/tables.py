"""Roles of the discordance data model played by the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import genome_features
from ..operators.ranks import hash_key

LINE_KEY = ["tree_no", "sid", "ds_no", "line_no"]
SITE_KEY = ["tree_no", "sim_model"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred gene trees: one per order line, its species tree being the part."""
    df = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sid"), F.col("l_orderkey").alias("tree_no"),
        F.col("l_suppkey").alias("ds_no"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_linenumber") % 3 + 1).alias("tid"), F.col("l_linestatus").alias("sim_model"),
        F.concat(F.lit("PROTCAT"), F.when(F.col("l_suppkey") % 2 == 0, "O").otherwise("F"))
        .alias("infer_model"),
        (F.col("l_linenumber") * 100).alias("seq_length"),
        F.col("l_quantity").alias("1_2"), F.col("l_extendedprice").alias("1_3"),
        F.col("l_discount").alias("2_3"), F.col("l_tax").alias("1_4"),
        (F.col("l_quantity") + F.col("l_tax")).alias("2_4"),
        (F.col("l_quantity") + F.col("l_discount")).alias("3_4"),
    )
    return df.withColumn("randomcolumn", hash_key(7, *LINE_KEY))


INFERRED = """(SELECT l_partkey AS sid, l_orderkey AS tree_no, l_suppkey AS ds_no,
  l_linenumber AS line_no, l_linenumber % 3 + 1 AS tid, l_linestatus AS sim_model,
  'PROTCAT' || CASE WHEN l_suppkey % 2 = 0 THEN 'O' ELSE 'F' END AS infer_model,
  l_linenumber * 100 AS seq_length, l_quantity AS "1_2", l_extendedprice AS "1_3",
  l_discount AS "2_3", l_tax AS "1_4", l_quantity + l_tax AS "2_4",
  l_quantity + l_discount AS "3_4",
  md5(concat_ws('|', '7', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS randomcolumn
  FROM lineitem)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Site concordance of gene trees: one row per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tree_no"), F.col("o_orderstatus").alias("sim_model"),
        F.col("o_totalprice").alias("top_1"), (F.col("o_custkey") % 97).cast("double").alias("top_2"),
        (F.col("o_orderkey") % 101).cast("double").alias("top_3"),
        (F.col("o_custkey") + 3).cast("double").alias("nsites"),
    )


SITES = """(SELECT o_orderkey AS tree_no, o_orderstatus AS sim_model, o_totalprice AS top_1,
  CAST(o_custkey % 97 AS DOUBLE) AS top_2, CAST(o_orderkey % 101 AS DOUBLE) AS top_3,
  CAST(o_custkey + 3 AS DOUBLE) AS nsites FROM orders)"""


def species(spark: SparkSession, sf: str) -> DataFrame:
    """Species trees: one per part."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("sid"), F.col("p_size").cast("double").alias("ebl"),
        (F.col("p_retailprice") / 1000).alias("ibl"))


SPECIES = """(SELECT p_partkey AS sid, CAST(p_size AS DOUBLE) AS ebl,
  p_retailprice / 1000 AS ibl FROM part)"""


def joined_trees(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.relational import trees_with_sites

    return trees_with_sites(inferred(spark, sf), sites(spark, sf), SITE_KEY)


JOINED = f"""(SELECT * FROM (SELECT * FROM {INFERRED} a WHERE contains(infer_model, sim_model)) i
  LEFT JOIN {SITES} s USING (tree_no, sim_model))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions per genome: one per event, its condition being the kind and the hour."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("dset_no"), kind.alias("matrix"),
        F.when(kind == "click", 20.0).when(kind == "error", 40.0).when(kind == "purchase", 60.0)
        .when(kind == "signup", 80.0).otherwise(100.0).alias("ebl"),
        ((F.hour("ts") + 1) / F.lit(4.0)).alias("ibl"),
        ((F.col("user_id") % 100 + 0.5) / 100).alias("y_true"),
        ((F.col("value") % 100 + 0.5) / 101).alias("preds"), "user_id", "value",
    )


PREDICTIONS = """(SELECT event_id AS dset_no, event_type AS matrix,
  CAST(CASE event_type WHEN 'click' THEN 20 WHEN 'error' THEN 40 WHEN 'purchase' THEN 60
    WHEN 'signup' THEN 80 ELSE 100 END AS DOUBLE) AS ebl,
  (extract(hour FROM ts) + 1) / CAST(4 AS DOUBLE) AS ibl,
  (user_id % 100 + CAST(0.5 AS DOUBLE)) / 100 AS y_true,
  (value % 100 + CAST(0.5 AS DOUBLE)) / 101 AS preds, user_id, value FROM events)"""


def learner_table(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of four learners side by side."""
    p = F.col("preds")
    return predictions(spark, sf).select(
        "dset_no", "ebl", "ibl", "y_true", p.alias("RF"),
        ((p * 3 + F.col("y_true")) / 4).alias("GradBoost"),
        ((p + F.col("y_true")) / 2).alias("ElasticNet"), F.lit(0.5).alias("Mean"))


LEARNERS = ["RF", "GradBoost", "ElasticNet", "Mean"]
LEARNER_TABLE = f"""(SELECT dset_no, ebl, ibl, y_true, preds AS "RF",
  (preds * 3 + y_true) / 4 AS "GradBoost", (preds + y_true) / 2 AS "ElasticNet",
  CAST(0.5 AS DOUBLE) AS "Mean" FROM {PREDICTIONS} p)"""


def newick_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Newick text of a four-leaf tree per order line; cherry and lengths come from the line."""
    q, d, t = (F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"),
               F.round(F.col("l_tax") * 100).cast("long"))
    n = F.col("l_linenumber").cast("long")

    def text(x, y, z):
        return F.concat(
            F.lit("(4:"), (q + 20).cast("string"), F.lit(f",({z}:"), (n + 5).cast("string"),
            F.lit(f",({x}:"), q.cast("string"), F.lit(f",{y}:"), (q + d).cast("string"),
            F.lit("):"), (t + 1).cast("string"), F.lit("):"), (d + 2).cast("string"), F.lit(");"))

    shape = n % 3
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return lines.select(
        F.col("l_partkey").alias("sid"), F.col("l_orderkey").alias("tree_no"),
        F.col("l_suppkey").alias("ds_no"), F.col("l_linenumber").alias("line_no"),
        F.when(shape == 0, text("1", "2", "3")).when(shape == 1, text("1", "3", "2"))
        .otherwise(text("2", "3", "1")).alias("newick"))


def tasks(spark: SparkSession) -> int:
    """Tasks to deal parsing over: as many as the cluster runs at once."""
    return spark.sparkContext.defaultParallelism


def spread_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The trees dealt over the cluster, since their table may come as one split."""
    return newick_trees(spark, sf).repartition(tasks(spark))


# leaf lengths x, y (cherry) and z, and the inner lengths, as the text above has them
NEWICK = """(SELECT l_partkey AS sid, l_orderkey AS tree_no, l_suppkey AS ds_no,
  l_linenumber AS line_no, l_linenumber % 3 + 1 AS tid,
  CAST(l_quantity AS BIGINT) AS lx,
  CAST(l_quantity AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) AS ly,
  CAST(l_linenumber AS BIGINT) + 5 AS lz, CAST(round(l_tax * 100) AS BIGINT) + 1 AS inner_len,
  CAST(round(l_discount * 100) AS BIGINT) + 2 AS up, CAST(l_quantity AS BIGINT) + 20 AS l4
  FROM lineitem)"""

FEATURES = list(genome_features())
