"""Queries on sampling, chunking and genome rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import STATS, TIDS, feature_name
from ..operators import sampling as L
from ..operators import summary as G
from ..operators.ranks import hash_key
from ..operators.relational import trees_with_sites, where_matched_model
from .registry import query, rounded, tidy
from .tables import (
    FEATURES,
    INFERRED,
    JOINED,
    LINE_KEY,
    SITE_KEY,
    inferred,
    joined_trees,
    sites,
    table,
)

GENES = 10
_ORDER = "randomcolumn, " + ", ".join(LINE_KEY)
_SQL_STAT = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max", "median": "median"}


def _wide_sql(source: str, keys: str, features=FEATURES, having: str = "") -> str:
    cells = []
    for t in TIDS:
        for f in features:
            cells += [
                f'{_SQL_STAT[s]}("{f}") FILTER (WHERE tid = {t}) AS "{feature_name(f, s, t)}"'
                for s in STATS]
        cells.append(f'count(*) FILTER (WHERE tid = {t}) AS "{feature_name("counts", "", t)}"')
    return f"SELECT {keys}, {', '.join(cells)} FROM {source} GROUP BY {keys} {having}"


def _doubles(features=FEATURES) -> list[str]:
    return [feature_name(f, s, t) for t in TIDS for f in features for s in STATS]


def _dealt(source: str, limit: str = "") -> str:
    return f"""(SELECT *, (rn - 1) // {GENES} AS dset_no FROM (SELECT *, row_number() OVER
 (PARTITION BY sid ORDER BY {_ORDER}) AS rn FROM {source} AS src) AS numbered {limit})"""


@query("genome_summary", rounded(_wide_sql(_dealt(JOINED), "sid, dset_no"), _doubles()))
def genome_summary(spark, sf):
    """Every species tree's gene trees dealt into genomes, one 168-column row each.

    Sites have one row per key, so trees are drawn and dealt before they are widened.
    """
    dealt = L.shuffled_genomes(
        where_matched_model(inferred(spark, sf)), ["sid"], GENES, "randomcolumn", LINE_KEY)
    rows = trees_with_sites(dealt, sites(spark, sf), SITE_KEY, matched_model=False)
    return tidy(G.genome_rows(rows, ["sid", "dset_no"], FEATURES))


@query("sampled_genomes", rounded(_wide_sql(
    _dealt(JOINED, f"WHERE rn <= {GENES}"), "sid, dset_no", ["1_2", "top_1"]),
    _doubles(["1_2", "top_1"])))
def sampled_genomes(spark, sf):
    """One genome per species tree from the rows with the smallest random keys."""
    drawn = L.shuffled_genomes(
        where_matched_model(inferred(spark, sf)), ["sid"], GENES, "randomcolumn", LINE_KEY,
        limit=GENES)
    rows = trees_with_sites(drawn, sites(spark, sf), SITE_KEY, matched_model=False)
    return tidy(G.genome_rows(rows, ["sid", "dset_no"], ["1_2", "top_1"]))


@query("genome_long", rounded(f"""WITH v AS (UNPIVOT (SELECT sid, dset_no, tid, "1_2", "top_1" FROM
 {_dealt(JOINED)} d) ON "1_2", "top_1" INTO NAME feature VALUE v) SELECT sid, dset_no, feature, 'mean' AS stat,
 tid, avg(v) AS value FROM v GROUP BY ALL UNION ALL SELECT sid, dset_no, feature, 'median', tid, median(v)
 FROM v GROUP BY ALL""", "value"))
def genome_long(spark, sf):
    """Two statistics of two features of every genome, as rows."""
    dealt = L.shuffled_genomes(
        where_matched_model(inferred(spark, sf)), ["sid"], GENES, "randomcolumn", LINE_KEY)
    rows = trees_with_sites(dealt, sites(spark, sf), SITE_KEY, matched_model=False)
    long = G.genome_long(rows, ["sid", "dset_no"], ["1_2", "top_1"])
    return tidy(long.where("stat IN ('mean', 'median') AND value IS NOT NULL"))


@query("top_by_key", f"""SELECT sid, tree_no, ds_no, line_no FROM {INFERRED} i QUALIFY
 row_number() OVER (PARTITION BY sid ORDER BY {_ORDER}) <= 5""")
def top_by_key(spark, sf):
    rows = L.first_by_key(inferred(spark, sf), ["sid"], 5, "randomcolumn", LINE_KEY)
    return tidy(rows.select("sid", "tree_no", "ds_no", "line_no"))


@query("hash_sample", """SELECT o_orderkey, o_totalprice FROM orders
 ORDER BY md5(concat_ws('|', '11', o_orderkey)), o_orderkey LIMIT 500""")
def hash_sample(spark, sf):
    return L.sample_rows(table(spark, sf, "orders"), 500, 11, ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query("block_sample", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE
 CAST('0x' || substr(md5(concat_ws('|', 3, 0, l_orderkey // 64)), 1, 13) AS BIGINT) / CAST(16 AS DOUBLE) ** 13 < 0.1""")
def block_sample(spark, sf):
    """Blocks of 64 neighbouring orders, one in ten, drawn from their numbers."""
    return tidy(L.sample_blocks(table(spark, sf, "lineitem"), 0.1, 3, "l_orderkey", 64).select(
        "l_orderkey", "l_linenumber", "l_quantity"))


@query("shuffle_chunks", """SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey
 ORDER BY md5(concat_ws('|', '5', o_orderkey)), o_orderkey) - 1) // 4 AS dset_no FROM orders""")
def shuffle_chunks(spark, sf):
    rows = table(spark, sf, "orders").withColumn("_k", hash_key(5, "o_orderkey"))
    return L.shuffled_genomes(rows, ["o_custkey"], 4, "_k", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "dset_no")


@query("data_sets_of_15", rounded("""SELECT e // 15 AS dataset, count(*) AS n, avg(v) AS m FROM
 (SELECT event_id AS e, value AS v FROM events) GROUP BY 1""", "m"))
def data_sets_of_15(spark, sf):
    rows = table(spark, sf, "events").withColumn(
        "dataset", L.data_set_number(F.col("event_id")))
    return tidy(rows.groupBy("dataset").agg(F.count("*").alias("n"), F.avg("value").alias("m")))


_R, _P, _SHARE, _SETS = 3, 7, 0.3, 2


def _part(model: str, n: int, src: str) -> str:
    return f"""SELECT *, '{src}' AS src FROM {INFERRED} i WHERE sim_model = '{model}' QUALIFY
 row_number() OVER (PARTITION BY sid ORDER BY {_ORDER}) <= {n}"""


@query("mixed_sample", rounded(f"""WITH b AS ({_part('O', _P * _SETS, 'p')} UNION ALL
 {_part('F', _R * _SETS, 'r')}), d AS (SELECT *, (row_number() OVER (PARTITION BY sid ORDER BY
 md5(concat_ws('|', '9', src, randomcolumn)), src, {", ".join(LINE_KEY)}) - 1) // {GENES} AS dset_no
 FROM b) SELECT sid, dset_no, count(*) AS genes, count(*) FILTER (WHERE sim_model = 'F') AS rec,
 avg("1_2") AS m FROM d GROUP BY sid, dset_no""", "m"))
def mixed_sample(spark, sf):
    """Genomes of 70 % plain and 30 % recombined trees."""
    rows = inferred(spark, sf)
    dealt = L.mixed_genomes(
        rows.where("sim_model = 'O'"), rows.where("sim_model = 'F'"), ["sid"], GENES, _SHARE, _SETS,
        "randomcolumn", LINE_KEY, seed=9)
    return tidy(dealt.groupBy("sid", "dset_no").agg(
        F.count("*").alias("genes"), F.count_if(F.col("sim_model") == "F").alias("rec"),
        F.avg("1_2").alias("m")))


_CUT = int(0.2 * 16**8)


@query("replicate_groups", rounded(f"""SELECT r AS replicate, l_partkey AS sid, count(*) AS n,
 avg(l_quantity) AS m FROM lineitem, (VALUES (1), (2), (3)) AS reps(r)
 WHERE CAST('0x' || substr(md5(concat_ws('|', '4:' || r, l_orderkey, l_partkey, l_suppkey,
 l_linenumber)), 1, 8) AS BIGINT) < {_CUT} GROUP BY ALL""", "m"))
def replicate_groups(spark, sf):
    """Repeated small samples grouped by species tree, all replicates in one pass."""
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = L.replicate_samples(table(spark, sf, "lineitem"), 0.2, 3, 4, ids)
    return tidy(rows.groupBy("replicate", F.col("l_partkey").alias("sid")).agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("m")))


@query("n_largest", """(SELECT 'largest' AS which, o_orderkey, o_totalprice FROM orders
 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'smallest', o_orderkey,
 o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""")
def n_largest(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    big = L.largest(rows, "o_totalprice", 10, ["o_orderkey"]).withColumn("which", F.lit("largest"))
    low = L.smallest(rows, "o_totalprice", 10, ["o_orderkey"]).withColumn("which", F.lit("smallest"))
    return big.unionByName(low)


@query("custom_order", """SELECT o_orderkey, o_orderpriority, list_position(['5-LOW', '1-URGENT',
 '3-MEDIUM', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority) AS place FROM orders""")
def custom_order(spark, sf):
    """Rows sorted by the place of their priority in a given list."""
    order = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"]
    place = L.order_position("o_orderpriority", order)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", place.cast("long").alias("place"))
    return rows.orderBy("place", "o_orderkey")


@query("quartet_summary", rounded(_wide_sql(
    f"{INFERRED} AS i", "sid", ["1_2", "1_3"], "HAVING count(*) >= 25"), _doubles(["1_2", "1_3"])))
def quartet_summary(spark, sf):
    """Genome rows of groups with enough genes; the groups may be of any size."""
    return tidy(G.quartet_genome_rows(inferred(spark, sf), ["sid"], ["1_2", "1_3"], 25))


@query("concordant_fraction", rounded(f"""SELECT sid, CAST(count(*) FILTER (WHERE tid = 1) AS DOUBLE)
 / count(*) AS share FROM {JOINED} j GROUP BY sid""", "share"))
def concordant_fraction(spark, sf):
    rows = G.genome_rows(joined_trees(spark, sf), ["sid"], [])
    return tidy(rows.select("sid", G.concordant_share(rows).alias("share")))
