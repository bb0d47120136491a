"""Queries on filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query, rounded, tidy
from .tables import (
    INFERRED,
    JOINED,
    SITES,
    SPECIES,
    inferred,
    joined_trees,
    sites,
    species,
    table,
)


@query("eligible_ids", rounded(f"""SELECT s.sid, s.ebl, s.ibl FROM {SPECIES} s JOIN
 (SELECT sid FROM {INFERRED} i GROUP BY sid HAVING count(*) >= 30) e ON s.sid = e.sid""", "ibl ebl"))
def eligible_ids(spark, sf):
    return tidy(R.eligible_ids(inferred(spark, sf), species(spark, sf), 30))


@query("sample_left_scf", rounded(f"""SELECT tree_no, sid, ds_no, line_no, tid, seq_length, "1_2",
 top_1, top_2, top_3, nsites FROM {JOINED} j""", "1_2 top_1 top_2 top_3 nsites"))
def sample_left_scf(spark, sf):
    return tidy(joined_trees(spark, sf).select(
        "tree_no", "sid", "ds_no", "line_no", "tid", "seq_length", "1_2", "top_1", "top_2",
        "top_3", "nsites"))


@query("model_left_scf", rounded(f"""SELECT i.tree_no, i.sid, i.ds_no, i.line_no, i.tid, s.top_1,
 s.nsites FROM (SELECT * FROM {INFERRED} a WHERE sim_model = 'O' AND contains(infer_model, 'F')) i
 LEFT JOIN (SELECT * FROM {SITES} b WHERE sim_model = 'F') s ON i.tree_no = s.tree_no""",
                                 "top_1 nsites"))
def model_left_scf(spark, sf):
    """Trees simulated under one model and inferred under the other; sites joined by tree alone."""
    left = R.where_equal(inferred(spark, sf), sim_model="O").where(
        F.col("infer_model").contains("F"))
    right = R.where_equal(sites(spark, sf), sim_model="F").drop("sim_model")
    out = R.trees_with_sites(left, right, ["tree_no"], matched_model=False)
    return tidy(out.select("tree_no", "sid", "ds_no", "line_no", "tid", "top_1", "nsites"))


_REC = """(SELECT l_partkey AS sid, l_suppkey AS ds_no, l_linestatus AS sim_model,
 l_linenumber AS line_no, l_orderkey AS ok, l_quantity AS x,
 CASE WHEN l_linenumber % 2 = 0 THEN [l_orderkey, CAST(l_linenumber AS BIGINT)]
 ELSE [l_orderkey] END AS tree_no FROM lineitem)"""


@query("rec_left_scf", rounded(f"""SELECT i.ok, i.sid, i.ds_no, i.line_no, i.x, s.top_1 FROM
 (SELECT * FROM {_REC} r WHERE len(tree_no) = 2) i LEFT JOIN
 (SELECT tree_no, sim_model, ds_no, avg(x) AS top_1 FROM {_REC} q
  GROUP BY tree_no, sim_model, ds_no) s USING (tree_no, sim_model, ds_no)""", "x top_1"))
def rec_left_scf(spark, sf):
    """Recombined trees and their sites, matched on the array of source trees."""
    key = F.col("l_orderkey")
    rec = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sid"), F.col("l_suppkey").alias("ds_no"),
        F.col("l_linestatus").alias("sim_model"), F.col("l_linenumber").alias("line_no"),
        key.alias("ok"), F.col("l_quantity").alias("x"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(key, F.col("l_linenumber").cast("long")))
        .otherwise(F.array(key)).alias("tree_no"))
    keys = ["tree_no", "sim_model", "ds_no"]
    counted = rec.groupBy(*keys).agg(F.avg("x").alias("top_1"))
    out = R.trees_with_sites(R.where_blocks(rec, 2), counted, keys, matched_model=False)
    return tidy(out.select("ok", "sid", "ds_no", "line_no", "x", "top_1"))


@query("all_lengths_join", rounded(f"""SELECT tree_no, sid, ds_no, line_no, seq_length, top_1, ebl,
 ibl FROM {INFERRED} i LEFT JOIN (SELECT l_partkey AS sid, l_linenumber * 100 AS seq_length,
 l_orderkey AS tree_no, l_linestatus AS sim_model, max(l_extendedprice) AS top_1 FROM lineitem
 GROUP BY ALL) c USING (sid, seq_length, tree_no, sim_model)
 JOIN {SPECIES} s USING (sid) WHERE ebl < 30 AND contains(infer_model, sim_model)""",
                                   "top_1 ebl ibl"))
def all_lengths_join(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("sid"), (F.col("l_linenumber") * 100).alias("seq_length"),
        F.col("l_orderkey").alias("tree_no"), F.col("l_linestatus").alias("sim_model"),
    ).agg(F.max("l_extendedprice").alias("top_1"))
    rows = R.trees_with_sites(
        inferred(spark, sf), counted, ["sid", "seq_length", "tree_no", "sim_model"])
    out = R.natural_join(rows, species(spark, sf)).where("ebl < 30")
    return tidy(out.select("tree_no", "sid", "ds_no", "line_no", "seq_length", "top_1", "ebl",
                           "ibl"))


_STAR = [("O", "A"), ("O", "N"), ("F", "A"), ("F", "N")]


@query("star_view", rounded(" UNION ALL ".join(f"""SELECT '{s}/{i}' AS view, o_orderkey AS gid,
 o_custkey AS sid, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS i_1_1,
 o_totalprice AS g_1_1, c_acctbal AS s_1_1, c_acctbal / 2 - c_nationkey AS ibl,
 c_acctbal - c_acctbal / 2 AS ebl
 FROM orders LEFT JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE l_linestatus = '{s}' AND l_returnflag = '{i}'""" for s, i in _STAR),
                            "i_1_1 g_1_1 s_1_1 ibl ebl"))
def star_view(spark, sf):
    """The four true / inferred / species views, one per pair of models."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    true = orders.select(F.col("o_orderkey").alias("gid"), F.col("o_totalprice").alias("g_1_1"))
    generated = orders.select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").alias("sid"))
    strees = customer.select(
        F.col("c_custkey").alias("sid"), F.col("c_acctbal").alias("s_1_1"),
        (F.col("c_acctbal") / 2).alias("s_1_2"), F.col("c_nationkey").alias("s_1_3"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("gid"), "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_linestatus").alias("sim_model"), F.col("l_returnflag").alias("infer_model"),
        F.col("l_extendedprice").alias("i_1_1"))
    views = R.star_views(true, generated, strees, lines, _STAR)
    return tidy(views.select(
        "view", "gid", "sid", "l_partkey", "l_suppkey", "l_linenumber", "i_1_1", "g_1_1", "s_1_1",
        "ibl", "ebl"))


@query("row_index_join", rounded(f"""SELECT sid, ebl, ibl FROM {SPECIES} s WHERE sid IN
 (SELECT sid FROM {INFERRED} i WHERE sim_model = 'O' GROUP BY sid HAVING count(*) >= 12) AND sid IN
 (SELECT sid FROM {INFERRED} i WHERE sim_model = 'F' GROUP BY sid HAVING count(*) >= 12)""",
                                 "ebl ibl"))
def row_index_join(spark, sf):
    trees = inferred(spark, sf)
    plain = R.eligible_ids(trees.where("sim_model = 'O'"), species(spark, sf), 12)
    return tidy(R.eligible_ids(trees.where("sim_model = 'F'"), plain, 12))


_SIDE = """(SELECT l_suppkey AS b, l_linenumber AS g, count(*) AS {0} FROM lineitem
 WHERE {1} GROUP BY ALL)"""


@query("outer_fraction", rounded(f"""SELECT b, g, c_x, c_y, c_x / (c_x + c_y) AS n FROM
 {_SIDE.format('c_x', "l_returnflag = 'A'")} x FULL JOIN
 {_SIDE.format('c_y', "l_returnflag <> 'A'")} y USING (b, g)""", "n"))
def outer_fraction(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("g"), "l_returnflag")
    count = F.count(F.lit(1)).alias("c")
    agree = rows.where("l_returnflag = 'A'").groupBy("b", "g").agg(count)
    differ = rows.where("l_returnflag <> 'A'").groupBy("b", "g").agg(count)
    return tidy(R.outer_fraction(agree, differ, ["b", "g"]))


@query("reindex_labels", """SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d
 LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def reindex_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return tidy(R.aligned(docs, table(spark, sf, "labels"), ["doc_id"]))


@query("natural_merge", """SELECT o_orderkey AS tree_no, o_orderstatus AS model, l_partkey, l_suppkey,
 l_linenumber, c_mktsegment AS result FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 AND l_linestatus = o_orderstatus LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0)
 ON c_custkey = o_custkey""")
def natural_merge(spark, sf):
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tree_no"), F.col("o_orderstatus").alias("model"), "o_custkey")
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tree_no"), F.col("l_linestatus").alias("model"), "l_partkey",
        "l_suppkey", "l_linenumber")
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("result"))
    out = R.natural_join(R.natural_join(a, b), c, "left")
    return tidy(out.drop("o_custkey"))


@query("index_merge", """SELECT e.doc_id, e.quality AS a, t.n_chars AS b,
 t.n_chars - e.quality AS d FROM labels e JOIN documents t ON e.doc_id = t.doc_id""")
def index_merge(spark, sf):
    """Two prediction tables side by side on their row keys."""
    a = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a"))
    b = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("b"))
    return tidy(a.join(b, "doc_id").withColumn("d", F.col("b") - F.col("a")))


@query("key_intersection", """SELECT o_custkey AS sid, o_orderpriority AS kind FROM orders
 WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, o_orderpriority FROM orders
 WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey, o_orderpriority FROM orders
 WHERE o_orderstatus = 'P'""")
def key_intersection(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("sid"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")
    return R.common_keys(
        [rows.where(F.col("o_orderstatus") == s) for s in "FOP"], ["sid", "kind"])


@query("key_difference", """SELECT doc_id AS sid FROM documents EXCEPT SELECT doc_id FROM labels""")
def key_difference(spark, sf):
    whole, labelled = (table(spark, sf, t).select(F.col("doc_id").alias("sid")) for t in ("documents", "labels"))
    return whole.subtract(labelled)


@query("union_results", """SELECT 'nonrec' AS kind, l_partkey AS sid, l_quantity AS q,
 CAST(NULL AS DOUBLE) AS x FROM lineitem WHERE l_returnflag = 'N' UNION ALL
 SELECT 'rec', l_partkey, l_quantity, l_tax FROM lineitem WHERE l_returnflag = 'R'""")
def union_results(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sid"), F.col("l_quantity").alias("q"),
        F.col("l_tax").alias("x"), "l_returnflag")
    a = rows.where("l_returnflag = 'N'").select(F.lit("nonrec").alias("kind"), "sid", "q")
    b = rows.where("l_returnflag = 'R'").select(F.lit("rec").alias("kind"), "sid", "q", "x")
    return R.union_rows(a, b)


@query("distinct_trios", """SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem""")
def distinct_trios(spark, sf):
    return tidy(table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_returnflag").distinct())


@query("balanced_keys", """WITH t AS (SELECT l_returnflag AS "Length", l_linenumber AS "Fraction",
 l_partkey AS sid, l_quantity AS q FROM lineitem), f AS (SELECT "Length", sid FROM t
 GROUP BY "Length", sid HAVING count(DISTINCT "Fraction") = (SELECT count(DISTINCT "Fraction")
 FROM t u WHERE u."Length" = t."Length")) SELECT t.* FROM t SEMI JOIN f USING ("Length", sid)""")
def balanced_keys(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("Length"), F.col("l_linenumber").alias("Fraction"),
        F.col("l_partkey").alias("sid"), F.col("l_quantity").alias("q"))
    return tidy(R.balanced_rows(rows, ["Length"], "Fraction", ["sid"]))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("ordered_pairs", rounded("""WITH m AS (SELECT event_type AS k, avg(value) AS v FROM events
 GROUP BY 1) SELECT a.k || '>' || b.k AS pair, a.v - b.v AS diff FROM m a JOIN m b ON a.k <> b.k""",
                                "diff"))
def ordered_pairs(spark, sf):
    """Differences of means over all ordered pairs of a fixed list of conditions."""
    from ..operators.rank_tests import all_pairs

    wide = table(spark, sf, "events").agg(
        *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in _TYPES])
    pairs = [F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col(a) - F.col(b)).alias("diff"))
             for a, b in all_pairs(_TYPES)]
    return tidy(wide.select(F.inline(F.array(*pairs))))


@query("filtered_rows", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
 AND o_orderpriority = '1-URGENT' AND 20000 < o_totalprice AND o_totalprice <= 300000""")
def filtered_rows(spark, sf):
    rows = R.where_equal(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")
    return R.where_query(rows, "20000<o_totalprice<=300000").select("o_orderkey", "o_totalprice")


@query("prefix_exclusion", """SELECT p_partkey, p_type, p_brand FROM part
 WHERE NOT starts_with(p_brand, 'Brand#1')""")
def prefix_exclusion(spark, sf):
    return R.without_prefix(table(spark, sf, "part"), "p_brand", "Brand#1").select(
        "p_partkey", "p_type", "p_brand")


@query("extreme_rows", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount
 FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.08""")
def extreme_rows(spark, sf):
    rows = R.where_extreme(table(spark, sf, "lineitem"), "l_discount", 0.02, 0.08)
    return tidy(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount"))


@query("big_groups", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN
 (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 7)""")
def big_groups(spark, sf):
    rows = R.where_group_size(table(spark, sf, "lineitem"), ["l_orderkey"], 7)
    return rows.select("l_orderkey", "l_partkey", "l_quantity")


@query("drop_null_rows", f"""SELECT tree_no, sid, ds_no, line_no, top_1, top_2 FROM {JOINED} j
 WHERE top_1 IS NOT NULL AND nullif(top_2, 5) IS NOT NULL""")
def drop_null_rows(spark, sf):
    rows = joined_trees(spark, sf).withColumn("top_2", F.nullif("top_2", F.lit(5.0)))
    return tidy(rows.na.drop(subset=["top_1", "top_2"]).select(
        "tree_no", "sid", "ds_no", "line_no", "top_1", "top_2"))


@query("enriched_rows", rounded("""SELECT c_custkey, n_name, 0.01 AS theta, 500 AS seq_length,
 'raxml' AS infer_engine, c_acctbal / 100 AS scaled,
 n_regionkey || '/' || c_mktsegment AS label FROM customer JOIN nation ON
 c_nationkey = n_nationkey""", "theta scaled"))
def enriched_rows(spark, sf):
    """Dictionary lookup, constants, unit scaling and a condition label."""
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = R.lookup(table(spark, sf, "customer"), nation, "c_nationkey", "n_name")
    rows = R.lookup(rows, nation, "c_nationkey", "n_regionkey")
    rows = R.with_constants(rows, theta=0.01, seq_length=500, infer_engine="raxml")
    rows = R.scaled(rows.withColumn("scaled", F.col("c_acctbal")), ["scaled"], 100)
    return tidy(rows.select(
        "c_custkey", "n_name", "theta", "seq_length", "infer_engine", "scaled",
        F.concat_ws("/", F.col("n_regionkey").cast("string"), "c_mktsegment").alias("label")))


@query("prefix_columns", """SELECT l_orderkey, l_discount, l_tax FROM lineitem""")
def prefix_columns(spark, sf):
    return R.columns_starting(table(spark, sf, "lineitem"), ["l_disc", "l_tax"], ["l_orderkey"])


