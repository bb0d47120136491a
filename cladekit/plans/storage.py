"""Queries that write data derived from the tables and read it back through the file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import feature_name
from ..operators import summary as G
from ..operators.relational import with_constants
from ..session import work_path
from ..sources import files, names, sinks
from .registry import query, rounded, tidy
from .tables import newick_trees, predictions, table


def _text_files(df, spark, label: str, folder: str, compression: str = "none") -> str:
    """Write lines as text, one folder per value of ``folder``."""
    path = work_path(spark, label)
    df.write.partitionBy(folder).option("compression", compression).text(path)
    return path


def _kept(path_column: str, folder: str):
    return F.regexp_extract(path_column, folder + r"=([^/]*)/", 1)


@query("newick_scan", """SELECT l_linenumber AS stree, l_partkey * 1000000 + l_suppkey AS tree_no, count(*) AS n
 FROM lineitem GROUP BY 1, 2""")
def newick_scan(spark, sf):
    """Numbered trees written to gzipped files with junk lines between, scanned back."""
    trees = newick_trees(spark, sf).select(
        F.col("line_no").alias("stree"),
        F.explode(F.array(
            F.concat((F.col("sid") * 1000000 + F.col("ds_no")).cast("string"), F.lit(" "), "newick"),
            F.concat(F.lit("# tree "), F.col("sid").cast("string")))).alias("value"))
    path = _text_files(trees, spark, "trees", "stree", "gzip")
    out = files.read_tree_files(spark, path, large=True)
    return out.groupBy(_kept("file_path", "stree").cast("long").alias("stree"), "tree_no").agg(
        F.count("*").alias("n"))


@query("newick_ordinals", """SELECT o_custkey % 10 AS stree, count(*) AS trees, count(*) - 1 AS last,
 sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f FROM orders GROUP BY 1""")
def newick_ordinals(spark, sf):
    """Kept trees of each file are counted from 0, skipped lines are not."""
    text = F.when(F.col("o_orderstatus") == "F", "(4:1,(3:1,(1:1,2:1):1):1);").otherwise(
        "(4:1,(2:1,(1:1,3:1):1):1);")
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("stree"),
        F.explode(F.array(F.lit("not a tree"), text)).alias("value"))
    path = _text_files(rows.repartition("stree"), spark, "ordinals", "stree")
    trees = files.read_tree_files(spark, path, min_bytes=0, large=True)
    return trees.groupBy(_kept("file_path", "stree").cast("long").alias("stree")).agg(
        F.count("*").alias("trees"), F.max("tree_no").cast("long").alias("last"),
        F.count_if(F.col("newick").contains("(1:1,2:1)")).alias("f"))


@query("site_count_scan", rounded("""SELECT o_orderpriority AS kind, sum(o_totalprice) AS top_1,
 sum(o_custkey)::DOUBLE AS nsites, count(*) AS n, count(*) - 1 AS last FROM orders GROUP BY 1""",
                                  "top_1 nsites", 2))
def site_count_scan(spark, sf):
    """Headerless count files; the line number is the tree number."""
    line = F.concat_ws("\t", F.lit("x"), F.col("o_totalprice").cast("string"), F.lit("2"),
                       F.lit("3"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), line.alias("value"))
    path = _text_files(rows.repartition("kind"), spark, "sites", "kind")
    out = files.read_site_counts(spark, path, large=True)
    return tidy(out.groupBy(F.url_decode(_kept("file_path", "kind")).alias("kind")).agg(
        F.sum("top_1").alias("top_1"), F.sum("nsites").alias("nsites"), F.count("*").alias("n"),
        F.max("tree_no").cast("long").alias("last")), 2)


@query("quartet_scan", rounded("""SELECT l_partkey // 20 AS gene, count(*) AS n, sum(l_suppkey)::BIGINT AS s1,
 sum(l_quantity) AS qcf, sum(l_tax) AS qn FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""",
                               "qcf qn", 3))
def quartet_scan(spark, sf):
    """Quartet files with a header line; rows with a gap are dropped."""
    li = table(spark, sf, "lineitem")
    missing = F.when(F.col("l_returnflag") == "R", F.lit("nan-")).otherwise(
        F.col("l_discount").cast("string"))
    body = F.concat_ws(
        "  ", F.lit("1"), F.col("l_suppkey").cast("string"), F.lit("2"), F.lit("3"), F.lit("4"),
        F.col("l_quantity").cast("string"), F.lit("1"), missing, F.lit("1"),
        F.col("l_discount").cast("string"), F.lit("1"), F.col("l_tax").cast("string"))
    head = F.lit("ID Seq1 Seq2 Seq3 Seq4 qCF qCF_N qDF1 qDF1_N qDF2 qDF2_N qN")
    rows = li.select(F.floor(F.col("l_partkey") / 20).alias("gene"), body.alias("value"), F.lit(1).alias("_o"))
    heads = rows.select("gene").distinct().select("gene", head.alias("value"), F.lit(0).alias("_o"))
    whole = heads.unionByName(rows).repartition("gene").sortWithinPartitions("gene", "_o")
    path = work_path(spark, "quartets")
    sinks.write_text_folders(whole, path, "gene")
    out = files.read_quartets(spark, path)
    return tidy(out.groupBy(_kept("file_path", "gene").cast("long").alias("gene")).agg(
        F.count("*").alias("n"), F.sum("Seq1").alias("s1"), F.sum("qCF").alias("qcf"),
        F.sum("qN").alias("qn")), 3)


@query("alignment_files", """SELECT o_custkey % 24 AS gene, count(*) AS taxa, max(length(o_orderpriority || o_orderstatus))::BIGINT AS longest,
 sum(rn * (o_orderkey % 1000))::BIGINT AS placed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 24 ORDER BY o_orderkey) AS rn
 FROM orders) GROUP BY 1""")
def alignment_files(spark, sf):
    """NEXUS files of many blocks: the taxa of each, numbered in file order, whatever block they lie in."""
    gene, key = (F.col("o_custkey") % 24).alias("gene"), F.col("o_orderkey")
    seq = F.concat(F.translate("o_orderpriority", " ", "-"), "o_orderstatus")
    orders = table(spark, sf, "orders")
    body = orders.select(gene, F.lit(1).alias("_part"), key.alias("_at"), F.concat(
        F.lit("Clade@S"), key.cast("string"), F.lit("   "), seq).alias("value"))
    genes = orders.select(gene).distinct()
    head = ["#NEXUS", "begin data;", "dimensions nchar=9;", "matrix"]
    ends = [("gene", 0, i, t) for i, t in enumerate(head)] + [("gene", 2, i, t) for i, t in enumerate([";", "end;", "after it"])]
    rest = genes.select("gene", F.inline(F.array(*[F.struct(
        F.lit(p).alias("_part"), F.lit(i).cast("long").alias("_at"), F.lit(t).alias("value")) for _, p, i, t in ends])))
    whole = body.unionByName(rest).repartition("gene").sortWithinPartitions("gene", "_part", "_at")
    path = _text_files(whole.drop("_part", "_at"), spark, "alignments", "gene")
    out = files.read_alignments(spark, path)
    number = F.regexp_extract("name", r"^Clade_S(\d+)$", 1).cast("long")
    return out.groupBy(_kept("file_path", "gene").cast("long").alias("gene")).agg(
        F.count("*").alias("taxa"), F.max("seq_length").cast("long").alias("longest"),
        F.sum(F.col("ix") * (number % 1000)).alias("placed"))


@query("tree_files_rerooted", """SELECT o_custkey % 12 AS stree, count(*) AS trees, count(*) - 1 AS last, sum(CASE WHEN o_orderstatus = 'F'
 THEN 1 ELSE 0 END)::BIGINT AS f FROM orders GROUP BY 1""")
def tree_files_rerooted(spark, sf):
    """Lines that end in a semicolon, in file order, rooted on leaf 4 as they are read."""
    text = F.when(F.col("o_orderstatus") == "F", "((1:1,2:1):1,3:1,4:2);").otherwise("((1:1,3:1):1,(2:1,4:2):1);")
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 12).alias("stree"), F.explode(F.array(F.lit("no tree"), text)).alias("value"))
    path = _text_files(rows.repartition("stree"), spark, "rooted", "stree")
    trees = files.read_trees(spark, path, outgroup="4")
    return trees.groupBy(_kept("file_path", "stree").cast("long").alias("stree")).agg(
        F.count("*").alias("trees"), F.max("tree_no").cast("long").alias("last"),
        F.count_if(F.col("newick") == "(4:1,((1:1,2:1):1,3:1):1);").alias("f"))


@query("quartet_cleanup", """SELECT DISTINCT l_orderkey || chr(9) || l_suppkey AS value FROM lineitem""")
def quartet_cleanup(spark, sf):
    """Raw quartet output without its second column, comments, header and repeats."""
    body = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_suppkey").cast("string"))
    lines = table(spark, sf, "lineitem").select(
        F.explode(F.array(body, F.lit("# comment"), F.lit("ID\tQuartID\tSeq1"))).alias("value"))
    return files.clean_quartet_lines(lines)


@query("nexus_scan", """SELECT o_custkey AS gene, count(*) AS taxa, max(length(o_orderpriority ||
 o_orderstatus))::BIGINT AS longest, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def nexus_scan(spark, sf):
    """Alignments written as NEXUS text, read back as one row per taxon."""
    seq = F.concat(F.translate("o_orderpriority", " ", "-"), "o_orderstatus")
    row = F.concat(F.lit("Clade@S"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("   "), seq)
    nexus = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"), F.count("*").alias("k"))
    text = nexus.select(
        F.concat(F.lit("#NEXUS\nbegin data;\ndimensions ntax="), F.col("k").cast("string"),
                 F.lit(" nchar=9;\nformat datatype=protein missing=? gap=-;\nmatrix\n"),
                 F.col("rows"), F.lit("\n;\nend;\n")).alias("value"),
        F.concat(F.lit("file:/g/"), F.col("o_custkey").cast("string"), F.lit(".nex"))
        .alias("file_path"))
    out = files.alignment_rows(text)
    return out.groupBy(F.col("gene").cast("long").alias("gene")).agg(
        F.count("*").alias("taxa"), F.max("seq_length").cast("long").alias("longest"),
        F.max(F.regexp_extract("name", r"^Clade_S0*(\d+)$", 1).cast("long")).alias("last"))


@query("matrix_store", rounded("""SELECT l_suppkey AS sid, CAST(avg(l_quantity) FILTER (WHERE l_linenumber % 3 = 0)
 AS FLOAT) AS "1_2__mean__1", count(*) FILTER (WHERE l_linenumber % 3 = 0) AS counts____1 FROM lineitem
 GROUP BY 1""", "1_2__mean__1", 3))
def matrix_store(spark, sf):
    """A genome matrix stored with sorted rows and columns, and read back from two parts."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sid"), (F.col("l_linenumber") % 3 + 1).alias("tid"),
        F.col("l_quantity").alias("1_2"))
    matrix = G.genome_rows(rows, ["sid"], ["1_2"])
    root = work_path(spark, "matrix")
    sinks.write_matrix(matrix.where("sid % 2 = 0"), f"{root}/a", ["sid"])
    sinks.write_matrix(matrix.where("sid % 2 = 1"), f"{root}/b", ["sid"])
    out = files.read_matrices(spark, [f"{root}/a", f"{root}/b"])
    return tidy(out.select("sid", f"`{feature_name('1_2', 'mean', 1)}`",
                           f"`{feature_name('counts', '', 1)}`"), 3)


@query("keyed_store", """SELECT event_type AS matrix, count(*) AS n, max(event_id) AS last FROM events
 WHERE event_type <> 'view' GROUP BY 1""")
def keyed_store(spark, sf):
    """One folder per data matrix; a filter on the key reads only its folders."""
    path = work_path(spark, "keyed")
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "matrix")
    sinks.write_keyed(rows.drop("ts"), path)
    out = files.read_keyed(spark, path).where("matrix <> 'view'")
    return out.groupBy("matrix").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("prediction_files", rounded("""SELECT CAST(100 * (1 + event_id % 3) AS BIGINT) AS "Genes", CAST(500 AS BIGINT)
 AS "Length", CAST(event_id % 3 AS DOUBLE) / 2 AS "Fraction", count(*) AS n, avg((value % 100 + 0.5) / 101) AS p
 FROM events GROUP BY ALL""", "Fraction p"))
def prediction_files(spark, sf):
    """Gzipped prediction files whose folder names hold their condition."""
    root = work_path(spark, "preds")
    rows = predictions(spark, sf).select("ebl", "ibl", "dset_no", "preds", "y_true")
    for k in range(3):
        part = rows.where(F.col("dset_no") % 3 == k)
        sinks.write_csv(part, f"{root}/g{100 * (1 + k)}_l500_f{k / 2:.1f}_20")
    sinks.write_csv(rows, f"{root}/other_20")
    schema = "ebl double, ibl double, dset_no bigint, preds double, y_true double"
    read = files.read_predictions(spark, f"{root}/*", schema)
    out = names.recombination_parameters(read, "folder")
    return tidy(out.groupBy("Genes", "Length", "Fraction").agg(
        F.count("*").alias("n"), F.avg("preds").alias("p")))


@query("gene_tables", """SELECT 'gene' || (l_linenumber) AS gene, count(*) AS n, max(l_suppkey) AS s FROM lineitem
 GROUP BY 1""")
def gene_tables(spark, sf):
    """Quartet tables stored one folder per gene, the gene taken from the folder name."""
    root = work_path(spark, "genes")
    rows = table(spark, sf, "lineitem").select("l_linenumber", "l_suppkey")
    for k in range(1, 8):
        rows.where(F.col("l_linenumber") == k).drop("l_linenumber").write.parquet(
            f"{root}/gene{k}.quartets")
    return files.read_by_gene(spark, root).groupBy("gene").agg(
        F.count("*").alias("n"), F.max("l_suppkey").alias("s"))


@query("append_new_rows", """SELECT count(*) AS n, count(DISTINCT k) AS keys, sum(k)::BIGINT AS s FROM
 (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem)""")
def append_new_rows(spark, sf):
    """Overlapping batches appended; every key is stored once."""
    path = work_path(spark, "append")
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_returnflag")
    for batch in (rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag <> 'A'"), rows):
        sinks.append_new(batch.select("k"), path, ["k"])
    stored = spark.read.parquet(path)
    return stored.agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"),
                      F.sum("k").alias("s"))


@query("array_store", rounded("""SELECT l_orderkey, 2 * sum(coalesce(nullif(l_tax, 0.05), 0)) AS s, 2 * count(*) AS n
 FROM lineitem GROUP BY 1""", "s"))
def array_store(spark, sf):
    """An array table grown twice, gaps stored as 0."""
    path = work_path(spark, "arrays")
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_tax", F.lit(0.05)).alias("x"))
    for _ in range(2):
        sinks.append_array(rows, path, fill_missing=True)
    return tidy(files.read_repartitioned(spark, path, 8).groupBy("l_orderkey").agg(
        F.sum("x").alias("s"), F.count("x").alias("n")))


@query("exported_view", """SELECT l_partkey AS sid, l_linenumber % 3 AS tid, count(*) AS c FROM lineitem
 WHERE l_quantity > 10 GROUP BY 1, 2""")
def exported_view(spark, sf):
    """A parameterised view written to CSV with a header, and read back."""
    path = work_path(spark, "export")
    files.read_table(spark, f"{sf}/lineitem.parquet",
                     ["l_partkey", "l_linenumber", "l_quantity"], view="gene_trees_view")
    sinks.export_view(spark, """SELECT l_partkey AS sid, l_linenumber % 3 AS tid, count(*) AS c
        FROM gene_trees_view WHERE l_quantity > :least GROUP BY 1, 2""", path, least=10)
    return spark.read.option("header", True).schema("sid bigint, tid bigint, c bigint").csv(path)


@query("file_name_keys", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'LG' AS sim_model, 'WAG' AS
 infer_model, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 END AS ds_no, CASE l_linenumber % 4 WHEN 0
 THEN 'heterotachy' WHEN 1 THEN 'one_rate' WHEN 2 THEN 'rec' ELSE 'nonrec' END AS dataset, CASE WHEN
 l_linenumber % 4 < 2 THEN 500 ELSE 250 END AS seq_length, CASE WHEN l_linenumber % 4 = 2 THEN 3 ELSE 1 END AS
 nblocks, CASE WHEN l_linenumber % 4 = 2 THEN 100 END AS ngenes, CAST(l_suppkey + 5 AS DOUBLE) AS ibl,
 '(4:' || (l_suppkey + 30) || ',(3:' || (2 * l_suppkey + 6) || ',(1:' || (l_suppkey + 1) || ',2:' ||
 (l_suppkey + 1) || '):' || (l_suppkey + 5) || '):' || (l_suppkey + 30) || ');' AS newick FROM lineitem""")
def file_name_keys(spark, sf):
    """Species tree, models, data set and table from file and folder names."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    stem = F.concat(F.lit("t_"), (s + 1).cast("string"), F.lit("_"), (2 * s + 6).cast("string"),
                    F.lit("_"), (2 * s + 33 + 0).cast("string"))
    stem = F.concat(F.lit("t_"), (s + 1).cast("string"), F.lit("_"), (2 * s + 6).cast("string"),
                    F.lit("_"), (2 * s + 33).cast("string"), F.lit(".0"))
    file = F.concat(stem, F.lit("_LG_PROTCATWAG."),
                    F.when(n % 2 == 0, F.concat(F.lit("ds"), n.cast("string"), F.lit("."))).otherwise(""),
                    F.lit("raxml.trees"))
    folder = F.when(n % 4 == 0, "250_hetero").when(n % 4 == 1, "set_1_rate").when(
        n % 4 == 2, "250bp_b3_g100").otherwise("250bp")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", file.alias("file"),
        folder.alias("folder"))
    out = names.data_set(names.run_parameters(names.species_tree(rows, "file"), "file"), "folder")
    return tidy(out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "sim_model", "infer_model", "ds_no",
        "dataset", "seq_length", "nblocks", "ngenes", "ibl", "newick"))


@query("gene_name_keys", """SELECT o_orderkey, 'set' AS prefix, CAST(o_orderkey AS VARCHAR) AS gene, CASE WHEN
 o_orderstatus = 'F' THEN 'LG+F' ELSE 'WAG' END AS infer_model, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN
 '3' ELSE '0' END AS clade, CASE o_orderstatus WHEN 'F' THEN 'ParaHoxozoa' WHEN 'O' THEN 'Porifera' ELSE 'Other'
 END AS clade_name, 'AA' AS seq_type FROM orders""")
def gene_name_keys(spark, sf):
    """Gene, prefix and model of tree files; clade of taxon names."""
    file = F.concat(F.lit("set_"), F.col("o_orderkey").cast("string"), F.lit("."),
                    F.when(F.col("o_orderstatus") == "F", "LG+F").otherwise("WAG"), F.lit(".treefile"))
    taxon = F.when(F.col("o_orderstatus") == "F", "ParaHoxozoa@Homo_sapiens").when(
        F.col("o_orderstatus") == "O", "Porifera_Ephydatia").otherwise("Other_x")
    rows = table(spark, sf, "orders").select("o_orderkey", file.alias("file"), taxon.alias("taxon"))
    rows = with_constants(names.gene_parameters(rows, "file"), seq_type="AA")
    clades = ["ParaHoxozoa", "Ctenophora", "Porifera", "Outgroup"]
    return rows.select("o_orderkey", "prefix", "gene", "infer_model",
                       names.clade_number("taxon", clades).alias("clade"),
                       names.clade("taxon").alias("clade_name"), "seq_type")


