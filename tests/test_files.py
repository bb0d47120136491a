import gzip

import pytest
from pyspark.sql import functions as F

from cladekit.sources import files, names, sinks
from cladekit.streaming import jobs

NEXUS = """#NEXUS
begin data;
dimensions ntax=3 nchar=6;
format datatype=protein missing=? gap=-;
matrix
Porifera@A_b   ACD-?F
Outgroup@C      AC DEF?
Ctenophora@D   AAAAAA
;
end;
"""


def test_tree_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.trees.gz", "wt") as f:
        f.write("# head\n(1,2);\n\n7 (3,4);\nnot a tree;\n(5,6);\n")
    (tmp_path / "b.trees").write_text("(1,2);\n")
    rows = files.read_tree_files(spark, str(tmp_path)).collect()
    got = sorted((r.file_path.split("/")[-1], r.tree_no, r.newick) for r in rows)
    assert got == [("a.trees.gz", 2, "(5,6);"), ("a.trees.gz", 7, "(3,4);"), ("a.trees.gz", 0, "(1,2);"),
                   ("b.trees", 0, "(1,2);")] or got == sorted(
        [("a.trees.gz", 0, "(1,2);"), ("a.trees.gz", 7, "(3,4);"), ("a.trees.gz", 2, "(5,6);"),
         ("b.trees", 0, "(1,2);")])
    assert files.read_trees(spark, str(tmp_path / "b.trees")).count() == 1
    assert files.read_tree_files(spark, str(tmp_path), min_bytes=2048).count() == 0
    assert files.read_tree_files(spark, str(tmp_path), modified_after="2000-01-01T00:00:00").count() == 4
    assert files.read_tree_files(spark, str(tmp_path), modified_after="2999-01-01T00:00:00").count() == 0


def test_alignments(spark, tmp_path):
    (tmp_path / "gene1.nex").write_text(NEXUS)
    rows = files.read_alignments(spark, str(tmp_path)).orderBy("ix").collect()
    assert [(r.gene, r.ix, r.name, r.seq, r.seq_length) for r in rows] == [
        ("gene1", 1, "Porifera_A_b", "ACD-?F", 6), ("gene1", 2, "Outgroup_C", "ACDEF?", 6),
        ("gene1", 3, "Ctenophora_D", "AAAAAA", 6)]


def test_quartets_and_counts(spark, tmp_path):
    (tmp_path / "q.scf").write_text(
        "ID  Seq1 Seq2 Seq3 Seq4 qCF qCF_N qDF1 qDF1_N qDF2 qDF2_N qN\n"
        "1\t1 2 3 4  50 5 30 3 20 2 10\n2 1 2 3 5 nan 0 x 0 1 0 0\n")
    rows = files.read_quartets(spark, str(tmp_path / "q.scf")).collect()
    assert [(r.Seq4, r.qCF, r.qDF2, r.qN) for r in rows] == [(4, 50.0, 20.0, 10.0)]
    (tmp_path / "s.tsv").write_text("a\t1\t2\t3\t6\nb\t4\t5\t6\t15\n")
    rows = files.read_site_counts(spark, str(tmp_path / "s.tsv")).orderBy("tree_no").collect()
    assert [(r.tree_no, r.top_1, r.nsites) for r in rows] == [(0, 1.0, 6.0), (1, 4.0, 15.0)]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 256 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "256")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_state_is_carried_over_blocks(spark, tmp_path, small_blocks):
    """Header, section and line number of a file are known in each of its blocks."""
    heads = ["ID Seq1 Seq2 Seq3 Seq4 qCF x qDF1 x qDF2 x qN", "ID qN Seq1 Seq2 Seq3 Seq4 qCF qDF1 qDF2"]
    for k, head in enumerate(heads):
        body = [f"{i} {i} 2 3 4 0.5 9 0.3 9 0.2 9 {k}" if k == 0 else f"{i} {k} {i} 2 3 4 0.5 0.3 0.2" for i in range(300)]
        (tmp_path / f"{k}.scf").write_text("\n\n".join([head, *body]) + "\n")
    rows = files.read_quartets(spark, str(tmp_path / "*.scf"))
    assert rows.select("file_path").distinct().count() == 2
    got = {(r.file_path[-5], r.Seq1, r.Seq4, r.qCF, r.qN) for r in rows.collect()}
    assert got == {(str(k), i, 4, 0.5, float(k)) for k in (0, 1) for i in range(300)}

    taxa = [f"T@{i}  AC GT{'A' * (i % 7)}" for i in range(200)]
    (tmp_path / "a.nex").write_text("#NEXUS\n[x;]\nbegin data;\n" + "filler;\n" * 60 + "format;\n Matrix\n" + "\n".join(taxa)
                                    + "\n;\nend;\n" + "late@x ACGT\nmatrix y ACGT\n" * 40)
    (tmp_path / "b.nex").write_text("x\n" * 200 + "MATRIX one AC\ntwo GT; three TT\n" + "four CC\n" * 90)
    (tmp_path / "c.nex").write_text("no section a AC;\n" * 30)
    rows = files.read_alignments(spark, str(tmp_path / "*.nex")).collect()
    a = sorted((r.ix, r.name, r.seq) for r in rows if r.gene == "a")
    assert a == [(i + 1, f"T_{i}", "ACGT" + "A" * (i % 7)) for i in range(200)]
    assert sorted((r.ix, r.name, r.seq) for r in rows if r.gene != "a") == [(1, "one", "AC"), (2, "two", "GT")]

    (tmp_path / "t.trees").write_text("junk\n" + "".join(f"(a:1,(b:{i},c:1):1);\n\nx\n" for i in range(150)))
    trees = files.read_trees(spark, str(tmp_path / "t.trees"), outgroup="b").collect()
    assert {(r.tree_no, r.newick) for r in trees} == {
        (i, f"(b:{i / 2:g},(c:1,a:2):{i / 2:g});") for i in range(150)}


def test_names(spark):
    df = spark.createDataFrame(
        [("t_60_74.5_94.5_LG_PROTCATWAG.ds3.raxml.trees", "250bp_b3_g100"),
         ("t_60_74.5_94.5_WAG_WAG+G.raxml.trees", "500bp")], "f string, d string")
    out = names.data_set(names.run_parameters(names.species_tree(df, "f"), "f"), "d")
    a, b = out.orderBy("sim_model").collect()
    assert (a.stree, a.sim_model, a.infer_model, a.ds_no) == ("t_60_74.5_94.5", "LG", "WAG", 2)
    assert (a.dataset, a.seq_length, a.nblocks, a.ngenes) == ("rec", 250, 3, 100)
    assert (b.infer_model, b.ds_no, b.dataset, b.seq_length) == ("WAG", None, "nonrec", 500)
    assert a.newick == "(4:57.25,(3:74.5,(1:60,2:60):14.5):57.25);"


def test_sinks_guard_and_skip_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", None)], "k int, matrix string, x double")
    path = str(tmp_path / "m")
    sinks.write_matrix(df, path, ["k"])
    with pytest.raises(Exception, match="already exists"):
        sinks.write_matrix(df, path, ["k"])
    sinks.write_matrix(df, path, ["k"], overwrite=True)
    assert dict(spark.read.parquet(path).dtypes)["x"] == "float"
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "a"), ["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    sinks.write_keyed(df, str(tmp_path / "k"))
    one = files.read_keyed(spark, str(tmp_path / "k")).where("matrix = 'b'")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(matrix" in one._jdf.queryExecution().toString()


def test_append_reads_only_files_that_can_hold_a_key(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")

    def batch(names, nulls=0):
        rows = [(n, k, "x") for n in names for k in range(3)] + [(None, k, "x") for k in range(nulls)]
        return spark.createDataFrame(rows, "name string, k int, v string")

    groups = [[f"{c}{i}" for i in range(20)] for c in "abc"] + [["a5x", "c7x"]]  # the last file spans all ranges
    for names in groups:
        sinks.append_new(batch(names).coalesce(1), path, ["name", "k"])
    files_of = {r["f"].replace("file:///", "file:/"): set(r["n"]) for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.collect_set("name").alias("n")).collect()}
    assert len(files_of) == 4
    for names in (["b3"], ["a1", "c19"], ["a5x"], ["zz"], ["b3", "new"]):
        found = sinks.files_with_keys(batch(names), path, ["name", "k"])
        assert {f for f, held in files_of.items() if held & set(names)} == set(found), names  # ranges and filters leave no other
        plan = spark.read.option("basePath", path).parquet(*found) if found else None
        assert plan is None or {f.replace("file:///", "file:/") for f in plan.inputFiles()} == set(found)
    assert spark.read.parquet(path + "/_keys").count() == 4  # each file once
    before = spark.read.parquet(path).count()
    for _ in range(2):
        sinks.append_new(batch(["b3", "new"], nulls=2), path, ["name", "k"])
        assert spark.read.parquet(path).count() == before + 5
    monkeypatch.setattr(sinks, "FEW", 1)  # by range alone
    assert len(sinks.files_with_keys(batch(["b3", "b4"]), path, ["name", "k"])) >= 1
    sinks.append_new(batch(["b3", "newer"], nulls=1), path, ["name", "k"])
    assert spark.read.parquet(path).count() == before + 8
    # a store without an index, or with files that it lacks, is indexed first
    other = str(tmp_path / "o")
    batch(["a", "b"]).write.parquet(other)
    sinks.append_new(batch(["b", "c"]), other, ["name", "k"])
    assert spark.read.parquet(other).count() == 9


def test_totals_write_their_changes_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 3)
    source, target, ckpt = (str(tmp_path / n) for n in ("in", "t", "c"))
    want = {}
    for turn in range(8):
        rows = [(k, turn % 2) for k in range(turn, turn + 4)]
        for r in rows:
            want[r] = want.get(r, 0) + 1
        spark.createDataFrame(rows, "sid int, tid int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("sid int, tid int").parquet(source)
        jobs.store_totals(jobs.running_topology_counts(stream), target, ckpt).awaitTermination()
        got = {(r.sid, r.tid): r.n for r in jobs.latest_totals(spark, target).collect()}
        assert got == want
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(target).groupBy("batch").count().collect()}
    assert all(n == 4 for b, n in sizes.items() if b % 3 != 2)  # the others are full tables
    assert min(sizes) >= 2  # older batches are gone


def test_late_rows_within_the_watermark_count(spark, tmp_path):
    source, target, ckpt = (str(tmp_path / n) for n in ("in", "t", "c"))
    waves = [["10:05", "10:50"], ["12:10", "10:10"], ["10:20", "11:50", "12:20"], ["15:00"], ["12:30", "14:10", "13:59"]]
    for times in waves:
        rows = [(f"2024-01-01 {t}:00",) for t in times]
        df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("t"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("t timestamp").parquet(source)
        jobs.store_totals(jobs.windowed_counts(stream, "t", width="1 hour", late="1 hour"), target, ckpt).awaitTermination()
    got = {r.start.hour: r.n for r in jobs.latest_totals(spark, target).collect()}
    # 10:20 comes when 11:10 is the mark, so its window has ended; 12:30 and 13:59 when it is 14:00
    assert got == {10: 3, 11: 1, 12: 2, 15: 1, 14: 1}


def test_stream_stores_each_tree_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tree = "(4:9.0,(3:5.0,(1:2.0,2:2.5):3.0):4.0);\n"
    (tmp_path / "in" / "a.trees").write_text(tree * 3)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        stream = jobs.tree_file_stream(spark, str(tmp_path / "in"))
        jobs.store_new_trees(stream, out, ckpt).awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 3
    (tmp_path / "in" / "b.trees").write_text(tree)
    rows = run()
    assert rows.count() == 4 and rows.select("tid").distinct().first()[0] == 1
    counts = jobs.running_topology_counts(
        spark.readStream.schema(rows.schema).parquet(out), "file_path")
    jobs.store_totals(counts, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    assert jobs.latest_totals(spark, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 4


def test_a_stored_table_is_read_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_ROWS", 100, raising=False)
    spark.range(1000).write.parquet(str(tmp_path / "a"))
    out = files.read_repartitioned(spark, str(tmp_path / "a"), 2)
    assert out.rdd.getNumPartitions() == 10
    assert out.agg({"id": "sum"}).first()[0] == 499_500 and out.count() == 1000
    assert files.read_repartitioned(spark, str(tmp_path / "a"), 16).rdd.getNumPartitions() == 16


def test_arrived_lines_are_dealt_before_they_are_parsed(spark):
    from cladekit.streaming.jobs import arrived_trees

    line = "(4:9.0,(3:5.0,(1:2.0,2:2.5):3.0):4.0);"
    batch = spark.range(200).selectExpr(f"'{line}' line", "'f' file_path", "0L _block").coalesce(1)
    out = arrived_trees(batch)
    assert out.count() == 200 and out.agg({"tree_no": "max"}).first()[0] == 199
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_quartet_files_in_whole_and_in_blocks(spark, tmp_path, monkeypatch):
    """Small files are read without a shuffle, larger ones by blocks; both give the same rows."""
    heads = ["ID Seq1 Seq2 Seq3 Seq4 qCF qDF1 qDF2 qN", "qN  Seq4 Seq3 Seq2 Seq1 qDF2 qDF1 qCF"]
    for g in range(6):
        body = "\r\n".join(f" 1 {i} 2 3 4 0.5 {'nan-' if i % 7 == 0 else 0.3} 0.2 {g}" for i in range(40 * (g + 1)))
        text = "\n \n" + heads[g % 2] + "\n" + body
        (tmp_path / f"q{g}.scf").write_text("" if g == 5 else text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        found = []
        for limit in (1 << 20, 0, 3000):
            monkeypatch.setattr(files, "WHOLE_BYTES", limit)
            found.append(sorted(map(str, files.read_quartets(spark, str(tmp_path)).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] == found[2]
    assert sum("q0.scf" in r for r in found[0]) == 34 and not any("q5.scf" in r for r in found[0])
    monkeypatch.setattr(files, "WHOLE_BYTES", 1 << 20)
    plan = files.read_quartets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_text_folders_as_partitioned_text(spark, tmp_path):
    from cladekit.sources import sinks

    rows = spark.range(3000).selectExpr("if(id = 7, null, id % 300) as g", "if(id = 9, null, concat('v', id, 'é')) as value", "id").repartition(
        3, "g").sortWithinPartitions("g", "id")
    sinks.write_text_folders(rows, str(tmp_path / "a"), "g")
    rows.drop("id").write.partitionBy("g").text(str(tmp_path / "b"))
    a, b = (sorted((r.p, r.value) for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / k)).selectExpr(
        "value", "regexp_extract(_metadata.file_path, '(g=[^/]*)/', 1) as p").collect()) for k in "ab")
    assert a == b and len(a) == 3000
    names = sorted(f.name for f in (tmp_path / "a").rglob("*") if f.is_file())
    assert len(names) == 301 and all(n.startswith("part-") for n in names)
