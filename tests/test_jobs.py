import random

from pyspark.sql import functions as F

from cladekit import jobs
from cladekit.functions.labels import genome_columns
from cladekit.operators.ranks import hash_key
from cladekit.sources import files

TREE = ("sid int, tree_no int, sim_model string, infer_model string, seq_length int, tid int, "
        "pdist array<array<double>>")
SITE = ("sid int, seq_length int, tree_no int, sim_model string, top_1 double, top_2 double, "
        "top_3 double, nsites double")


def data(spark, recombined=False):
    rng = random.Random(8)
    trees, sites = [], []
    for sid in (1, 2):
        for n in range(60):
            m = [[float(i != j) * rng.randrange(1, 9) for j in range(4)] for i in range(4)]
            model = "LG" if n % 2 else "WAG"
            trees.append((sid, n, model, "PROTCATLG" if n % 4 < 2 else "WAG+G", 500, n % 3 + 1, m))
            if n % 5:
                sites.append((sid, 500, n, model, float(n), 2.0, 3.0, 10.0))
    t = spark.createDataFrame(trees, TREE).withColumn("randomcolumn", hash_key(3, "sid", "tree_no"))
    s = spark.createDataFrame(sites, SITE)
    if recombined:
        t = t.withColumns({"tree_no": F.array("tree_no", "tree_no"), "ds_no": F.lit(1)})
        s = s.withColumns({"tree_no": F.array("tree_no", "tree_no"), "ds_no": F.lit(1)})
    species = spark.createDataFrame([(1, 20.0, 0.5), (2, 40.0, 1.0)], "sid int, ebl double, ibl double")
    return t, s, species


def test_genome_matrix(spark):
    t, s, species = data(spark)
    out = jobs.genome_matrix(t, s, species, genes=10, genomes=3, length=500)
    assert set(out.columns) == {"ebl", "ibl", "dset_no", *genome_columns()}
    rows = out.collect()
    assert len(rows) == 6
    assert all(sum(r[f"counts____{k}"] for k in (1, 2, 3)) == 10 for r in rows)
    assert jobs.genome_matrix(t, s, species, 10, 3, 500, ebl=40.0).select("ebl").distinct().count() == 1
    rt, rs, _ = data(spark, recombined=True)
    mixed = jobs.genome_matrix(t, s, species, 10, 2, 500, rt, rs, share=0.3, blocks=2).collect()
    assert len(mixed) == 4
    assert all(sum(r[f"counts____{k}"] for k in (1, 2, 3)) == 10 for r in mixed)
    assert any(r["top_1__mean__1"] is not None for r in mixed)


def test_other_matrices(spark):
    t, s, species = data(spark)
    by_model = jobs.model_matrices(t, s, species, 5, 2).groupBy("model").count().collect()
    assert {r.model for r in by_model} == {"LG/LG", "LG/WAG", "WAG/LG", "WAG/WAG"}
    train = jobs.training_matrix(t, s, species, 0.5, 3)
    assert train.count() == 6 and set(genome_columns()) <= set(train.columns)


def test_quartets_from_files(spark, tmp_path):
    clades = ["ParaHoxozoa", "Ctenophora", "Porifera", "Outgroup"]
    for g in (1, 2):
        (tmp_path / f"gene_{g}.nex").write_text(
            "#NEXUS\nmatrix\nParaHoxozoa@a AC\nCtenophora@b AC\nPorifera@c CA\nOutgroup@d CA\n"
            "Outgroup@e CA\n;\nend;\n")
        (tmp_path / f"gene_{g}.scf").write_text(
            "ID Seq1 Seq2 Seq3 Seq4 qCF qCF_N qDF1 qDF1_N qDF2 qDF2_N qN\n"
            "1 1 2 3 4 0.5 5 0.3 3 0.2 2 10\n2 2 5 1 3 0.4 4 0.4 4 0.2 2 10\n")
        (tmp_path / f"gene_{g}.LG+F.treefile").write_text(
            "((ParaHoxozoa@a:1,Ctenophora@b:2):3,Porifera@c:4,(Outgroup@d:5,Outgroup@e:6):7);\n")
    q = jobs.quartet_table(spark, str(tmp_path), clades)
    rows = q.where("gene = 'gene_1'").orderBy("Outgroup").collect()
    assert [r.Outgroup for r in rows] == ["Outgroup_d", "Outgroup_e"]
    assert (rows[0].top_1, rows[0].tid, rows[0]["1_2"], rows[0]["3_4"]) == (50.0, 1, 3.0, 16.0)
    assert (rows[1].top_2, rows[1].infer_model, rows[1].seq_length) == (40.0, "LG+F", 2)
    out = jobs.quartet_matrix(q, clades, least=2).collect()
    assert len(out) == 2 and all(r["counts____1"] == 2 for r in out)


def test_large_files_number_lines_like_small_ones(spark, tmp_path):
    lines = [f"({i},{i});" if i % 3 else "junk" for i in range(3000)]
    (tmp_path / "a.trees").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        big = files.read_tree_files(spark, str(tmp_path), large=True)
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct()
        assert blocks.count() > 3
        small = files.read_tree_files(spark, str(tmp_path))
        assert {(r.tree_no, r.newick) for r in big.collect()} == {
            (r.tree_no, r.newick) for r in small.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_genome_rows_over_batches(spark):
    from cladekit.operators.summary import genome_rows

    nan = float("nan")
    values = [("a", 1.0, 1, 2.0), ("a", 1.0, 1, 5.0), ("a", 1.0, 1, None), ("a", 1.0, 2, nan), ("a", 1.0, 2, 1.0), ("a", 1.0, None, 9.0),
              ("b", -0.0, 3, 4.0), ("b", 0.0, 3, 4.0), ("b", None, 3, 4.0), *[("c", 0.0, 1, float(k)) for k in range(40)]]
    df = spark.createDataFrame(values, "k string, e double, tid int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = genome_rows(df, ["k", "e"], ["x"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in plan and sorted(got) == ["a", "b", "c"]
    a, b, c = (got[k] for k in "abc")
    assert (a["x__mean__1"], a["x__std__1"], a["x__min__1"], a["x__max__1"], a["x__median__1"], a["counts____1"]) == (3.5, 1.5, 2.0, 5.0, 3.5, 3)
    assert a["x__min__2"] == 1.0 and a["x__max__2"] != a["x__max__2"] and a["counts____2"] == 2
    assert a["x__mean__3"] is None and a["counts____3"] == 0
    assert (b["counts____3"], b["x__median__3"], b["x__std__3"]) == (2, 4.0, 0.0)
    assert (c["counts____1"], c["x__median__1"], c["x__mean__1"], c["x__max__1"]) == (40, 19.5, 19.5, 39.0)


def test_groups_of_one_row_or_more_need_no_count(spark):
    from cladekit.operators.relational import where_group_size

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2)], "k string, v int")
    out = where_group_size(df, ["k", "v"], 1)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("a", 1), ("a", 1)]
    assert where_group_size(df, ["k", "v"], 2).count() == 2
    assert where_group_size(spark.createDataFrame([(float("nan"),), (None,)], "x double"), ["x"], 1).count() == 1


def test_training_rows_are_stored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    trees = spark.range(40).selectExpr(
        "id % 2 sid", "id tree_no", "'LG' sim_model", "'LG' infer_model", "500 seq_length", "1 tid",
        "array_repeat(array_repeat(id * 1D, 4), 4) pdist", "md5(string(id)) randomcolumn")
    sites = trees.select("sid", "seq_length", "tree_no", "sim_model", *[F.lit(1.0).alias(c) for c in ("top_1", "top_2", "top_3", "nsites")])
    species = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0)], "sid long, ebl double, ibl double")
    out = jobs.training_matrix(trees, sites, species, 1.0, 2)
    assert "training-" in out.inputFiles()[0]
    assert sorted((r.ebl, r.dset_no, r.counts____1) for r in out.collect()) == [(1.0, 1, 20), (1.0, 2, 20), (2.0, 1, 20), (2.0, 2, 20)]


def test_model_matrices_move_rows_three_times(spark):
    """The genomes stay where the rows met their species trees; the rows are those of the steps taken one after another."""
    from cladekit.functions.labels import genome_features
    from cladekit.operators.relational import trees_with_sites
    from cladekit.operators.sampling import shuffled_genomes
    from cladekit.operators.summary import genome_rows

    t, s, species = data(spark)
    t, s = t.unionByName(t.where("tree_no < 3")), s.unionByName(s.where("tree_no = 7"))  # some come twice
    species = species.unionByName(spark.createDataFrame([(1, 30.0, 0.7), (None, 1.0, 1.0)], species.schema))
    t = t.unionByName(t.where("tree_no = 1").withColumn("sid", F.lit(None).cast("int")))
    names = F.array_compact(F.array(*[F.when(F.col("infer_model").contains(m), F.concat_ws("/", "sim_model", F.lit(m))) for m in ("LG", "WAG")]))
    drawn = shuffled_genomes(t.withColumn("model", F.explode(names)), ["sid", "model"], 5, "randomcolumn", ["tree_no"], limit=10)
    rows = trees_with_sites(drawn, s, ["sid", "seq_length", "tree_no", "sim_model"], matched_model=False)
    want = genome_rows(jobs.flattened(rows).join(species, "sid"), ["sid", "model", *jobs.KEYS], genome_features()).drop("sid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jobs.model_matrices(t, s, species, 5, 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 5  # the rows thrice, sites and species once
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    order = sorted(want.columns)
    assert set(order) == set(out.columns)
    shown = [sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in (r[c] for c in order)]) for r in rows) for rows in (got, want.collect())]
    assert shown[0] == shown[1] and len(got) > 12
