import random

from pyspark.sql import functions as F

from cladekit.functions.labels import genome_columns, pair_labels
from cladekit.operators import permute as P
from cladekit.operators import quartets as Q
from cladekit.operators import summary as G


def sites(a, b, c, d):
    n = [0, 0, 0]
    for w, x, y, z in zip(a, b, c, d):
        if {w, x, y, z} & set("-?"):
            continue
        n[0] += w == x and y == z and w != y
        n[1] += w == y and x == z and w != x
        n[2] += w == z and x == y and w != x
    return n


def test_site_concordance_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(Q, "SITES_PER_BLOCK", 16)
    rng = random.Random(1)
    rows = [(i, *["".join(rng.choice("AC-?é") for _ in range(n + rng.randrange(3))) for _ in range(4)])
            for i, n in enumerate((0, 1, 15, 16, 17, 90))]
    df = spark.createDataFrame(rows, "q int, s1 string, s2 string, s3 string, s4 string")
    got = {r.q: r for r in Q.site_concordance(df, ["q"]).collect()}
    assert len(got) == len(rows)
    for q, *seqs in rows:
        want = sites(*seqs)
        r = got[q]
        assert [r.qCF_N, r.qDF1_N, r.qDF2_N] == want and r.qN == sum(want)
        assert r.qCF is None if not sum(want) else abs(r.qCF - 100 * want[0] / sum(want)) < 1e-9


def test_labels_swapped_twice_come_back(spark):
    cols = genome_columns()
    df = spark.createDataFrame([(k, *[float(i + 1000 * k) for i in range(len(cols))]) for k in range(4)],
                               ["k", *cols])
    df = df.withColumn("k", F.col("k").cast("int"))
    twice = P.permuted(P.permuted(df, "k"), "k")
    assert sorted(twice.collect()) == sorted(df.collect())
    one = P.permuted(df, F.lit(2)).where("k = 0").first()
    src = df.where("k = 0").first()
    assert one["1_2__mean__1"] == src["2_3__mean__3"] and one["top_1__max__2"] == src["top_3__max__2"]
    assert one["counts____1"] == src["counts____3"] and one["nsites__std__1"] == src["nsites__std__3"]
    assert len(cols) == 168 and pair_labels() == ["1_2", "1_3", "2_3", "1_4", "2_4", "3_4"]


def test_species_topology_follows_the_swap(spark):
    df = spark.createDataFrame([(k,) for k in range(4)], "k int")
    got = [r.s for r in df.select("k", P.species_label(F.col("k")).alias("s")).orderBy("k").collect()]
    assert got == [0, 0, 2, 1]


def test_named_quartets_need_one_taxon_per_clade(spark):
    clades = ["ParaHoxozoa", "Ctenophora", "Porifera", "Outgroup"]
    taxa = spark.createDataFrame(
        [("g", i, n) for i, n in enumerate(
            ["ParaHoxozoa_a", "Ctenophora_b", "Porifera_c", "Outgroup_d", "Porifera_e"], 1)],
        "gene string, ix int, name string")
    q = spark.createDataFrame(
        [("g", 1, 2, 3, 4, 60.0, 30.0, 10.0), ("g", 4, 2, 5, 1, 50.0, 40.0, 10.0),
         ("g", 1, 3, 5, 4, 1.0, 2.0, 3.0), ("g", 2, 3, 1, 4, 70.0, 20.0, 10.0)],
        "gene string, Seq1 int, Seq2 int, Seq3 int, Seq4 int, qCF double, qDF1 double, qDF2 double")
    out = Q.sorted_taxa(Q.remapped_sites(Q.named_quartets(q, taxa, clades)), clades).collect()
    got = {r.order: r for r in out}
    assert set(got) == {"1234", "2413", "2314"} and len(out) == 3
    assert (got["2413"].qCF, got["2413"].qDF1, got["2413"].Porifera) == (40.0, 50.0, "Porifera_e")
    assert (got["2314"].qCF, got["2314"].qDF1, got["2314"].qDF2) == (20.0, 10.0, 70.0)


def test_genome_rows_skip_null_and_fill_missing_topologies(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0), (1, 1, None), (1, 1, 4.0), (1, 2, 5.0)], "g int, tid int, x double")
    r = G.genome_rows(df, ["g"], ["x"]).first()
    assert (r["x__mean__1"], r["x__std__1"], r["x__median__1"], r["counts____1"]) == (3.0, 1.0, 3.0, 3)
    assert (r["x__std__2"], r["x__mean__3"], r["counts____3"]) == (0.0, None, 0)
    big = G.quartet_genome_rows(df, ["g"], ["x"], 4).first()
    assert {k: big[k] for k in r.asDict()} == r.asDict()
    assert G.quartet_genome_rows(df, ["g"], ["x"], 5).count() == 0


def test_repeated_rows_and_missing_keys(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 2, 0.5), (1, 1, 9, 0.5), (2, 3, 3, 1.0)], "g int, a int, b int, w double")
    names = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "z"), (2, 1, "q")], "g int, ix int, name string")
    out = Q.attach_each(rows, names, "g", "ix", "name", ["a", "b"], ["na", "nb"])
    assert sorted((r.g, r.na, r.nb, r.w) for r in out.collect()) == [(1, "x", "y", 0.5), (1, "x", "y", 0.5), (2, "z", "z", 1.0)]


def test_a_generated_source_is_joined_by_its_measured_size(spark):
    """Names made by a generator look small to the planner; they are not broadcast when they are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        genes = spark.range(40).select(F.col("id").alias("gene"))
        taxa = genes.select("gene", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("ix")).withColumn(
            "name", F.concat(F.lit("taxon"), F.col("ix").cast("string")))
        rows = genes.select("gene", F.lit(3).alias("a"), F.lit(1000).alias("b"))
        out = Q.attach_each(rows, taxa, "gene", "ix", "name", ["a", "b"], ["x", "y"])
        assert {(r.x, r.y) for r in out.collect()} == {("taxon3", "taxon1000")}
        assert out.count() == 40
        plan = out._jdf.queryExecution()
        out._jdf.collectToPython()
        final = plan.executedPlan().toString().split("Initial Plan")[0]
        assert "BuildRight" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_groups_give_the_rows_of_small_ones(spark, monkeypatch):
    """Groups that are never brought together have the same statistics, whatever the sketch says of their middle."""
    from cladekit.operators import ranks

    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [("c", 1, 7.0, None), ("c", 9, 8.0, 1.0), (None, 1, 3.0, 3.0), *[("e", 2, nan, inf)] * 5, ("e", 3, -inf, 1.0), ("f", None, 1.0, 2.0)]
    for g, n in (("a", 401), ("b", 400), ("d", 30)):
        rows += [(g, rng.choice((1, 2, 3, None)), rng.choice((None, nan, *[float(k) for k in range(9)])), rng.gauss(0, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, tid int, x double, y double").repartition(3)
    want = {r.g: r for r in G.genome_rows(df, ["g"], ["x", "y"]).collect()}
    assert G.quartet_genome_rows(df, ["g"], ["x", "y"], 1).count() == len(want) == 6

    def compare():
        got = {r.g: r for r in G.quartet_genome_rows(df, ["g"], ["x", "y"], 1).collect()}
        assert set(got) == set(want)
        for g, r in want.items():
            for c, v in r.asDict().items():
                w = got[g][c]
                assert w == v or (w != w and v != v) or abs(w - v) < 1e-9, (g, c, w, v)

    for least in (100, 1):
        monkeypatch.setattr(ranks, "SPLIT_ROWS", least)
        compare()
    monkeypatch.setattr(G, "MIDDLE", 0.0)
    compare()
    monkeypatch.setattr(G, "MIDDLE", -0.3)  # a wrong sketch
    compare()


def test_stored_names_are_joined_like_others(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 2, 0.5), (1, 1, 9, 0.5), (2, 3, 3, 1.0), (3, 1, 2, 0.1), (None, 1, 2, 0.2)],
                                 "g int, a int, b int, w double")
    names = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "z"), (2, 1, "q"), (3, 1, "u"), (3, 1, "v"), (3, 2, None), (None, 1, "n")],
                                  "g int, ix int, name string")
    names.write.parquet(str(tmp_path / "names"))
    plain, stored = (sorted(map(str, Q.attach_each(rows, names, "g", "ix", "name", ["a", "b"], ["na", "nb"], s).collect())) for s in (False, True))
    assert plain == stored and len(stored) == 5
    kept = spark.read.parquet(str(tmp_path / "names"))
    out = Q.attach_each(rows, kept, "g", "ix", "name", ["a", "b"], ["na", "nb"], True)
    assert sorted(map(str, out.collect())) == plain
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_names_from_a_generator_are_never_broadcast(spark):
    """The planner takes them for a small table, and keeps a broadcast it has planned whatever their rows turn out to be."""
    genes = spark.range(300).select(F.col("id").alias("gene"))
    rows = genes.select("gene", F.lit(1).alias("a"), F.lit(40).alias("b"), (F.col("gene") % 7).alias("q"))
    taxa = genes.select("gene", F.inline(F.transform(
        F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(i.alias("ix"), F.concat(F.lit("taxon_" * 20), i.cast("string")).alias("name")))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # below the 12,000 rows of names, above the guess
    try:
        out = Q.attach_each(rows, taxa, "gene", "ix", "name", ["a", "b"], ["x", "y"])
        got = out.collect()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 300 and {(r.x[-2:], r.y[-3:]) for r in got} == {("_1", "_40")}
