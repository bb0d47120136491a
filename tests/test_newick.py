from cladekit.functions import newick as N
from cladekit.functions import trees as T
from cladekit.operators import quartets as Q

HAND = {
    "(4:9.0,(3:5.0,(1:2.0,2:2.5):3.0):4.0);": ([4.5, 10, 18, 10.5, 18.5, 18], 1),
    "(4:1,(2:2,(1:3,3:4):5):6);": ([10, 7, 15, 11, 9, 16], 2),
    "((2:1,3:1)x:2, (1:4,\n4:1)[note]:3);": ([10, 10, 5, 2, 7, 7], 3),
}


def test_distances_and_topology_of_hand_checked_trees(spark):
    df = spark.createDataFrame([(k,) for k in HAND], "newick string")
    out = N.with_leaves(df).withColumns(N.pair_distances()).withColumn("tid", N.topology_id())
    for r in out.collect():
        want, tid = HAND[r.newick]
        assert [r[k] for k in ("1_2", "1_3", "1_4", "2_3", "2_4", "3_4")] == want
        assert r.tid == tid


def test_zero_branch_keeps_its_split_and_polytomy_is_null(spark):
    df = spark.createDataFrame(
        [("((1:1,2:1):0,3:1,4:2);",), ("(1:1,2:1,3:1,4:1);",), ("(4:1,(1:1,2:1,3:1):1);",),
         ("(1:1,(2:1,4:2):1);",)], "newick string")
    out = N.with_leaves(df).withColumn("tid", N.topology_id()).withColumns(N.pair_distances())
    rows = out.collect()
    assert [r.tid for r in rows] == [1, None, None, None]
    assert rows[3]["1_3"] is None and rows[3]["2_4"] == 3


def test_species_record(spark):
    df = spark.createDataFrame([("(4:9.0,(3:5.0,(1:2.0,2:2.0):3.0):4.0);",)], "newick string")
    r = Q.tree_records(df, species=True).first()
    assert (r.newick, r.tid, r.ebl, r.ibl) == ("(4:6.5,(3:5,(1:2,2:2):3):6.5);", 1, 2.0, 3.0)
    assert r["1_4"] == r["2_4"] and r.pdist[0][3] == r["1_4"] and r.pdist[2][2] == 0
    assert "_l1" not in r.asDict() and "_n12" not in r.asDict()


def test_species_lengths_when_the_cherry_is_not_12(spark):
    df = spark.createDataFrame([("(4:1,(2:2,(1:3,3:4):5):6);",)], "newick string")
    r = Q.tree_records(df, species=True).first()
    assert (r.ebl, r.ibl) == (8.0, 5.0)


def test_covariance_subtree_and_copies(spark):
    df = spark.createDataFrame([("(4:9.0,(3:5.0,(1:2.0,2:2.5):3.0):4.0);",)], "newick string")
    r = N.with_leaves(df).withColumns(N.pair_covariances()).withColumn(
        "s", T.text(T.standard(T.prune(T.parse("newick"), ["2", "3", "4"])), lengths=False)).first()
    assert (r["1_2"], r["1_3"], r["1_4"], r["2_2"]) == (7, 4, 0, 9.5)
    assert r.s == "(4,(2,3));"
    two = spark.createDataFrame([("((a_1_1:1,b_2_1:2):1,a_1_2:5);",)], "newick string").select(
        N.leaf_paths("newick").alias("l"))
    got = two.select(N.single_copy("l").alias("one"), N.last_copies("l").alias("k")).first()
    assert got.one is False
    assert sorted((e.name, e.len) for e in got.k) == [("a", 5.0), ("b", 2.0)]


def test_clades_ignore_leaf_order(spark):
    df = spark.createDataFrame(
        [("((1,2),(3,4));", "((4,3),(2,1));"), ("((1,2),(3,4));", "((1,3),(2,4));")], "a string, b string")
    assert Q.different_share(df, "a", "b").first()[0] == 0.5


def test_quartet_of_a_larger_tree(spark):
    tree = "(((a:1,b:2):3,(c:4,d:5):6):7,(e:8,f:9):10);"
    trees = spark.createDataFrame([("g", tree)], "gene string, newick string")
    q = spark.createDataFrame([("g", "a", "c", "d", "f"), ("g", "a", "b", "zz", "f")],
                              "gene string, q1 string, q2 string, q3 string, q4 string")
    rows = Q.quartet_tree_summary(q, trees, ["q1", "q2", "q3", "q4"]).collect()
    assert len(rows) == 1
    assert rows[0]["1_2"] == 1 + 3 + 6 + 4 and rows[0]["2_3"] == 9 and rows[0].tid == 3
    assert rows[0]["1_4"] == 1 + 3 + 7 + 10 + 9
