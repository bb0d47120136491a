import random

import pytest
from pyspark.sql import functions as F

from cladekit.functions import trees as T


# -- a plain version: nodes are (name, length, children) --------------------------------------------------------------

def read(text):
    """Nested (name, length, children) of a newick text without notes."""
    at = 0

    def node():
        nonlocal at
        children = []
        if text[at] == "(":
            while text[at] in "(,":
                at += 1
                children.append(node())
            at += 1
        start = at
        while text[at] not in "(),;":
            at += 1
        name, _, size = text[start:at].partition(":")
        return [name, float(size or 0), children]

    return node()


def names(node):
    return [node[0]] if not node[2] else [n for c in node[2] for n in names(c)]


def without_single(node):
    while len(node[2]) == 1:
        (child,) = node[2]
        node = [child[0], node[1] + child[1], child[2]]
    return [node[0], node[1], [without_single(c) for c in node[2]]]


def pruned(node, taxa):
    def keep(n):
        if not n[2]:
            return n if n[0] in taxa else None
        kids = [k for k in map(keep, n[2]) if k]
        return [n[0], n[1], kids] if kids else None

    out = without_single(keep(node))
    return [out[0], 0.0 if out[2] else out[1], out[2]]


def rerooted(node, leaf):
    """By walking the branches as a graph from the outgroup."""
    links, number = {}, [0]

    def add(n, up):
        me = number[0]
        number[0] += 1
        label[me] = n[0] if not n[2] else ""
        if up is not None:
            links.setdefault(me, []).append((up, n[1]))
            links.setdefault(up, []).append((me, n[1]))
        for c in n[2]:
            add(c, me)

    label = {}
    add(node, None)
    (tip,) = [k for k, v in label.items() if v == leaf]

    def walk(me, come, size):
        return [label[me], size, [walk(to, me, s) for to, s in links[me] if to != come]]

    (first, size), = links[tip]
    rest = without_single(walk(first, tip, 0.0))
    size += rest[1]
    return ["", 0.0, [[leaf, size / 2, []], [rest[0], size / 2, rest[2]]]]


def clades(node, root=True):
    """Sorted names below every branch with the branch's length."""
    out = [(",".join(sorted(names(node))), round(node[1], 9))]
    return sorted(out + [x for c in node[2] for x in clades(c, False)])


def ordered(node):
    kids = sorted((ordered(c) for c in node[2]), key=lambda c: (len(names(c)), min(names(c))))
    return [node[0], node[1], kids]


def shape(node):
    return "(" + ",".join(map(shape, node[2])) + ")" if node[2] else node[0]


def random_tree(pick, n):
    """A text of n leaves: many shapes, polytomies, zero lengths."""
    parts = [f"t{k}:{pick.choice([0, 1, 2.5, 0.125, 3e-7, 40])}" for k in range(n)]
    pick.shuffle(parts)
    while len(parts) > 1:
        k = min(len(parts), pick.choice([2, 2, 2, 3, 4]))
        at = pick.randrange(len(parts) - k + 1) if pick.random() < 0.6 else 0
        size = f":{pick.choice([0, 1, 0.5, 7])}" if len(parts) > k else ""
        parts[at : at + k] = ["(" + ",".join(parts[at : at + k]) + ")" + size]
    return parts[0] + ";"


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(8)
    return [random_tree(pick, pick.randrange(2, 14)) for _ in range(120)] + ["(t0:1,(t1:2,t2:3):4);", "((t0:1,t1:2):3,t2:4);", "t0:5;"]


def found(df, *columns):
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, newick string").withColumn("t", T.parse("newick"))


def as_clades(value):
    return value if value is None else sorted((r["clade"], round(r["len"], 9)) for r in value)


def test_parsed_edges_and_text(spark, texts):
    got = found(rows(spark, texts), T.clade_rows("t").alias("c"), T.text("t").alias("s"), T.text("t", False).alias("p"))
    for source, (c, s, p) in zip(texts, got, strict=True):
        assert as_clades(c) == clades(read(source))
        assert clades(read(s)) == clades(read(source)) and p == shape(read(source)) + ";"


def test_reroot_on_any_leaf(spark, texts):
    pick = random.Random(3)
    outs = [pick.choice(names(read(t))) for t in texts]
    df = rows(spark, texts).join(spark.createDataFrame(list(enumerate(outs)), "i int, o string"), "i")
    got = found(df.withColumn("r", T.reroot("t", F.col("o"))), T.clade_rows("r").alias("c"), T.text("r").alias("s"))
    for source, o, (c, s) in zip(texts, outs, got, strict=True):
        if "(" not in source:
            assert as_clades(c) == clades(read(source))
            continue
        want = clades(rerooted(read(source), o))
        assert as_clades(c) == want, (source, o)
        assert clades(read(s)) == want and names(read(s))[0] == o
    assert found(rows(spark, texts[:2]).select("i", T.reroot("t", "absent").alias("r")), "r") == [(None,), (None,)]


def test_prune_to_any_taxa(spark, texts):
    pick = random.Random(4)
    keep = [sorted(pick.sample(names(read(t)), pick.randrange(1, len(names(read(t))) + 1))) for t in texts]
    df = rows(spark, texts).join(spark.createDataFrame(list(enumerate(keep)), "i int, k array<string>"), "i")
    got = found(df, T.clade_rows(T.prune("t", F.col("k"))).alias("c"))
    for source, k, (c,) in zip(texts, keep, got, strict=True):
        assert as_clades(c) == clades(pruned(read(source), k)), (source, k)
    one = rows(spark, ["((a:1,b:2):3,(c:4,d:5):6);"])
    assert one.select(T.text(T.prune("t", ["a", "c", "d"], {"a": "x"}))).first()[0] == "(x:4,(c:4,d:5):6);"
    assert one.select(T.prune("t", ["a", "zz"])).first()[0] is None


def test_standard_order(spark, texts):
    got = found(rows(spark, texts), T.text(T.standard("t"), False).alias("s"), T.clade_rows(T.standard("t")).alias("c"))
    for source, (s, c) in zip(texts, got, strict=True):
        assert s == shape(ordered(read(source))) + ";"
        assert as_clades(c) == clades(read(source))


def test_same_clades(spark, texts):
    pick = random.Random(5)

    def shuffled(node):
        kids = [shuffled(c) for c in node[2]]
        pick.shuffle(kids)
        return [node[0], node[1], kids]

    pairs = [(t, shape(shuffled(read(t))) + ";") for t in texts] + [(a, b) for a in texts[:25] for b in texts[:25]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(4)
    for (a, b), (same,) in zip(pairs, found(df, T.same_clades("a", "b").alias("s")), strict=True):
        want = {c for c, _ in clades(read(a)) if "," in c} == {c for c, _ in clades(read(b)) if "," in c} and (
            sorted(names(read(a))) == sorted(names(read(b))))
        assert same == want, (a, b)
    odd = spark.createDataFrame([(0, None, "(a,b);"), (1, ";", ";"), (2, "(a,a,b);", "(b,a,a);"), (3, "((a,b));", "(a,b);")],
                                "i int, a string, b string")
    assert found(odd, T.same_clades("a", "b").alias("s")) == [(None,), (True,), (True,), (True,)]


def test_small_lengths_survive(spark):
    df = spark.createDataFrame([(0, "(a:1e-7,b:123456789.5,c:0.1,d:1E30,e:1.2345678901234566E-9,f:x);")], "i int, newick string")
    assert df.select(T.text(T.parse("newick"))).first()[0] == (
        "(a:0.0000001,b:123456789.5,c:0.1,d:1.0E30,e:1.2345678901234566E-9,f:0);")


def test_steps_run_in_one_pass_over_batches(spark, texts):
    df = rows(spark, texts).select(T.text(T.reroot(T.standard(T.prune(T.parse("newick"), ["t0", "t1"])), "t1")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan


def test_brackets_too_many_and_null(spark):
    odd = [None, "", ";", "(1:1,2:2)):3,4:5;", "((1:1,2:+2):x,3:1_0", "()(1:1d,2:\t2 [n] );", "(\u00e4:1,2:1e1,3):1;"]
    got = found(rows(spark, odd), T.text(T.parse("newick")), T.text(T.standard(T.prune(T.parse("newick"), ["1"]))))
    assert got == [(None, None), (";", None), (";", None), ("(1:1,2:2):0,4:5;", "1:1;"), ("(1:1,2:2):0,3:0;", "1:1;"),
                   ("(1:1,2:2);", "1:1;"), ("(\u00e4:1,2:10,3:0);", None)]


def test_deep_trees_in_parts(spark, monkeypatch):
    from cladekit.functions import forests as B

    deep = "t0:1"
    for k in range(1, 60):
        deep = f"({deep},t{k:02d}:1):1"
    batch = B.pa.array([deep + ";", None, "(b:1,a:2);", deep + ";"])
    whole = B.text(B.standard(B.parse(batch)), True)
    monkeypatch.setattr(B, "PAIRS_AT_ONCE", 16)
    assert B.text(B.standard(B.parse(batch)), True) == whole
    assert whole.to_pylist()[0] == shape_with(ordered(read(deep + ";"))) and whole.to_pylist()[1:3] == [None, "(a:2,b:1);"]


def shape_with(node, root=True):
    size = "" if root else f":{node[1]:g}"
    body = "(" + ",".join(shape_with(c, False) for c in node[2]) + ")" if node[2] else node[0]
    return body + size + (";" if root else "")
