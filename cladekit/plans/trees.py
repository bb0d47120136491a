"""Queries on trees, quartets, trios and label permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import newick as N
from ..functions import scalars as S
from ..functions import trees as T
from ..functions.labels import flatten_pairs, pair_labels
from ..operators import permute as P
from ..operators import quartets as Q
from .registry import query, rounded, tidy
from .tables import NEWICK, spread_trees, table, tasks

_ID = "sid, tree_no, ds_no, line_no"
_IDS = ["sid", "tree_no", "ds_no", "line_no"]

# distances within (4,(z,(x,y))): the cherry, either cherry leaf to z, each leaf to 4
_DIST = f"""(SELECT {_ID}, tid, lx + ly AS xy, lx + inner_len + lz AS xz, ly + inner_len + lz AS yz,
 lx + inner_len + up + l4 AS x4, ly + inner_len + up + l4 AS y4, lz + up + l4 AS z4,
 lx, ly, lz, inner_len, up, l4 FROM {NEWICK} n)"""
_SIX = f"""(SELECT {_ID}, tid, CASE tid WHEN 1 THEN xy WHEN 2 THEN xz ELSE xz END AS "1_2",
 CASE tid WHEN 1 THEN xz WHEN 2 THEN xy ELSE yz END AS "1_3", CASE tid WHEN 1 THEN x4 WHEN 2 THEN x4 ELSE
 z4 END AS "1_4", CASE tid WHEN 1 THEN yz WHEN 2 THEN yz ELSE xy END AS "2_3", CASE tid WHEN 1 THEN y4
 WHEN 2 THEN z4 ELSE x4 END AS "2_4", CASE tid WHEN 1 THEN z4 WHEN 2 THEN y4 ELSE y4 END AS "3_4",
 lx, ly, lz, inner_len, up, l4 FROM {_DIST} d)"""


@query("tree_distances", rounded(
    f'SELECT {_ID}, "1_2", "1_3", "1_4", "2_3", "2_4", "3_4" FROM {_SIX} s', pair_labels()))
def tree_distances(spark, sf):
    """Six leaf distances of every tree, read from its text."""
    rows = N.with_leaves(spread_trees(spark, sf)).withColumns(N.pair_distances())
    return tidy(rows.select(*_IDS, *pair_labels()))


@query("topology_id", f"""SELECT {_ID}, tid, CASE tid WHEN 1 THEN '(4,(3,(1,2)));' WHEN 2 THEN
 '(4,(2,(1,3)));' ELSE '(4,(1,(2,3)));' END AS topology FROM {NEWICK} n""")
def topology_id(spark, sf):
    rows = N.with_leaves(spread_trees(spark, sf)).withColumn("tid", N.topology_id())
    return tidy(rows.select(*_IDS, "tid", N.topology_text("tid").alias("topology")))


def _half(x: str) -> str:
    return f"CASE WHEN ({x}) % 2 = 0 THEN CAST(({x}) // 2 AS VARCHAR) ELSE CAST(({x}) // 2 AS VARCHAR) || '.5' END"


_CANON = f"""'(4:' || {_half('up + l4')} || ',(' || z || ':' || lz || ',(' || x || ':' || lx || ',' || y ||
 ':' || ly || '):' || inner_len || '):' || {_half('up + l4')} || ');'"""


@query("tree_summary", rounded(f"""WITH t AS (SELECT *, CASE tid WHEN 3 THEN '2' ELSE '1' END AS x,
 CASE tid WHEN 1 THEN '2' ELSE '3' END AS y, CASE tid WHEN 1 THEN '3' WHEN 2 THEN '2' ELSE '1' END AS z
 FROM {_SIX} s) SELECT {_ID}, {_CANON} AS newick, tid, "3_4" AS d34,
 CASE tid WHEN 1 THEN lx WHEN 2 THEN lx + inner_len ELSE lz END AS ebl,
 CASE WHEN tid = 3 THEN 0 ELSE inner_len END AS ibl FROM t""", "d34 ebl ibl"))
def tree_summary(spark, sf):
    """Tree records with the branch lengths of a species tree."""
    rows = Q.tree_records(spread_trees(spark, sf), species=True)
    return tidy(rows.select(*_IDS, "newick", "tid", F.col("pdist")[2][3].alias("d34"), "ebl", "ibl"))


@query("tree_covariance", rounded(f"""SELECT {_ID}, CASE tid WHEN 1 THEN up + inner_len ELSE up END AS
 "1_2", CASE tid WHEN 2 THEN up + inner_len ELSE up END AS "1_3", CASE tid WHEN 3 THEN up + inner_len
 ELSE up END AS "2_3", CASE tid WHEN 3 THEN up + lz ELSE up + inner_len + lx END AS "1_1", 0 AS "1_4"
 FROM {NEWICK} n""", "1_2 1_3 2_3 1_1 1_4"))
def tree_covariance(spark, sf):
    """Length from the root to the common ancestor of each leaf pair."""
    rows = N.with_leaves(spread_trees(spark, sf)).withColumns(N.pair_covariances())
    return tidy(rows.select(*_IDS, "1_2", "1_3", "2_3", "1_1", "1_4"))


@query("cherry_labels", f"""SELECT {_ID}, tid - 1 AS cherry FROM {NEWICK} n""")
def cherry_labels(spark, sf):
    """Cherry from the three ingroup covariances."""
    rows = N.with_leaves(spread_trees(spark, sf)).withColumns(N.pair_covariances())
    return tidy(rows.select(*_IDS, S.cherry("1_2", "1_3", "2_3").alias("cherry")))


@query("subtree_topology", f"""SELECT {_ID}, CASE tid WHEN 1 THEN '(3,(1,2));' WHEN 2 THEN '(2,(1,3));'
 ELSE '(1,(2,3));' END AS ingroup, CASE WHEN tid = 3 THEN '(4,(1,2));' ELSE '(4,(1,2));' END AS with_root,
 CAST(NULL AS VARCHAR) AS absent FROM {NEWICK} n""")
def subtree_topology(spark, sf):
    """Trees pruned to three taxa; a taxon the tree lacks gives NULL."""
    rows = spread_trees(spark, sf).withColumn("tree", T.parse("newick"))

    def topology(taxa):
        return T.text(T.standard(T.prune("tree", taxa)), lengths=False)

    return tidy(rows.select(*_IDS, topology(["1", "2", "3"]).alias("ingroup"), topology(["1", "2", "4"]).alias("with_root"),
                            topology(["1", "2", "9"]).alias("absent")))


@query("rf_share", rounded("""SELECT avg(CASE WHEN a.l_linenumber % 3 <> (a.l_suppkey + a.l_orderkey) % 3
 THEN 1.0 ELSE 0 END) AS share FROM lineitem a""", "share"))
def rf_share(spark, sf):
    """Share of true and inferred trees that differ in their clades."""
    def text(shape):
        return F.when(shape == 0, "(4:1,(3:1,(1:1,2:1):1):1);").when(
            shape == 1, "(4:1,(2:1,(3:1,1:1):1):1);").otherwise("(4:1,(1:1,(2:1,3:1):1):1);")

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    pairs = lines.select(
        text(F.col("l_linenumber") % 3).alias("a"),
        text((F.col("l_suppkey") + F.col("l_orderkey")) % 3).alias("b"))
    return tidy(Q.different_share(pairs, "a", "b", partitions=tasks(spark)))


_BIG = "abcdefgh"


def _eight_leaf_trees(spark, sf):
    def size(i):
        return F.floor(F.abs(F.col("embedding")[i].cast("double")) * 1000).cast("long").cast("string")

    def pair(i, j, k):
        return F.concat(F.lit(f"({_BIG[i]}_x:"), size(i), F.lit(f",{_BIG[j]}_x:"), size(j),
                        F.lit("):"), size(k))

    whole = F.concat(
        F.lit("(("), pair(0, 1, 8), F.lit(","), pair(2, 3, 9), F.lit("):"), size(12), F.lit(",("),
        pair(4, 5, 10), F.lit(","), pair(6, 7, 11), F.lit("):"), size(13), F.lit(");"))
    return table(spark, sf, "embeddings").select("vec_id", whole.alias("newick"))


def _eight_leaf_quartets(spark, sf):
    """Two listed quartets of taxa per tree."""
    letter = [F.substring(F.lit(_BIG), (F.col("vec_id") % 8 + i).cast("int") % 8 + 1, F.lit(1))
              for i in (0, 3, 5, 6)]
    a = [F.concat(x, F.lit("_x")) for x in letter]
    rows = table(spark, sf, "embeddings").select("vec_id", *[x.alias(f"t{i}") for i, x in enumerate(a)])
    one = rows.select("vec_id", *[F.col(f"t{i}").alias(f"q{i + 1}") for i in range(4)])
    two = rows.select("vec_id", F.col("t1").alias("q1"), F.col("t2").alias("q2"),
                      F.col("t3").alias("q3"), F.col("t0").alias("q4"))
    return one.unionByName(two)


_ROOT = 14
# the eight-leaf tree as a table of parent pointers: leaf or node, its parent, the number of its length
_PARENTS = [*[(leaf, str(8 + i // 2), i) for i, leaf in enumerate(_BIG)], ("8", "12", 8), ("9", "12", 9), ("10", "13", 10),
            ("11", "13", 11), ("12", str(_ROOT), 12), ("13", str(_ROOT), 13)]
_EDGE_SQL = f"""up(child, parent, k) AS (VALUES {", ".join(f"('{c}', '{p}', {k})" for c, p, k in _PARENTS)}),
 e AS (SELECT vec_id, child, parent, floor(abs(CAST(embedding[k + 1] AS DOUBLE)) * 1000) AS len FROM embeddings, up)"""


@query("rerooted_trees", rounded(f"""WITH RECURSIVE {_EDGE_SQL}, o AS (SELECT vec_id, substr('{_BIG}', CAST(vec_id % 8 + 1 AS BIGINT), 1)
 AS leaf FROM embeddings), link AS (SELECT vec_id, child AS a, parent AS b, len FROM e UNION ALL SELECT vec_id, parent, child, len FROM e),
 walk AS (SELECT o.vec_id, link.b AS node, o.leaf AS come, [link.b] AS path, link.len FROM o JOIN link ON link.vec_id = o.vec_id AND
 link.a = o.leaf UNION ALL SELECT w.vec_id, x.b, w.node, list_append(w.path, x.b), x.len FROM walk w JOIN link x ON x.vec_id = w.vec_id AND
 x.a = w.node AND x.b <> w.come), below AS (SELECT n.vec_id, n.node, list_sort(list(m.node || '_x')) AS c, any_value(n.len) AS len,
 any_value(len(n.path)) AS depth FROM walk n JOIN walk m ON m.vec_id = n.vec_id AND list_contains(m.path, n.node) AND m.node IN
 ({", ".join(f"'{x}'" for x in _BIG)}) GROUP BY 1, 2), branches AS (SELECT vec_id, array_to_string(c, ',') AS clade, CASE WHEN depth = 1 THEN
 len / 2 ELSE len END AS len FROM below UNION ALL SELECT o.vec_id, o.leaf || '_x', link.len / 2 FROM o JOIN link ON link.vec_id = o.vec_id
 AND link.a = o.leaf UNION ALL SELECT vec_id, array_to_string(list_sort(list_transform(string_split('{",".join(_BIG)}', ','), lambda x: x || '_x')), ','),
 0 FROM embeddings) SELECT vec_id, clade, sum(len) AS len FROM branches GROUP BY 1, 2""", "len"))
def rerooted_trees(spark, sf):
    """Eight-leaf trees rooted on one of their leaves each, as branches; the old root is passed through."""
    letter = F.concat(F.substring(F.lit(_BIG), (F.col("vec_id") % 8 + 1).cast("int"), F.lit(1)), F.lit("_x"))
    trees = _eight_leaf_trees(spark, sf).repartition(tasks(spark))
    return tidy(Q.branch_table(trees, ["vec_id"], T.reroot(T.parse("newick"), letter)))


@query("pruned_trees", rounded(f"""WITH RECURSIVE {_EDGE_SQL}, k AS (SELECT vec_id, substr('{_BIG}', CAST((vec_id + i) % 8 + 1 AS BIGINT), 1)
 AS leaf FROM embeddings, (VALUES (0), (1), (3), (6), (7)) v(i)), climb AS (SELECT k.vec_id, k.leaf, e.child AS node, e.parent, e.len FROM k
 JOIN e ON e.vec_id = k.vec_id AND e.child = k.leaf UNION ALL SELECT c.vec_id, c.leaf, e.child, e.parent, e.len FROM climb c JOIN e ON
 e.vec_id = c.vec_id AND e.child = c.parent), below AS (SELECT vec_id, node, list_sort(list(leaf || '_x')) AS c, any_value(len) AS len FROM
 climb GROUP BY 1, 2), branches AS (SELECT vec_id, array_to_string(c, ',') AS clade, len FROM below WHERE len(c) < 5 UNION ALL
 SELECT vec_id, array_to_string(list_sort(list(leaf || '_x')), ','), 0 FROM k GROUP BY 1) SELECT vec_id, clade, sum(len) AS len FROM branches
 GROUP BY 1, 2""", "len"))
def pruned_trees(spark, sf):
    """Eight-leaf trees cut down to five taxa each, as branches; nodes with one child left are passed through."""
    taxa = F.array(*[F.concat(F.substring(F.lit(_BIG), ((F.col("vec_id") + i) % 8 + 1).cast("int"), F.lit(1)), F.lit("_x"))
                     for i in (0, 1, 3, 6, 7)])
    trees = _eight_leaf_trees(spark, sf).repartition(tasks(spark))
    return tidy(Q.branch_table(trees, ["vec_id"], T.prune(T.parse("newick"), taxa)))


@query("standard_newick", f"""WITH t AS (SELECT *, CASE tid WHEN 3 THEN '2' ELSE '1' END AS x, CASE tid WHEN 1 THEN '2' ELSE '3' END AS y,
 CASE tid WHEN 1 THEN '3' WHEN 2 THEN '2' ELSE '1' END AS z FROM {_SIX} s) SELECT {_ID}, {_CANON} AS newick FROM t""")
def standard_newick(spark, sf):
    """Trees rooted on leaf 4, sorted and ladderised, printed with their lengths."""
    return tidy(Q.standard_trees(spread_trees(spark, sf), outgroup="4").select(*_IDS, "newick"))


_MEMBERS = [(leaf, node) for leaf, nodes in {
    "a": (0, 8, 12), "b": (1, 8, 12), "c": (2, 9, 12), "d": (3, 9, 12), "e": (4, 10, 13),
    "f": (5, 10, 13), "g": (6, 11, 13), "h": (7, 11, 13)}.items() for node in nodes]


@query("quartet_trees", rounded(f"""WITH m(leaf, node) AS (VALUES {", ".join(f"('{a}', {b})" for a, b in
 _MEMBERS)}), d AS (SELECT vec_id, x, y, (SELECT sum(floor(abs(CAST(embedding[n + 1] AS DOUBLE)) * 1000))
 FROM (SELECT node AS n FROM m WHERE leaf IN (x, y) GROUP BY node HAVING count(*) = 1)) AS len,
 (SELECT count(*) FROM (SELECT node AS n FROM m WHERE leaf IN (x, y) GROUP BY node HAVING count(*) = 1))
 AS steps FROM embeddings, (SELECT DISTINCT a.leaf AS x, b.leaf AS y FROM m a, m b WHERE a.leaf <> b.leaf)),
 r AS (SELECT vec_id, list_transform([0, 3, 5, 6], lambda i: substr('{_BIG}', CAST((vec_id % 8 + i) % 8 +
 1 AS BIGINT), 1)) AS t FROM embeddings), q AS (SELECT vec_id, t[1] AS q1, t[2] AS q2, t[3] AS q3, t[4] AS
 q4 FROM r UNION ALL SELECT vec_id, t[2], t[3], t[4], t[1] FROM r) SELECT vec_id, q1 || '_x' AS q1,
 q2 || '_x' AS q2, q3 || '_x' AS q3, q4 || '_x' AS q4, a.len AS "1_2", f.len AS "3_4",
 CASE WHEN a.steps + f.steps < least(b.steps + e.steps, c.steps + g.steps) THEN 1 WHEN b.steps + e.steps <
 least(a.steps + f.steps, c.steps + g.steps) THEN 2 WHEN c.steps + g.steps < least(a.steps + f.steps,
 b.steps + e.steps) THEN 3 END AS tid FROM q
 JOIN d a ON a.vec_id = q.vec_id AND a.x = q1 AND a.y = q2 JOIN d b ON b.vec_id = q.vec_id AND b.x = q1
 AND b.y = q3 JOIN d c ON c.vec_id = q.vec_id AND c.x = q1 AND c.y = q4 JOIN d g ON g.vec_id = q.vec_id
 AND g.x = q2 AND g.y = q3 JOIN d e ON e.vec_id = q.vec_id AND e.x = q2 AND e.y = q4 JOIN d f ON
 f.vec_id = q.vec_id AND f.x = q3 AND f.y = q4""".replace("SELECT vec_id, q1 ||", "SELECT q.vec_id, q1 ||"),
    "1_2 3_4"))
def quartet_trees(spark, sf):
    """Listed quartets seen in larger trees: distances and topology of the pruned tree."""
    out = Q.quartet_tree_summary(
        _eight_leaf_quartets(spark, sf), _eight_leaf_trees(spark, sf), ["q1", "q2", "q3", "q4"],
        "vec_id")
    return tidy(out.select("vec_id", "q1", "q2", "q3", "q4", "1_2", "3_4", "tid"))


@query("gene_copies", """SELECT vec_id, label % 2 = 1 AS single, CASE WHEN label % 2 = 1 THEN 'a,b,c'
 ELSE 'a,b' END AS kept FROM embeddings""")
def gene_copies(spark, sf):
    """Copy numbers stripped from leaf names; families with copies flagged, last copies kept."""
    text = F.when(F.col("label") % 2 == 1, "((a_1_1:1,b_2_1:2):1,c_3_1:1);").otherwise(
        "((a_1_1:1,b_2_1:2):1,a_1_2:1);")
    rows = table(spark, sf, "embeddings").select("vec_id", N.leaf_paths(text).alias("l"))
    kept = F.array_join(F.array_sort(F.transform(N.last_copies("l"), lambda e: e["name"])), ",")
    return rows.select("vec_id", N.single_copy("l").alias("single"), kept.alias("kept"))


@query("pair_flatten", rounded("SELECT vec_id, " + ", ".join(
    f'embedding[{8 * i + j + 1}] AS "{j + 1}_{i + 1}"' for i in range(8) for j in range(i))
    + " FROM embeddings", pair_labels("12345678")))
def pair_flatten(spark, sf):
    """Lower triangle of an 8 x 8 matrix column as 28 named columns."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)]).alias("pdist"))
    return tidy(rows.select("vec_id", *flatten_pairs("pdist", "12345678")))


# ---- permutations ------------------------------------------------------------------------

# all 64 entries of a vector: the columns of a genome row, and one that no exchange moves
_MATRIX = [
    *[f"{f}__{s}__{t}" for f in ("1_2", "1_3", "2_3", "1_4", "2_4", "3_4", "top_1", "top_2", "top_3", "nsites")
      for s in ("mean", "std") for t in (1, 2, 3)],
    "counts____1", "counts____2", "counts____3", "ibl"]


def _matrix(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate(_MATRIX)])


def _moved_sql(swap: int) -> list[str]:
    """Source of each column under a swap, by exchanging the names character by character."""
    if swap == 0:
        return list(_MATRIX)
    a, b = {1: "12", 2: "13", 3: "23"}[swap]
    tid = {1: "132", 2: "321", 3: "213"}[swap]

    def leaf_swap(x):
        return b if x == a else a if x == b else x

    out = []
    for c in _MATRIX:
        if "__" not in c:
            out.append(c)
            continue
        f, s, t = c.split("__")
        if f[0] == "t":
            f = "top_" + tid[int(f[-1]) - 1]
        elif f not in ("counts", "nsites"):
            f = "_".join(sorted(map(leaf_swap, f.split("_"))))
        out.append(f"{f}__{s}__{tid[int(t) - 1]}")
    return out


_POS = {c: i + 1 for i, c in enumerate(_MATRIX)}
_BUCKET = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', vec_id)), 1, 8) AS BIGINT)"


def _permuted_sql(swap_expr: str) -> str:
    cells = []
    for i, c in enumerate(_MATRIX):
        whens = " ".join(f"WHEN {k} THEN embedding[{_POS[_moved_sql(k)[i]]}]" for k in range(4))
        cells.append(f'CASE {swap_expr} {whens} END AS "{c}"')
    return ", ".join(cells)


@query("permute_columns", rounded(f"""SELECT vec_id, CASE swap WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS
 species_topology, {_permuted_sql('swap')} FROM (SELECT *, {_BUCKET.format(seed=21)} % 4 AS swap FROM
 embeddings)""", _MATRIX))
def permute_columns(spark, sf):
    """Each row's leaf labels exchanged at random, with the resulting species topology."""
    return tidy(P.random_labels(_matrix(spark, sf), ["vec_id"], 21, topology=True))


@query("permutation_scoring_set", rounded(f"""SELECT vec_id, "Permutation", {_permuted_sql('"Permutation"')}
 FROM embeddings, (VALUES (0), (1), (2)) AS p("Permutation")""", _MATRIX))
def permutation_scoring_set(spark, sf):
    """Every row under the three scoring permutations."""
    return tidy(P.scoring_set(_matrix(spark, sf)))


# ---- quartets of sequences ---------------------------------------------------------------

def _document_quartets(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("quartet"), (F.col("doc_id") % 4).alias("slot"), "text")
    picks = [F.max(F.when(F.col("slot") == i, F.col("text"))).alias(f"s{i + 1}") for i in range(4)]
    return docs.groupBy("quartet").agg(*picks).na.drop()


_SITE_SQL = """WITH q AS (SELECT doc_id // 4 AS quartet, max(text) FILTER (WHERE doc_id % 4 = 0) AS s1,
 max(text) FILTER (WHERE doc_id % 4 = 1) AS s2, max(text) FILTER (WHERE doc_id % 4 = 2) AS s3,
 max(text) FILTER (WHERE doc_id % 4 = 3) AS s4 FROM documents GROUP BY 1 HAVING count(*) = 4),
 s AS (SELECT quartet, unnest(regexp_extract_all(s1, '(?s).')) AS a,
 unnest(regexp_extract_all(s2, '(?s).')) AS b, unnest(regexp_extract_all(s3, '(?s).')) AS c,
 unnest(regexp_extract_all(s4, '(?s).')) AS d FROM q), n AS (SELECT quartet,
 count(*) FILTER (WHERE a = b AND c = d AND a <> c AND a NOT IN ('-', '?') AND c NOT IN ('-', '?')) AS "qCF_N",
 count(*) FILTER (WHERE a = c AND b = d AND a <> b AND a NOT IN ('-', '?') AND b NOT IN ('-', '?')) AS "qDF1_N",
 count(*) FILTER (WHERE a = d AND b = c AND a <> b AND a NOT IN ('-', '?') AND b NOT IN ('-', '?')) AS "qDF2_N"
 FROM s GROUP BY 1) SELECT *, "qCF_N" + "qDF1_N" + "qDF2_N" AS "qN", 100 * "qCF_N" / CAST(nullif("qCF_N" +
 "qDF1_N" + "qDF2_N", 0) AS DOUBLE) AS "qCF", 100 * "qDF1_N" / CAST(nullif("qCF_N" + "qDF1_N" + "qDF2_N", 0)
 AS DOUBLE) AS "qDF1", 100 * "qDF2_N" / CAST(nullif("qCF_N" + "qDF1_N" + "qDF2_N", 0) AS DOUBLE) AS "qDF2"
 FROM n"""


@query("site_concordance", rounded(_SITE_SQL, "qCF qDF1 qDF2"))
def site_concordance(spark, sf):
    """Decisive sites of quartets of whole texts, and the share behind each split."""
    return tidy(Q.site_concordance(_document_quartets(spark, sf), ["quartet"]))


_CLADES = ["ParaHoxozoa", "Ctenophora", "Porifera", "Outgroup"]
_ORDERS = ["1234", "1324", "1423", "2413", "3412", "2314", "2143"]


def _numbered_quartets(spark, sf):
    """Quartets of sequence numbers: part lines with shuffled clade slots."""
    order = F.element_at(
        F.array(*[F.lit(o) for o in _ORDERS]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    base = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("gene"), "l_suppkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    rows = base.withColumn("code", order)
    return rows.select(
        "gene", *[(F.substring("code", i, 1).cast("int") + 4 * (F.col("l_linenumber") - 1))
                  .cast("int").alias(f"Seq{i}") for i in (1, 2, 3, 4)],
        F.col("q").alias("qCF"), F.col("d").alias("qDF1"), F.col("t").alias("qDF2"), "code",
        "l_suppkey", "l_linenumber")


def _numbered_taxa(spark, sf):
    genes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gene")).distinct()
    names = F.transform(
        F.sequence(F.lit(0), F.lit(27)),
        lambda i: F.struct(
            (i + 1).alias("ix"),
            F.concat(F.element_at(F.array(*[F.lit(c) for c in _CLADES]), i % 4 + 1),
                     F.lit("_s"), i.cast("string")).alias("name")))
    return genes.select("gene", F.inline(names))


@query("scf_reorder", """WITH b AS (SELECT l_orderkey AS gene, l_suppkey, l_linenumber, max(l_quantity) AS
 cf, max(l_discount) AS d1, max(l_tax) AS d2, ['1234', '1324', '1423', '2413', '3412', '2314', '2143']
 [l_suppkey % 7 + 1] AS code FROM lineitem GROUP BY 1, 2, 3), h AS (SELECT *, list_sort([substr(code, 1, 1),
 substr(code, 2, 1)]) AS l, list_sort([substr(code, 3, 1), substr(code, 4, 1)]) AS r FROM b),
 k AS (SELECT *, CASE WHEN {n1} <= {n2} THEN l || r ELSE r || l END AS o FROM h), s AS (SELECT *,
 array_to_string(o, '') AS "order", list_position(o, '1') AS pos FROM k), p AS (SELECT *, o[[2, 1, 4, 3][pos]] AS p1,
 o[[3, 4, 1, 2][pos]] AS p2, o[[4, 3, 2, 1][pos]] AS p3 FROM s) SELECT gene, l_suppkey, l_linenumber, "order",
 CASE '2' WHEN p1 THEN cf WHEN p2 THEN d1 WHEN p3 THEN d2 END AS "qCF",
 CASE '3' WHEN p1 THEN cf WHEN p2 THEN d1 WHEN p3 THEN d2 END AS "qDF1",
 CASE '4' WHEN p1 THEN cf WHEN p2 THEN d1 WHEN p3 THEN d2 END AS "qDF2",
 'ParaHoxozoa_s' || (4 * (l_linenumber - 1)) AS "ParaHoxozoa",
 'Outgroup_s' || (4 * (l_linenumber - 1) + 3) AS "Outgroup" FROM p""".format(
    n1="CASE l[1] WHEN '1' THEN 'ParaHoxozoa' WHEN '2' THEN 'Ctenophora' WHEN '3' THEN 'Porifera' END",
    n2="CASE r[1] WHEN '1' THEN 'ParaHoxozoa' WHEN '2' THEN 'Ctenophora' WHEN '3' THEN 'Porifera' END"))
def scf_reorder(spark, sf):
    """Quartet numbers to taxon names, clade order, and concordance columns moved to their splits."""
    named = Q.named_quartets(_numbered_quartets(spark, sf), _numbered_taxa(spark, sf), _CLADES)
    out = Q.sorted_taxa(Q.remapped_sites(named), _CLADES)
    return tidy(out.select("gene", "l_suppkey", "l_linenumber", "order", "qCF", "qDF1", "qDF2",
                           "ParaHoxozoa", "Outgroup"))


@query("percent_sites", rounded("""WITH b AS (SELECT l_partkey AS gene, l_orderkey, l_suppkey, l_linenumber,
 l_discount AS "qCF", l_tax AS "qDF1", CASE WHEN l_partkey % 2 = 0 THEN 1 - l_discount - l_tax ELSE
 l_quantity END AS "qDF2" FROM lineitem), g AS (SELECT gene, bool_and(abs("qCF" + "qDF1" + "qDF2" - 1) <=
 1e-8 + 1e-5) AS u FROM b GROUP BY 1) SELECT gene, l_orderkey, l_suppkey, l_linenumber, CASE WHEN u THEN
 "qCF" * 100 ELSE "qCF" END AS "qCF", CASE WHEN u THEN "qDF1" * 100 ELSE "qDF1" END AS "qDF1", CASE WHEN u
 THEN "qDF2" * 100 ELSE "qDF2" END AS "qDF2" FROM b JOIN g USING (gene)""", "qCF qDF1 qDF2"))
def percent_sites(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"), "l_orderkey", "l_suppkey", "l_linenumber",
        F.col("l_discount").alias("qCF"), F.col("l_tax").alias("qDF1"),
        F.when(F.col("l_partkey") % 2 == 0, 1 - F.col("l_discount") - F.col("l_tax"))
        .otherwise(F.col("l_quantity")).alias("qDF2"))
    return tidy(Q.percent_sites(rows, ["gene"]))


# ---- trios -------------------------------------------------------------------------------

def _trio_topologies(spark, sf):
    """Counted topologies of the trio of leaves starting at each supplier; some unresolved."""
    a = F.col("l_suppkey").cast("string")
    b = (F.col("l_suppkey") + 1000).cast("string")
    c = (F.col("l_suppkey") + 5000).cast("string")
    n = F.col("l_linenumber")

    def nested(x, y, z):
        return F.concat(F.lit("("), x, F.lit(",("), y, F.lit(","), z, F.lit("));"))

    topo = F.when(n == 7, F.concat(F.lit("("), a, F.lit(","), b, F.lit(","), c, F.lit(");"))).when(
        n % 3 == 0, nested(a, b, c)).when(n % 3 == 1, nested(b, a, c)).otherwise(nested(c, a, b))
    return table(spark, sf, "lineitem").groupBy(topo.alias("topo")).agg(F.count("*").alias("count"))


def _trio_species(spark, sf):
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.concat(
        F.lit("("), s.cast("string"), F.lit(",("), (s + 1000).cast("string"), F.lit(","),
        (s + 5000).cast("string"), F.lit("));")).alias("topo"))


_TRIO = """(WITH c AS (SELECT l_suppkey AS s, l_linenumber % 3 AS k, count(*) AS n FROM lineitem WHERE
 l_linenumber <> 7 GROUP BY 1, 2), d AS (SELECT s, (max(n) - min(n)) / CAST(sum(n) AS DOUBLE) AS diff FROM c
 GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT s, (SELECT n FROM c x WHERE x.s = d.s AND k = 0) AS
 concordant, (SELECT n FROM c x WHERE x.s = d.s AND k = 1) AS n1, (SELECT n FROM c x WHERE x.s = d.s AND
 k = 2) AS n2, diff FROM d WHERE diff < 0.2), w AS (SELECT *, '(' || (s + 1000) || ',(' || s || ',' ||
 (s + 5000) || '));' AS t1, '(' || (s + 5000) || ',(' || s || ',' || (s + 1000) || '));' AS t2 FROM t)
 SELECT list_aggregate(list_sort([CAST(s AS VARCHAR), CAST(s + 1000 AS VARCHAR), CAST(s + 5000 AS VARCHAR)]),
 'string_agg', ',') AS trio, concordant, CASE WHEN t1 < t2 THEN n1 ELSE n2 END AS ils1, CASE WHEN t1 < t2
 THEN n2 ELSE n1 END AS ils2, diff FROM w)"""


@query("trio_counts", rounded(f"SELECT * FROM {_TRIO} t", "diff"))
def trio_counts(spark, sf):
    """Counts of the true and the other topologies of nearly even trios."""
    return tidy(Q.trio_counts(_trio_topologies(spark, sf), _trio_species(spark, sf), 0.2))


@query("dominant_share", rounded(f"""SELECT avg(CASE WHEN concordant >= greatest(ils1, ils2) THEN 1.0 ELSE
 0 END) AS share FROM {_TRIO} t""", "share"))
def dominant_share(spark, sf):
    trios = Q.trio_counts(_trio_topologies(spark, sf), _trio_species(spark, sf), 0.2)
    return tidy(Q.dominant_share(trios))


@query("true_topology_counts", """SELECT '(' || s_suppkey || ',(' || (s_suppkey + 1000) || ',' ||
 (s_suppkey + 5000) || '));' AS topo, (SELECT nullif(count(*), 0) FROM lineitem WHERE l_suppkey = s_suppkey
 AND l_linenumber % 3 = 0) AS count_i FROM supplier""")
def true_topology_counts(spark, sf):
    return Q.true_topology_counts(_trio_topologies(spark, sf), _trio_species(spark, sf))


@query("recombined_trees", """WITH m AS (SELECT o_custkey AS stree, o_orderstatus AS sim_model,
 o_orderkey % 5 AS ds_no, o_orderkey % 11 AS tree_ix, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY
 o_orderkey) AS src FROM orders GROUP BY 1, 2, 3, 4) SELECT o.o_orderkey, coalesce(m.src,
 CAST(o.o_orderkey % 13 + 1 AS VARCHAR)) AS sources FROM orders o LEFT JOIN m ON m.stree = o.o_custkey AND
 m.sim_model = o.o_orderstatus AND m.ds_no = o.o_orderkey % 5 AND m.tree_ix = o.o_orderkey % 13""")
def recombined_trees(spark, sf):
    """Source trees of each recombined tree, in block order."""
    orders = table(spark, sf, "orders")
    recmap = orders.select(
        F.col("o_custkey").alias("stree"), F.col("o_orderstatus").alias("sim_model"),
        (F.col("o_orderkey") % 5).alias("ds_no"), F.col("o_orderkey").alias("block"),
        (F.col("o_orderkey") % 11).alias("tree_ix"),
        F.col("o_orderkey").alias("source"))
    rows = orders.select(
        "o_orderkey", F.col("o_custkey").alias("stree"), F.col("o_orderstatus").alias("sim_model"),
        (F.col("o_orderkey") % 5).alias("ds_no"), (F.col("o_orderkey") % 13 + 1).alias("tree_no"))
    out = Q.recombined_trees(rows, recmap)
    return out.select("o_orderkey", F.array_join(F.col("tree_no").cast("array<string>"), ",")
                      .alias("sources"))


@query("leaf_strings", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 translate(CAST(l_partkey AS VARCHAR), '12', '21') AS swapped, CASE WHEN l_partkey % 10 < l_suppkey % 10 THEN
 (l_partkey % 10) || ',' || (l_suppkey % 10) ELSE (l_suppkey % 10) || ',' || (l_partkey % 10) END || ',z' AS
 leaves, CASE WHEN translate(CAST(l_partkey % 10 AS VARCHAR), '12', '21') < translate(CAST(l_suppkey % 10 AS
 VARCHAR), '12', '21') THEN translate((l_partkey % 10) || '_' || (l_suppkey % 10), '12', '21') ELSE
 translate((l_suppkey % 10) || '_' || (l_partkey % 10), '12', '21') END AS pair FROM lineitem""")
def leaf_strings(spark, sf):
    """Leaf lists and label exchange on text."""
    a, b = (F.col(c) % 10 for c in ("l_partkey", "l_suppkey"))
    nw = F.concat(F.lit("("), a.cast("string"), F.lit(",(z,"), b.cast("string"), F.lit("));"))
    return tidy(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        S.swap_labels(F.col("l_partkey").cast("string"), "1", "2").alias("swapped"),
        S.leaf_string(nw).alias("leaves"),
        S.swap_pair_label(F.concat_ws("_", a.cast("string"), b.cast("string")), "1", "2").alias("pair")))
