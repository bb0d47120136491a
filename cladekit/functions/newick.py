"""Trees as rows: distances, covariances and topologies straight from newick text.

A tree stays one row, so nothing here shuffles. Measures of a few taxa come from the intervals of ``trees``.
``leaf_paths`` gives, for every leaf, its own length and the inner nodes above it, for trees
whose leaves become rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import trees as T
from .labels import LEAVES
from .trees import TOKEN, let

# Canonical rooted topologies and their ids.
TOPOLOGIES = {
    "(4,(3,(1,2)));": 1,
    "(4,(2,(1,3)));": 2,
    "(4,(1,(2,3)));": 3,
}

_STATE = "struct<ids:array<int>,lens:array<double>,at:int,found:array<{leaf}>>"
_LEAF = "struct<name:string,len:double,ids:array<int>,lens:array<double>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _length(token: Column) -> Column:
    number = F.substring_index(token, ":", -1).try_cast("double")
    return F.when(F.contains(token, F.lit(":")), F.coalesce(number, F.lit(0.0))).otherwise(0.0)


def leaf_paths(newick) -> Column:
    """array<struct<name, len, ids, lens>>: every leaf with the inner nodes above it, root first.

    The text is read once from its end: a closing bracket enters a node, an opening bracket
    leaves it, and a leaf takes a copy of the nodes entered so far.
    """
    plain = F.regexp_replace(_c(newick), r"\s|\[[^\]]*\]", "")
    tokens = F.reverse(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(1)))
    start = F.struct(
        F.array().alias("ids"), F.array().alias("lens"), F.lit(0).alias("at"),
        F.array().alias("found"),
    ).cast(_STATE.format(leaf=_LEAF))

    def step(acc, token):
        enters, leaves = F.startswith(token, F.lit(")")), token == F.lit("(")
        depth = F.size(acc["ids"])
        here = F.struct(
            F.substring_index(token, ":", 1).alias("name"), _length(token).alias("len"),
            acc["ids"].alias("ids"), acc["lens"].alias("lens"))
        return (
            F.when(enters, F.struct(
                F.concat(acc["ids"], F.array(acc["at"])).alias("ids"),
                F.concat(acc["lens"], F.array(_length(token))).alias("lens"),
                (acc["at"] + 1).alias("at"), acc["found"].alias("found")))
            .when(leaves, F.struct(
                F.slice(acc["ids"], F.lit(1), depth - 1).alias("ids"),
                F.slice(acc["lens"], F.lit(1), depth - 1).alias("lens"),
                acc["at"].alias("at"), acc["found"].alias("found")))
            .otherwise(F.struct(
                acc["ids"].alias("ids"), acc["lens"].alias("lens"), acc["at"].alias("at"),
                F.concat(acc["found"], F.array(here)).alias("found")))
        )

    return F.reverse(F.aggregate(tokens, start, step, lambda acc: acc["found"]))


def leaf(leaves: Column, name) -> Column:
    """The entry of one leaf, NULL when the tree lacks it."""
    leaves = _c(leaves)
    name = F.lit(name) if isinstance(name, str) else name
    return F.get(leaves, (F.array_position(leaves["name"], name) - 1).cast("int"))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + x)


def _shared(a: Column, b: Column) -> Column:
    """Number of inner nodes above both leaves; they come first in both lists."""
    return F.size(F.array_intersect(a["ids"], b["ids"]))


def _below(x: Column, shared: Column) -> Column:
    return _total(F.slice(x["lens"], shared + 1, F.size(x["lens"])))


def distance(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Path length between two leaf entries."""
    n = _shared(a, b) if shared is None else shared
    both = a["len"] + b["len"] + _below(a, n) + _below(b, n)
    return F.when(a.isNotNull() & b.isNotNull(), both)


def steps(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Number of edges between two leaf entries."""
    n = _shared(a, b) if shared is None else shared
    apart = F.size(a["ids"]) + F.size(b["ids"]) - 2 * n + 2
    return F.when(a.isNotNull() & b.isNotNull(), apart)


def _pairs(taxa) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(taxa) for b in taxa[i + 1:]]


def with_leaves(df, newick: str = "newick", name: str = "_leaves", taxa=LEAVES):
    """Add the leaf array and what the measures of the wanted taxa need."""
    return T.with_taxa(df.withColumn(name, leaf_paths(newick)), newick, taxa)


def without_leaves(df, name: str = "_leaves"):
    return df.drop(name, "_taxa")


def pair_distances(taxa=LEAVES) -> dict[str, Column]:
    order = list(taxa)
    return {f"{a}_{b}": T.apart(order.index(a), order.index(b), order) for a, b in _pairs(taxa)}


def pair_covariances(taxa=LEAVES) -> dict[str, Column]:
    order = list(taxa)
    return {f"{a}_{b}": T.above_both(order.index(a), order.index(b), order)
            for a, b in [*_pairs(taxa), *[(t, t) for t in taxa]]}


def listed_pairs(measure, taxa=LEAVES) -> dict[str, Column]:
    """``distance`` or ``steps`` of each pair of leaf entries ``_l<taxon>``."""
    return {f"{a}_{b}": measure(F.col(f"_l{a}"), F.col(f"_l{b}"), F.col(f"_n{a}_{b}")) for a, b in _pairs(taxa)}


def with_shared(df, taxa=LEAVES):
    """Add ``_n<a>_<b>``, the number of inner nodes above both leaf entries, for each pair."""
    return df.withColumns({
        f"_n{a}_{b}": _shared(F.col(f"_l{a}"), F.col(f"_l{b}")) for a, b in _pairs(taxa)})


def without_shared(df, taxa=LEAVES):
    return df.drop(*[f"_l{t}" for t in taxa], *[f"_n{a}_{b}" for a, b in _pairs(taxa)])


def distance_matrix(pairs: dict[str, Column] | None = None, taxa=LEAVES) -> Column:
    """Symmetric matrix in leaf-name order."""
    def cell(a, b):
        if a == b:
            return F.lit(0.0)
        low, high = sorted((a, b), key=taxa.index)
        return pairs[f"{low}_{high}"] if pairs else F.col(f"{low}_{high}")

    return F.array(*[F.array(*[cell(a, b) for b in taxa]) for a in taxa])


def quartet_split(d12_34: Column, d13_24: Column, d14_23: Column) -> Column:
    """Topology id from the smallest of three pair sums; NULL when the smallest is tied."""
    def smallest(sums):
        a, b, c = (F.get(sums, F.lit(i)) for i in range(3))
        return (
            F.when((a < b) & (a < c), F.lit(1)).when((b < a) & (b < c), F.lit(2))
            .when((c < a) & (c < b), F.lit(3))
        )

    return let(F.array(d12_34, d13_24, d14_23), smallest)


def topology_id(taxa=LEAVES, steps: dict[str, Column] | None = None) -> Column:
    """Id of the topology the four taxa take once the tree is rooted on the last of them.

    Edges count 1 each, so branches of length 0 do not hide a split; only a true
    polytomy gives NULL.
    """
    a, b, c, d = order = list(taxa)
    s = steps or {f"{x}_{y}": T.edges_apart(order.index(x), order.index(y), order) for x, y in _pairs(taxa)}
    return quartet_split(
        s[f"{a}_{b}"] + s[f"{c}_{d}"], s[f"{a}_{c}"] + s[f"{b}_{d}"],
        s[f"{a}_{d}"] + s[f"{b}_{c}"])


def topology_text(tid) -> Column:
    tid = _c(tid)
    out = F.lit(None).cast("string")
    for text, number in TOPOLOGIES.items():
        out = F.when(tid == number, F.lit(text)).otherwise(out)
    return out


def external_length(d: dict[str, Column] | None = None) -> Column:
    """Length from leaf 1 to its ancestor with leaf 2, the tree being rooted on leaf 4."""
    g = (lambda k: d[k]) if d else F.col
    return (g("1_2") + g("1_4") - g("2_4")) / 2


def internal_length(d: dict[str, Column] | None = None) -> Column:
    """Length between the ancestors of 1,2 and of 1,3, the tree being rooted on leaf 4."""
    g = (lambda k: d[k]) if d else F.col
    return F.abs((g("1_3") - g("3_4")) / 2 - (g("1_2") - g("2_4")) / 2)


def canonical_newick(tid="tid") -> Column:
    """Text with lengths, rooted halfway along the branch of leaf 4, sorted and ladderised.

    Needs the six pair-distance columns next to ``tid``.
    """
    tid = _c(tid)

    def render(x, y, z):
        def d(a, b):
            return F.col("_".join(sorted((a, b))))

        len_x = (d(x, y) + d(x, z) - d(y, z)) / 2
        len_y = d(x, y) - len_x
        up_z = (d(x, z) + d(z, "4") - d(x, "4")) / 2
        inner = d(x, z) - len_x - up_z
        out = d(z, "4") - up_z
        return F.concat(
            F.lit("(4:"), T.number_text(out / 2), F.lit(f",({z}:"), T.number_text(up_z), F.lit(f",({x}:"),
            T.number_text(len_x), F.lit(f",{y}:"), T.number_text(len_y), F.lit("):"), T.number_text(inner),
            F.lit("):"), T.number_text(out / 2), F.lit(");"),
        )

    return (
        F.when(tid == 1, render("1", "2", "3"))
        .when(tid == 2, render("1", "3", "2"))
        .when(tid == 3, render("2", "3", "1"))
    )


def gene_family(name) -> Column:
    """Leaf name without its trailing ``_copy_number`` suffix."""
    return F.regexp_replace(_c(name), r"_\d+_\d+", "")


def single_copy(leaves) -> Column:
    """True when no gene family has two leaves."""
    names = F.transform(_c(leaves)["name"], gene_family)
    return F.size(F.array_distinct(names)) == F.size(_c(leaves))


def last_copies(leaves) -> Column:
    """One leaf per family (the last one met), renamed to the family."""
    def pick(tree):
        return F.filter(
            tree,
            lambda e, i: ~F.array_contains(
                F.slice(tree["name"], i + 2, F.size(tree)), e["name"]))

    renamed = F.transform(
        _c(leaves),
        lambda e: F.struct(gene_family(e["name"]).alias("name"), e["len"].alias("len"),
                           e["ids"].alias("ids"), e["lens"].alias("lens")))
    return let(renamed, pick)
