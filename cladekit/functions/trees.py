"""Trees of any size as intervals of leaves, one tree a row.

The leaves of a newick text are numbered as they stand, so every inner node covers an unbroken run of them. A tree is
a struct of leaf names and edges ``(lo, hi, len)``: an edge leads to the node above leaves ``lo`` to ``hi``, and with
``lo = hi`` to a leaf or to a node above that leaf alone. One pass over the brackets gives all of it. Taking a new root turns
edges into their complements, pruning maps their ends to the leaves that are kept, and edges that come to cover the same leaves
are one edge whose lengths add up. No step looks at pairs of nodes and nothing is shuffled. The steps work on batches of rows
(``forests``); steps put into one another run in one pass, without a column between them.

Cases: NULL text gives NULL; white space and ``[...]`` notes are skipped; a missing length counts 0; names of inner
nodes are dropped; a text without a leaf has no edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import forests as B

TOKEN = r"(\(|\)[^(),;]*|[^(),;]+)"
_TREE = "struct<names:array<string>,edges:array<struct<lo:int,hi:int,len:double>>>"
_SPANS = "struct<at:int,low:int,high:int,open:array<struct<at:int,low:int,high:int>>,found:array<long>,whole:boolean>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(newick) -> Column:
    plain = F.regexp_replace(_c(newick), r"\s|\[[^\]]*\]", "")
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(1))


def _closes(token: Column) -> Column:
    return F.startswith(token, F.lit(")"))


def _leaf_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: (t != F.lit("(")) & ~_closes(t))


def _names(leaves: Column) -> Column:
    return F.transform(leaves, lambda t: F.substring_index(t, ":", 1))


# ---- from texts to trees ------------------------------------------------------------------------

def _of_text(work, kind: str, text) -> Column:
    return F.arrow_udf(lambda x: work(B.parse(x)), kind)(_c(text))


def _of_tree(work, kind: str, tree, *more: Column) -> Column:
    """``work`` on a batch of trees. A NULL tree stays NULL."""
    return F.arrow_udf(lambda x, *y: work(B.from_arrow(x), *y), kind)(_c(tree), *more)


def parse(newick) -> Column:
    """struct<names, edges>: inner edges in the order in which their brackets close, then the leaves'."""
    return _of_text(B.to_arrow, _TREE, newick)


# ---- equal clades --------------------------------------------------------------------------

def _codes(toks: Column, ranks: Column) -> Column:
    """(span codes, whether every node's ranks are unbroken) of a text whose leaves have these ranks."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(1 << 30).alias("low"), F.lit(-1).alias("high"), F.array().alias("open"),
        F.array().alias("found"), F.lit(True).alias("whole")).cast(_SPANS)

    def step(acc, token):
        def opened():
            here = F.struct(acc["at"].alias("at"), acc["low"].alias("low"), acc["high"].alias("high"))
            return F.struct(
                acc["at"].alias("at"), F.lit(1 << 30).alias("low"), F.lit(-1).alias("high"),
                F.concat(acc["open"], F.array(here)).alias("open"), acc["found"].alias("found"), acc["whole"].alias("whole"))

        def closed():
            last = F.size(acc["open"]) - 1
            outer = F.get(acc["open"], last)
            code = F.shiftleft(acc["low"].cast("long"), 31) + acc["high"]
            return F.struct(
                acc["at"].alias("at"), F.least(acc["low"], outer["low"]).alias("low"), F.greatest(acc["high"], outer["high"]).alias("high"),
                F.slice(acc["open"], F.lit(1), F.greatest(last, F.lit(0))).alias("open"),
                F.concat(acc["found"], F.array(code)).alias("found"),
                (acc["whole"] & (acc["high"] - acc["low"] == acc["at"] - outer["at"] - 1)).alias("whole"))

        def read():
            rank = F.get(ranks, acc["at"])
            return F.struct(
                (acc["at"] + 1).alias("at"), F.least(acc["low"], rank).alias("low"), F.greatest(acc["high"], rank).alias("high"),
                acc["open"].alias("open"), acc["found"].alias("found"), acc["whole"].alias("whole"))

        return F.when(token == F.lit("("), opened()).when(_closes(token), closed()).otherwise(read())

    return F.aggregate(toks, start, step, lambda acc: F.struct(
        F.sort_array(F.array_distinct(acc["found"])).alias("codes"), acc["whole"].alias("whole")))


def same_clades(a, b) -> Column:
    """True when two newick texts have the same sets of leaves below their nodes; NULL when either is NULL.

    The leaves of ``b`` get the numbers they have in ``a``. Equal trees cover the same intervals of numbers, and a node of ``b``
    whose numbers have a gap equals none of ``a``. Of leaves with one name the first, second and so on are matched.
    """
    def placed(names):
        return F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))

    def compared(ta, tb):
        def ordered(order_a, order_b):
            pairs = F.array_sort(F.zip_with(order_a, order_b, lambda x, y: F.struct(y["i"].alias("i"), x["i"].alias("r"))))
            same = F.transform(order_a, lambda x: x["n"]) == F.transform(order_b, lambda x: x["n"])

            def codes(ranks):
                own = F.sequence(F.lit(0), F.size(ranks) - 1)
                return let(_codes(tb, ranks), lambda cb: F.when(
                    cb["whole"], _codes(ta, own)["codes"] == cb["codes"]).otherwise(False))

            return F.when(~same, F.lit(False)).when(F.size(order_a) == 0, F.lit(True)).otherwise(
                let(F.transform(pairs, lambda p: p["r"]), codes))

        return let(placed(_names(_leaf_tokens(ta))), lambda oa: let(placed(_names(_leaf_tokens(tb))), lambda ob: ordered(oa, ob)))

    return F.when(_c(a).isNotNull() & _c(b).isNotNull(),
                  let(tokens(a), lambda ta: let(tokens(b), lambda tb: compared(ta, tb))))


# ---- new roots, fewer leaves ------------------------------------------------------------------

def reroot(tree, outgroup) -> Column:
    """The tree rooted halfway along the branch of a leaf, which comes first; NULL when the tree lacks it.

    The leaves are numbered round from the outgroup on. A node above it then leads to all leaves it did not hold; what
    was the old root and has one child left goes, its two branches being one.
    """
    if isinstance(outgroup, Column):
        return _of_tree(lambda f, o: B.to_arrow(B.reroot(f, o)), _TREE, tree, outgroup)
    return _of_tree(lambda f: B.to_arrow(B.reroot(f, outgroup)), _TREE, tree)


def prune(tree, taxa, rename: Mapping[str, str] | None = None) -> Column:
    """The tree on some of its leaves, nodes with one child left out and their lengths added; NULL when a taxon is absent.

    ``taxa`` is a list of names or an array column.
    """
    if isinstance(taxa, Column):
        return _of_tree(lambda f, wanted: B.to_arrow(B.prune(f, wanted, rename)), _TREE, tree, taxa)
    return _of_tree(lambda f: B.to_arrow(B.prune(f, taxa, rename)), _TREE, tree)


# ---- text ---------------------------------------------------------------------------------------

def standard(tree) -> Column:
    """Children of every node ordered by their number of leaves, then by their least leaf name."""
    return _of_tree(lambda f: B.to_arrow(B.standard(f)), _TREE, tree)


def number_text(x: Column) -> Column:
    """A number as plain text without trailing zeros; with an exponent where plain text would lose digits."""
    def written(v):
        short = F.regexp_replace(v.cast("string"), r"\.0$", "")
        plain = F.regexp_replace(F.regexp_replace(v.try_cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        exact = (plain.try_cast("double") == v) & ~F.contains(plain, F.lit("E"))
        return F.when(F.contains(short, F.lit("E")) & exact, plain).otherwise(short)

    return let(x.cast("double"), written)


def text(tree, lengths: bool = True) -> Column:
    """Newick text of a tree, with lengths on all branches but the root's, or with leaf names only."""
    return _of_tree(lambda f: B.text(f, lengths), "string", tree)


def clade_rows(tree) -> Column:
    """array<struct<clade, len>>: for each branch the sorted names below it and its length."""
    return let(_c(tree), lambda t: F.transform(t["edges"], lambda e: F.struct(
        F.array_join(F.array_sort(F.slice(t["names"], e["lo"] + 1, e["hi"] - e["lo"] + 1)), ",").alias("clade"), e["len"].alias("len"))))


# ---- a few taxa of a tree ---------------------------------------------------------------------

def with_taxa(df, newick: str, taxa: Sequence[str]):
    """Add ``_taxa``, the measures of the wanted taxa in the tree."""
    taxa = list(taxa)
    kind = "struct<apart:array<double>,steps:array<int>,above:array<double>>"
    return df.withColumn("_taxa", _of_text(lambda f: B.measures(f, taxa), kind, newick))


def _of_pair(measure: str, a: int, b: int, taxa: Sequence[str]) -> Column:
    pairs = B.pairs(len(taxa))
    return F.get(F.col(f"_taxa.{measure}"), F.lit(len(pairs) + a if a == b else pairs.index((min(a, b), max(a, b)))))


def apart(a: int, b: int, taxa: Sequence[str]) -> Column:
    """Path length between two taxa."""
    return _of_pair("apart", a, b, taxa)


def edges_apart(a: int, b: int, taxa: Sequence[str]) -> Column:
    """Number of edges between two taxa."""
    return _of_pair("steps", a, b, taxa)


def above_both(a: int, b: int, taxa: Sequence[str]) -> Column:
    """Length from the root to the common ancestor of two taxa; to the leaf itself for one."""
    return _of_pair("above", a, b, taxa)
