"""Quartets of taxa: site concordance, renaming, tree summaries, trios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import newick as N
from ..functions import trees as T
from ..functions.labels import LEAVES
from ..functions.scalars import is_polytomy, leaf_string
from ..sources.names import clade_number
from .aggregates import balance
from .relational import with_group

# Where qCF, qDF1 and qDF2 end up for each clade order seen in the input.
SITE_COLUMN_MAP = {
    "2143": ("qCF", "qDF1", "qDF2"),
    "1234": ("qCF", "qDF1", "qDF2"),
    "2413": ("qDF1", "qCF", "qDF2"),
    "4123": ("qDF2", "qCF", "qDF1"),
    "2314": ("qDF2", "qCF", "qDF1"),
}

SITES_PER_BLOCK = 4096


def site_concordance(
    quartets: DataFrame, keys: Sequence[str], seqs: Sequence[str] = ("s1", "s2", "s3", "s4"),
    gaps: str = "-?",
) -> DataFrame:
    """Decisive sites of each quartet and the share backing each of its three splits.

    A site is decisive when the four states form two equal pairs of different states. The
    sequences are cut into blocks that are counted apart and summed, so one very long
    alignment does not sit in a single task.
    """
    length = F.least(*[F.length(s) for s in seqs])
    block = F.lit(SITES_PER_BLOCK)
    starts = F.sequence(F.lit(1), F.greatest(length, F.lit(1)), block)
    cut = quartets.withColumn("_at", F.explode(starts)).select(
        *keys,
        *[F.split(F.substring(s, F.col("_at"), F.least(block, length - F.col("_at") + 1)), "")
          .alias(f"_{i}") for i, s in enumerate(seqs)],
    )
    sites = F.arrays_zip(*[F.col(f"_{i}") for i in range(4)])
    a, b, c, d = ("_0", "_1", "_2", "_3")

    def backing(w, x, y, z) -> Column:
        def two_pairs(s):
            paired = (s[w] == s[x]) & (s[y] == s[z]) & (s[w] != s[y])
            for g in gaps:
                paired = paired & (s[w] != g) & (s[y] != g)
            return paired
        return F.sum(F.size(F.filter(sites, two_pairs))).cast("long")

    counts = cut.groupBy(*keys).agg(
        backing(a, b, c, d).alias("qCF_N"), backing(a, c, b, d).alias("qDF1_N"),
        backing(a, d, b, c).alias("qDF2_N"),
    )
    total = F.col("qCF_N") + F.col("qDF1_N") + F.col("qDF2_N")
    counts = counts.withColumn("qN", total)
    return counts.withColumns({
        q: F.when(F.col("qN") > 0, 100 * F.col(f"{q}_N") / F.col("qN"))
        for q in ("qCF", "qDF1", "qDF2")
    })


def attach_each(rows: DataFrame, source: DataFrame, gene: str, key: str, value: str,
                columns: Sequence[str], names: Sequence[str], stored: bool = False) -> DataFrame:
    """Look up one value per listed column by (gene, key); rows lacking any of them drop out.

    A ``stored`` source is a table read from files, so the planner knows its size and may be left to choose: one join a column, which moves
    the rows at most once for each. Any other source goes as follows.

    The listed columns become rows that are joined once, on both keys, which spreads the rows of a
    large gene over its taxa. A row's values are then gathered by a hash of its content, the row itself being
    carried beside the first of them only. ``source`` has one row per gene and key. The join is a merge join by hint: rows made by a
    generator look smaller to the planner than they are, and it does not give up a broadcast once planned for a join with more shuffles.
    Repeated rows are counted before and put back after. A repeated key of ``source`` gives its largest value, and repeats the rows
    that have it in the first column.
    """
    if stored:
        return _attach_stored(rows, source, gene, key, value, columns, names)
    kept = rows.columns
    names_of = [F.col(f"`{c}`") for c in kept]
    once = rows.groupBy(*names_of).agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_h": F.xxhash64(*names_of), "_g": F.xxhash64(F.lit(gene), *names_of), "_row": F.struct(*names_of, "_n")})
    slots = once.select("_h", "_g", "_row", gene, F.posexplode(F.array(*columns)).alias("_slot", "_key")).withColumn(
        "_row", F.when(F.col("_slot") == 0, F.col("_row")))
    one = source.select(F.col(gene), F.col(key).alias("_key"), F.struct(F.col(value)).alias("_value")).hint("merge")
    whole = Window.partitionBy("_h", "_g")
    found = slots.join(one, [gene, "_key"]).select(
        "_row", *[F.max(F.when(F.col("_slot") == i, F.col("_value"))).over(whole).alias(f"_v{i}") for i in range(len(names))])
    there = found.where(F.col("_row").isNotNull()).na.drop(subset=[f"_v{i}" for i in range(len(names))])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_row._n")))
    return there.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        *[F.col(f"_v{i}").getField(value).alias(name) for i, name in enumerate(names)], times.alias("_t")).drop("_t")


def _attach_stored(rows: DataFrame, source: DataFrame, gene: str, key: str, value: str,
                   columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in rows.columns]
    one = source.groupBy(gene, key).agg(F.max(F.struct(F.col(value))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    out = rows
    for i, c in enumerate(columns):
        side = one.select(F.col(gene).alias("_g"), F.col(key).alias("_k"), F.col("_v").alias(f"_v{i}"), *(["_n"] if i == 0 else []))
        out = out.join(side, (out[gene] == side["_g"]) & (out[c] == side["_k"])).drop("_g", "_k")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
    return out.select(*kept, *[F.col(f"_v{i}").getField(value).alias(name) for i, name in enumerate(names)], times.alias("_t")).drop("_t")


def quartet_sequences(quartets: DataFrame, sequences: DataFrame, gene: str = "gene",
                      taxa: Sequence[str] = ("q1", "q2", "q3", "q4")) -> DataFrame:
    """Put the four sequences next to each listed quartet."""
    return attach_each(
        quartets.select(gene, *taxa), sequences, gene, "name", "seq", taxa,
        ["s1", "s2", "s3", "s4"])


def named_quartets(
    quartets: DataFrame, taxa: DataFrame, clades: Sequence[str], gene: str = "gene", stored: bool = False,
) -> DataFrame:
    """Replace sequence numbers by taxon names and keep quartets with one taxon per clade.

    The halves ``q1,q2`` and ``q3,q4`` survive: each is ordered by clade, then the halves by
    name, so the three concordance columns still know their splits. ``stored`` taxa are a table read from files.
    """
    rows = attach_each(quartets, taxa, gene, "ix", "name", ["Seq1", "Seq2", "Seq3", "Seq4"],
                       ["_n1", "_n2", "_n3", "_n4"], stored)
    rows = rows.withColumns({f"_k{i}": clade_number(f"_n{i}", clades) for i in (1, 2, 3, 4)})
    one_each = F.sort_array(F.array("_k1", "_k2", "_k3", "_k4")) == F.array(*map(F.lit, "1234"))
    halves = {}
    for side, x, y in (("l", 1, 2), ("r", 3, 4)):
        turned = F.col(f"_k{x}") > F.col(f"_k{y}")
        for place, (a, b) in enumerate(((x, y), (y, x))):
            for part in "nk":
                halves[f"_{part}{side}{place}"] = F.when(turned, F.col(f"_{part}{b}")).otherwise(F.col(f"_{part}{a}"))
    rows = rows.where(one_each).withColumns(halves)
    front = (F.col("_nl0") < F.col("_nr0")) | ((F.col("_nl0") == F.col("_nr0")) & (F.col("_nl1") <= F.col("_nr1")))

    def ordered(part: str, put) -> Column:
        left, right = [f"_{part}l0", f"_{part}l1"], [f"_{part}r0", f"_{part}r1"]
        return F.when(front, put(*left, *right)).otherwise(put(*right, *left))

    # a generator of one row: filters above are not worked out from the steps below it
    made = F.explode(F.array(F.struct(ordered("n", F.array).alias("taxa"), ordered("k", F.concat).alias("order")))).alias("_o")
    return rows.select(*[F.col(f"`{c}`") for c in quartets.columns], made).select(
        *[F.col(f"`{c}`") for c in quartets.columns], "_o.taxa", "_o.order")


def remapped_sites(df: DataFrame, order: str = "order") -> DataFrame:
    """Concordance columns moved to the splits of clades 12|34, 13|24 and 14|23.

    The columns stand for the splits 12|34, 13|24 and 14|23 of places; the clade that shares a side with
    clade 1 names the split. Orders of the fixed table are moved as it says.
    """
    names = ("qCF", "qDF1", "qDF2")
    place = F.locate("1", F.col(order))
    partner = [F.substring(order, F.element_at(F.array(*map(F.lit, mate)), F.greatest(place, F.lit(1))), F.lit(1))
               for mate in ((2, 1, 4, 3), (3, 4, 1, 2), (4, 3, 2, 1))]
    out = {}
    for target, mate in zip(names, "234"):
        value = F.coalesce(*[F.when(p == mate, F.col(c)) for p, c in zip(partner, names)])
        for code, places in SITE_COLUMN_MAP.items():
            value = F.when(F.col(order) == code, F.col(names[places.index(target)])).otherwise(value)
        out[target] = value
    return df.withColumns(out)


def sorted_taxa(df: DataFrame, clades: Sequence[str], taxa: str = "taxa") -> DataFrame:
    """Four columns, one per clade, named after the clades: the first taxon of each."""
    names = [F.get(taxa, F.lit(i)) for i in range(4)]
    first = F.struct(*[F.coalesce(*[F.when(n.startswith(c), n) for n in names]).alias(c) for c in clades])
    # a generator of one row, so a step of its own: worked out in one step with others it was too long to be compiled
    kept = [F.col(f"`{c}`") for c in df.columns if c != taxa and c not in clades]
    return df.select(*kept, F.explode(F.array(first)).alias("_c")).select(*kept, "_c.*")


def percent_sites(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares to percent, for files (``keys``) in which every row's shares sum to 1."""
    cols = ("qCF", "qDF1", "qDF2")
    whole = sum(F.col(c) for c in cols)
    close = F.abs(whole - 1) <= 1e-8 + 1e-5
    tagged = with_group(df, keys, F.bool_and(close).alias("_unit"))
    return tagged.withColumns({
        c: F.when(F.col("_unit"), F.col(c) * 100).otherwise(F.col(c)) for c in cols}).drop("_unit")


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows over so many tasks before they are parsed; for tables that come as fewer, large splits."""
    return df if partitions is None else df.repartition(partitions)


def tree_records(df: DataFrame, newick: str = "newick", species: bool = False, partitions: int | None = None) -> DataFrame:
    """Canonical text, pair distances, matrix and topology id of four-taxon trees."""
    out = N.with_leaves(spread(df, partitions), newick).withColumns(N.pair_distances())
    out = out.withColumn("tid", N.topology_id())
    out = out.withColumns({"newick": N.canonical_newick(), "pdist": N.distance_matrix()})
    if species:
        out = out.withColumns({"ebl": N.external_length(), "ibl": N.internal_length()})
    return N.without_leaves(out)


def standard_trees(df: DataFrame, newick: str = "newick", outgroup=None, taxa=None, lengths: bool = True,
                   rename=None, partitions: int | None = None) -> DataFrame:
    """Trees of any size pruned to ``taxa``, renamed, rooted on ``outgroup``, their children in standard order, as text.

    ``outgroup`` is a name or a column, ``taxa`` names or an array column. A tree that lacks one of them gives NULL.
    """
    tree = T.parse(newick)
    if taxa is not None:
        tree = T.prune(tree, taxa, rename)
    if outgroup is not None:
        tree = T.reroot(tree, outgroup)
    return spread(df, partitions).withColumn(newick, T.text(T.standard(tree), lengths))


def branch_table(df: DataFrame, keys: Sequence[str], tree: Column) -> DataFrame:
    """One row per branch of each tree: the sorted leaf names below it and its length."""
    return df.select(*keys, F.explode(T.clade_rows(tree)).alias("b")).select(*keys, "b.clade", "b.len")


def leaf_table(trees: DataFrame, keys: Sequence[str], newick: str = "newick") -> DataFrame:
    """One row per leaf with the inner nodes above it."""
    return trees.select(*keys, F.explode(N.leaf_paths(newick)).alias("e")).select(
        *keys, F.col("e.name").alias("name"), F.col("e").alias("leaf"))


def quartet_tree_summary(
    quartets: DataFrame, trees: DataFrame, taxa: Sequence[str], gene: str = "gene",
) -> DataFrame:
    """Distances and topology of the larger tree seen by each quartet (taxa as leaves 1 to 4)."""
    listed = quartets.select(gene, *taxa).distinct()
    wide = attach_each(listed, leaf_table(trees, [gene]), gene, "name", "leaf", taxa,
                       [f"_l{t}" for t in LEAVES])
    out = N.with_shared(wide).withColumns(N.listed_pairs(N.distance))
    return N.without_shared(out.withColumn("tid", N.topology_id(steps=N.listed_pairs(N.steps))))


def different_share(pairs: DataFrame, a: str, b: str, partitions: int | None = None) -> DataFrame:
    """Share of tree pairs that do not have the same clades."""
    rows = spread(pairs, partitions)
    return rows.agg(F.avg((~T.same_clades(a, b)).cast("double")).alias("share"))


def stem_pairs(a: DataFrame, b: DataFrame, stem: str = "stem", place: str = "ord") -> DataFrame:
    """Rows of two file families matched by file stem and position."""
    return a.join(b, [stem, place])


# ---- trios -------------------------------------------------------------------------------

def trio_counts(
    topologies: DataFrame, species: DataFrame, tol: float, topo: str = "topo",
    count: str = "count",
) -> DataFrame:
    """Counts of the true topology and of the first and last other one, per nearly even trio."""
    resolved = topologies.where(~is_polytomy(topo)).withColumn("trio", leaf_string(topo))
    even = balance(resolved, ["trio"], count, tol).select("trio", "diff")
    known = resolved.join(species.select(topo, F.lit(True).alias("_true")), topo, "left")
    mine = F.col("_true").isNotNull()
    other = F.when(~mine, F.col(topo))
    per = known.groupBy("trio").agg(
        F.max(F.when(mine, F.col(count))).alias("concordant"),
        F.min_by(count, other).alias("ils1"), F.max_by(count, other).alias("ils2"),
    )
    return per.join(even, "trio").where(
        F.col("concordant").isNotNull() & F.col("ils1").isNotNull())


def dominant_share(trios: DataFrame) -> DataFrame:
    """Share of trios whose true topology is the most frequent."""
    top = F.col("concordant") >= F.greatest("ils1", "ils2")
    return trios.agg(F.avg(F.when(top, 1.0).otherwise(0.0)).alias("share"))


def true_topology_counts(topologies: DataFrame, species: DataFrame, topo: str = "topo",
                         count: str = "count") -> DataFrame:
    """Every species topology with its gene-tree count, NULL when never seen."""
    return species.select(topo).join(
        topologies.select(topo, F.col(count).alias("count_i")), topo, "left")


def recombined_trees(rows: DataFrame, recmap: DataFrame, one_based: bool = True) -> DataFrame:
    """Attach the source trees of each recombined tree, in block order.

    ``recmap`` is the long map ``(stree, sim_model, ds_no, block, tree_ix, source)``; a tree
    outside it keeps its own number as the single source.
    """
    keys = ["stree", "sim_model", "ds_no"]
    sources = recmap.groupBy(*keys, "tree_ix").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "source"))), lambda s: s["source"]
    ).alias("_src"))
    place = F.col("tree_no") - (1 if one_based else 0)
    return (
        rows.withColumn("tree_ix", place.cast("long")).join(sources, [*keys, "tree_ix"], "left")
        .withColumn("tree_no", F.coalesce("_src", F.array(F.col("tree_no").cast("long"))))
        .drop("_src", "tree_ix")
    )
