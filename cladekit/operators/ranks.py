"""Row numbers, ranks, quantiles and intervals over groups of any size.

A window partitioned by group alone sorts a whole group in one task, so a group that
holds a third of the table would stall the job. Here each large group is first cut into
order-preserving buckets, at values that a mergeable quantile sketch of the group gives, so they
are even whatever the values are. Bucket totals are small, so a running sum over them is cheap;
the rows are then ordered inside their buckets only, and the bucket offset is added.
The results are exact and do not depend on how Spark lays out its partitions.

Rows whose group key is NULL form a group of their own. Values that are NaN stand last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 256  # of a large group; a power of two
SKETCH_ACCURACY = 4096  # the sketch misses a place by one in so many at most
SPLIT_ROWS = 65_536  # groups with fewer rows stay whole
SPLIT_GROUPS = 1000  # groups cut at most: the largest
BLOCK = 1 << 20
# the planner's own bound (spark.sql.optimizer.windowGroupLimitThreshold) for cutting groups early
CUT_LIMIT = 1000

_UNBOUNDED = Window.unboundedPreceding


def hash_key(seed, *columns) -> Column:
    """Repeatable random text key for integer and string columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c
                                                      for c in columns]))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, NULL being equal to NULL; the keys stay once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def _offsets(sizes: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    running = Window.partitionBy(*group).orderBy(bucket)
    return sizes.withColumns({
        "_before": F.coalesce(
            F.sum("_size").over(running.rowsBetween(_UNBOUNDED, -1)), F.lit(0)
        ),
        "_total": F.sum("_size").over(Window.partitionBy(*group)),
    })


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    tiebreak: Sequence[str] = (),
    name: str = "rn",
    limit: int | None = None,
    digits: int = 3,
) -> DataFrame:
    """1-based row number within ``group`` in the order of a hash key.

    ``key`` is hex text (see ``hash_key``), so its first digits spread every group evenly
    over ``16**digits`` buckets. With ``limit`` only the first rows of each group are kept: up
    to ``CUT_LIMIT`` the planner cuts every group to so many rows before its one shuffle; above,
    buckets that lie wholly behind the limit are dropped before the rows are sorted.
    """
    group = list(group)
    if limit is not None and limit <= CUT_LIMIT:
        whole = Window.partitionBy(*group).orderBy(key, *tiebreak)
        return df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= limit).withColumn(
            name, F.col(name).cast("long"))
    tagged = df.withColumn("_bucket", F.substring(key, 1, digits))
    sizes = tagged.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = _offsets(sizes, group, "_bucket").select(*group, "_bucket", "_before")
    if limit is not None:
        offsets = offsets.where(F.col("_before") < limit)
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, *tiebreak)
    out = join_groups(tagged, offsets, [*group, "_bucket"]).withColumn(
        name, (F.col("_before") + F.row_number().over(inside)).cast("long")
    )
    if limit is not None:
        out = out.where(F.col(name) <= limit)
    return out.drop("_bucket", "_before")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of ``keys`` with the ``_r_`` columns of the other side, NULL being equal to NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_r_{k}"])
    return out


def large_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The groups that are cut, at most ``SPLIT_GROUPS`` of them: those with the most rows, ``SPLIT_ROWS`` or more.

    All others hold less than one row in ``SPLIT_GROUPS`` of the table, or few rows anyway.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    return (sizes.where(F.col("_rows") >= SPLIT_ROWS).orderBy(F.desc("_rows"), *group).limit(SPLIT_GROUPS)
            .select(*[F.col(k).alias(f"_r_{k}") for k in group]))


def cut_points(df: DataFrame, group: Sequence[str], value: str) -> DataFrame | None:
    """``_edges`` of each large group: ``BUCKETS - 1`` values that cut it evenly, from a sketch; None if no group is large.

    The sketches of a group's parts are merged, so no rows are shuffled. They only place the cuts; counts behind
    them are exact. The cuts are worked out at once, as ``SPLIT_GROUPS`` rows at most: a table without large groups, which most are,
    then gets a plan without them.
    """
    spark = df.sparkSession
    v = F.col(value).cast("double")
    edges = F.percentile_approx(v, [i / BUCKETS for i in range(1, BUCKETS)], SKETCH_ACCURACY).alias("_edges")
    known = df.where(v.isNotNull() & ~F.isnan(v))
    if not group:
        row = known.agg(F.count(F.lit(1)).alias("n"), edges).first()
        return spark.createDataFrame([(row["_edges"],)], "_edges array<double>") if row["n"] >= SPLIT_ROWS else None
    chosen = large_groups(df, group, value)
    found = chosen.collect()
    if not found:
        return None
    large = F.broadcast(spark.createDataFrame(found, chosen.schema))
    rows = known.join(large, _null_safe(known, large, group), "left_semi")
    cuts = rows.groupBy(*[F.col(k).alias(f"_r_{k}") for k in group]).agg(edges)
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def with_bucket(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Add ``_bucket``, the number of the group's cut points below ``value``, and ``_cut``, whether the group has any.

    The bucket never falls when the value rises. The cut points are broadcast and searched by halving.
    Filter on ``_cut``: a filter on the bucket would be worked out from its steps again, further down.
    """
    edges = cut_points(df, group, value)
    if edges is None:
        return df.withColumns({"_bucket": F.lit(0), "_cut": F.lit(False)})
    if group:
        small = F.broadcast(edges)
        out = df.join(small, _null_safe(df, small, group), "left").drop(*[f"_r_{k}" for k in group])
    else:
        out = df.withColumn("_edges", edges.scalar())
    v = F.col(value).cast("double")
    out = out.withColumns({"_bucket": F.lit(0), "_cut": F.col("_edges").isNotNull()})
    step = BUCKETS // 2
    while step:
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(
            v > F.get("_edges", F.col("_bucket") + (step - 1)), F.lit(step)).otherwise(0))
        step //= 2
    return out.drop("_edges")


def _bucket_offsets(bucketed: DataFrame, group: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """For each bucket of a large group, what its rows sum up to below it, in it and in the whole group.

    At most ``BUCKETS`` rows a group; the rows themselves are not moved.
    """
    sizes = bucketed.where("_cut").groupBy(*group, "_bucket").agg(
        *[F.sum(c).alias(f"_s_{k}") for k, c in counts.items()])
    order = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(_UNBOUNDED, -1)
    return sizes.select(
        *[F.col(k).alias(f"_r_{k}") for k in (*group, "_bucket")],
        *[F.coalesce(F.sum(f"_s_{k}").over(order), F.lit(0)).alias(f"_b_{k}") for k in counts],
        *[F.sum(f"_s_{k}").over(Window.partitionBy(*group)).alias(f"_t_{k}") for k in counts],
        *[F.col(f"_s_{k}") for k in counts])


def running_sums(
    df: DataFrame, group: Sequence[str], value: str, counts: dict[str, Column], by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each distinct value of a group (and each ``by`` beside it), in the order of the values.

    For each entry of ``counts``: its sum in the row (the name), over the smaller values (``name_before``), over the
    equal ones (``name_here``) and over the group (``name_total``). Entries of ``sums`` are only summed. NULL values are
    left out. Equal values are added up before they move; then the distinct ones are brought to their buckets, once.
    """
    group, by = list(group), list(by)
    named = df.where(F.col(value).isNotNull()).withColumns({f"_c_{k}": c for k, c in (counts | (sums or {})).items()})
    bucketed = with_bucket(named, group, value)
    offsets = F.broadcast(_bucket_offsets(bucketed, group, {k: F.col(f"_c_{k}") for k in counts}))
    base = bucketed.groupBy(*group, "_bucket", value, *by).agg(
        *[F.sum(f"_c_{k}").alias(k) for k in (*counts, *(sums or {}))])
    cell = Window.partitionBy(*group, "_bucket")
    below, here = cell.orderBy(value).rangeBetween(_UNBOUNDED, 0), Window.partitionBy(*group, "_bucket", value)
    out = base.withColumns(
        {f"{k}_here": F.sum(k).over(here) if by else F.col(k) for k in counts}
        | {f"_u_{k}": F.sum(k).over(below) for k in counts} | {f"_w_{k}": F.sum(k).over(cell) for k in counts})
    out = out.join(offsets, _null_safe(out, offsets, [*group, "_bucket"]), "left")
    return out.withColumns(
        {f"{k}_before": F.coalesce(f"_b_{k}", F.lit(0)) + F.col(f"_u_{k}") - F.col(f"{k}_here") for k in counts}
        | {f"{k}_total": F.coalesce(f"_t_{k}", f"_w_{k}") for k in counts}
    ).select(*group, value, *by, *[f"{k}{end}" for k in counts for end in ("", "_here", "_before", "_total")], *(sums or {}))


def value_positions(
    df: DataFrame, group: Sequence[str], value: str, sums: dict[str, Column] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct value of a group, with its place in the sorted group.

    Columns: group, ``value``, ``n`` rows with it, ``before`` rows below it, ``total`` rows
    of the group, and one column per entry of ``sums``. With ``by`` there is a row for each of its
    values too, ``here`` of whose rows have the value. NULL values are left out.
    """
    out = running_sums(df, group, value, {"n": F.lit(1)}, by, sums)
    return out.withColumnsRenamed({"n_before": "before", "n_total": "total", "n_here": "here"}).drop(
        *(() if by else ("here",)))


def average_rank() -> Column:
    """Rank with ties averaged, for the rows of ``value_positions``."""
    return F.col("before") + (F.col("n") + 1) / 2


def shared_rank() -> Column:
    """The same for rows of ``value_positions`` with ``by``."""
    return F.col("before") + (F.col("here") + 1) / 2


def at_position(value: str, position: Column) -> Column:
    """Aggregate that picks the value standing at a 0-based position of the sorted group."""
    here = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
    return F.max(F.when(here, F.col(value)))


def quantile_of(value: str, p: float) -> Column:
    """Aggregate over ``value_positions``: linear interpolation between neighbours."""
    place = (F.col("total") - 1) * F.lit(float(p))
    low = at_position(value, F.floor(place))
    high = at_position(value, F.ceil(place))
    weight = F.max(place - F.floor(place))
    return low + (high - low) * weight


def group_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of each group, one column per entry of ``probs``.

    Of a large group the rows are counted by bucket, and only buckets in which a wanted place lies are sorted.
    """
    group = list(group)
    bucketed = with_bucket(df.where(F.col(value).isNotNull()), group, value).select(*group, "_bucket", "_cut", value)
    offsets = _bucket_offsets(bucketed, group, {"n": F.lit(1)})
    first, last, whole = F.col("_b_n"), F.col("_b_n") + F.col("_s_n"), F.col("_t_n") - 1
    inside = F.lit(False)
    for p in set(probs.values()):
        for place in (F.floor(whole * F.lit(float(p))), F.ceil(whole * F.lit(float(p)))):
            inside = inside | ((first <= place) & (place < last))
    wanted = F.broadcast(offsets.where(inside).drop("_s_n"))
    rows = bucketed.join(wanted, _null_safe(bucketed, wanted, [*group, "_bucket"]), "left").where(
        ~F.col("_cut") | F.col("_t_n").isNotNull())
    base = rows.groupBy(*group, "_bucket", value).agg(F.count(F.lit(1)).alias("n"), F.first("_b_n").alias("_b"), F.first("_t_n").alias("_t"))
    cell = Window.partitionBy(*group, "_bucket")
    upto = F.sum("n").over(cell.orderBy(value).rowsBetween(_UNBOUNDED, 0))
    places = base.withColumns({
        "before": F.coalesce("_b", F.lit(0)) + upto - F.col("n"), "total": F.coalesce("_t", F.sum("n").over(cell))})
    aggs = [quantile_of(value, p).cast("double").alias(k) for k, p in probs.items()]
    return places.groupBy(*group).agg(*aggs) if group else places.agg(*aggs)


def quantiles_long(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: dict[str, float],
    name: str = "variable",
) -> DataFrame:
    """Quantiles of several columns at once: one row per group and column."""
    long = unpivot(df, keys, values, name, "value")
    return group_quantiles(long, [*keys, name], "value", probs)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str):
    wide = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return wide.unpivot(list(ids), list(values), name, value)


def shortest_interval(
    df: DataFrame, group: Sequence[str], value: str, share: float
) -> DataFrame:
    """Narrowest interval holding ``share`` of each group: columns group, ``low``, ``high``.

    Of equally narrow intervals the lowest wins. ``share`` 1 gives the range.
    """
    group = list(group)
    if share == 1:
        return df.where(F.col(value).isNotNull()).groupBy(*group).agg(
            F.min(value).alias("low"), F.max(value).alias("high")
        )
    places = value_positions(df, group, value)
    reach = F.floor(F.lit(float(share)) * F.col("total"))
    block = F.lit(BLOCK)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    # a value is repeated at the head of every block it spans, so no block looks back
    known = places.withColumn(
        "_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block)))
    ).select(
        *group, "_block", F.greatest(first, F.col("_block") * block).alias("_at"),
        F.lit(0).alias("_kind"), F.col(value).alias("_high"),
        F.lit(None).cast(places.schema[value].dataType).alias("_low"),
    )
    target = first + reach
    wanted = places.where(target < F.col("total")).select(
        *group, F.floor(target / block).alias("_block"), target.alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(places.schema[value].dataType).alias("_high"),
        F.col(value).alias("_low"),
    )
    upto = (
        Window.partitionBy(*group, "_block").orderBy("_at", "_kind").rowsBetween(_UNBOUNDED, 0)
    )
    ends = (
        known.unionByName(wanted)
        .withColumn("_high", F.last("_high", ignorenulls=True).over(upto))
        .where(F.col("_kind") == 1)
    )
    best = F.min(F.struct(
        (F.col("_high") - F.col("_low")).alias("w"), F.col("_low").alias("low"),
        F.col("_high").alias("high"),
    ))
    return ends.groupBy(*group).agg(best.alias("_best")).select(
        *group, F.col("_best.low").alias("low"), F.col("_best.high").alias("high")
    )


def cumulative_counts(
    df: DataFrame, group: Sequence[str], score: str, positive: Column
) -> DataFrame:
    """Running true and false positives down the scores, one row per distinct score.

    ``tp``/``fp`` count rows scoring at least ``score``; ``pos``/``neg`` are group totals.
    """
    hit = F.when(positive, 1).otherwise(0)
    sums = running_sums(df, group, score, {"p": hit, "q": 1 - hit})
    return sums.select(
        *group, score, (F.col("p_total") - F.col("p_before")).alias("tp"), (F.col("q_total") - F.col("q_before")).alias("fp"),
        F.col("p_total").alias("pos"), F.col("q_total").alias("neg"))
