"""Queries that run a stream over data derived from the tables and return what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_path
from ..streaming import jobs
from .registry import query, rounded, tidy
from .tables import newick_trees, table


@query("stream_tree_ingest", rounded("""SELECT l_linenumber AS line, count(*) AS n,
 sum(2 * CAST(l_quantity AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT))::DOUBLE AS cherry
 FROM lineitem GROUP BY 1""", "cherry"))
def stream_tree_ingest(spark, sf):
    """Tree files arriving in a folder, summarised and stored once each."""
    root = work_path(spark, "incoming")
    rows = newick_trees(spark, sf).select(
        F.concat(F.lit("l"), F.col("line_no").cast("string")).alias("line"),
        F.col("newick").alias("value"))
    rows.write.partitionBy("line").text(f"{root}/in")
    stream = jobs.tree_file_stream(spark, f"{root}/in/*", files_per_trigger=4)
    for _ in range(2):  # the second run finds nothing new
        jobs.store_new_trees(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    stored = spark.read.parquet(f"{root}/out")
    cherry = F.when(F.col("tid") == 1, F.col("1_2")).when(F.col("tid") == 2, F.col("1_3")).otherwise(
        F.col("2_3"))
    line = F.regexp_extract("file_path", r"line=l(\d+)/", 1).cast("long")
    return tidy(stored.groupBy(line.alias("line")).agg(
        F.count("*").alias("n"), F.sum(cherry).alias("cherry")))


@query("stream_topology_counts", """SELECT l_partkey AS sid, l_linenumber % 3 + 1 AS tid, count(*) AS n FROM lineitem
 GROUP BY 1, 2""")
def stream_topology_counts(spark, sf):
    """Running topology frequencies, kept up to date by a stateful aggregate."""
    root = work_path(spark, "running")
    trees = table(spark, sf, "lineitem")
    stream = (
        spark.readStream.schema(trees.schema).parquet(f"{sf}/lineitem.parquet*")
        .select(F.col("l_partkey").alias("sid"), (F.col("l_linenumber") % 3 + 1).alias("tid")))
    counts = jobs.running_topology_counts(stream)
    jobs.store_totals(counts, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return tidy(jobs.latest_totals(spark, f"{root}/out"))


_WAVES, _LATE = 5, "2 days"


@query("stream_event_windows", f"""WITH w AS (SELECT *, least((day(ts) - 1) // 6 + CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 3
 ELSE 0 END, {_WAVES - 1}) AS wave, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start FROM events), tops AS (SELECT wave, max(ts) AS top
 FROM w GROUP BY 1), marks AS (SELECT a.wave, max(b.top) - INTERVAL '{_LATE}' AS mark FROM tops a JOIN tops b ON b.wave < a.wave GROUP BY 1)
 SELECT event_type, strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM w LEFT JOIN marks USING (wave) WHERE mark IS NULL
 OR start + INTERVAL '1 day' > mark GROUP BY 1, 2""")
def stream_event_windows(spark, sf):
    """Events that arrive in waves, some of them late: those within the watermark count, later ones don't."""
    root = work_path(spark, "events")
    # event time needs an instant: the times of the table taken as those of UTC, whatever the session's zone is
    parts = [f("ts") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    instant = F.make_timestamp(*parts, F.date_part(F.lit("SECOND"), F.col("ts")), F.lit("UTC"))
    events = table(spark, sf, "events").select("event_id", "event_type", instant.alias("ts"), F.dayofmonth("ts").alias("day"))
    late = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 11 == 0, 3).otherwise(0)
    wave = F.least(F.floor((F.col("day") - 1) / 6) + late, F.lit(_WAVES - 1))
    events.withColumn("wave", wave).write.partitionBy("wave").parquet(f"{root}/all")
    for k in range(_WAVES):
        spark.read.schema(events.schema).parquet(f"{root}/all/wave={k}").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        counts = jobs.windowed_counts(stream, "ts", ["event_type"], "1 day", _LATE)
        jobs.store_totals(counts, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return jobs.latest_totals(spark, f"{root}/out").select(
        "event_type", F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("start"), "n")
