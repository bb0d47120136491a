"""Conversations in reply order, with quotations linked to the messages they come from; DataFrame functions only.

A line's quote level is the number of ``>`` before it. Neighbouring lines of one level from 1 up are a quoted passage. Its
normalised text is hashed and joined to the hashes of what was said before in the conversation: whole messages, their
unquoted parts, paragraphs and single lines. A passage of several lines that is none of these comes from the latest earlier message
that said all of its lines. A message replies to the latest message that its first linked passage of the lowest
level comes from, else to the message before it. A message that answers something else than the one before it opens a
branch; branches stand after the branch they answer, so every reply follows what it replies to.

Messages are numbered over the whole table by a range sort, so a conversation of any length is spread over tasks.

Cases: NULL text is empty; NULL conv_id is one conversation of its own, NULL turn sorts first and NULL role is written
``unknown``; messages of one turn are ordered by role and text, and repeated ones all stay; a passage found nowhere is dropped from the
text but links nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

_SPACE = r"[\x20\x09-\x0D]+"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_BLANK_LINES = r"\n[\x20\x09-\x0D]*\n"
_MARKS = r"^(?:[ \t]*>)+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ROWS = 4096
CHUNK_MESSAGES = 256


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal(text: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(text, _SPACE, " ")), _UPPER, _LOWER)


def _joined(lines: Column, by: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["content"]), by)


def _line(x: Column) -> Column:
    marks = F.regexp_extract(x, _MARKS, 0)
    return F.struct((F.length(marks) - F.length(F.translate(marks, ">", ""))).alias("level"),
                    F.regexp_replace(x, _MARKS + r"[ \t]?", "").alias("content"))


def parsed(text: Column) -> Column:
    """Struct of a message: ``body`` without quotes, ``quotes`` (level, hash, hashes of the lines) and ``said`` (hashes of what it says)."""
    def passages(lines: Column) -> Column:
        n = F.size(lines)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.get(lines, i)["level"] != F.coalesce(F.get(lines, i - 1)["level"], F.lit(-1))))
        return _let(starts, lambda s: F.transform(s, lambda a, k: F.struct(
            F.get(lines, a)["level"].alias("level"),
            _joined(F.slice(lines, a + 1, F.coalesce(F.get(s, k + 1), n) - a), "\n").alias("raw"))))

    def built(lines: Column) -> Column:
        own = F.filter(lines, lambda x: x["level"] == 0)
        body = F.regexp_replace(_joined(own, "\n"), _EDGES, "")
        single = F.transform(own, lambda x: normal(x["content"]))
        return _let(passages(lines), lambda p: F.struct(
            body.alias("body"),
            F.transform(F.filter(p, lambda x: (x["level"] > 0) & (normal(x["raw"]) != "")),
                        lambda x: F.struct(x["level"].alias("level"), F.md5(normal(x["raw"])).alias("hash"),
                                           hashes(F.transform(F.split(x["raw"], "\n"), normal)).alias("lines"))).alias("quotes"),
            hashes(F.concat(F.array(normal(body)), F.flatten(F.transform(F.filter(p, lambda x: x["level"] == 0), units)), single)).alias("said")))

    def units(x: Column) -> Column:
        return F.concat(F.array(normal(x["raw"])), F.transform(F.split(x["raw"], _BLANK_LINES), normal))

    def hashes(texts: Column) -> Column:
        return F.transform(F.array_remove(F.array_distinct(texts), ""), lambda x: F.md5(x))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line)
    return _let(lines, built)


def _sources(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """``quotes`` with ``source``, the latest row before each that said its ``hash``; without those that nobody said before."""
    said = said.join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    # quotations sort before what their own message says
    both = quotes.select("conv", "hash", "row", "at", "level", F.lit(0).alias("says")).unionByName(
        said.select("conv", "hash", "row", F.lit(0).alias("at"), F.lit(0).alias("level"), F.lit(1).alias("says")))
    # a saying of a hot group is carried over blocks of rows, as branch starts are
    blocked = both.withColumn("_block", F.floor(F.col("row") / BLOCK_ROWS)).withColumn("_said", F.when(F.col("says") == 1, F.col("row")))
    tops = blocked.groupBy("conv", "hash", "_block").agg(F.max("_said").alias("_top"))
    carried = tops.select("conv", "hash", "_block", F.max("_top").over(
        Window.partitionBy("conv", "hash").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("conv", "hash", "_block").orderBy("row", "says").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (blocked.withColumn("_last", F.max("_said").over(inside)).where("says = 0").join(carried, ["conv", "hash", "_block"])
            .withColumn("source", F.coalesce("_last", "_carried")).where("source IS NOT NULL").select("row", "at", "level", "source"))


def _holders(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """Rows (``conv``, ``row``) that said all lines of a passage (``hash``) before the last quotation of it.

    Equal passages of a conversation are looked up once, from the line that the fewest messages said.
    """
    wanted = quotes.groupBy("conv", "hash").agg(F.max("row").alias("upto"), F.first("lines").alias("lines"))
    lines = wanted.select("conv", F.col("hash").alias("passage"), "upto", F.size("lines").alias("n"), F.explode("lines").alias("hash"))
    held = said.join(lines.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    often = held.groupBy("conv", "hash").agg(F.count("*").alias("times"))
    # a line that nobody said leaves its passage short of lines
    rarest = lines.join(often, ["conv", "hash"]).groupBy("conv", "passage", "upto", "n").agg(
        F.count("*").alias("found"), F.min(F.struct("times", "hash"))["hash"].alias("hash")).where("found = n")
    candidates = rarest.join(held, ["conv", "hash"]).where("row < upto").select("conv", "passage", "row")
    full = (candidates.join(lines, ["conv", "passage"]).join(held, ["conv", "row", "hash"])
            .groupBy("conv", "passage", "row", "n").count().where("count = n"))
    return full.select("conv", F.col("passage").alias("hash"), "row")


def _links(rows: DataFrame) -> DataFrame:
    """For each message with linked quotes: how many are linked, and the row it replies to."""
    quotes = rows.where(F.size("quotes") > 0).select("conv", "row", F.posexplode("quotes").alias("at", "q")).select(
        "conv", "row", "at", "q.level", "q.hash", "q.lines")
    quoting = quotes.select("conv").distinct()
    said = rows.join(quoting, "conv", "left_semi").select("conv", "row", F.explode("said").alias("hash"))
    whole = stored(_sources(quotes, said), "quotes-whole")
    # equal lines make equal passages here, however a passage was broken into them
    left = stored(quotes.where(F.size("lines") > 1).join(whole.select("row", "at"), ["row", "at"], "left_anti")
                  .withColumn("hash", F.md5(F.array_join(F.array_sort("lines"), ","))), "quotes-left")
    found = whole
    if left.limit(1).count():
        found = whole.unionByName(_sources(left, _holders(left, said)))
    return found.groupBy("row").agg(F.count("*").alias("n_linked"),
                                    F.min(F.struct("level", "at", "source"))["source"].alias("reply_row"))


def _latest_start(rows: DataFrame) -> DataFrame:
    """``branch``: the latest branch start up to each row, carried over blocks of rows by their largest start."""
    blocked = rows.withColumn("_block", F.floor(F.col("row") / BLOCK_ROWS))
    tops = blocked.groupBy("_block").agg(F.max("start").alias("_top"))
    # one row for each block
    carried = tops.select("_block", F.max("_top").over(
        Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("_block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (blocked.join(carried, "_block").withColumn("branch", F.greatest(F.max("start").over(inside), "_carried"))
            .drop("_block", "_carried"))


def _paths(branches: DataFrame, label: str) -> DataFrame:
    """Each branch's path of branches from its conversation's first; ancestors are skipped by doubling."""
    now = stored(branches.select("branch", "parent", F.array("branch").alias("path")), f"{label}-0")
    turn = 0
    while now.where("parent IS NOT NULL").limit(1).count():
        turn += 1
        up = now.select(F.col("branch").alias("parent"), F.col("parent").alias("_next"), F.col("path").alias("_path"))
        now = stored(now.join(up, "parent", "left").select(
            "branch", F.col("_next").alias("parent"),
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")), f"{label}-{turn}")
    return now.select("branch", "path")


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, reply_turn, depth, n_quotes, n_linked and body of every message."""
    least = F.lit(-(1 << 63)).cast("long")
    # messages are numbered as they are, since the range sort reads its input twice, and parsed once after
    base = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("conv_id", least).cast("long").alias("conv"),
        "text", F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    placed = numbered(base, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("_text"),
                      label="messages")
    read = placed.select("conv_id", "turn", "role", "conv", "row", F.explode(F.array(parsed(F.col("text")))).alias("m"))
    rows = stored(read.select("conv_id", "turn", "role", "conv", "row", "m.body", "m.quotes", "m.said"), "messages-numbered")
    firsts = rows.groupBy("conv").agg(F.min("row").alias("first"))
    linked = _links(rows)
    placed = (rows.join(firsts, "conv").join(linked, "row", "left")
              .withColumn("n_linked", F.coalesce("n_linked", F.lit(0)).cast("long"))
              .withColumn("reply_row", F.coalesce("reply_row", F.when(F.col("row") > F.col("first"), F.col("row") - 1)))
              .withColumn("start", F.when(F.col("reply_row").isNull() | (F.col("reply_row") != F.col("row") - 1), F.col("row"))))
    branched = stored(_latest_start(placed), "branched")
    reply = branched.select(F.col("row").alias("reply_row"), F.col("turn").alias("reply_turn"), F.col("branch").alias("parent"))
    opened = (branched.where("start IS NOT NULL AND reply_row IS NOT NULL").select("branch", "reply_row")
              .join(reply.select("reply_row", "parent"), "reply_row").select("branch", "parent"))
    paths = _paths(opened, "paths")
    # branches that open a conversation have no row in paths
    whole = (branched.join(reply.select("reply_row", "reply_turn"), "reply_row", "left").join(paths, "branch", "left")
             .withColumn("path", F.coalesce("path", F.array("branch"))))
    # the first branch of a conversation stands before every path
    whole = whole.withColumn("path", F.when(F.get("path", F.lit(0)) == F.col("first"), F.col("path")).otherwise(
        F.concat(F.array("first"), "path"))).withColumn("depth", (F.size("path") - 1).cast("long"))
    kept = whole.select("conv_id", "turn", "role", "conv", "first", "path", "row", "reply_turn", "depth",
                        F.size("quotes").cast("long").alias("n_quotes"), "n_linked", "body").withColumnRenamed("row", "_row")
    ordered = numbered(kept, F.col("conv"), F.col("path"), F.col("_row"), label="reply-order")
    return ordered.select("conv_id", "turn", "role", (F.col("row") - F.col("first")).alias("position"), "reply_turn", "depth",
                          "n_quotes", "n_linked", "body")


def chat_texts(linked: DataFrame, chunk: int = CHUNK_MESSAGES) -> DataFrame:
    """Training text of each conversation in reply order, ``chunk`` messages in a row, so a row's size is bounded."""
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("<|end|>"))
    parts = (linked.select("conv_id", F.floor(F.col("position") / chunk).alias("chunk"), F.struct("position", said.alias("said")).alias("m"))
             .groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("m")).alias("ms")))
    return parts.select("conv_id", "chunk", F.size("ms").alias("n_messages"),
                        F.array_join(F.transform("ms", lambda m: m["said"]), "\n").alias("text"))


ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) - 1 AS "row",
         conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT "row", conv_id, i, len(replace(regexp_extract(ls[i], '^(?:[ \t]*>)+'), '>', '')) AS gap,
             len(regexp_extract(ls[i], '^(?:[ \t]*>)+')) AS marks, regexp_replace(ls[i], '^(?:[ \t]*>)+[ \t]?', '') AS c
      FROM (SELECT "row", conv_id, ls, unnest(generate_series(1, len(ls))) AS i FROM r)),
v AS (SELECT *, marks - gap AS lv, CASE WHEN marks - gap IS DISTINCT FROM lag(marks - gap) OVER (PARTITION BY "row" ORDER BY i) THEN 1 ELSE 0 END AS s FROM l),
g AS (SELECT *, sum(s) OVER (PARTITION BY "row" ORDER BY i) AS p FROM v),
pass AS (SELECT "row", conv_id, p, any_value(lv) AS lv, string_agg(c, chr(10) ORDER BY i) AS raw,
                translate(trim(regexp_replace(string_agg(c, ' ' ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
         FROM g GROUP BY 1, 2, 3),
own AS (SELECT "row", regexp_replace(coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (lv = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
        FROM g GROUP BY 1),
q AS (SELECT "row", conv_id, p, lv, t FROM pass WHERE lv > 0 AND t <> ''),
said AS (
  SELECT "row", conv_id, t FROM pass WHERE lv = 0
  UNION SELECT "row", conv_id, translate(trim(regexp_replace(unnest(regexp_split_to_array(raw, chr(10) || '[\x20\x09-\x0D]*' || chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM pass WHERE lv = 0
  UNION SELECT "row", conv_id, translate(trim(regexp_replace(c, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM g WHERE lv = 0
  UNION SELECT "row", r.conv_id, translate(trim(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM own JOIN r USING ("row")),
whole AS (SELECT q."row", q.p, q.lv, max(said."row") AS src FROM q JOIN said ON q.conv_id IS NOT DISTINCT FROM said.conv_id AND q.t = said.t AND said."row" < q."row" GROUP BY 1, 2, 3),
ql AS (SELECT DISTINCT q."row", q.conv_id, q.p, q.lv, translate(trim(regexp_replace(g.c, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
       FROM q JOIN g USING ("row", p) ANTI JOIN whole USING ("row", p)),
qn AS (SELECT *, count(*) OVER (PARTITION BY "row", p) AS n FROM ql WHERE t <> ''),
holds AS (SELECT qn."row", qn.p, qn.lv, said."row" AS src FROM qn JOIN said ON qn.conv_id IS NOT DISTINCT FROM said.conv_id AND qn.t = said.t AND said."row" < qn."row"
          WHERE n > 1 GROUP BY ALL HAVING count(DISTINCT qn.t) = any_value(n)),
lk AS (SELECT * FROM whole UNION ALL SELECT "row", p, lv, max(src) FROM holds GROUP BY 1, 2, 3),
b AS (SELECT "row", count(*) AS n_linked, arg_min(src, lv * 1000000 + p) AS src FROM lk GROUP BY 1),
m AS (SELECT r."row", r.conv_id, r.turn, r.role, own.body, coalesce(b.n_linked, 0) AS n_linked,
             min(r."row") OVER (PARTITION BY r.conv_id) AS first,
             coalesce(b.src, CASE WHEN r."row" > min(r."row") OVER (PARTITION BY r.conv_id) THEN r."row" - 1 END) AS reply
      FROM r JOIN own USING ("row") LEFT JOIN b USING ("row")),
n AS (SELECT *, max(CASE WHEN reply IS NULL OR reply <> "row" - 1 THEN "row" END) OVER (PARTITION BY conv_id ORDER BY "row") AS branch FROM m),
path AS (
  SELECT "row" AS branch, ["row"] AS path FROM n WHERE "row" = first
  UNION ALL
  SELECT n."row", list_append(path.path, n."row") FROM n JOIN n AS up ON n.reply = up."row" JOIN path ON path.branch = up.branch
  WHERE n."row" = n.branch AND n.reply IS NOT NULL)
SELECT n.conv_id, n.turn, n.role,
       CAST(row_number() OVER (PARTITION BY n.conv_id ORDER BY path.path, n."row") - 1 AS BIGINT) AS position,
       coalesce(up.turn, -1) AS reply_turn, CAST(len(path.path) - 1 AS BIGINT) AS depth,
       CAST((SELECT count(*) FROM q WHERE q."row" = n."row") AS BIGINT) AS n_quotes, CAST(n.n_linked AS BIGINT) AS n_linked, n.body
FROM n JOIN path USING (branch) LEFT JOIN n AS up ON n.reply = up."row"
"""
