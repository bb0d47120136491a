"""Quality rules as a ledger of failure bits and measurements, in DataFrame functions only.

Every rule is evaluated once per document and leaves a bit; a policy is a version name and the bits it rejects on, so
a change of policy, or asking what a single rule costs, reads the ledger and never the texts again.

Cases: NULL text is the empty text, has no words and fails ``few_words``; repeated rows and NULL doc_ids keep a row each;
an empty table gives an empty ledger; columns of the documents with names of the ledger are kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8

#: bit number, name, and when a document fails
RULES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("few_words", lambda: F.col("n_words") < 20),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    ("shouting", lambda: 2 * F.col("n_exclaims") > F.col("n_words")),
    ("too_many_words", lambda: F.col("n_words") > 1_000_000),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: version -> the bits it rejects on
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": (1 << len(RULES)) - 1,
    # no document goes for its length alone; long words are judged without scripts that put no spaces between words
    "v3": ((1 << len(RULES)) - 1) & ~BIT["too_many_words"],
}
CURRENT = "v3"
#: policies under which ``long_words`` does not count where only letters of unspaced scripts make the words long
WAIVES_UNSPACED = frozenset(("v3",))
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and their extensions
UNSPACED = (r"[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{312F}\x{31A0}-\x{31FF}\x{3400}-\x{9FFF}"
            r"\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a lambda's argument is not copied into its body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _characters(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, of, ""))).cast("long")


def _unspaced(text: Column) -> Column:
    """Characters of scripts without spaces between words; a text of single-byte characters has none."""
    return F.when(F.octet_length(text) == F.length(text), F.lit(0).cast("long")).otherwise(
        (F.length(text) - F.length(F.regexp_replace(text, UNSPACED, ""))).cast("long"))


def _repeated(words: Column) -> Column:
    """Words inside windows of SPAN words that occur twice or more in the text, the first included."""
    def cover(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(
            (p + SPAN).alias("end"), (a["n"] + SPAN - F.greatest(F.lit(0), a["end"] - p)).cast("long").alias("n"))
        return F.aggregate(F.sort_array(starts), zero, step, lambda a: a["n"])

    def sorted_windows(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        text = lambda x: F.slice(words, x["p"] + 1, SPAN)

        def pick(s: Column) -> Column:
            same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (text(x) == text(y)), F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return cover(F.transform(twice, lambda x: x["p"]))

        return let(F.sort_array(placed), pick)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - SPAN + 1), lambda k: F.xxhash64(F.slice(h, k, SPAN)))

    def distinct_first(g: Column) -> Column:
        # most texts repeat nothing: a hash set of longs tells, and nothing is sorted
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(sorted_windows(g))

    return F.when(F.size(words) <= SPAN, F.lit(0).cast("long")).otherwise(
        let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), distinct_first))


def _lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(with_word, lambda a: F.struct(
        F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))


def _words(text: Column) -> Column:
    return let(F.array_remove(F.split(text, SPACE), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))


def measures(text: Column) -> Column:
    """All measurements of a text in one struct."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), _characters(t, SYMBOLS).alias("n_symbols"),
        _characters(t, "!").alias("n_exclaims"), _words(t).alias("w"), _lines(t).alias("l"), _unspaced(t).alias("n_unspaced")))


_MEASURES = ("w.n_words", "word_chars", "n_symbols", "n_exclaims", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_unspaced")


def _measured(rows: DataFrame, kept: str) -> DataFrame:
    """``kept`` and the ledger's columns. The measurements pass through a generator of one row, which
    filters and projections above are not pushed through, so each is made once."""
    made = rows.select(kept, F.explode(F.array(measures(F.col("text")))).alias("m"))
    named = made.select(kept, *[F.col(f"m.{x}").alias(x.split(".")[-1]) for x in _MEASURES])
    bits = [F.when(fails(), F.lit(1 << k)).otherwise(0) for k, (_, fails) in enumerate(RULES)]
    return named.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``fail_bits``: bit k is set where rule k fails."""
    return _measured(docs.select("doc_id", "text"), "doc_id")


def rejected_bits(policy: str = CURRENT) -> Column:
    """The failure bits on which a policy rejects a document."""
    bits = F.col("fail_bits").bitwiseAND(POLICIES[policy])
    if policy not in WAIVES_UNSPACED:
        return bits
    long_without = F.col("word_chars") - F.col("n_unspaced") > 15 * F.col("n_words")
    return F.when(long_without, bits).otherwise(bits.bitwiseAND(~BIT["long_words"]))


def passes(policy: str = CURRENT) -> Column:
    return rejected_bits(policy) == 0


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    return (ledger(docs).withColumn("base_failed", F.col("fail_bits").bitwiseAND(BASE) != 0)
            .withColumn("kept", passes(policy)).drop("n_unspaced"))


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return _measured(whole, "_row").where(passes(policy)).select("_row.*")


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it rejects, and documents kept without it.

    Documents are first counted by their bits (at most 2 to the number of rules), so the rules are compared on that
    small table.
    """
    mask = POLICIES[policy]
    counts = book.groupBy(rejected_bits(policy).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
                                for name, bit in BIT.items() if bit & mask])).alias("r")
    rest = F.col("bits").bitwiseAND(F.lit(mask) - F.col("r.bit"))
    return (counts.select("bits", "n", rules).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, k, list_slice(w, k, k + 7) AS x
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS k FROM w WHERE len(w) > 8)),
twice AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + 7)) AS p FROM twice) GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
         length(t) - length(regexp_replace(t, '""" + UNSPACED + r"""', '', 'g')) AS n_unspaced,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed,
       fail_bits & CASE WHEN word_chars - n_unspaced > 15 * n_words THEN 127 ELSE 95 END = 0 AS kept FROM f
"""
