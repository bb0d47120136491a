"""Benchmark decontamination with a generalised suffix automaton over words.

The words of all test items form one automaton per ``MAX_WORDS`` of them; the words of each document stream through it,
keeping the longest match that ends at each word. Where it reaches a window (``window`` words of an item, or a whole
shorter item) these words are hit. Items are collected only in lots of bounded size; more lots mean more passes.

Cases: NULL text and texts without words have no words and no hits; items without words match nothing; a NULL item_id
is written ``null``; repeated items count once per item_id; empty tables on either side work; equal doc_ids keep a row each;
columns of any name pass through, as the row is carried whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_bytes

WINDOW = 13
MAX_WORDS = 200_000
COVERAGE = 20  # contaminated from one word in so many

# bytes to what they count as: letters A-Z in lower case, other ASCII but 0-9 and a-z as space
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """All substrings of the items; ``marks`` tell which windows end in a state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min([min(len(w), window) for _, w in numbered], default=window)
        # items of each window: at the state of its full length
        self.marks: list[dict[int, set[str]] | None] = [None] * len(self.next)
        for name, words in numbered:
            state, size = 0, min(len(words), window)
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks[at] = self.marks[at] or {}
                    self.marks[at].setdefault(size, set()).add(name)
        # the nearest state up the links that has marks, itself included
        self.up = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.up[s] = s if self.marks[s] else self.up[self.link[s]] if self.link[s] > 0 else -1

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest string followed by w, split off if it shares one with longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word numbers (disjoint, in order) and the items whose windows occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if last - first >= self.shortest:
                self._run(ids[first:last].tolist(), first, spans, found)
        return spans, found

    def _run(self, ids: list[int], base: int, spans: list, found: set[str]) -> None:
        state, size = 0, 0
        for k, w in enumerate(ids):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            at, reach = self.up[state], 0
            while at > 0:
                for n, names in self.marks[at].items():
                    if n <= size:
                        found |= names
                        reach = max(reach, n)
                at = self.up[self.link[at]] if self.link[at] > 0 else -1
            if reach:
                first, last = base + k + 1 - reach, base + k + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, last))


def _lots(items: DataFrame, window: int, max_words: int) -> tuple[int, Iterator[Automaton]]:
    """How many automata the items make, each of a bounded number of words, and these one by one.

    An item, being one row, is never divided: a longer one has an automaton to itself.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), text_bytes().alias("text"))
    size = F.octet_length("text") / 2 + 1
    total = words.agg(F.sum(size)).first()[0] or 0
    lots = max(1, int(-(-total // max_words)))
    dealt = words.withColumn("_lot", F.pmod(F.xxhash64("name", "text"), F.lit(lots)))

    def build() -> Iterator[Automaton]:
        for k in range(lots):
            rows = dealt.where(F.col("_lot") == k).select("name", "text").collect()
            yield Automaton([(r["name"], item_words(bytes(r["text"]))) for r in rows], window)

    return lots, build()


def _scan(rows: DataFrame, automaton: Broadcast) -> DataFrame:
    """The first column of ``rows`` (the second is the text's bytes) and words, spans (of word numbers) and items."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    kept = rows.schema[0]

    def stream(batches):
        a = automaton.value
        for batch in batches:
            words, spans, names = [], [], []
            for text in batch.column(1):
                w = item_words(text.as_py())
                hit, found = a.scan(w)
                words.append(len(w))
                spans.append([{"first": x, "last": y} for x, y in hit])
                names.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))],
                schema=pa.schema([batch.schema.field(0), ("words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))]))

    more = T.StructType.fromDDL("words long, spans array<struct<first:int,last:int>>, items array<string>")
    return rows.mapInArrow(stream, T.StructType([kept, *more]))


def _merged(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["last"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"]))).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``whole``, a struct of all columns of ``docs``, with words, spans, items and hit.

    One automaton is applied as the rows pass. If the items make more, the rows are stored under a key, and each automaton is
    built, broadcast, applied and released before the next one, its findings being stored; the result is the same.
    """
    lots, automata = _lots(items, window, max_words)
    share = docs.sparkSession.sparkContext.broadcast  # at most MAX_WORDS words at a time
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    if lots == 1:
        return _hits(_scan(docs.select(whole, text_bytes().alias("bytes")), share(next(automata))))
    # the key is the row's place in the stored table, so every pass sees the same one
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), whole), "decontam-docs")
    slim = keyed.select("key", text_bytes("whole.text").alias("bytes"))
    parts = None
    for automaton in automata:
        shared = share(automaton)
        part = stored(_scan(slim, shared), "decontam-lot")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    joined = parts.groupBy("key").agg(
        F.max("words").alias("words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return _hits(keyed.join(joined, "key").drop("key"))


def _hits(marked: DataFrame) -> DataFrame:
    return marked.withColumn("hit", _merged(F.col("spans")))


def contaminated(coverage: int = COVERAGE) -> Column:
    return (F.col("hit") > 0) & (coverage * F.col("hit") >= F.col("words"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
           max_words: int = MAX_WORDS) -> DataFrame:
    marked = mark(docs.select(F.col("doc_id").cast("long"), "text"), items.select("item_id", "text"), window, max_words)
    return marked.select(
        "whole.doc_id", F.col("words").alias("n_words"), F.col("hit").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(coverage).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """The documents whose hit words stay below the coverage limit, as they are."""
    return mark(docs, items.select("item_id", "text"), window).where(~contaminated(coverage)).select("whole.*")


_WORD_AT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def cut(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
        longest: int = WINDOW) -> DataFrame:
    """As ``clean``, and cuts hit spans of at least ``longest`` words out of the documents that stay."""
    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            gone = [x for x in (s if s is not None else []) if x["last"] - x["first"] >= longest]
            if t is None or not gone:
                out.append(t)
                continue
            fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            at = [(m.start(), m.end()) for m in re.finditer(_WORD_AT, fold)]
            parts, upto = [], 0
            for x in gone:
                parts.append(t[upto : at[x["first"]][0]])
                upto = at[x["last"] - 1][1]
            out.append("".join([*parts, t[upto:]]))
        return pd.Series(out)

    marked = mark(docs, items.select("item_id", "text"), window).where(~contaminated(coverage))
    text = without("whole.text", "spans").alias("text")
    return marked.withColumn("_text", text).select(
        *[F.col("_text").alias("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
