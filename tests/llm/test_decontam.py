import hashlib
import re

import pytest

from cladekit.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, names = [False] * len(w), set()
    for name, item in items:
        x = words(item)
        n = min(len(x), 13)
        for k in range(len(x) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit[at : at + n] = [True] * n
                    names.add("null" if name is None else str(name))
    return (len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
            sum(hit) > 0 and 20 * sum(hit) >= len(w))


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs off home again today"), (2, "Ärger im café"), (3, None),
         (4, "..."), (None, "one"), (10, "the quick brown fox jumps over the lazy dog and runs off home"), (2, "Ärger im café"),
         (5, "a a a a a a a a a a a a a a a")]
TEXTS = [None, "", "one", "The QUICK brown fox jumps over the lazy dog, and runs off home!", "x " * 500 + "Ärger Im café", "a " * 40,
         "Ärger im café. ärger im cafe", "the quick brown fox jumps over the lazy dog and runs off home again today " * 3, "b " * 30 + "one"]


@pytest.mark.parametrize("most", [200_000, 8])
def test_against_brute_force(spark, most):
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontam.report(docs, items, max_words=most).collect()}
    assert got == {k: brute(t, ITEMS) for k, t in enumerate([*TEXTS, TEXTS[3]])}


def test_clean_and_cut_keep_the_columns(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, _hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    good = [k for k, t in enumerate(TEXTS) if not brute(t, ITEMS)[-1]]
    kept = decontam.clean(docs.withColumnRenamed("_hit", "n_words"), items)
    assert kept.columns == ["doc_id", "text", "n_words"] and sorted(r["doc_id"] for r in kept.collect()) == good
    cut = {r["doc_id"]: r["text"] for r in decontam.cut(docs.drop("_hit"), items, longest=1).collect()}
    assert cut[4] == "x " * 500


def test_empty_sides(spark, empty, odd, odd_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.report(empty, items).collect() == []
    none = decontam.report(odd, items.where("false")).collect()
    assert len(none) == len(odd_rows) and not any(r["contaminated"] for r in none)


def test_columns_named_like_the_operators_own(spark):
    """Columns of any name come back as they were, from one automaton and from several."""
    names = ["_words", "_spans", "_bytes", "_hit", "_items", "words", "spans", "items", "hit", "whole", "key", "bytes", "_text", "_lot"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    good = [r for r in rows if not brute(r[1], ITEMS)[-1]]
    assert sorted(map(tuple, decontam.clean(docs, items).collect())) == good
    cut = decontam.cut(docs, items, longest=1)
    assert cut.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in cut.collect()) == sorted(r[2:] for r in good)
    marked = decontam.mark(docs, items, max_words=8).where(~decontam.contaminated()).select("whole.*")
    assert sorted(map(tuple, marked.collect())) == good
