from collections import Counter

import duckdb
import pandas as pd

from cladekit.llm import rules


def test_odd_rows(odd, odd_rows, empty):
    book = rules.verdicts(odd).collect()
    assert len(book) == len(odd_rows)
    kept = rules.keep(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in book if r["kept"])
    assert rules.verdicts(empty).collect() == [] and rules.keep(empty).collect() == []


def test_measures(spark):
    texts = ["a b c d e f g h i a b c d e f g h z", "x " * 9, "x " * 8, "l\n\nl\nm\n l\n", "#*$ %&|<> é!", None, "q r s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.ledger(df).collect()}
    assert [got[k]["n_repeat_words"] for k in range(3)] == [16, 9, 0]
    assert (got[3]["n_lines"], got[3]["n_dup_lines"]) == (4, 1)
    assert (got[4]["n_symbols"], got[4]["n_exclaims"], got[4]["word_chars"]) == (8, 1, 10)
    assert (got[5]["n_words"], got[5]["fail_bits"] & 1, got[6]["n_words"]) == (0, 1, 2)


def test_ablation(spark, documents):
    book = rules.ledger(documents)
    bits = [r["fail_bits"] for r in book.collect()]
    for r in rules.ablation(book).collect():
        bit = rules.BIT[r["rule"]]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (
            sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_policies_agree_with_labels(spark, folder, documents):
    """Documents labelled good stay unless the base rules reject them; most bad ones go."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    book = [r for r in rules.verdicts(documents).collect() if r["doc_id"] in labels]
    good = [r for r in book if labels[r["doc_id"]] and not r["base_failed"]]
    bad = [r for r in book if not labels[r["doc_id"]]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.7 * len(bad)


def test_length_and_script_reject_nothing(spark):
    """A clean text over a million words and one in a script without spaces stay; long words with spaces still go."""
    numbers = " ".join(map(str, range(1_000_001)))
    unspaced = " ".join("".join(chr(0x4E00 + 40 * k + j) for j in range(30)) for k in range(25))
    spaced = " ".join(f"{k:03d}" + "abcdefghijklmnopqrst" for k in range(25))
    df = spark.createDataFrame([(1, numbers), (2, unspaced), (3, spaced)], "doc_id long, text string")
    book = {r["doc_id"]: r for r in rules.verdicts(df).collect()}
    assert [book[k]["fail_bits"] for k in (1, 2, 3)] == [rules.BIT["too_many_words"], rules.BIT["long_words"], rules.BIT["long_words"]]
    assert [book[k]["kept"] for k in (1, 2, 3)] == [True, True, False]
    assert sorted(r["doc_id"] for r in rules.keep(df).select("doc_id").collect()) == [1, 2]
    assert [r["kept"] for r in rules.verdicts(df, "v2").orderBy("doc_id").collect()] == [False] * 3


def test_same_as_sql(spark):
    """Query and SQL agree on texts that each rule fails, on scripts without spaces, and on mixtures of both."""
    thai = "".join(chr(0x0E01 + k) for k in range(20))
    words = [f"word{k:02d}" for k in range(40)]
    texts = [" ".join(thai + w for w in words), " ".join([thai] * 40), " ".join(w + "x" * 20 for w in words), " ".join(words),
             " ".join(w + "日本語" * 3 + "y" * 12 for w in words), " ".join("日本語" * 8 + w[4:] for w in words), " ".join(words) + " #" * 5,
             " ".join(words) + "\nl" * 9, " ".join(w + "!" for w in words), "a " * 10, None, "", "x y " * 30, "é " + " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = rules.verdicts(df)
    want = con.sql(rules.ORACLE).fetchall()
    assert sorted(map(tuple, got.select(*con.sql(rules.ORACLE).columns).collect())) == sorted(want)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept[0] and kept[5] and not kept[2] and not kept[4]
