import zlib
from collections import Counter

import numpy as np

from cladekit.llm import sharding
from cladekit.llm.queries import QUERIES


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 10, 255, 256, 257, 1000):
        p = sharding.Permutation(n, 3)
        out = p.forward(np.arange(n))
        assert sorted(out.tolist()) == list(range(n))
        assert p.inverse(out).tolist() == list(range(n))


def test_query(spark, folder, texts):
    rows = QUERIES["op9_feistel_shards"](spark, folder).collect()
    p = sharding.Permutation(len(texts), 0).forward(np.arange(len(texts)))
    place = {d: (int(x) % 16, int(x) // 16) for d, x in zip(sorted(texts), p, strict=True)}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (r["shard"], r["slot"]) == place[r["doc_id"]]
        assert sorted(texts)[sharding.row_at(r["shard"], r["slot"], 16, len(texts))] == r["doc_id"]
    assert len(rows) == len(texts)


def shards(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({k: len(v) for k, v in slots.items()})


def test_odd_rows(odd, odd_rows, empty):
    sizes = shards(sharding.shard_rows(odd, 7).collect())
    assert sum(sizes.values()) == len(odd_rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_rows(empty).collect() == []


def test_files_hold_each_row_in_slot_order(spark, documents, texts, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts
    shards(back.collect())


def test_repeated_rows_are_written_once_each(spark, tmp_path):
    """Equal rows, NULL ids and rows alike in id and checksum keep their number and their place."""
    rows = [(1, "a", "k")] * 3 + [(None, "b", "k")] * 2 + [(2, None, "key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    sharding.write_shards(docs, str(tmp_path / "r"), 4)
    back = spark.read.parquet(str(tmp_path / "r")).collect()
    assert Counter((r["doc_id"], r["text"], r["key"]) for r in back) == Counter(rows)
    shards(back)
    hot = spark.range(3000).selectExpr("7 as doc_id", "'same' as text", "'whole' as whole")
    sharding.write_shards(hot, str(tmp_path / "h"), 4)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3000
