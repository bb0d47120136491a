import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cladekit.llm import suffix
from cladekit.llm.queries import QUERIES


def brute(docs):
    """Rows as a list of (doc_id, bytes): each byte under an earlier equal string of 100 goes."""
    seen, out = set(), []
    for doc, raw in docs:
        gone, new = bytearray(len(raw)), []
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen or w in new:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_query(spark, folder, texts):
    assert got(QUERIES["op2_suffix_dedup"](spark, folder)) == brute([(d, t.encode()) for d, t in sorted(texts.items())])


def passages(n, seed):
    pick = random.Random(seed)
    base = ["".join(pick.choice("abcd é") for _ in range(260)) for _ in range(4)]
    out = []
    for k in range(n):
        a, b = pick.choice(base), pick.choice(base)
        at = pick.randrange(0, 120)
        out.append((k, "".join(pick.choice("xyz ") for _ in range(pick.randrange(150))) + a[at : at + pick.randrange(90, 200)]
                    + pick.choice(["", "q"]) + b[: pick.randrange(0, 200)] + "z" * pick.choice([0, 0, 130, 250])))
    return out + [(n, ""), (n + 1, "a" * 99), (n + 2, "a" * 100), (n + 3, "a" * 1000), (n + 4, "ab" * 300), (n + 5, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_over_tasks(spark, seed):
    docs = passages(150, seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert got(suffix.dedup(df)) == brute([(d, (t or "").encode()) for d, t in docs])


def test_odd_rows(odd, odd_rows, empty):
    rows = [(d, (t or "").encode()) for d, t in odd_rows]
    # equal rows are one document; texts of one doc_id here share nothing
    single = list(dict.fromkeys(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))))
    times = Counter(rows)
    expected = Counter()
    for row, n in zip(single, brute_in_order(single), strict=True):
        expected[n] += times[row]
    assert got(suffix.dedup(odd)) == expected
    assert suffix.dedup(empty).collect() == []


def brute_in_order(docs):
    out, upto = [], []
    for d in docs:
        upto.append(d)
        out.append(next(iter(brute(upto) - sum((Counter([x]) for x in out), Counter()))))
    return out


def test_cut_text_returned(spark):
    df = spark.createDataFrame([(1, "p" + "0123456789" * 10 + "q"), (2, "r" + "0123456789" * 10 + "s")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix.dedup(df, with_text=True).collect()}
    assert kept[2] == b"rs"


def test_sort_by_common_extensions():
    text = np.frombuffer(b"banana bandana banana cabana bandana" * 8, np.uint8)
    start = np.arange(0, len(text) - 20)
    size = np.full(len(start), 20)
    order = suffix.suffix_order(suffix.Prefixes(text), start, size, np.zeros(len(start), np.int64))
    parts = [bytes(text[s : s + 20]) for s in start[order]]
    assert parts == sorted(parts)


def test_equal_hashes_are_verified():
    p = suffix.Prefixes(np.frombuffer(b"abcabd", np.uint8))
    p.common = lambda a, b, most: most  # every hash collides
    p.less = lambda a, b, *_: np.zeros(len(a), bool)
    lead = suffix.equal_to_first(p, np.array([0, 3]), np.array([3, 3]), np.array([1, 1]))
    assert lead.tolist() == [0, 1]


def test_small_blocks(spark, monkeypatch):
    docs = passages(60, 5)
    monkeypatch.setattr(suffix, "BLOCK", 300)
    stream = [(d, d, (t or "").encode()) for d, t in docs]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in stream]), pa.array([r[1] for r in stream]),
                                        pa.array([r[2] for r in stream])], names=["doc", "key", "text"])
    strings = set()
    for block in suffix._blocks([batch]):
        for doc, _, at, piece in block:
            for k in range(len(piece) - 99):
                assert (doc, at + k) not in strings  # each string is in one piece
                strings.add((doc, at + k))
    assert len(strings) == sum(max(0, len(t) - 99) for *_, t in stream)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_first_contexts_over_batches(size):
    """An anchor known to have several contexts stays so over batches that hold only repeats of one of them."""
    order = [(7, 10, 1), (7, 20, 2), *[(7, 20, d) for d in range(3, 9)], (7, 30, 9), (8, 40, 10)]
    rows = [(h, h, c, doc, doc, 0, 5, 0) for h, c, doc in order]
    batches = [suffix._rows(suffix._CONTEXT, *map(np.array, zip(*rows[k : k + size], strict=True))) for k in range(0, len(rows), size)]
    found = [(r["doc"], r["whole"]) for b in suffix._first_contexts(iter(batches)) for r in b.to_pylist()]
    assert sorted(found) == [(1, False), (2, False), *[(d, True) for d in range(3, 9)], (9, False)]
