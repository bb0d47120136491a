import bisect
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladekit.llm import packing
from cladekit.llm.encoding import WORD_BPE, encoder
from cladekit.llm.queries import QUERIES


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def pieces(whole, docs, end, capacity):
    out = []
    for doc, text in docs:
        ids = [*whole(text), end]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, n)
        bisect.insort(bins, (bins.pop(at) if at < len(bins) else capacity) - n)
    return len(bins)


def check(rows, expected, capacity):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(u <= capacity for u in used.values())
    assert len(used) <= 1.02 * best_fit_decreasing([r["length"] for r in rows], capacity) + 1


def test_query(spark, folder, texts, whole):
    check(QUERIES["op1_best_fit_packing"](spark, folder).collect(), pieces(whole, texts.items(), 1, 4096), 4096)


def test_odd_rows(odd, odd_rows, whole):
    check(packing.pack(odd, capacity=512).collect(), pieces(whole, odd_rows, 1, 512), 512)


def test_empty(empty):
    assert packing.pack(empty).collect() == []


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_same_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder().ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 100), max_size=300))
@settings(max_examples=60, deadline=None)
def test_plan_fits_and_is_near_the_bound(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=101) if lengths else np.zeros(101, int)
    seen, used = Counter(), Counter()
    for length, lo, hi, first, each, _ in packing.plan(counts, 100):
        for rank in range(lo, hi):
            seen[int(length), rank] += 1
            used[int(first + (rank - lo) // each)] += int(length)
    assert seen == Counter((n, k) for n in range(1, 101) for k in range(counts[n]))
    assert all(u <= 100 for u in used.values())
    assert len(used) <= 1.1 * best_fit_decreasing(lengths, 100) + 2


def test_configurations_are_solved():
    # three sizes of which the best mix wastes nothing: 50+50, 60+40
    found = packing.solve_configurations([60, 50, 40], np.array([10.0, 20.0, 10.0]), 100)
    assert abs(sum(a for _, a in found) - 20) < 1e-6
