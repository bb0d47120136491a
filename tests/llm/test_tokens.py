import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladekit.llm import bitpack, counts
from cladekit.llm.encoding import WORD_BPE
from cladekit.llm.queries import QUERIES


def ids_of(text, literal=False):
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    t.encode_special_tokens = literal
    return t.encode(text or "", add_special_tokens=False).ids


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_pack_round_trip(bits, values):
    ids = np.array(values, np.uint64) % (1 << bits)
    packed = bitpack.pack(ids.astype("<u4"), bits)
    assert len(packed) == (len(values) * bits + 7) // 8
    assert bitpack.unpack(packed, bits, len(values)).tolist() == ids.tolist()


def expected(docs):
    out, at = [], 0
    for doc, text in docs:
        ids = [*ids_of(text), 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, folder, texts):
    got = sorted(map(tuple, QUERIES["op5_bit_packed_ids"](spark, folder).collect()))
    assert got == expected(sorted(texts.items()))


def test_odd_rows(odd, odd_rows):
    got = sorted(map(tuple, bitpack.packed_round_trip(odd).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in odd_rows), key=lambda d: (d is not None, d or 0))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, n, c) for d, _, n, c in expected(odd_rows))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_empty(empty):
    assert bitpack.packed_round_trip(empty).collect() == []
    assert counts.document_counts(empty).collect() == []


def test_random_access(tmp_path):
    ids = np.arange(200_001, dtype="<u4") % 49_408
    for bits in (16, 17):
        w = bitpack.PackedWriter(str(tmp_path / f"{bits}.bin"), bits)
        w.add(1, ids[:150_000].tobytes())
        w.add(None, b"")
        w.add(3, ids[150_000:].tobytes())
        w.close()
        r = bitpack.PackedReader(w.path)
        assert r.doc_ids == [1, None, 3] and r.count == len(ids)
        for a, b in ((0, 1), (65_535, 65_537), (199_000, 200_001), (5, 5)):
            assert r.ids(a, b).tolist() == ids[a:b].tolist()


def test_counts_query(spark, folder, texts):
    got = Counter(map(tuple, QUERIES["op8_separator_scan"](spark, folder).collect()))
    assert got == Counter((d, len(ids_of(t, True))) for d, t in texts.items())


def test_counts_odd_rows(odd, odd_rows):
    got = Counter(map(tuple, counts.document_counts(odd).collect()))
    assert got == Counter((d, len(ids_of(t, True))) for d, t in odd_rows)


def test_documents_over_block_borders(spark, tmp_path):
    ids = [7, 7, 0, 0, 5] + [9] * 23 + [0, 1, 0] + [4] * 9  # 0 ends a document; the last one has no end
    (tmp_path / "a").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b").write_bytes(np.array([0] * 5, "<u2").tobytes())
    (tmp_path / "c").write_bytes(b"")
    files = spark.createDataFrame([(k, str(tmp_path / n), (tmp_path / n).stat().st_size) for k, n in enumerate("abc")],
                                  "file_no int, path string, file_bytes long")
    for block in (1, 2, 3, 4, 8, 100):
        got = sorted(map(tuple, counts.scan_flat(files, 0, block_ids=block).collect()))
        assert got == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 24, True), (0, 3, 1, True), (0, 4, 9, False),
                       *[(1, k, 0, True) for k in range(5)]], block
