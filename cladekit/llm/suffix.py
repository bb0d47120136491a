"""Exact removal of byte strings that occur earlier in the corpus, by hash-compared sorting of suffixes.

Every string of ``MATCH`` bytes has one anchor: of the ``GRAM``-byte strings inside it, the one whose hash is least. Equal
strings have equal anchors at the same place, so only strings with equal anchors are ever compared. The strings
that share an anchor lie next to each other and make up its context, at most 2 * MATCH - GRAM bytes.

1. Contexts: in each block of text, contexts with equal anchors are sorted as suffixes. Two are compared by
   the longest common extension, found by binary search over prefix polynomial hashes; neighbours that are
   equal by hash are verified byte by byte. Only the first of equal contexts is sent on; over all blocks, anchors are
   brought together by hash and again only the first of equal contexts stays. All others are covered as a whole.
2. Strings: where first contexts share an anchor but differ (the borders of repeated passages), their
   single strings are compared in the same way.
3. Each document's covered spans are joined and cut out.

Between blocks, contexts and strings are compared by two independent hashes (94 bits or more).
An anchor that is frequent within a block is dealt out by its context as well, so it spreads over all tasks.

Cases: NULL text is empty; texts under MATCH bytes stay whole; a NULL doc_id comes before all others; of documents
with one doc_id the order is that of a hash of their text, and rows alike in doc_id and text are one document, each
of them reported; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes

MATCH, GRAM = 100, 40
_SPAN = MATCH - GRAM + 1  # grams in a string
BLOCK = 1 << 20
FREQUENT = 8  # contexts of one anchor in a block above which it is dealt out by context

_U = np.uint64
_PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))
_WRAP = 0x9E3779B97F4A7C15


def _powers(base: int, prime: int | None, n: int) -> np.ndarray:
    """1, base, base^2, ... by doubling, modulo a prime or 2^64."""
    out = np.ones(n, np.int64 if prime else np.uint64)
    have, factor = 1, base
    while have < n:
        m = min(have, n - have)
        if prime:
            out[have : have + m] = out[:m] * factor % prime
            factor = factor * factor % prime
        else:
            out[have : have + m] = out[:m] * _U(factor)
            factor = factor * factor % (1 << 64)
        have += m
    return out


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, prime: int | None, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        _TABLES[name] = _powers(base, prime, max(n, BLOCK + 4 * MATCH))
    return _TABLES[name][:n]


class Prefixes:
    """Prefix polynomial hashes of a text; ``of(start, length)`` is the hash of any part."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.sums, self.back = [], []
        for k, (prime, base) in enumerate(_PRIMES):
            terms = (text.astype(np.int64) + 1) * _table(f"p{k}", base, prime, n) % prime
            self.sums.append(np.concatenate(([0], np.cumsum(terms) % prime)))
            self.back.append(_table(f"b{k}", pow(base, -1, prime), prime, n + 1))

    def _part(self, k: int, start: np.ndarray, length) -> np.ndarray:
        prime = _PRIMES[k][0]
        return (self.sums[k][start + length] - self.sums[k][start]) % prime * self.back[k][start] % prime

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Both hashes in one 62-bit number."""
        return (self._part(0, start, length) << 31) | self._part(1, start, length)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of a and b, up to ``most``: a binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = self._part(0, x, mid) == self._part(0, y, mid)
            s = np.flatnonzero(same)
            same[s] = self._part(1, x[s], mid[s]) == self._part(1, y[s], mid[s])
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        return low

    def less(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the part at a comes before that at b (or is equal, where asked)."""
        most = np.minimum(size_a, size_b)
        n = self.common(a, b, most)
        inside = n < most
        top = len(self.text) - 1
        by_byte = self.text[np.minimum(a + n, top)] < self.text[np.minimum(b + n, top)]
        by_size = (size_a < size_b) | (or_equal & (size_a == size_b))
        return np.where(inside, by_byte, by_size)


def suffix_order(prefixes: Prefixes, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the parts [start, start + size) inside each run of equal ``group`` (sorted): a mergesort of all
    groups at once, in which each part finds its place in the neighbouring run by binary search."""
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    base, end = first[of], np.append(first[1:], n)[of]
    width = 1
    largest = int((end - base).max(initial=0))
    at = np.arange(n)
    while width < largest:
        run = (at - base) // width
        left = run % 2 == 0
        low = np.where(left, base + (run + 1) * width, base + (run - 1) * width)
        low = np.minimum(low, end)
        high = np.minimum(low + width, end)
        begin = low.copy()
        live = np.flatnonzero(low < high)
        lo, hi = low, high.copy()
        while (open_ := live[lo[live] < hi[live]]).size:
            mid = (lo[open_] + hi[open_]) >> 1
            mine, other = order[open_], order[mid]
            # a left part passes those before it, a right part also its equals
            goes = prefixes.less(start[other], start[mine], size[other], size[mine], ~left[open_])
            lo[open_[goes]] = mid[goes] + 1
            hi[open_[~goes]] = mid[~goes]
        passed = lo - begin
        pair = base + run // 2 * 2 * width
        place = pair + (at - (base + run * width)) + passed
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def equal_to_first(prefixes: Prefixes, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each part, the index of the first part (in the order given) with the same bytes; key: equal for equal parts."""
    n = len(start)
    out = np.arange(n)
    by_key = np.argsort(key, kind="stable")
    sorted_key = key[by_key]
    same = sorted_key[1:] == sorted_key[:-1]
    many = by_key[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    if not len(many):
        return out
    sub = many[suffix_order(prefixes, start[many], size[many], key[many])]
    a, b = sub[:-1], sub[1:]
    near = np.flatnonzero((key[a] == key[b]) & (size[a] == size[b]))
    x, y, m = start[a[near]], start[b[near]], size[a[near]]
    near = near[prefixes.common(x, y, m) >= m]
    # verified byte by byte: equal hashes alone don't count
    true = np.zeros(len(near), bool)
    for f in range(0, len(near), 4096):
        part = near[f : f + 4096]
        x, y, m = start[a[part]], start[b[part]], size[a[part]]
        reach = np.arange(int(m.max(initial=0)))
        top = len(prefixes.text) - 1
        gap = (prefixes.text[np.minimum(x[:, None] + reach, top)] != prefixes.text[np.minimum(y[:, None] + reach, top)])
        true[f : f + 4096] = ~(gap & (reach < m[:, None])).any(axis=1)
    near = near[true]
    breaks = np.ones(len(sub), bool)
    breaks[near + 1] = False
    run = np.cumsum(breaks) - 1
    least = np.full(run[-1] + 1, n)
    np.minimum.at(least, run, sub)
    out[sub] = least[run]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def gram_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes at every place."""
    n = len(text)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + _U(1)) * _table("w", _WRAP, None, n), dtype=np.uint64)))
    m = n - length + 1
    return _mix((sums[length:] - sums[:m]) * _table("v", pow(_WRAP, -1, 1 << 64), None, m))


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: (document number, first string, last string, hash of the anchor).

    ``ends``: where each document of the block ends; no string crosses an end.
    """
    n = len(text)
    if n < MATCH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    grams = gram_hashes(text, GRAM)
    place = _U((1 << 22) - 1)
    ranked = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(ranked) % _SPAN
    rows = np.concatenate((ranked, np.full(pad, np.iinfo(np.uint64).max))).reshape(-1, _SPAN)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - MATCH + 1
    anchor = (np.minimum(since[:m], upto[_SPAN - 1 : _SPAN - 1 + m]) & place).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - starts)[:m]
    valid = np.arange(m) + MATCH <= ends[doc]
    keep = np.flatnonzero(valid)
    if not len(keep):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    new = np.concatenate(([True], (anchor[keep[1:]] != anchor[keep[:-1]]) | (doc[keep[1:]] != doc[keep[:-1]])))
    first = keep[new]
    last = np.append(keep[np.flatnonzero(new)[1:] - 1], keep[-1])
    return doc[first], first, last, grams[anchor[first]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc, key, offset, bytes) of about BLOCK bytes; a longer text is cut, each string being in one piece."""
    held, size = [], 0
    for batch in batches:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_py()
            for at in range(0, max(1, len(raw) - MATCH + 1), BLOCK):
                piece = raw[at : at + BLOCK + MATCH - 1]
                if len(piece) < MATCH:
                    continue
                if size + len(piece) > BLOCK and held:
                    yield held
                    held, size = [], 0
                held.append((doc, key, at, piece))
                size += len(piece)
    if held:
        yield held


# mark 0: a context; 1: one that is compared string by string in any case; 2: stands for the contexts of a
# frequent anchor; 3: covered as a whole
_CONTEXT = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()),
                      ("lo", pa.int64()), ("hi", pa.int64()), ("mark", pa.int8())])
_CONTEXT_DDL = "k long, h long, c long, doc long, key long, lo long, hi long, mark byte"


def _rows(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        block.sort(key=lambda x: x[:3])
        text = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
        ends = np.cumsum([len(p) for *_, p in block])
        begins = ends - np.array([len(p) for *_, p in block])
        doc, first, last, h = anchors(text, ends)
        if not len(doc):
            continue
        size = last - first + MATCH
        prefixes = Prefixes(text)
        lead = equal_to_first(prefixes, first, size, h)
        c = _signed(_mix(prefixes.of(first, size).astype(np.uint64) ^ (size.astype(np.uint64) << _U(50))))
        docs, keys, offset = (np.array([b[i] for b in block], np.int64) for i in range(3))
        # a row repeated as a whole is the same document, not an earlier occurrence
        same_row = (docs[doc] == docs[doc[lead]]) & (keys[doc] == keys[doc[lead]]) & (
            first - begins[doc] + offset[doc] == first[lead] - begins[doc[lead]] + offset[doc[lead]])
        again = same_row & (lead != np.arange(len(lead)))
        doc, first, last, h, c, lead = (x[~again] for x in (doc, first, last, h, c, lead))
        covered = lead != np.flatnonzero(~again)
        # anchors with many different contexts in this block
        left = np.flatnonzero(~covered)
        _, which, count = np.unique(h[left], return_inverse=True, return_counts=True)
        frequent = np.zeros(len(h), bool)
        frequent[left] = count[which] > FREQUENT
        k = np.where(frequent, _mix(h ^ c.view(np.uint64)), h)
        k = np.where(covered, _mix(h + _U(1) + np.arange(len(h), dtype=np.uint64)), k)
        mark = np.where(covered, 3, np.where(frequent, 1, 0))
        shift = offset[doc] - begins[doc]
        yield _rows(_CONTEXT, _signed(k), _signed(h), c, docs[doc], keys[doc], first + shift, last + shift, mark)
        stand = np.unique(h[frequent])
        if len(stand):
            zero = np.zeros(len(stand), np.int64)
            yield _rows(_CONTEXT, _signed(stand), _signed(stand), zero, zero, zero, zero, zero, zero + 2)


_FOUND = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("whole", pa.bool_())])
_FOUND_DDL = "key long, doc long, lo long, hi long, whole boolean"


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _first_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by (h, c, doc, key, lo): those covered as a whole, and first ones of anchors that
    have several. Only the previous row and one waiting row are held between batches."""
    waiting = None  # a first context that is so far alone with its anchor: (h, key, doc, lo, hi)
    before = None  # (h, c, doc, key, lo) of the previous row
    several_h = None  # the previous row's anchor, if it is known to have several
    for batch in batches:
        _, h, c, doc, key, lo, hi, mark = _columns(batch)
        done = mark == 3
        if done.any():
            yield _rows(_FOUND, key[done], doc[done], lo[done], hi[done], np.ones(int(done.sum()), bool))
            h, c, doc, key, lo, hi, mark = (x[~done] for x in (h, c, doc, key, lo, hi, mark))
        n = len(h)
        if not n:
            continue
        p = [np.concatenate(([x[0] if before is None else v], x[:-1])) for x, v in
             zip((h, c, doc, key, lo), before or (0,) * 5, strict=True)]
        same_h, same_c = h == p[0], (h == p[0]) & (c == p[1])
        repeat = same_c & (doc == p[2]) & (key == p[3]) & (lo == p[4])
        if before is None:
            same_h[0] = same_c[0] = repeat[0] = False
        stands = mark == 2
        cover = same_c & ~repeat & ~stands
        if cover.any():
            yield _rows(_FOUND, key[cover], doc[cover], lo[cover], hi[cover], np.ones(int(cover.sum()), bool))
        # runs of one anchor
        run = np.cumsum(~same_h)
        first = ~same_c
        contexts = np.bincount(run, first, run[-1] + 1)
        forced = np.bincount(run, mark == 1, run[-1] + 1) > 0
        goes_on = bool(same_h[0])
        if goes_on and waiting is not None:
            contexts[run[0]] += 1
        several = (contexts > 1) | forced
        if goes_on and several_h == h[0]:
            several[run[0]] = True  # known for good, whatever this batch adds
        if waiting is not None and (not goes_on or several[run[0]]):
            if goes_on:
                yield _rows(_FOUND, *(np.array([v]) for v in waiting), np.zeros(1, bool))
            waiting = None
        sent = first & several[run] & ~stands
        if sent.any():
            yield _rows(_FOUND, key[sent], doc[sent], lo[sent], hi[sent], np.zeros(int(sent.sum()), bool))
        last = run[-1]
        alone = np.flatnonzero(first & (run == last) & ~stands)
        if several[last]:
            several_h, waiting = h[-1], None
        elif stands[-1] and not len(alone):
            several_h, waiting = h[-1], None  # a stand-in alone so far: whatever follows is one of several
        else:
            several_h = None
            if len(alone):
                i = alone[0]
                waiting = (key[i], doc[i], lo[i], hi[i])
        before = (h[-1], c[-1], doc[-1], key[-1], lo[-1])


_STRING = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])
_STRING_DDL = "w1 long, w2 int, doc long, key long, at long"
#: a span (first and last string) as one number: first * 2^24 + (last - first)
_LENGTH_BITS = 24


def _unpacked(span: int) -> tuple[int, int]:
    first = span >> _LENGTH_BITS
    return first, first + (span & ((1 << _LENGTH_BITS) - 1))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings of the contexts in each document: hashes and place. at < 0: the span -at - 1 is covered already."""
    def emit(docs, keys, los, parts):
        text = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        count = sizes - MATCH + 1
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(np.arange(len(parts)), count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        doc, key, lo = np.array(docs)[at], np.array(keys)[at], np.array(los)[at] + step
        start = begins[at] + step
        order = np.lexsort((lo, key, doc))
        doc, key, lo, start = (x[order] for x in (doc, key, lo, start))
        prefixes = Prefixes(text)
        w1 = prefixes.of(start, MATCH)
        w2 = (_signed(gram_hashes(text, MATCH)[start]) >> 32).astype(np.int32)
        lead = equal_to_first(prefixes, start, np.full(len(start), MATCH), w1)
        covered = lead != np.arange(len(lead))
        # one row of several contexts may hold the same string: that is no other occurrence
        here = (doc[lead] == doc) & (key[lead] == key) & (lo[lead] == lo)
        yield _rows(_STRING, w1[~covered], w2[~covered], doc[~covered], key[~covered], lo[~covered] << _LENGTH_BITS)
        gone = np.flatnonzero(covered & ~here)
        if len(gone):
            d, k, s = doc[gone], key[gone], lo[gone]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)))
            head = np.flatnonzero(new)
            tail = np.append(head[1:] - 1, len(gone) - 1)
            yield _rows(_STRING, w1[gone[head]], w2[gone[head]], d[head], k[head],
                        -((s[head] << _LENGTH_BITS) | (s[tail] - s[head])) - 1)

    docs, keys, los, parts, size = [], [], [], [], 0
    for batch in batches:
        for doc, key, text, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
            raw, doc, key = text.as_py(), doc.as_py(), key.as_py()
            for span in spans.as_py():
                lo, hi = _unpacked(span)
                part = raw[lo : hi + MATCH]
                docs.append(doc)
                keys.append(key)
                los.append(lo)
                parts.append(part)
                size += len(part)
                if size >= BLOCK:
                    yield from emit(docs, keys, los, parts)
                    docs, keys, los, parts, size = [], [], [], [], 0
    if parts:
        yield from emit(docs, keys, los, parts)


def _first_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings sorted by (w1, w2, doc, key, at): the covered ones."""
    before = None
    for batch in batches:
        w1, w2, doc, key, lo = _columns(batch)
        done = lo < 0
        if done.any():
            first, last = _unpacked(-lo[done] - 1)
            yield _rows(_FOUND, key[done], doc[done], first, last, np.ones(int(done.sum()), bool))
            w1, w2, doc, key, lo = (x[~done] for x in (w1, w2, doc, key, lo))
        lo = lo >> _LENGTH_BITS
        if not len(w1):
            continue
        p = [np.concatenate(([x[0] if before is None else v], x[:-1])) for x, v in
             zip((w1, w2, doc, key, lo), before or (0,) * 5, strict=True)]
        same = (w1 == p[0]) & (w2 == p[1])
        cover = same & ~((doc == p[2]) & (key == p[3]) & (lo == p[4]))
        if before is None:
            cover[0] = False
        if cover.any():
            yield _rows(_FOUND, key[cover], doc[cover], lo[cover], lo[cover], np.ones(int(cover.sum()), bool))
        before = (w1[-1], w2[-1], doc[-1], key[-1], lo[-1])


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, kept, upto, removed, n = text.as_py(), [], 0, 0, 0
                for span in sorted(spans.as_py() or []):
                    lo, hi = _unpacked(span)
                    hi += MATCH
                    if lo > upto or n == 0:
                        kept.append(raw[upto:lo])
                        n += 1
                        removed += hi - lo
                        upto = hi
                    elif hi > upto:
                        removed += hi - upto
                        upto = hi
                kept.append(raw[upto:])
                rest = b"".join(kept)
                out.append((doc, len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and, if asked, the bytes that stay."""
    spark = docs.sparkSession
    least = -(1 << 63)
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(least).cast("long"))
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if repeated else doc
    source = docs.select(F.col("doc_id").cast("long"), doc.alias("doc"), key.alias("key"), text_bytes().alias("text"))

    found = source.select("doc", "key", "text").mapInArrow(_contexts, _CONTEXT_DDL)
    sorted_ = found.repartition(F.col("k")).sortWithinPartitions("h", "c", "doc", "key", "lo")
    contexts = stored(sorted_.mapInArrow(_first_contexts, _FOUND_DDL), "contexts")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the only shuffle of the texts; both joins below start from it
    by_key = source.select("doc_id", "key", "text").repartition(tasks, "key")
    span = F.shiftleft("lo", _LENGTH_BITS) + F.col("hi") - F.col("lo")
    open_ = contexts.where("NOT whole").groupBy("key").agg(F.collect_list(span).alias("spans"))
    # both joins read the same columns, else the shuffle would be made twice
    strings = (by_key.join(open_.hint("shuffle_hash"), "key")
               .select(F.coalesce("doc_id", F.lit(least).cast("long")).alias("doc"), "key", "text", "spans")
               .mapInArrow(_strings, _STRING_DDL)
               .repartition(F.col("w1")).sortWithinPartitions("w1", "w2", "doc", "key", "at"))
    covers = (contexts.where("whole").select("key", "lo", "hi")
              .unionByName(strings.mapInArrow(_first_strings, _FOUND_DDL).select("key", "lo", "hi"))
              .groupBy("key").agg(F.collect_list(span).alias("spans")))
    out = (by_key.join(covers.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")
           .mapInArrow(_cut(with_text), _CUT))
    return out if with_text else out.drop("kept")
