"""Many trees at once, as flat NumPy arrays: what the columns of ``trees`` do to a batch of rows.

``names`` holds the leaves of all trees, those of tree ``t`` from ``start[t]`` to ``start[t + 1]``. An edge belongs to tree ``te``, leads
to its leaves ``lo`` to ``hi`` and is ``size`` long; a tree's inner edges come before those of its leaves. A bracket too many has ``lo`` -1.
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EDGE = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("len", pa.float64())])
PAIRS_AT_ONCE = 1 << 20  # pairs of a leaf and an edge above it that are held while trees are put in order


class Forest(NamedTuple):
    there: np.ndarray  # whether the tree is not NULL
    names: pa.Array
    start: np.ndarray
    te: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray


def _starts(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _ranges(first, count) -> np.ndarray:
    """The numbers from ``first`` on, ``count`` of them, one run after the other."""
    return np.repeat(first - _starts(count)[:-1], count) + np.arange(count.sum())


def _strings(offsets, values, count: int) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts without NULLs and their bytes."""
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(values, np.uint8) if values and values.size else np.zeros(0, np.uint8)


def _number_of(text: str) -> float:
    """As Spark reads a number; 0 if it is none."""
    if re.fullmatch(r"\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?|inf|infinity|nan)\s*", text, re.I | re.ASCII):
        return float(text if re.search(r"inf|nan", text, re.I) else text.strip().rstrip("dDfF"))
    return 0.0


def _numbers(texts: pa.Array) -> np.ndarray:
    try:
        return pc.cast(texts, pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        return np.array([_number_of(t) for t in texts.to_pylist()], float)


def _edges_in_order(f: Forest, te, lo, hi, size, leaf) -> Forest:
    """Inner edges before leaves within each tree, as they stand otherwise."""
    order = np.argsort(te * 2 + leaf, kind="stable")
    return f._replace(te=te[order], lo=lo[order], hi=hi[order], size=size[order])


def parse(texts: pa.Array) -> Forest:
    """Inner edges in the order in which their brackets close, then the leaves'."""
    there = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets, text = _bytes(texts)
    if np.isin(text, np.frombuffer(b" \t\n\r\f\v[", np.uint8)).any():
        offsets, text = _bytes(pc.replace_substring_regex(texts, r"[\s\v]|\[[^\]]*\]", ""))
    # a piece is what stands behind a bracket, a comma, a semicolon or the beginning of a text
    marks = offsets[0] + np.flatnonzero(np.isin(text[offsets[0]:offsets[-1]], np.frombuffer(b"(),;", np.uint8)))
    at = np.concatenate([offsets[:-1], marks])
    behind = np.concatenate([np.zeros(len(there), np.uint8), text[marks]])
    order = np.lexsort((behind > 0, at)) if len(marks) else np.arange(len(at))
    at, behind = at[order], behind[order]
    tree = np.cumsum(behind == 0) - 1
    opens, closes = behind == ord("("), behind == ord(")")
    begin, end = at + (behind > 0), np.append(at[1:], offsets[-1])
    leaf = ~closes & (end > begin)
    start = _starts(np.bincount(tree[leaf], minlength=len(there)))
    seen = np.cumsum(leaf) - leaf - start[tree]  # leaves of the tree before the piece

    # brackets of one depth take turns, so a closing one belongs to the one before it
    bracket = np.flatnonzero(opens | closes)
    depth = np.cumsum(np.where(opens, 1, np.where(closes, -1, 0)))[bracket] + closes[bracket]
    # depth runs on over the texts, which does not matter within one
    turns = bracket[np.lexsort((depth, tree[bracket]))]
    level = np.sort(tree[bracket]), depth[np.lexsort((depth, tree[bracket]))]
    mate = np.full(len(at), -1)
    if len(turns) > 1:
        fits = closes[turns[1:]] & opens[turns[:-1]] & (level[0][1:] == level[0][:-1]) & (level[1][1:] == level[1][:-1])
        mate[turns[1:][fits]] = seen[turns[:-1][fits]]

    colons = np.append(np.flatnonzero(text == ord(":")), len(text) + 1)
    token = np.flatnonzero(closes | leaf)
    first = colons[np.searchsorted(colons, begin[token])]
    last = colons[np.searchsorted(colons, end[token]) - 1]
    has = (first < end[token]) & (last + 1 < end[token])
    size = np.zeros(len(token))
    size[has] = _numbers(_slices(text, last[has] + 1, end[token][has]))
    own = leaf[token]
    names = _slices(text, begin[token][own], np.minimum(first, end[token])[own])
    lo, hi = np.where(own, seen[token], mate[token]), np.where(own, seen[token], seen[token] - 1)
    return _edges_in_order(Forest(there, names, start, *[None] * 4), tree[token], lo, hi, size, own)


def _slices(text, begin, end) -> pa.Array:
    return _strings(_starts(end - begin), text[_ranges(begin, end - begin)], len(begin))


def to_arrow(f: Forest) -> pa.Array:
    edges = pa.StructArray.from_arrays(
        [pa.array(f.lo, pa.int32(), mask=f.lo < 0), pa.array(f.hi, pa.int32()), pa.array(f.size)], fields=list(EDGE))
    bounds = _starts(np.bincount(f.te, minlength=len(f.there)))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(f.start, pa.int32()), f.names), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), edges)],
        ["names", "edges"], mask=pa.array(~f.there))


def from_arrow(trees: pa.Array) -> Forest:
    there = pc.is_valid(trees).to_numpy(zero_copy_only=False)
    names, edges = (pc.struct_field(trees, k) for k in ("names", "edges"))
    count, held = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, edges))
    flat = edges.flatten()
    lo, hi, size = (flat.field(k) for k in range(3))
    return Forest(there, names.flatten(), _starts(count), np.repeat(np.arange(len(there)), held),
                  pc.fill_null(lo, -1).to_numpy(zero_copy_only=False).astype(np.int64),
                  hi.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False))


def _owner(f: Forest) -> np.ndarray:
    """The tree of each leaf."""
    return np.repeat(np.arange(len(f.there)), np.diff(f.start))


def _covering(f: Forest) -> Forest:
    """Without edges of NULL trees, of brackets too many and of those without a leaf."""
    keep = f.there[f.te] & (f.lo >= 0) & (f.lo <= f.hi)
    return f._replace(te=f.te[keep], lo=f.lo[keep], hi=f.hi[keep], size=f.size[keep])


def _only(f: Forest, there) -> Forest:
    """NULL trees emptied."""
    keep = there[_owner(f)]
    start = _starts(np.diff(f.start) * there)
    return _covering(f._replace(there=there, names=f.names.filter(pa.array(keep)), start=start))


def _merged(f: Forest) -> Forest:
    """Edges over the same leaves as one, their lengths added, in the order of (lo, hi)."""
    order = np.lexsort((f.size, f.hi, f.lo, f.te))
    te, lo, hi = f.te[order], f.lo[order], f.hi[order]
    new = np.ones(len(order), bool)
    new[1:] = (te[1:] != te[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(new)
    return f._replace(te=te[at], lo=lo[at], hi=hi[at], size=np.add.reduceat(f.size[order], at) if len(at) else f.size[order])


def _arranged(f: Forest) -> Forest:
    """Merged edges: inner ones first, the root's length 0."""
    root = (f.lo == 0) & (f.hi == np.diff(f.start)[f.te] - 1) & (f.lo < f.hi)
    return _edges_in_order(f, f.te, f.lo, f.hi, np.where(root, 0.0, f.size), f.lo == f.hi)


def _places(f: Forest, names) -> np.ndarray:
    """Number of the first leaf of each tree with the name, -1 if the tree lacks it. A name, or one for each tree."""
    wanted = names.take(pa.array(_owner(f))) if isinstance(names, pa.Array) else pa.scalar(names, pa.string())
    hits = np.flatnonzero(pc.fill_null(pc.equal(f.names, wanted), False).to_numpy(zero_copy_only=False))[::-1]
    place = np.full(len(f.there), -1)
    tree = _owner(f)[hits]
    place[tree] = hits - f.start[tree]
    return place


def reroot(f: Forest, outgroup) -> Forest:
    p = _places(f, outgroup)
    f = _only(f, f.there & (p >= 0))
    n = np.diff(f.start)
    owner = _owner(f)
    local = np.arange(len(owner)) - f.start[owner]
    turned = np.empty(len(owner), np.int64)
    turned[f.start[owner] + (local - p[owner]) % n[owner]] = np.arange(len(owner))
    te, lo, hi, size = f.te, f.lo, f.hi, f.size
    q, m = p[te], n[te]
    above = (lo <= q) & (hi >= q) & (lo < hi)
    lo, hi = np.where(above, hi + 1 - q, (lo - q) % m), np.where(above, m - 1 + lo - q, (hi - q) % m)
    keep = (lo <= hi) & (m > 1)  # the whole tree's complement is empty: that edge is no more
    more = np.flatnonzero(n > 1)
    none = np.zeros(len(more))
    moved = f._replace(
        names=f.names.take(pa.array(turned)), te=np.concatenate([te[keep], more, more]),
        lo=np.concatenate([lo[keep], none, none + 1]).astype(np.int64), hi=np.concatenate([hi[keep], n[more] - 1, n[more] - 1]),
        size=np.concatenate([size[keep], none, none]))
    moved = _merged(moved)
    ends = ((moved.lo == 0) & (moved.hi == 0)) | ((moved.lo == 1) & (moved.hi == n[moved.te] - 1))
    both = np.bincount(moved.te[ends], moved.size[ends], len(n))
    moved = _arranged(moved._replace(size=np.where(ends, both[moved.te] / 2, moved.size)))
    one = n[f.te] == 1  # a single leaf stays as it is
    parts = [(getattr(moved, k), getattr(f, k)[one]) for k in ("te", "lo", "hi", "size")]
    te, lo, hi, size = (np.concatenate(x) for x in parts)
    return _edges_in_order(moved, te, lo, hi, size, np.zeros(len(te), int))


def prune(f: Forest, taxa, rename=None) -> Forest:
    """``taxa``: a list of names, or an array of lists."""
    count = len(f.there)
    if isinstance(taxa, pa.Array):
        there = f.there & pc.is_valid(taxa).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(count), pc.fill_null(pc.list_value_length(taxa), 0).to_numpy(zero_copy_only=False))
        asked = taxa.flatten()
    else:
        there, of, asked = f.there, np.repeat(np.arange(count), len(taxa)), pa.array(list(taxa) * count, pa.string())
    codes = pa.concat_arrays([f.names, asked.cast(pa.string())]).dictionary_encode()
    code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = _owner(f)
    have = owner * (len(codes.dictionary) + 1) + code[:len(owner)]
    want = of * (len(codes.dictionary) + 1) + code[len(owner):]
    lacks = (code[len(owner):] < 0) | ~np.isin(want, have)
    there = there & (np.bincount(of[lacks], minlength=count) == 0)
    keep = np.isin(have, want) & there[owner]
    before = _starts(keep)  # how many leaves are kept before each
    cut = _covering(f._replace(there=there))
    base = f.start[cut.te]
    lo = before[base + cut.lo] - before[base]
    hi = before[base + cut.hi + 1] - before[base] - 1
    names = f.names.filter(pa.array(keep))
    if rename:
        coded = names.dictionary_encode()
        names = pa.array([rename.get(x, x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    cut = cut._replace(names=names, start=_starts(np.bincount(owner[keep], minlength=count)), lo=lo, hi=hi)
    return _arranged(_merged(_covering(cut)))


def _least(values, first, last) -> np.ndarray:
    """Least value of each run from ``first`` to ``last``."""
    ends = np.stack([first, last + 1], 1).ravel()
    return np.minimum.reduceat(np.append(values, values.max(initial=0)), ends)[::2] if len(ends) else first


def _leaf_order(owner, start, te, lo, hi, key) -> np.ndarray:
    """Leaves in the order of the keys on their way from the root, largest key first; ``lo`` and ``hi`` number the leaves of all trees."""
    ranked = np.lexsort((hi, lo, key))[::-1]
    leaf = _ranges(lo[ranked], (hi - lo + 1)[ranked])
    way = np.repeat(key[ranked], (hi - lo + 1)[ranked])
    way = way[np.argsort(leaf, kind="stable")]
    steps = np.bincount(leaf, minlength=len(owner))
    at, place, k = _starts(steps), start[owner] - start[owner[:1]].sum(), 0
    while True:  # leaves that went the same way so far share a place; each step parts them
        on = np.flatnonzero(steps > k)
        if not len(on):
            return np.argsort(place, kind="stable")
        here = way[at[on] + k]
        order = np.lexsort((here, place[on]))
        group, value = place[on][order], here[order]
        fresh = np.ones(len(on), bool)
        fresh[1:] = group[1:] != group[:-1]
        turn = fresh.copy()
        turn[1:] |= value[1:] != value[:-1]
        index = np.arange(len(on))
        inside = np.maximum.accumulate(np.where(turn, index, 0)) - np.maximum.accumulate(np.where(fresh, index, 0))
        done = np.bincount(place, minlength=len(owner)) - np.bincount(place[on], minlength=len(owner))
        place = place.copy()
        place[on[order]] = group + done[group] + inside
        k += 1


def standard(f: Forest) -> Forest:
    f = _only(f, f.there)
    coded = f.names.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    owner = _owner(f)
    lo, hi = f.start[f.te] + f.lo, f.start[f.te] + f.hi
    key = (f.hi - f.lo) * (len(rank) + 1) + _least(code, lo, hi)
    pairs = _starts(np.bincount(f.te, f.hi - f.lo + 1, len(f.there)).astype(np.int64))
    parts = pairs[:-1] // PAIRS_AT_ONCE
    order = np.empty(len(owner), np.int64)
    for part in np.unique(parts):
        trees = np.flatnonzero(parts == part)
        a, b = f.start[trees[0]], f.start[trees[-1] + 1]
        mine = (f.te >= trees[0]) & (f.te <= trees[-1])
        order[a:b] = a + _leaf_order(owner[a:b], f.start, f.te[mine], lo[mine] - a, hi[mine] - a, key[mine])
    place = np.empty(len(owner), np.int64)
    place[order] = np.arange(len(owner))
    first = _least(place, lo, hi) - f.start[f.te]
    return _arranged(_merged(f._replace(names=f.names.take(pa.array(order)), lo=first, hi=first + f.hi - f.lo)))


def number_text(x: float) -> str:
    """As ``trees.number_text`` writes it."""
    short = repr(float(x)).removesuffix(".0")
    if "e" not in short:
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}.get(short, short)
    exact, (digits, exponent) = Decimal(short), short.split("e")
    if exact.as_tuple().exponent >= -20 and abs(x) < 1e18:
        return format(exact, "f")
    return f"{digits}{'' if '.' in digits else '.0'}E{int(exponent)}"


def _number_texts(x: np.ndarray) -> pa.Array:
    whole = (np.abs(x) < 1e15) & (x == np.trunc(x)) & ~((x == 0) & np.signbit(x))
    if whole.all():
        return pa.array(x.astype(np.int64)).cast(pa.string())
    rest = pa.array([number_text(v) for v in x[~whole].tolist()], pa.string())
    return pc.replace_with_mask(pa.array(np.where(whole, x, 0).astype(np.int64)).cast(pa.string()), pa.array(~whole), rest)


def text(f: Forest, lengths: bool) -> pa.Array:
    f = _only(f, f.there)
    n = np.diff(f.start)
    inner = np.flatnonzero(f.lo < f.hi)
    leaves = np.flatnonzero(f.lo == f.hi)
    every = np.arange(len(n))
    # pieces: opening brackets, leaves, closing brackets, the end of each text
    te = np.concatenate([f.te[inner], f.te[leaves], f.te[inner], every])
    at = np.concatenate([f.lo[inner], f.lo[leaves], f.hi[inner], n])
    kind = np.repeat([0, 1, 2, 3], [len(inner), len(leaves), len(inner), len(n)])
    within = np.concatenate([-f.hi[inner], leaves * 0, -f.lo[inner], every * 0])
    order = np.lexsort((within, kind, at, te))
    marks = pa.array(["(", ")", ";", ",", "", ":"], pa.string())
    body = pa.concat_arrays([marks.take(pa.array(inner * 0)), f.names.take(pa.array(f.start[f.te[leaves]] + f.lo[leaves])),
                             marks.take(pa.array(inner * 0 + 1)), marks.take(pa.array(every * 0 + 2))])
    kind, te = kind[order], te[order]
    comma = np.zeros(len(order), bool)
    comma[1:] = (kind[1:] < 2) & (te[1:] == te[:-1]) & (kind[:-1] != 0)
    parts = [marks.take(pa.array(np.where(comma, 3, 4))), body.take(pa.array(order))]
    if lengths:
        edge = np.concatenate([inner * 0 - 1, leaves, inner, every * 0 - 1])
        root = (f.lo == 0) & (f.hi == n[f.te] - 1) & (n[f.te] > 1)
        edge = np.where((edge >= 0) & ~np.append(root, False)[edge], edge, len(f.te))[order]
        tails = pa.concat_arrays([pc.binary_join_element_wise(":", _number_texts(f.size), ""), pa.array([""], pa.string())])
        parts.append(tails.take(pa.array(edge)))
    pieces = pc.binary_join_element_wise(*parts, "")
    offsets, values = _bytes(pieces)
    bounds = offsets[_starts(np.bincount(te, minlength=len(n)))]
    out = _strings(bounds - bounds[0], values[bounds[0]:bounds[-1]], len(n))
    return pc.if_else(pa.array(f.there), out, pa.scalar(None, pa.string()))


def pairs(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def _lists(columns, missing, kind) -> pa.Array:
    values, mask = np.stack(columns, 1), np.stack(missing, 1)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(values) + 1) * len(columns), pa.int32()), pa.array(values.ravel(), kind, mask=mask.ravel()))


def measures(f: Forest, taxa) -> pa.Array:
    """For each pair of taxa length and number of edges between them and length above both; for each taxon the length above it."""
    count = len(f.there)
    place = [_places(f, t) for t in taxa]
    n, held = np.diff(f.start), np.cumsum(np.bincount(f.te, minlength=count))
    is_leaf = np.arange(len(f.te)) >= (held - n)[f.te]
    own = [np.append(f.size, 0.0)[np.where(p >= 0, held - n + p, -1)] for p in place]
    inner = _covering(f._replace(te=f.te[~is_leaf], lo=f.lo[~is_leaf], hi=f.hi[~is_leaf], size=f.size[~is_leaf]))
    holds = [(inner.lo <= p[inner.te]) & (inner.hi >= p[inner.te]) & (p[inner.te] >= 0) for p in place]

    def total(which):
        return np.bincount(inner.te[which], inner.size[which], count)

    apart, steps, above, gone = [], [], [], []
    for a, b in pairs(len(taxa)):
        between = holds[a] != holds[b]
        apart.append(own[a] + own[b] + total(between))
        steps.append(np.bincount(inner.te[between], minlength=count) + 2)
        above.append(total(holds[a] & holds[b]))
        gone.append((place[a] < 0) | (place[b] < 0))
    above += [total(h) + x for h, x in zip(holds, own)]
    lists = [_lists(apart, gone, pa.float64()), _lists(steps, gone, pa.int32()), _lists(above, gone + [p < 0 for p in place], pa.float64())]
    return pa.StructArray.from_arrays(lists, ["apart", "steps", "above"])
