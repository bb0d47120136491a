"""Personal data by weak supervision.

Strict patterns find the base spans, which always stay. Wider patterns propose more: other spellings of the same kinds, and
secrets. On every span, base or proposed, four labelers vote yes, no or nothing: the shape of the span, a gazetteer, the words before
it, and its borders. Expectation-maximisation estimates each labeler's reliability from the counts of all
vote patterns of the corpus, and a logistic classifier is then trained on the patterns with these posteriors as soft
labels; it decides on the proposed spans. Votes and features are few discrete values, so what is gathered is one count
for each pattern, at most ``PATTERNS`` of them at any size of the corpus.

Cases: NULL text is empty and has no spans; an empty table trains nothing and proposes nothing; repeated rows and NULL doc_ids
keep a row each; long texts are scanned whole, with patterns that don't go back over what they have read.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TEN = tuple("0123456789")
_LEAST_SECRET = 8
# proposals: kind, pattern, strings of which a text must hold one for the pattern to match
_PROPOSALS = (
    (0, re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
                   r"(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,24}){1,4}(?![\w])"), (" at ", "(at)", "[at]")),
    (1, re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])"), (":",)),
    (2, re.compile(r"(?<![\w-])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])"), _TEN),
    (3, re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"), _TEN),
    (3, re.compile(r"(?<![\w+.-])00[1-9][0-9 ().-]{6,18}[0-9](?![\w-])"), ("00",)),
    (4, re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?([^\s\"']{8,}+)[\"']?"), ("=", ":")),
    (4, re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"), ("AKIA",)),
    (4, re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"), _TEN),
)
# words that speak for a kind when they stand before a span
_CUES = tuple(re.compile(p, re.I) for p in (
    r"\b(?:mail|e-mail|contact|write|from|to)\W*$", r"\b(?:ip|host|server|address|login from)\W*$",
    r"\b(?:card|visa|amex|credit|pay\w*)\W*$", r"\b(?:tel|phone|call|mobile|fax|dial)\W*$",
    r"\b(?:key|login|credentials?|auth\w*|password|token|secret)\W*$"))
_AGAINST = re.compile(r"\b(?:version|v|page|section|isbn|issn|no|nr|order|item|id|build|release)\W*$", re.I)
_TLDS = frozenset("com org net edu gov io de fr es uk info eu co us ch at it nl".split())
_KEYS = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)|AKIA")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The strict spans (kind, start, end): leftmost and not overlapping within each kind."""
    out = []
    # an address grows from its @ in both directions, so runs without one cost nothing
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if any(map(text.__contains__, _TEN)):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def _beside(m: re.Match, edges: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """A secret's span; where spans taken lie in it, the stretches of its value beside them that are long enough."""
    start, end = m.span()
    k, value = bisect_right(ends, start), m.start(m.lastindex or 0)
    if k == len(ends) or edges[k][0] >= end:
        return [(start, end)]
    out, since = [], value
    head = start if edges[k][0] >= value else value  # the key word goes with the first stretch
    for s, e in [*itertools.takewhile(lambda x: x[0] < end, itertools.islice(edges, k, None)), (end, end)]:
        if s - since >= _LEAST_SECRET:
            out.append((head if since == value else since, s))
        since = max(since, e)
    return out


def proposed_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wider spans that touch none of the spans taken and none of each other."""
    found = []
    edges: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if edges and s <= edges[-1][1]:
            edges[-1] = (edges[-1][0], max(edges[-1][1], e))
        else:
            edges.append((s, e))
    ends = [e for _, e in edges]
    for kind, pattern, needed in _PROPOSALS:
        if any(map(text.__contains__, needed)):
            for m in pattern.finditer(text):
                found += [(kind, *span) for span in (_beside(m, edges, ends) if kind == 4 else [m.span()])]
    out, upto, k, reach = [], 0, 0, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while k < len(edges) and edges[k][0] < e:
            reach = max(reach, edges[k][1])
            k += 1
        if s >= upto and s >= reach:
            out.append((kind, s, e))
            upto = e
    return out


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, 0 against, 2 none."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - 24) : start]
    if kind == 0:
        shape = 1 if re.search(r"@|\(at\)|\[at\]|\(dot\)|\[dot\]| dot ", span) else 0
        gazetteer = 1 if re.split(r"\W+", span.rstrip(")]."))[-1].lower() in _TLDS else 2
    elif kind == 1:
        shape = 1 if ":" in span or not re.fullmatch(r"(?:[0-9]\.){3}[0-9]", span) else 0
        gazetteer = 0 if span.startswith(("0.", "127.", "255.")) else 2
    elif kind == 2:
        shape = 1 if _luhn(digits) else 0
        gazetteer = 1 if digits[0] in "3456" else 0
    elif kind == 3:
        shape = 1 if 8 <= len(digits) <= 15 else 0
        gazetteer = 1 if span[0] in "+(" or span.startswith("00") else 2
    else:
        shape = 1 if len(set(span)) >= 8 and any(c.isdigit() for c in span) else 0
        gazetteer = 1 if _KEYS.match(span) else 2
    context = 0 if _AGAINST.search(before) else 1 if _CUES[kind].search(before) else 2
    left, right = text[start - 1 : start], text[end : end + 1]
    border = 1 if (not left or left.isspace() or left in "(<\"'") and (not right or right.isspace() or right in ".,;:)>\"'") else 0
    return shape, gazetteer, context, border


def _code(text: str, kind: int, start: int, end: int) -> int:
    """Kind, votes and two coarse features of a span as one number."""
    span = text[start:end]
    share = len(_digits(span)) * 3 // (len(span) + 1)
    size = 0 if len(span) < 12 else 1 if len(span) < 24 else 2
    code = kind
    for v in (*votes(text, kind, start, end), share, size):
        code = code * 3 + v
    return code


PATTERNS = len(KINDS) * 3 ** (LABELERS + 2)


def decode(code: int) -> list[int]:
    out = []
    for _ in range(LABELERS + 2):
        code, v = divmod(code, 3)
        out.append(v)
    return [code, *reversed(out)]


def fit_reliabilities(votes_seen: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and each labeler's vote probabilities given no and yes."""
    # start from labelers that are right more often than not
    table = np.tile(np.array([[[0.5, 0.2, 0.3], [0.15, 0.55, 0.3]]]), (LABELERS, 1, 1))
    share, posterior = 0.5, np.full(len(n), 0.5)
    for _ in range(rounds):
        odds = np.log([1 - share, share])[:, None] + sum(np.log(table[j][:, votes_seen[:, j]]) for j in range(LABELERS))
        new = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -60, 60)))
        for j in range(LABELERS):
            for y, weight in ((0, 1 - new), (1, new)):
                seen = np.bincount(votes_seen[:, j], weight * n, minlength=3)
                # a few counts of the starting table keep unseen votes possible
                start = 4 * np.array([[0.5, 0.2, 0.3], [0.15, 0.55, 0.3]][y])
                table[j, y] = (seen + start) / (seen + start).sum()
        share = float(np.clip((new * n).sum() / n.sum(), 0.01, 0.99))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return new, table


def _features(codes: np.ndarray) -> np.ndarray:
    parts = np.array([decode(int(c)) for c in codes]).reshape(-1, LABELERS + 3)
    blocks = [np.eye(len(KINDS))[parts[:, 0]]] + [np.eye(3)[parts[:, k]] for k in range(1, LABELERS + 3)]
    return np.hstack(blocks)


def train_classifier(codes: np.ndarray, n: np.ndarray, soft: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic classifier on soft labels, each pattern with its count, by Newton's method."""
    x = _features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (soft - p)) - penalty * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(counts: list[tuple[int, int]]) -> list[int]:
    """The pattern codes that the trained classifier accepts."""
    if not counts:
        return []
    codes, n = np.array([c for c, _ in counts]), np.array([m for _, m in counts], float)
    kinds = codes // 3 ** (LABELERS + 2)
    seen = np.array([decode(int(c)) for c in codes])[:, 1 : 1 + LABELERS]
    soft = np.zeros(len(codes))
    for kind in np.unique(kinds):  # reliabilities differ by kind
        of = kinds == kind
        soft[of] = fit_reliabilities(seen[of], n[of])[0]
    weights = train_classifier(codes, n, soft)
    return [int(c) for c, score in zip(codes, _features(codes) @ weights, strict=True) if score >= 0]


_SPANS = "array<struct<kind:int,start:int,end:int,code:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))


def _found(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    more = proposed_spans(text, base)
    shown = lambda spans: [{"kind": k, "start": s, "end": e, "code": _code(text, k, s, e)} for k, s, e in spans]
    return shown(base), shown(more)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and the base and proposed spans with their pattern codes."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column(1):
                b, m = _found(text.as_py() or "")
                base.append(b)
                more.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN_ARROW), pa.array(more, _SPAN_ARROW)],
                                             names=["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, base {_SPANS}, more {_SPANS}")


def accepted_codes(found: DataFrame) -> list[int]:
    """Fit on the counts of all patterns in ``base`` and ``more``; at most PATTERNS rows are collected."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.code").count()
    return learn(sorted((r["code"], r["count"]) for r in spans.collect()))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = stored(detect(docs), "pii-spans")
    good = F.array(*map(F.lit, accepted_codes(found))).cast("array<int>")
    spans = F.concat("base", F.filter("more", lambda s: F.array_contains(good, s["code"])))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{KINDS[k]}") for k in range(4)],
                        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, if there, follows the text."""
    good = frozenset(accepted_codes(stored(detect(docs), "pii-spans")))  # at most PATTERNS codes
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        base, more = _found(text)
        parts, upto = [], 0
        for s in sorted([*base, *(m for m in more if m["code"] in good)], key=lambda x: (x["start"], -x["end"])):
            if s["end"] <= upto:
                continue
            if s["start"] >= upto:
                parts += [text[upto : s["start"]], f"[{KINDS[s['kind']]}]"]
            upto = s["end"]
        return "".join([*parts, text[upto:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [hide(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                was = columns[chars].to_pylist()
                columns[chars] = pa.array([w if a == b or w is None else len(b) for w, a, b in zip(was, old, new, strict=True)],
                                          batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)


