import hashlib
import re

import numpy as np
import pytest

from cladekit.llm import pii
from cladekit.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


HARD = ["a@b.c@d.e x@y@z.w @q.r a@ b.c@d..e.f-.g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3.4567", "4111 1111 1111 1111 4111-1111-1111-1112",
        "+1 (555) 555-0100, +12 +123456789012345678 ++4 4 4 4 4 4 4 4", "é@b.cd ñ1.1.1.1", "9" * 3000, "1." * 2000, "a" * 3000 + "@", "1 " * 900, ""]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert pii.base_spans(text) == brute(text)


def test_query(spark, folder, texts):
    for r in QUERIES["op10_weak_supervision_pii"](spark, folder).collect():
        base = brute(texts[r["doc_id"]])
        written = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[0] == k for b in base) for k in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(written) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.4
    right = np.array([0.95, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((40_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    seen, n = np.unique(votes, axis=0, return_counts=True)
    posterior, table = pii.fit_reliabilities(seen, n.astype(float))
    assert np.abs(table[:, 1, 1] - right).max() < 0.06
    which = {tuple(v): p for v, p in zip(seen.tolist(), posterior, strict=True)}
    accuracy = np.mean([(which[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)])
    assert accuracy > 0.94


def test_proposals_held_out(spark):
    """A classifier trained on one part finds secrets in the other and leaves version numbers alone."""
    def made(seed, n):
        rng = np.random.default_rng(seed)
        out = []
        for k in range(n):
            word = "".join(rng.choice(list("0123456789abcdef"), 20))
            out.append((k, f"some words password={word} and more") if k % 2 else (k, "read page 555-555-5555 no 555 555 5555 later"))
        return out

    codes = pii.accepted_codes(pii.detect(spark.createDataFrame(made(1, 200), "doc_id long, text string")))
    hits = [any(s["code"] in codes for s in pii._found(t)[1] if s["kind"] == 4) for _, t in made(2, 100)]
    assert hits == [k % 2 == 1 for k in range(100)]


def test_odd_rows(odd, odd_rows, empty):
    got = pii.report(odd).collect()
    assert len(got) == len(odd_rows)
    assert sum(r["n_email"] for r in got) == 1 and sum(r["n_phone"] for r in got) == 1
    assert pii.report(empty).collect() == []
    hidden = pii.redact(odd)
    assert hidden.columns == odd.columns
    text = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert text[13] == "Mail [email] or [phone]" and text[1] is None
    assert pii.redact(empty).collect() == []


def test_long_secrets_are_whole():
    """A secret of any length is proposed to its end, and its border speaks for it."""
    token = "token=" + "aB3-x_" * 150
    digits = "0123456789abcdef" * 20
    for secret in (token, digits):
        text = f"see {secret} here"
        assert pii.proposed_spans(text, pii.base_spans(text)) == [(4, 4, 4 + len(secret))]
        assert pii.votes(text, 4, 4, 4 + len(secret))[3] == 1


def test_secret_around_base_span():
    """An address far inside a long value takes nothing of the rest of the value out of the proposals."""
    head, tail = "token=" + "aB3x" * 100, "&k=" + "Zy9" * 10
    text = f"{head}&to:me@example.org{tail}"
    base = pii.base_spans(text)
    assert [text[s:e] for _, s, e in base] == ["me@example.org"]
    assert [text[s:e] for _, s, e in pii.proposed_spans(text, base)] == [f"{head}&to:", tail]
    text = "password: me@example.org"
    assert pii.proposed_spans(text, pii.base_spans(text)) == []
