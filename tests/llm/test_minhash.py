import random

from cladekit.llm import minhash
from cladekit.llm.queries import QUERIES


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, width):
    sets = [(d, shingle_set(t, width)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(s), top(d), top(d) == d) for d, s in sets}


def test_query(spark, folder, texts):
    rows = QUERIES["op4_multi_index_minhash"](spark, folder).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == brute(sorted(texts.items()), 2)


def near_copies(n, seed=3):
    """One hot group of edited copies, of which many pairs are not similar to each other."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(5000)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(pick.randrange(0, 11)):
            words[pick.randrange(len(words))] = f"e{pick.randrange(10_000)}"
        out.append((k, " ".join(words)))
    return out + [(n + k, " ".join(f"v{pick.randrange(4000)}" for _ in range(90))) for k in range(40)]


def test_hot_group(spark):
    docs = near_copies(160)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r[0]: tuple(r)[1:] for r in minhash.groups(df, 2).collect()} == brute(docs, 2)


def framed(n, shared, own, seed=5):
    """Texts of one frame, each with words of its own: under a common key often, similar never."""
    pick = random.Random(seed)
    frame = [f"f{k}" for k in range(shared)]
    return [(k, " ".join(frame + [f"o{pick.randrange(10**9)}" for _ in range(own)])) for k in range(n)]


def test_texts_of_one_frame_are_not_compared(spark, monkeypatch):
    """Documents that share a frame are not linked, and no pair of blocks is made; linked ones among them are found."""
    docs = framed(500, 150, 50)
    twins = [(1000 + k, docs[k][1] + " one more") for k in range(0, 40, 4)]
    made = []
    inner = minhash._between
    monkeypatch.setattr(minhash, "_between", lambda *a: made.append(1) or inner(*a))
    df = spark.createDataFrame(docs + twins, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in minhash.groups(df, 2).collect()}
    assert got == brute(docs + twins, 2)
    texts = df.selectExpr("doc_id as id", "cast(text as binary) as text")
    every = spark.createDataFrame([(1, d, d) for d, _ in docs], "key long, id long, c long")
    assert minhash._prefixes(every, texts, 2, 80).count() == 0


def test_prefixes_keep_all_links(spark):
    """Every linked pair of different components shares a shingle of its prefixes, at any similarity."""
    docs = near_copies(90, seed=9) + [(500 + k, t) for k, t in framed(40, 60, 12)]
    texts = spark.createDataFrame([(d, bytearray(t.encode())) for d, t in docs], "id long, text binary")
    every = spark.createDataFrame([(1, d, d) for d, _ in docs], "key long, id long, c long")
    for similarity in (80, 95, 60):
        held = {}
        for r in minhash._prefixes(every, texts, 2, similarity).collect():
            held.setdefault(r["id"], set()).add(r["key"])
        sets = {d: shingle_set(t, 2) for d, t in docs}
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and 100 * len(x & y) >= similarity * len(x | y):
                    assert held[a] & held[b], (a, b)


def test_planted_pairs_just_above_the_limit(spark):
    """Recall over pairs of similarity 0.80 to 0.85, of whole sets: every one is found."""
    pick = random.Random(11)
    docs, pairs = [], []
    for k in range(300):
        words = [f"p{pick.randrange(10**9)}" for _ in range(200)]
        other = list(words)
        for at in pick.sample(range(0, 200, 3), 9 + k % 3):
            other[at] = f"q{pick.randrange(10**9)}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        x, y = (shingle_set(docs[-i][1], 2) for i in (2, 1))
        if 80 * len(x | y) <= 100 * len(x & y) <= 86 * len(x | y):
            pairs.append(k)
    rows = {r["doc_id"]: r["component_id"] for r in minhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    found = [rows[2 * k] == rows[2 * k + 1] for k in pairs]
    assert len(pairs) > 150 and all(found)


def test_odd_rows(odd, odd_rows, empty):
    got = minhash.groups(odd, 2).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert (by_id[1]["n_shingles"], by_id[2]["component_id"], by_id[4]["kept"]) == (0, 2, True)
    assert (by_id[6]["component_id"], by_id[7]["component_id"], by_id[7]["kept"]) == (6, 6, False)
    assert minhash.groups(empty, 2).collect() == []
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in odd_rows} - {7}


def test_pigeonhole():
    """Signatures that differ in as many components as are guaranteed share a key."""
    import numpy as np

    rng = np.random.default_rng(1)
    limit = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for _ in range(50):
        a = rng.integers(0, 1 << 16, minhash.CHUNKS * minhash.WIDTH).astype(np.uint64)
        b = a.copy()
        b[rng.choice(len(a), limit, replace=False)] += np.uint64(1)
        assert set(minhash.keys(a).tolist()) & set(minhash.keys(b).tolist())


def test_texts_of_one_id_link_classes_led_by_others(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, one), (4, two), (5, one), (5, two)]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (4, 3), (5, 3), (5, 3)]
