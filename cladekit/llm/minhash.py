"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A signature has ``CHUNKS * WIDTH`` components of ``BITS`` bits; its distance to another is the number of components that
differ. If two signatures differ in at most ``CHUNKS * (ERRORS + 1) - 1`` components, then, by the pigeonhole principle, some chunk
has at most ``ERRORS`` differing components. So a document is filed under every chunk with every choice of ``ERRORS``
components left out, and all pairs within that distance meet under a key. With 12 chunks of 6 and one error (distance 23 of
72), a pair of similarity 0.8 meets nowhere with probability 3e-6. Pairs that meet are confirmed on their full shingle sets.

Documents of equal sets are one class first, so copies are never compared. Within the documents under a key, links are
sought from a leader (another one each round, and only to documents not yet in its component). At the end all documents
of different components that still share a key are looked at: those whose prefixes share a shingle are compared block against
block. Links inside one component would change nothing.

Cases: NULL or empty text has no shingles, is linked with nothing and stays its own component; fewer words than a
shingle form one; a NULL doc_id is not linked, has component NULL and is kept; rows of one doc_id are one document whose
texts all link it; empty tables work; further columns are kept by ``keep_one``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, numbered, stored, text_bytes

CHUNKS, WIDTH, ERRORS, BITS = 12, 6, 1, 16
SIMILARITY = 80  # hundredths
ROUNDS = 2
BLOCK_DOCS = 256
TIER_BYTES = 1 << 15  # blocks of shorter texts have BLOCK_DOCS of them
ROWS = 65_536  # shingles in a batch
COLUMNS = 8192
_REMEMBERED = 600_000

_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ _U(key)) * _U(0x9FB21C651E98DF25)
    x = (x ^ (x >> _U(35))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = found
        return found


_WORDS = _Hashes()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; a shorter text is one shingle."""
    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII spaces separate
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > _REMEMBERED:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        out = _mix(out + h[k : k + n], k + 1)
    return np.unique(out)


_SEEDS = np.random.default_rng(20240229)
_ODD = _SEEDS.integers(0, 1 << 63, CHUNKS * WIDTH, np.uint64) * _U(2) + _U(1)
_ADD = _SEEDS.integers(0, 1 << 63, CHUNKS * WIDTH, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The BITS top bits of each component's least value."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        some = hashes[at : at + 2048, None] * _ODD + _ADD
        np.minimum(least, some.min(axis=0), out=least)
    return _mix(least, 77) >> _U(64 - BITS)


_KEPT = np.array(list(itertools.combinations(range(WIDTH), WIDTH - ERRORS)))


def keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each chunk and each choice of the components kept."""
    parts = sig.reshape(CHUNKS, WIDTH)[:, _KEPT]  # chunks x choices x kept
    tag = np.arange(CHUNKS * len(_KEPT), dtype=np.uint64).reshape(CHUNKS, len(_KEPT))
    out = _mix(tag, 99)
    for k in range(parts.shape[2]):
        out = _mix(out + parts[:, :, k], k + 11)
    return out.ravel()


_SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                           ("keys", pa.list_(pa.int64()))])


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Each document's set size, a 128-bit fingerprint of its set, and the keys it is filed under."""
    def run(batches):
        for batch in batches:
            n, f1, f2, filed = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                f1.append(int(_mix(s, 5).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(_mix(s, 6).sum(dtype=np.uint64).astype(np.int64)))
                filed.append(keys(signature(s)).astype(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, f1, f2)),
                                              pa.array(filed, pa.list_(pa.int64()))], schema=_SKETCH_ARROW)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, _SKETCH)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets reach the similarity."""
    def run(batches):
        last, held = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last is None or last[0] != a or last[1] != x:
                    last, held = (a, x), shingles(x.as_py(), width)
                s = shingles(y.as_py(), width)
                both = len(np.intersect1d(held, s, assume_unique=True))
                good.append(100 * both >= similarity * (len(held) + len(s) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (``key``, ``id``, component ``c``) of the keys whose documents are of different components."""
    labelled = (members.select("key", "id").join(found, "id", "left")
                .select("key", "id", F.coalesce("component", "id").alias("c")))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("_min"), F.max("c").alias("_max"), F.count("*").alias("_n"))
    # the pair under a key of two has been tested from its leader
    return labelled.join(mixed.where("_min != _max AND _n > 2").select("key"), "key")


_TOKENS = pa.schema([("id", pa.int64()), ("c", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])


def _tokens(rows: DataFrame, width: int) -> DataFrame:
    """A row for each shingle of each text: ``id``, ``c``, ``own`` (which of the id's texts), ``n`` (set size), ``h``."""
    def run(batches):
        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                s = shingles(text.as_py(), width).astype(np.int64)
                fixed = [batch.column(i)[k].as_py() for i in (0, 1, 3)]
                for at in range(0, len(s), ROWS):
                    part = s[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), v), pa.int64()) for v in (*fixed, len(s))] + [pa.array(part)], schema=_TOKENS)

    return rows.select("id", "c", "text", F.xxhash64("text").alias("own")).mapInArrow(run, "id long, c long, own long, n long, h long")


def _prefixes(open_: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Members (``key``, ``id``, ``c``) under the shingles that a link between two components must share.

    Similar sets share more than what is left of either when so many of its shingles are taken off that the rest is too small
    (a prefix, in any order common to all). Shingles that lie in one component only come first, then the rare ones. So of texts
    that share a frame but are not similar, the prefixes hold what is their own, and nothing is left to compare.
    """
    ids = open_.select("id", "c").distinct()
    tokens = stored(_tokens(ids.join(texts, "id"), width), "open-shingles")
    often = tokens.groupBy("h").agg(F.count("*").alias("df"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi")
    shared = tokens.join(often.select("h", "df"), "h")
    of_text = Window.partitionBy("id", "own")
    # as many of a text's shingles as lie in one component only stand before these
    size = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1 - (F.col("n") - F.col("_m"))
    kept = shared.withColumns({"_m": F.count("*").over(of_text), "_at": F.row_number().over(of_text.orderBy("df", "h"))}).where(
        F.col("_at") <= size).select(F.col("h").alias("key"), "id", "c").distinct()
    kept = stored(kept, "open-prefixes")
    mixed = kept.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select("key")
    return kept.join(mixed, "key")


def _rest(members: DataFrame, found: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links between different components among all documents that share a key, whoever leads it.

    Of these documents only those are compared whose prefixes share a shingle. Documents that such shingles connect are
    numbered next to each other, components together, and cut into blocks of ``BLOCK_DOCS``, fewer if they are long. Two
    blocks with a common shingle are compared as a whole, by one product of their incidence matrices, so
    rows are made for pairs of blocks and for links, not for pairs of documents.
    """
    open_ = stored(_prefixes(stored(_mixed(members, found), "key-mixed"), texts, width, similarity), "prefix-mixed")
    lead = open_.groupBy("key").agg(F.min("id").alias("a"))
    near = components(open_.join(lead, "key").select("a", F.col("id").alias("b")), "near")
    sizes = texts.groupBy("id").agg(F.sum(F.length("text")).alias("_bytes"))
    ids = open_.select("id", "c").distinct().join(near.withColumnRenamed("component", "near"), "id").join(sizes, "id")
    # four times as long, a quarter as many in a block
    ids = ids.withColumn("tier", F.greatest(F.lit(0), F.ceil(F.log(F.col("_bytes") / TIER_BYTES) / F.log(F.lit(4.0)))).cast("int")).drop("_bytes")
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_DOCS) / F.pow(F.lit(4.0), F.col("tier"))))
    placed = numbered(ids, F.col("tier"), F.col("near"), F.col("c"), F.col("id"), label="near-order").select(
        "id", "c", (F.col("tier").cast("long") * (1 << 48) + F.floor(F.col("row") / rows)).alias("block"))
    placed = stored(placed, "near-blocks")
    held = open_.join(placed.select("id", "block"), "id").groupBy("key", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    x, y = (held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi")]) for side in "xy")
    differ = (F.least("lo_x", "lo_y") != F.greatest("hi_x", "hi_y")) & (F.col("block_x") <= F.col("block_y"))
    pairs = x.join(y, "key").where(differ).select("block_x", "block_y").distinct()
    blocks = placed.join(texts, "id").groupBy("block").agg(F.collect_list(F.struct("id", "c", "text")).alias("docs"))
    left, right = (blocks.select(F.col("block").alias(f"block_{side}"), F.col("docs").alias(f"docs_{side}")) for side in "xy")

    def compare(batches):
        last, one = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                bx, by = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if last != bx:
                    last, one = bx, _block(batch.column(2)[i].as_py(), width)
                other = one if by == bx else _block(batch.column(3)[i].as_py(), width)
                a, b = _between(one, other, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (pairs.join(right, "block_y").join(left, "block_x").select("block_x", "block_y", "docs_x", "docs_y")
            .mapInArrow(compare, "a long, b long"))


def _block(docs: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (np.array([d["id"] for d in docs]), np.array([d["c"] for d in docs]), [shingles(d["text"], width) for d in docs])


def _between(one: tuple, other: tuple, similarity: int) -> tuple[list[int], list[int]]:
    """Linked documents of two blocks, one pair for each two components."""
    sides = []
    for _, _, sets in (one, other):
        flat = np.concatenate(sets)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    if one is other:
        values, n = np.unique(sides[0][0], return_counts=True)
        shared = values[n > 1]
    else:
        shared = np.intersect1d(sides[0][0], sides[1][0])
    both = np.zeros((len(one[0]), len(other[0])), np.int64)
    for at in range(0, len(shared), COLUMNS):
        some = shared[at : at + COLUMNS]
        parts = []
        for (flat, owner), (ids, _, _) in zip(sides, (one, other), strict=True):
            place = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[place] == flat
            m = np.zeros((len(ids), len(some)), np.float32)
            m[owner[hit], place[hit]] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    size = [np.array([len(s) for s in x[2]]) for x in (one, other)]
    linked = (100 * both >= similarity * (size[0][:, None] + size[1][None, :] - both)) & (one[1][:, None] != other[1][None, :])
    i, j = np.nonzero(linked)
    if not len(i):
        return [], []
    _, first = np.unique(np.stack([one[1][i], other[1][j]], axis=1), axis=0, return_index=True)
    return one[0][i[first]].tolist(), other[0][j[first]].tolist()


def link(docs: DataFrame, width: int, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its sketch and class representative (``rep``), and the component of linked representatives."""
    sketches = stored(sketch(docs, width), "sketches")
    set_key = ["n_shingles", "f1", "f2"]
    named = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy(*set_key).agg(F.min(F.struct("doc_id", "keys")).alias("m"))
    classes = stored(classes.select(*set_key, F.col("m.doc_id").alias("rep"), F.col("m.keys").alias("keys")), "classes")
    # a doc_id with several texts links their classes with each other, whoever leads them
    sets = F.struct(*set_key)
    many = named.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo != hi").select("doc_id")
    led = (named.select("doc_id", *set_key).join(many, "doc_id").distinct()
           .join(classes.select(*set_key, "rep"), set_key).select("doc_id", "rep"))
    several = (led.join(led.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep != a")
               .select("a", F.col("rep").alias("b")).distinct())

    filed = classes.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    shared = filed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("_last")).where("lead != _last")
    members = stored(filed.join(shared.select("key", "lead"), "key"), "key-members")
    wanted = members.select("id").distinct()
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
             .where("length(text) > 0").join(wanted, "id"))
    texts = stored(texts, "candidate-texts")

    tested = stored(members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs-0")
    links = stored(_confirm(tested, texts, width, similarity).union(several), "links-0")
    found = components(links, "group-0")
    for turn in range(1, ROUNDS + 1):
        open_ = _mixed(members, found)
        lead = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "c")).alias("m")).select(
            "key", F.col("m.id").alias("x"), F.col("m.c").alias("cx"))
        pairs = open_.join(lead, "key").where("c != cx").select(
            F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
        new = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{turn}")
        more = stored(_confirm(new, texts, width, similarity), f"links-{turn}")
        tested = tested.union(new)
        if more.limit(1).count():
            links = links.union(more)
            found = components(links, f"group-{turn}")
    rest = stored(_rest(members, found, texts, width, similarity), "links-rest")
    if rest.limit(1).count():
        found = components(links.union(rest), "group-rest")
    return sketches.join(classes.select(*set_key, "rep"), set_key, "left"), found


def groups(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    rows, found = link(docs, width, similarity)
    # a row without words or id is in no class
    named = rows.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = named.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    own = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id; all columns are kept."""
    gone = groups(docs, width, similarity).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
