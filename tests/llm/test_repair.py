import hashlib
import itertools
import random
import zlib

import pytest

from cladekit.llm import repair as R
from cladekit.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part long, at long, open boolean, gone string, cost int, tie int"
EXTRA = (1, 2, True, "g", -1, 0)
INSERTS = {0: [(0, ""), (2, "I"), (3, "II")], 1: [(1, ""), (2, "I"), (3, "II")], 2: [(2, ""), (3, "I")], 3: [(3, ""), (2, "I")]}


def brute(rows, start=0, goal=None):
    """Cheapest (cost, audit) by all edits of all rows, state by state."""
    at = {start: (0, "")}
    for ch in rows:
        new = {}
        for g, (cost, audit) in at.items():
            for q, put in INSERTS[g]:
                edits = [(q, 4, "D")]
                if ch != "-":
                    kind, cut = R._ROW[ch]
                    if (q, kind) in R._STEP:
                        edits.append((R._STEP[q, kind], 3 * cut, "K"))
                    edits.append((3 if q == 2 else 2, 3 + 3 * cut, "R"))
                for to, more, edit in edits:
                    found = (cost + 3 * len(put) + more, audit + put + edit)
                    new[to] = min(new.get(to, found), found)
        at = new
    if goal is not None:
        return at.get(goal)
    return min((c + 3 * len(R._TAIL[g]), a + R._TAIL[g]) for g, (c, a) in at.items())


def test_search_is_cheapest_and_ascii_least():
    pick = random.Random(1)
    short = ["".join(t) for n in range(4) for t in itertools.product("suaxSUAX-", repeat=n)]
    for s in short + ["".join(pick.choice("suaxSUAX-") for _ in range(k % 9)) for k in range(500)]:
        assert R.cheapest(s) == brute(s), s
    for s in short[:200]:
        for g in range(4):
            for to in range(4):
                assert R.cheapest(s, g, to) == brute(s, g, to), (s, g, to)


def test_chained_blocks_equal_one_search():
    pick = random.Random(2)
    for _ in range(40):
        s = "".join(pick.choice("uuaauasxUA-") for _ in range(pick.randrange(9, 60)))
        assert R.repair_rows(s) == brute(s), s


def expected(rows, damaged=True):
    """The contract in plain Python: conv -> result."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        name = [" " if v is None else str(v) for v in (conv, turn)]
        d = zlib.crc32(":".join(name).encode()) % 20 if damaged else 19
        role, text = (" " if v is None else v for v in (role, text))
        out = convs.setdefault(conv, [])
        key = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [] if d == 0 else [(key, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    result = {}
    for conv, lines in convs.items():
        lines.sort(key=lambda r: r[0])
        seen, symbols, faults, kinds = set(), "", [], []
        for _, _, role, text in lines:
            core = text.rstrip(R.WHITE)
            fault = (R.BLANK if not core else R.DUPLICATE if (role, text) in seen else R.FINE if core[-1] in ".!?" else R.CUT_OFF)
            seen.add((role, text))
            faults.append(fault)
            kinds.append(role[:1])
            symbols += R.symbol(role[:1], fault)
        cost, audit = brute(symbols)
        turns = {r[1] for r in lines} - {None}
        edits, tail = R.apply_audit(symbols, audit)
        text = []
        for (before, to), r in zip(edits, lines, strict=True):
            text += [R.NAMES[k] + ":" for k in before] + ([] if to is None else [f"{to or r[2]}:{r[3]}"])
        text += [R.NAMES[k] + ":" for k in tail]
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(R.BLANK), faults.count(R.DUPLICATE),
                        faults.count(R.CUT_OFF), sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False)),
                        cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return result


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in R.RESULT.arrow.names[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, folder)) == expected(rows)
    assert "op12_conversation_repair" in ORACLES


def conversations():
    pick = random.Random(3)
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "Why?", "ok.  \n", "née…", None, "long text. " * 200]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    out = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "a."), (7, None, "assistant", "b."), (7, 3, "user", "c."), (7, 3, "user", "c.")]
    out += [(100, t, "user" if t % 2 == 0 else "assistant", pick.choice(texts)) for t in range(400)]  # hot, over several ranges
    out += [(101, t, pick.choice(roles), pick.choice(texts)) for t in range(60)]
    for conv in range(200, 260):
        out += [(conv, t, pick.choice(roles[:5]), pick.choice(texts)) for t in range(pick.randrange(1, 9))]
    return out


@pytest.mark.parametrize("held", [R.HELD, 300])
def test_odd_rows(spark, held):
    rows = conversations()
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)
    assert found(R.repair(R.damage(df), held)) == expected(rows)
    assert found(R.repair(R.plain(df), held)) == expected(rows, damaged=False)


def test_dropped_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", *EXTRA)], SCHEMA)
    assert found(R.repair(R.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repair(R.damage(df.limit(0))).collect() == []
