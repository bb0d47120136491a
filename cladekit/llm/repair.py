"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, by turn, become the cheapest sequence of edits (Delete, Insert, Keep, Rerole) whose roles read
``(s?(ua)+)?``. The search goes depth first through the edits in ASCII order under a cost bound that rises to the least
value that was cut off; a table of failed states (row, grammar state, whether an insert may follow) with the budget they failed
under cuts repeats. So the first accepting path is the cheapest and, of equally cheap ones, the ASCII-least. The estimate of
what is left: what faulty rows cost at least, and a heaviest set of disjoint illegal neighbours.

Long conversations are cut into blocks of rows. A block is searched from each grammar state to each, and the blocks are
chained by (cost, audit). Inserts stand before a row, or at the very end; so of two different audits of one block none begins
the other, and the chain's answer is that of one search over the whole.

Rows are range-partitioned by conversation and turn. A conversation that lies in one task's range is repaired as it passes.
Those at the borders of ranges, and those with more than ``HELD`` bytes, stay as rows: their pieces are searched where they
are, one small table of costs and audits a piece is chained, and the repaired lines of a conversation pass its digest as a
stream. So no task holds a long conversation's texts (SHA-256 is sequential: one task reads a conversation's lines for it).

Cases: NULL role and text count as one space; NULL turns stand first, equal turns by role, then md5 of text; NULL conv_ids
are one conversation; repeated rows are duplicates; a conversation whose rows all went has zeros, an empty audit and the
digest of the empty text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK = 8  # rows searched at once
HELD = 16 << 20  # bytes of text a task keeps of one conversation
CACHED = 1 << 16  # blocks whose result is remembered
WHITE = " \t\n\x0b\x0c\r"

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs; Keep has none
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states, by the role read last
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)  # faults of a row
NAMES = {"u": "user", "a": "assistant"}
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


# -- the search -----------------------------------------------------------------------------------------------------------

def symbol(initial: str, fault: int) -> str:
    """A row as one character: ``-`` if it must go, the initial in upper case if it is truncated."""
    kind = initial if initial in ("s", "u", "a") else "x"
    return {FINE: kind, CUT_OFF: kind.upper()}.get(fault, "-")


_ROW = {**{k: (k, 0) for k in "suax"}, **{k.upper(): (k, 1) for k in "suax"}}


def estimates(rows: str) -> list[tuple[int, int, int, int]]:
    """For each row and each grammar state before it, the least cost of the row and all after it.

    A row that must go, is truncated or has a role of no use costs its cheapest edit. Of the pairs of neighbours that
    cannot stand side by side, disjoint ones need an edit each: a heaviest set of them is added.
    """
    out = [(0, 0, 0, 0)] * (len(rows) + 1)
    sure, following = 0, None  # cost of the faults so far; the next row that may stay
    near, far = 0, 0  # heaviest pairs from the next row that may stay on, and from the one behind it on
    for i in range(len(rows) - 1, -1, -1):
        if rows[i] == "-":
            sure += DELETE
        else:
            kind, cut = _ROW[rows[i]]
            useless = kind == "x"
            sure += (DELETE if cut else REROLE) if useless else TRUNCATED * cut
            weight = 0
            if following and not useless and following[0] != "x" and kind + following[0] not in _LEGAL:
                weight = DELETE - TRUNCATED if cut or following[1] else INSERT
            near, far = max(near, weight + far), near
            following = (kind, cut)
        entry = [near] * 4
        if following and following[0] != "x":
            for g in range(4):
                if (g, following[0]) not in _STEP:
                    entry[g] = max(near, (DELETE - TRUNCATED if following[1] else INSERT) + far)
        out[i] = tuple(sure + e for e in entry)
    return out


def _reachable(rows: str, start: int, goal: int) -> bool:
    if not rows:
        return start == goal
    if goal == START:
        return start == START
    return goal != SYSTEM or start == SYSTEM or (start == START and ("s" in rows or "S" in rows))


@lru_cache(CACHED)
def cheapest(rows: str, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and audit from one grammar state to another, the last edit taking a row; without a goal to an accepting end."""
    if goal is not None and not _reachable(rows, start, goal):
        return None
    n, least = len(rows), estimates(rows)
    bound = least[0][start]
    while True:
        failed: dict[tuple[int, int, int], int] = {}
        path: list[str] = []
        over = 1 << 60

        def visit(i: int, g: int, inserts: int, left: int) -> bool:
            nonlocal over
            if least[i][g] > left:
                over = min(over, least[i][g] - left)
                return False
            if i == n:
                if g == goal or (goal is None and g in (START, ASSISTANT)):
                    return True
                if goal is not None:
                    return False
            if failed.get((i, g, inserts), -1) >= left:
                return False

            def take(edit: str, cost: int, *to: int) -> bool:
                path.append(edit)
                if visit(*to, left - cost):
                    return True
                path.pop()
                return False

            if i < n and take("D", DELETE, i + 1, g, 0):
                return True
            # a second insert follows only where one doesn't lead: two from user or assistant come back to it
            if inserts < 2 and take("I", INSERT, i, ASSISTANT if g == USER else USER, 1 if not inserts and g in (START, SYSTEM) else 2):
                return True
            if i < n and rows[i] != "-":
                kind, cut = _ROW[rows[i]]
                to = _STEP.get((g, kind))
                if to is not None and take("K", TRUNCATED * cut, i + 1, to, 0):
                    return True
                if take("R", REROLE + TRUNCATED * cut, i + 1, ASSISTANT if g == USER else USER, 0):
                    return True
            failed[(i, g, inserts)] = left
            return False

        if visit(0, start, 0, bound):
            return bound, "".join(path)
        bound += over


def table_of(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of a block for each pair of grammar states that it can join."""
    found = {(g, to): cheapest(rows, g, to) for g in range(4) for to in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def chain(tables: list[dict[tuple[int, int], tuple[int, str]]], start: int) -> dict[int, tuple[int, int, list[str]]]:
    """For each grammar state at the end: cost, rank of the audit among these, and the audit by block."""
    ends = {start: (0, 0)}
    back: list[dict[int, tuple[int, str]]] = []
    for t in tables:
        best = {}
        for (g, to), (cost, audit) in t.items():
            if g in ends:
                key = (ends[g][0] + cost, ends[g][1], audit, g)
                if to not in best or key < best[to]:
                    best[to] = key
        order = sorted(best, key=lambda to: (best[to][1], best[to][2]))
        ends = {to: (best[to][0], order.index(to)) for to in best}
        back.append({to: (key[3], key[2]) for to, key in best.items()})
    out = {}
    for end, (cost, rank) in ends.items():
        g, parts = end, []
        for step in reversed(back):
            g, audit = step[g]
            parts.append(audit)
        out[end] = (cost, rank, parts[::-1])
    return out


def blocks(rows: str) -> list[str]:
    return [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]


def accepted(ends: dict[int, tuple[int, int, list[str]]]) -> tuple[int, list[str], str]:
    """Cheapest accepting end of a chain: cost, audit by block, closing inserts."""
    cost, _, end = min((c + INSERT * len(_TAIL[g]), rank, g) for g, (c, rank, _) in ends.items())
    return cost, ends[end][2], _TAIL[end]


def repair_rows(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(rows) <= BLOCK:
        return cheapest(rows)
    cost, parts, tail = accepted(chain([table_of(b) for b in blocks(rows)], START))
    return cost, "".join(parts) + tail


def apply_audit(rows: str, audit: str, start: int = START) -> tuple[list[tuple[str, str | None]], str]:
    """For each row the roles inserted before it and its role after the edit ("" unchanged, None deleted); the closing inserts."""
    out, before, g, i = [], "", start, 0
    for edit in audit:
        to = "a" if g == USER else "u"
        if edit == "I":
            before, g = before + to, _STEP[g, to]
            continue
        if edit == "D":
            out.append((before, None))
        elif edit == "K":
            out.append((before, ""))
            g = _STEP[g, _ROW[rows[i]][0]]
        else:
            out.append((before, NAMES[to]))
            g = _STEP[g, to]
        before, i = "", i + 1
    return out, before


def end_state(rows: str, audit: str, start: int) -> int:
    g, i = start, 0
    for edit in audit:
        if edit == "K":
            g = _STEP[g, _ROW[rows[i]][0]]
        elif edit in "IR":
            g = ASSISTANT if g == USER else USER
        i += edit != "I"
    return g


# -- rows -------------------------------------------------------------------------------------------------------------------

def damage(df: DataFrame) -> DataFrame:
    """The rows of conversations with faults put in by a checksum of conversation and turn; ``gone`` marks dropped rows."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     name("role").alias("_role"), name("text").alias("_text"), kind.alias("_kind"))
    rows = rows.withColumn("_tie", F.md5("_text")).withColumn(
        "_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = (F.when(F.col("_kind") < 2, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", ""))
            .otherwise(F.col("_text")))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"),
                       text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.struct("_role", "_tie").alias("tie"))


def plain(df: DataFrame) -> DataFrame:
    """The rows of conversations as they are, in the form that ``repair`` reads."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"),
                     name("text").alias("text"), F.lit(False).alias("gone"), F.struct(name("role"), F.md5(name("text"))).alias("tie"))


def _fault() -> Column:
    text = F.rtrim(F.col("text"), F.lit(WHITE))
    return F.when(text == "", BLANK).when(F.right(text, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
          "strings": pa.list_(pa.string()),
          "joins": pa.list_(pa.struct([("g", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}
_DDL = {"strings": "array<string>", "joins": "array<struct<g:int,to:int,cost:long,audit:string>>"}


class Form:
    """A table's columns, for Spark and for Arrow."""

    def __init__(self, text: str):
        pairs = [part.split() for part in text.split(",")]
        self.ddl = ", ".join(f"{n} {_DDL.get(t, t)}" for n, t in pairs)
        self.arrow = pa.schema([(n, _ARROW[t]) for n, t in pairs])

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=self.arrow)

    def table(self, rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, schema=self.arrow)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = Form(f"conv_id long, {_COUNTS}, repaired_sha256 string")
WALKED = Form("conv_id long, open boolean, part long, at long, turn long, role string, text string, gone boolean, fault int, "
              f"digest binary, {_COUNTS}, repaired_sha256 string")
PIECE = Form("conv_id long, part long, first_at long, present long, blank long, duplicate long, truncated long, illegal long, "
             "first string, last string, distinct long, first_turn long, last_turn long, symbols string, joins joins")
CHAINED = Form(f"conv_id long, part long, first_at long, start int, piece string, symbols string, tail string, {_COUNTS}")
EDIT = Form("part long, at long, before strings, to string, stays boolean")
DIGEST = Form("conv_id long, repaired_sha256 string")


def _gaps(turns: list[int], distinct: int) -> int:
    """``turns``: the least and the largest at least, or none."""
    return max(turns) - min(turns) + 1 - distinct if turns else 0


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def _illegal(kinds: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


def _named(kinds: str) -> list[str]:
    return [f"{NAMES[k]}:" for k in kinds]


def _solve(rows: list[dict]) -> dict:
    """The result of a conversation whose rows are all here, in order."""
    seen, faults = set(), []
    for r in rows:
        faults.append(DUPLICATE if r["fault"] != BLANK and r["digest"] in seen else r["fault"])
        seen.add(r["digest"])
    kinds = [_initial(r["role"]) for r in rows]
    symbols = "".join(map(symbol, kinds, faults))
    cost, audit = repair_rows(symbols)
    edits, tail = apply_audit(symbols, audit)
    lines = []
    for (before, role), r in zip(edits, rows, strict=True):
        lines += _named(before)
        if role is not None:
            lines.append(f"{role or r['role']}:{r['text']}")
    lines += _named(tail)
    turns = list({r["turn"] for r in rows} - {None})
    return {"gaps": _gaps(turns, len(turns)), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(CUT_OFF), "illegal": _illegal(kinds), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _walk(batches, held_bytes: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie inside the task's rows; the rows of the first, the last and the large ones."""
    part = TaskContext.get().partitionId()
    none = object()
    conv, held, size, passing, at = none, [], 0, True, 0
    out: list[dict] = []
    written = 0

    def put(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        nonlocal out, written
        for r in rows:
            out.append(r)
            written += len(r.get("text") or r.get("audit") or "") + 64
            if written > 4 << 20:
                yield WALKED.batch(out)
                out, written = [], 0

    def kept(rows: list[dict]) -> list[dict]:
        return [{**r, "conv_id": conv, "open": True} for r in rows]

    for batch in batches:
        for row in batch.to_pylist():
            if conv is none or row["conv_id"] != conv:
                if conv is not none and not passing:
                    yield from put([{"conv_id": conv, "open": False, **_solve([r for r in held if not r["gone"]])}])
                passing = conv is none
                conv, held, size = row["conv_id"], [], 0
            row |= {"part": part, "at": -1 if row["gone"] else at}
            at += not row["gone"]
            if passing:
                yield from put(kept([row]))
                continue
            held.append(row)
            size += len(row["text"]) + 64
            if size > held_bytes:
                passing = True
                yield from put(kept(held))
                held = []
    if conv is not none and not passing:
        yield from put(kept(held))
    if out:
        yield WALKED.batch(out)


# -- conversations over several ranges ----------------------------------------------------------------------------------------

def _piece(table: pa.Table) -> pa.Table:
    """Counts and search results of the rows that one task's range holds of a conversation."""
    rows = table.to_pylist()
    conv, part = rows[0]["conv_id"], rows[0]["part"]
    rows = sorted((r for r in rows if not r["gone"]), key=lambda r: r["at"])
    faults, kinds = [r["fault"] for r in rows], [r["kind"] for r in rows]
    symbols = "".join(map(symbol, kinds, faults))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    tables = [table_of(b) for b in blocks(symbols)]
    joins = [{"g": g, "to": to, "cost": cost, "audit": "".join(parts)}
             for g in range(4) for to, (cost, _, parts) in chain(tables, g).items()]
    return PIECE.table([{
        "conv_id": conv, "part": part, "first_at": rows[0]["at"] if rows else 0, "present": len(rows),
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
        "illegal": _illegal(kinds), "first": kinds[0] if kinds else None, "last": kinds[-1] if kinds else None,
        "distinct": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "symbols": symbols, "joins": joins}])


def _chained(table: pa.Table) -> pa.Table:
    """One row a piece: its part of the audit; the first one has the conversation's counts."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["part"])
    total = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
    some = [p for p in pieces if p["present"]]
    total["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(some, some[1:], strict=False))
    dated = [p for p in pieces if p["distinct"]]
    both = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
    total["gaps"] = _gaps([p[k] for p in dated for k in ("first_turn", "last_turn")], sum(p["distinct"] for p in dated) - both)
    total["cost"], parts, tail = accepted(chain(
        [{(j["g"], j["to"]): (j["cost"], j["audit"]) for j in p["joins"]} for p in pieces], START))
    total["audit"] = "".join(parts) + tail
    out, g = [], START
    for k, (p, audit) in enumerate(zip(pieces, parts, strict=True)):
        out.append({"conv_id": p["conv_id"], "part": p["part"], "first_at": p["first_at"], "start": g, "piece": audit,
                    "symbols": p["symbols"], "tail": tail if k + 1 == len(pieces) else "", **({} if k else total)})
        g = end_state(p["symbols"], audit, g)
    return CHAINED.table(out)


def _edits(batches) -> Iterator[pa.RecordBatch]:
    """The edit of each row."""
    for batch in batches:
        for p in batch.to_pylist():
            edits, _ = apply_audit(p["symbols"], p["piece"], p["start"])
            for k in range(0, len(edits), 4096):
                yield EDIT.batch([{"part": p["part"], "at": p["first_at"] + k + j, "before": _named(b), "to": to or None,
                                   "stays": to is not None} for j, (b, to) in enumerate(edits[k : k + 4096])])


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order."""
    none = object()
    conv, state, first, out = none, None, True, []
    for batch in batches:
        for name, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if conv is none or name != conv:
                if conv is not none:
                    out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                conv, state, first = name, hashlib.sha256(), True
            for line in lines:
                state.update((line if first else "\n" + line).encode())
                first = False
        if out:
            yield DIGEST.batch(out)
            out = []
    if conv is not none:
        yield DIGEST.batch([{"conv_id": conv, "repaired_sha256": state.hexdigest()}])


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def _spread(rows: DataFrame) -> DataFrame:
    """Results of the conversations whose rows lie in several ranges or are too large to be held."""
    place = F.struct("part", "at")
    firsts = rows.where(~F.col("gone")).groupBy(F.col("conv_id").alias("_conv_id"), F.col("digest").alias("_digest")).agg(
        F.min(place).alias("_first"))
    marked = rows.join(firsts, _same(rows, firsts, "conv_id", "digest"), "left")
    again = (F.col("fault") != BLANK) & (F.col("_first") < place)
    initial = F.substring("role", 1, 1)
    slim = marked.select("conv_id", "part", "at", "turn", "gone", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"),
                         F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("kind"))
    pieces = slim.groupBy("conv_id", "part").applyInArrow(_piece, PIECE.ddl)
    chained = stored(pieces.groupBy("conv_id").applyInArrow(_chained, CHAINED.ddl), "repair-chained")

    edits = chained.mapInArrow(_edits, EDIT.ddl).where(F.col("stays") | (F.size("before") > 0))
    own = F.concat(F.coalesce("to", "role"), F.lit(":"), F.col("text"))
    lines = rows.join(edits, ["part", "at"]).select(
        "conv_id", "part", "at", F.when(F.col("stays"), F.array_append("before", own)).otherwise(F.col("before")).alias("lines"))
    named = F.transform(F.split("tail", ""), lambda k: F.when(k == "u", "user:").otherwise("assistant:"))
    tails = chained.where("tail <> ''").select("conv_id", "part", F.lit(1 << 62).alias("at"), named.alias("lines"))
    digests = (lines.unionByName(tails).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
               .select("conv_id", "lines").mapInArrow(_digests, DIGEST.ddl)
               .select(F.col("conv_id").alias("_conv_id"), "repaired_sha256"))
    totals = chained.where("audit is not null")
    return totals.join(digests, _same(totals, digests, "conv_id"), "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).select(*RESULT.arrow.names)


def repair(rows: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """One row a conversation: its faults, the cheapest repair and the digest of what it gives. See ``damage`` and ``plain``."""
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = ("conv_id", "turn", "tie")
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "gone", _fault().alias("fault"), digest.alias("digest"))
    walked = stored(laid.mapInArrow(lambda b: _walk(b, held_bytes), WALKED.ddl), "repair-walk")
    closed = walked.where(~F.col("open")).select(*RESULT.arrow.names)
    opened = walked.where("open").select("conv_id", "part", "at", "turn", "role", "text", "gone", "fault", "digest")
    return closed.unionByName(_spread(opened))


ORACLE = """
WITH RECURSIVE bytes AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t
    FROM range(256) x(b)
), named AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn,
           coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), chosen AS (
    SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
    FROM named, bytes
), damaged AS (
    SELECT k, turn, role0, md5(text0) AS tie, CASE WHEN d = 4 THEN 'user' ELSE role0 END AS role,
           CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
           unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM chosen
), ordered AS (
    SELECT k, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind,
           row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role0, tie, copy) AS i,
           row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, role0, tie, copy) AS seen
    FROM damaged
), r AS (
    SELECT *, CASE WHEN core = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                   WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
           lag(kind) OVER (PARTITION BY k ORDER BY i) || kind AS pair
    FROM ordered
), facts AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM r GROUP BY k
), inserts AS (
    SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'u'), (0, 3, 'ua'), (1, 1, ''), (1, 2, 'u'), (1, 3, 'ua'),
                          (2, 2, ''), (2, 3, 'a'), (3, 3, ''), (3, 2, 'u')) v(g, q, put)
), edits AS (
    SELECT * FROM (VALUES ('D', 0, 0, 'any'), ('D', 1, 1, 'any'), ('D', 2, 2, 'any'), ('D', 3, 3, 'any'),
                          ('K', 0, 1, 's'), ('K', 0, 2, 'u'), ('K', 1, 2, 'u'), ('K', 3, 2, 'u'), ('K', 2, 3, 'a'),
                          ('R', 0, 2, 'any'), ('R', 1, 2, 'any'), ('R', 3, 2, 'any'), ('R', 2, 3, 'any')) v(edit, q, z, needs)
), best AS (
    SELECT k, 0::BIGINT AS i, 0 AS g, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM facts
    UNION ALL
    SELECT k, i, z, min(b)
    FROM (
        SELECT p.k, p.i + 1 AS i, e.z, {
            'cost': p.b.cost + 3 * length(s.put) + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                    + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
            'audit': p.b.audit || repeat('I', length(s.put)) || e.edit,
            'lines': list_concat(p.b.lines, list_concat(
                CASE s.put WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE [] END,
                CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                     ELSE [CASE e.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END))} AS b
        FROM best p
        JOIN r ON r.k = p.k AND r.i = p.i + 1
        JOIN inserts s ON s.g = p.g
        JOIN edits e ON e.q = s.q AND (e.needs = 'any' OR e.needs = r.kind) AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    )
    GROUP BY k, i, z
), ended AS (
    SELECT b.k, min({'cost': b.b.cost + CASE g WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
                     'audit': b.b.audit || CASE g WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                     'lines': list_concat(b.b.lines, CASE g WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
    FROM best b JOIN facts f ON f.k = b.k AND f.n = b.i
    GROUP BY b.k
)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(e.b.cost, 0) AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM named) c LEFT JOIN facts f ON f.k = c.k LEFT JOIN ended e ON e.k = c.k
"""
