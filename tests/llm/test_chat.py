import random
import re

import duckdb
import pandas as pd
import pytest

from cladekit.llm import chat

ROWS = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks.\n\nAnd  You?"),
        (1, 2, "user", ">> how are you?\n> Fine, thanks. And you?\nGood"), (1, 3, "assistant", "> Hello there\nI answer the first line"),
        (1, 4, "user", "ok"), (1, 5, "user", "> I answer the first line\nsecond level"), (1, 6, "user", "> Good\nback"),
        (1, 7, None, "> not found anywhere\nx"), (None, 0, "user", "A"), (None, 1, "user", "> a\nB"), (2, None, "user", None),
        (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, "assistant", ">>> \n>\n> x\n  y ")]
SCHEMA = "conv_id long, turn long, role string, text string, row long, path string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, -1, "x") for r in rows], SCHEMA)


def plain(df):
    return sorted(tuple("-1" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r)
                  for r in df[sorted(df.columns)].astype(object).values.tolist())


def test_linked_replies(spark):
    got = chat.link_quotations(messages(spark, ROWS)).where("conv_id = 1").collect()
    told = {r["turn"]: (r["position"], r["reply_turn"], r["depth"], r["n_quotes"], r["n_linked"], r["body"]) for r in got}
    assert told[1] == (1, 0, 0, 1, 1, "Fine, thanks.\n\nAnd  You?")
    assert told[2] == (2, 1, 0, 2, 2, "Good")  # the lower level decides
    assert told[3][:3] == (3, 0, 1) and told[5][:3] == (5, 3, 2)  # branches after what they answer
    assert told[6][:3] == (6, 2, 1) and told[7][4:] == (0, "x")


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert plain(chat.link_quotations(messages(spark, ROWS)).toPandas()) == plain(con.sql(chat.ORACLE).df())


def test_one_long_conversation(spark):
    """A conversation of many messages with a common first line: order by turn, texts in bounded rows."""
    rows = [(5, k, "user" if k % 2 else "assistant", f"Hi\nmessage {k}") for k in range(600)]
    rows[300] = (5, 300, "user", "> message 10\nthis one")
    got = {r["turn"]: r for r in chat.link_quotations(messages(spark, rows).repartition(4)).collect()}
    assert got[299]["position"] == 299 and got[300]["depth"] == 1 and got[300]["reply_turn"] == 10
    parts = chat.chat_texts(chat.link_quotations(messages(spark, rows))).orderBy("chunk").collect()
    assert [r["n_messages"] for r in parts] == [256, 256, 88]
    assert parts[0]["text"].startswith("<|assistant|>\nHi\nmessage 0<|end|>\n<|user|>")


def test_empty(spark):
    assert chat.link_quotations(messages(spark, ROWS).where("false")).collect() == []


def test_some_lines_of_a_message(spark):
    """Two or more, but not all, lines of a message are linked to it, as paragraphs and line by line."""
    rows = [(1, 0, "user", "One a\nTwo b\nThree c\nFour d\n\nFive e\nSix f"), (1, 1, "assistant", "Two b\nOne a\nelse"),
            (1, 2, "user", "ok"), (1, 3, "user", "> Three c\n> Four d\nx\n> One a\n>\n> two  B\ny"),
            (1, 4, "user", "> Five e Six\n> f\nz"), (1, 5, "user", "> Two b\n> One a\nw"), (1, 6, "user", "> Three c\n> else\nv"),
            (2, 0, "user", "One a\nTwo b\nThree c"), (1, 7, "user", "Three c\nFour d"), (1, 8, "user", "> Six f\n> Four d\nu")]
    told = {r["turn"]: (r["reply_turn"], r["n_quotes"], r["n_linked"]) for r in
            chat.link_quotations(messages(spark, rows)).where("conv_id = 1").collect()}
    assert told[3] == (0, 2, 2)  # its first passage decides
    assert told[4] == (0, 1, 1)  # a paragraph broken elsewhere
    assert told[5] == (1, 1, 1)  # the latest message that said both lines
    assert told[6] == (5, 1, 0)  # lines of two messages
    assert told[8] == (0, 1, 1)


def test_sayings_of_a_hot_text_over_blocks(spark, monkeypatch):
    """Each quotation of a common text finds the latest saying, also from blocks of rows before its own."""
    monkeypatch.setattr(chat, "BLOCK_ROWS", 4)
    rows = [(1, k, "user", "> ok\nso" if k % 7 == 6 else "ok" if k % 11 < 2 else f"m {k}") for k in range(80)]
    got = {r["turn"]: r["reply_turn"] for r in chat.link_quotations(messages(spark, rows)).collect()}
    for k in range(6, 80, 7):
        assert got[k] == max(j for j in range(k) if j % 7 != 6 and j % 11 < 2)


# -- a plain version, and generated threads ---------------------------------------------------------------------------------

WHITE = "[\\x20\\x09-\\x0D]"


def normal(text):
    fold = re.sub(WHITE + "+", " ", text).strip(" ")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in fold)


def read(text):
    """Body, quoted passages (level, whole, set of lines) and the set of what a message says."""
    lines = []
    for line in (text or "").split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        lines.append((marks.count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)))
    passages = []
    for level, content in lines:
        if passages and passages[-1][0] == level:
            passages[-1][1].append(content)
        else:
            passages.append((level, [content]))
    own = [c for level, c in lines if level == 0]
    body = re.sub(f"^{WHITE}+|{WHITE}+$", "", "\n".join(own))
    said = {normal(body)} | {normal(c) for c in own}
    for level, contents in passages:
        if level == 0:
            raw = "\n".join(contents)
            said |= {normal(raw)} | {normal(x) for x in re.split(f"\n{WHITE}*\n", raw)}
    quotes = [(level, normal("\n".join(c)), {normal(x) for x in c} - {""}) for level, c in passages if level]
    return body, [q for q in quotes if q[1]], said - {""}


def brute(rows):
    """conv, turn -> position, reply_turn, depth, n_quotes, n_linked, body; turns are unique here."""
    out = {}
    for conv in {r[0] for r in rows}:
        messages = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        parts = [read(m[3]) for m in messages]
        reply, linked = [], []
        for k, (_, quotes, _) in enumerate(parts):
            found = []
            for at, (level, whole, lines) in enumerate(quotes):
                source = [j for j in range(k) if whole in parts[j][2]]
                if not source and len(lines) > 1:
                    source = [j for j in range(k) if lines <= parts[j][2]]
                if source:
                    found.append((level, at, source[-1]))
            linked.append(len(found))
            reply.append(min(found)[2] if found else k - 1 if k else None)
        branch, path = [], {}
        for k, r in enumerate(reply):
            branch.append(k if r is None or r != k - 1 else branch[-1])
            if branch[k] == k:
                path[k] = [k] if r is None else [*path[branch[r]], k]
        order = sorted(range(len(messages)), key=lambda k: (path[branch[k]], k))
        for position, k in enumerate(order):
            out[conv, messages[k][1]] = (position, None if reply[k] is None else messages[reply[k]][1], len(path[branch[k]]) - 1,
                                         len(parts[k][1]), linked[k], parts[k][0])
    return out


def threads(seed, convs=12):
    """Messages that quote whole messages, paragraphs, some lines, several levels, repeats, or nothing that was said."""
    pick = random.Random(seed)
    line = lambda: " ".join(pick.choice(["Alpha", "beta", "gamma", "ok", "yes  no"]) for _ in range(pick.randrange(1, 4)))
    rows = []
    for conv in range(convs):
        said = []
        for turn in range(pick.randrange(2, 14)):
            parts = []
            for _ in range(pick.randrange(0, 3) if said else 0):
                lines = pick.choice(said).split("\n")
                how = pick.randrange(5)
                if how == 1:
                    lines = lines[: pick.randrange(1, len(lines) + 1)]
                elif how == 2:
                    lines = pick.sample(lines, pick.randrange(1, len(lines) + 1))
                elif how == 3:
                    lines = [x.upper() + "  " for x in lines]
                elif how == 4:
                    lines = [line(), line()]
                parts.append("\n".join(pick.choice(["> ", ">", " >"]) + x for x in lines))
            own = "\n\n".join("\n".join(line() for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(1, 3)))
            pick.shuffle(parts)
            text = "\n".join([*parts, own] if pick.random() < 0.7 else [own, *parts, line()])
            rows.append((conv, turn, "user" if turn % 2 else "assistant", text))
            said.append(text)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_generated_threads(spark, seed):
    """The query, the SQL and the plain version agree on every message; many are linked, in every way."""
    rows = threads(seed)
    linked = chat.link_quotations(messages(spark, rows))
    got = {(r["conv_id"], r["turn"]): (r["position"], r["reply_turn"], r["depth"], r["n_quotes"], r["n_linked"], r["body"])
           for r in linked.collect()}
    want = brute(rows)
    assert got == want
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    sql = {(r[0], r[1]): (r[3], None if r[4] == -1 else r[4], *r[5:]) for r in con.sql(chat.ORACLE).fetchall()}
    assert sql == want
    assert sum(v[4] for v in want.values()) > 20 and max(v[2] for v in want.values()) > 1
