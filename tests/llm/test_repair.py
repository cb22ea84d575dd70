"""Conversation repair against exhaustive search, block by block against the whole, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reqlens.llm import queries, repair

SF = "/root/testdata/sf0.01"
SHAPE = re.compile(r"(s?(ua)+)?")


def all_repairs(codes, most_inserts=2):
    """Every edit string of a short conversation with the roles' initials it gives: (cost, audit, initials)."""
    found = []

    def onward(i, cost, audit, initials, inserted):
        if i == len(codes):
            if SHAPE.fullmatch(initials):
                found.append((cost, audit, initials))
        if inserted < most_inserts:
            for role in "ua":
                onward(i, cost + 5, audit + "I", initials + role, inserted + 1)
        if i < len(codes):
            code = codes[i]
            onward(i + 1, cost + 2, audit + "D", initials, 0)
            if code != "x":
                extra = 5 if code in "SUA_" else 0
                onward(i + 1, cost + extra, audit + "K", initials + code.lower(), 0)
                for role in "ua":
                    onward(i + 1, cost + extra + 1, audit + "R", initials + role, 0)

    onward(0, 0, "", "", 0)
    return min(found)[:2]


def test_search_equals_all_repairs():
    for n in range(3):
        for codes in itertools.product("xsuaU_", repeat=n):
            assert repair.repair_codes("".join(codes)) == all_repairs(codes), codes
    draw = random.Random(5)
    for _ in range(25):
        codes = "".join(draw.choice("xsuaSUA-_") for _ in range(3))
        assert repair.repair_codes(codes) == all_repairs(codes), codes


def least_by_layers(codes):
    """The same optimum by a table over all rows and states."""
    def inserted(layer):
        for _ in range(4):
            for state, (cost, audit) in list(layer.items()):
                after = repair.AFTER[state][repair.EXPECTED[state]]
                layer[after] = min(layer.get(after, (10 ** 9, "")), (cost + 5, audit + "I"))
        return layer

    layer = inserted({0: (0, "")})
    for code in codes:
        after = {}
        for state, (cost, audit) in layer.items():
            ways = [(state, (cost + 2, audit + "D"))]
            if code != "x":
                extra = 5 if code in "SUA_" else 0
                if code.lower() in repair.AFTER[state]:
                    ways.append((repair.AFTER[state][code.lower()], (cost + extra, audit + "K")))
                ways.append((repair.AFTER[state][repair.EXPECTED[state]], (cost + extra + 1, audit + "R")))
            for to, label in ways:
                after[to] = min(after.get(to, (10 ** 9, "")), label)
        layer = inserted(after)
    return min(label for state, label in layer.items() if state in (0, 3))


def test_long_conversations_equal_the_table():
    draw = random.Random(3)
    for letters in ("xsuaSUA-_", "uaaaus", "us", "s-", "uaU", "x"):
        for n in (9, 60, 400):
            codes = "".join(draw.choice(letters) for _ in range(n))
            assert repair.repair_codes(codes) == least_by_layers(codes)


def test_blocks_give_the_same_repair():
    draw = random.Random(7)
    for _ in range(300):
        rows = [(draw.choice([None, 1, 2, 3]), draw.choice(["user", "assistant", "system", "tool", ""]),
                 draw.choice(["a.", "b", "c!", "", f"q{draw.randint(0, 9)}."])) for _ in range(draw.randint(0, 14))]
        results = set()
        for block in (1, 2, 3, 512):
            conversation = repair.Conversation(block)
            for row in rows:
                conversation.add(*row)
            results.add(conversation.finish())
        assert len(results) == 1, rows


def expected(conv_id, rows):
    """The contract for one conversation's original rows (turn, role, text), by plain Python."""
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, codes, seen = dict.fromkeys(repair.COUNTS, 0), "", []
    for _, role, text in out:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.append((role, text))
        if fault:
            counts[fault] += 1
        codes += repair.row_code(role[:1], fault)
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    turns = {t for t, _, _ in out if t is not None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["cost"], audit = least_by_layers(codes)
    final, state, left = [], 0, iter(out)
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (None, "", "")
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[repair.EXPECTED[state]]
            state = repair.AFTER[state][role[0]]
            final.append(f"{role}:{text}")
    return (conv_id, *(counts[n] for n in repair.COUNTS), audit, hashlib.sha256("\n".join(final).encode()).hexdigest()), final


def by_conversation(frame):
    rows = {}
    for r in frame.select("conv_id", "turn", "role", "text").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    return rows


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_query_equals_plain_python_on_the_whole_table(spark):
    result = sorted(map(tuple, queries.QUERIES["op11_conversation_repair"](spark, SF).collect()), key=key)
    rows = by_conversation(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert result == sorted((expected(conv, own)[0] for conv, own in rows.items()), key=key)


ODD = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 5, "assistant", ""), (2, 1, "", "a."), (2, 2, "User", "b."),
       (3, 1, "assistant", " \t\n"), (None, 1, "user", "x?"), (None, 2, "assistant", "y! "), (4, 1, "system", "s." * 40_000),
       (4, 2, "user", "word " * 50_000), (5, -3, "usher", "é."), (5, 9, "assistant", "ü.\x0b"), (6, 1, "tool", "t."), (6, 1, "assistant", "t.")]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string").withColumns({"present": F.lit("x"), "audit": F.lit(1)})
    result = sorted(map(tuple, repair.repair(repair.damaged(frame), F.col("present")).collect()), key=key)
    assert result == sorted((expected(conv, own)[0] for conv, own in by_conversation(frame).items()), key=key)
    assert repair.repair(frame.limit(0)).count() == 0
    nothing = repair.repair(frame.filter("conv_id = 2"), F.lit(False)).collect()
    assert [tuple(r) for r in nothing] == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows", ["table", "odd"])
def test_repaired_turns_are_what_the_hash_covers(spark, rows):
    frame = (spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string") if rows == "odd"
             else spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    damaged = repair.damaged(frame)
    turns = repair.repaired_turns(damaged, repair.repair(damaged, F.col("present")), F.col("present")).collect()
    for conv, own in by_conversation(frame).items():
        mine = sorted((r["place"], f"{r['role']}:{r['text']}") for r in turns if r["conv_id"] == conv)
        assert [t for _, t in mine] == expected(conv, own)[1]
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
