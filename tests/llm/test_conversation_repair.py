import hashlib
import random
import re
import zlib

import pytest

from sameas.llm import conversation_repair as repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
        role, text = key(role), key(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation, every sequence of edits by a table of (cost, audit, turns)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    # states by last initial; inserts in a row: three are more than any best sequence needs
    best = {"": (0, "", ())}

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                put(table, follow[state], cost + 5, audit + "I", turns + ((names[follow[state]], ""),))

    def put(table, state, cost, audit, turns):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, turns)

    for (_, role, text), fault in zip(rows, faults):
        inserts(best)
        after = {}
        for state, (cost, audit, turns) in best.items():
            put(after, state, cost + 2, audit + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if role[:1] == follow[state] or role[:1] == "s" and state == "":
                put(after, role[:1], cost + extra, audit + "K", turns + ((role, text),))
            put(after, follow[state], cost + 1 + extra, audit + "R", turns + ((names[follow[state]], text),))
        best = after
    inserts(best)
    cost, audit, turns = min(best[s] for s in ("", "a") if s in best)
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def check(spark, rows, block_rows=repair.BLOCK_ROWS):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r["conv_id"]: r.asDict() for r in repair.repair_report(repair.damage(table), block_rows=block_rows).collect()}
    left = plain_damage(rows)
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        expected = plain_repair([r[1:] for r in left if r[0] == conv])
        assert {k: row[k] for k in expected} == expected, (conv, row, expected)


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None]
    texts = ["Well.", "So", "So ", " \n", "", None, "Ready? ", "Ünd.\t", "no end"] + [f"text {i}." for i in range(12)] + [f"open {i}" for i in range(6)]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed,block_rows", [(1, 4096), (2, 1), (3, 3)])
def test_agrees_with_the_plain_table(spark, seed, block_rows):
    check(spark, random_rows(seed, 40, 12), block_rows)


def test_one_long_conversation_in_many_blocks(spark):
    rows = [(7, i, r, f"line {i}" + ("." if i % 5 else "")) for i, r in enumerate(random.Random(4).choices(["user", "assistant", "system"], k=900))]
    check(spark, rows, 16)
    check(spark, rows)


def test_nulls_repeats_and_empty_tables(spark):
    check(spark, [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "x" * 200_000 + ".")] * 2 + [(5, 3, "user", "A.")] * 300)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, TEXT string, conv string")
    assert repair.repair_report(repair.damage(empty)).count() == 0


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "assistant", "Late."), (1, 1, "user", "One."), (1, 2, "user", "Two."), (1, 3, "assistant", "Three.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv bigint, turn bigint, role string, text string, times bigint")
    turns = repair.repaired_turns(table, repair.plan_repairs(table)).orderBy("place").collect()
    initials = "".join(t["role"][0] for t in turns)
    assert re.fullmatch("(s?(ua)+)?", initials) and len(turns) >= 2
