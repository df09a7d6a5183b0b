"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is legal when the initials of its roles spell `(s?(ua)+)?`. A row is kept
(K, 0), given the role of user or assistant (R, 1) or deleted (D, 2; blank and repeated
rows must go), an empty turn can be inserted anywhere (I, 5), and a row that breaks off costs 5
more unless it is deleted. Of the cheapest edit sequences the least in ASCII is taken.

The state is the last role, so the costs to the end are a vector of four numbers per
place. Vectors are stored at checkpoints only: rows are sorted over all partitions, so that one
conversation may lie in many, and cut into blocks. A block gives a 4 x 4 matrix of costs
(min, +); the matrices of a conversation, read backwards, give the vector at each block's
end. With it every block is walked forward on its own, from each of the four states,
computing its vectors again between square-root checkpoints and taking the least
letter that stays on a cheapest way; which of the four walks holds follows from the block
before. Rows meet only as digests; texts are moved once, for the repaired turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sameas.llm.packing import pick
from sameas.session import cut_lineage

BLOCK_ROWS = 4096       # rows between the checkpoints that are stored
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = (USER, USER, ASSISTANT, USER)      # the only role that can come next, a first system aside
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 50

Vector = tuple[int, int, int, int]


# Rows are coded: 0 must go; else 1 + place of the initial in "sua" (3: another) + 4 if it breaks off.

def _keeps(state: int, initial: int) -> int | None:
    """The state after keeping a row, None where it is illegal."""
    if initial == 0:
        return SYSTEM if state == START else None
    return FOLLOW[state] if initial < 3 and FOLLOW[state] == initial + 1 else None


def _with_inserts(v: list[int]) -> Vector:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


END = _with_inserts([0, NEVER, NEVER, 0])


@lru_cache(maxsize=1 << 16)
def _before(code: int, after: Vector) -> Vector:
    """Costs to the end before a row, from those behind it."""
    found = []
    for state in range(4):
        best = DELETE + after[state]
        if code:
            cut, initial = divmod(code - 1, 4)
            kept = _keeps(state, initial)
            best = min(best, CUT * cut + min(REROLE + after[FOLLOW[state]], NEVER if kept is None else after[kept]))
        found.append(best)
    return _with_inserts(found)


@lru_cache(maxsize=1 << 16)
def _move(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The least letters, inserts before a row and its own, on a cheapest way; the state behind."""
    here, letters = _before(code, after), ""
    while True:
        if DELETE + after[state] == here[state]:
            return letters + "D", state
        if INSERT + here[FOLLOW[state]] == here[state]:
            letters, state = letters + "I", FOLLOW[state]
            continue
        cut, initial = divmod(code - 1, 4)
        kept = _keeps(state, initial)
        if kept is not None and CUT * cut + after[kept] == here[state]:
            return letters + "K", kept
        return letters + "R", FOLLOW[state]


def _level(v: Vector) -> tuple[Vector, int]:
    """The vector less its least cost, so that few vectors occur, and that cost."""
    low = min(v)
    return tuple(x - low for x in v), low


def _matrix(codes: bytes, extras: list[int]) -> list[int]:
    """Costs through the block: 4 a + b is from state a before it to state b behind it."""
    columns = []
    for end in range(4):
        v, total = tuple(0 if s == end else NEVER for s in range(4)), DELETE * sum(extras)
        for code in reversed(codes):
            v, low = _level(_before(code, v))
            total += low
        columns.append([min(x + total, NEVER) for x in v])
    return [columns[b][a] for a in range(4) for b in range(4)]


def _through(matrix: list[int], after: list[int]) -> list[int]:
    return [min(matrix[4 * a + b] + after[b] for b in range(4)) for a in range(4)]


def _walks(codes: bytes, extras: list[int], after: Vector, last: bool) -> tuple[list[int], list[str]]:
    """(state behind the block, letters) for each state before it."""
    v, every = _level(after)[0], isqrt(len(codes)) + 1
    stored = {}
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % every == 0 or i == len(codes) - 1:
            stored[i // every] = v
        v = _level(_before(codes[i], v))[0]
    states, letters = list(range(4)), [[] for _ in range(4)]
    for piece in range(-(-len(codes) // every)):
        inner, behind = [], stored[piece]
        rows = range(piece * every, min((piece + 1) * every, len(codes)))
        for i in reversed(rows):
            inner.append(behind)
            behind = _level(_before(codes[i], behind))[0]
        for i, v in zip(rows, reversed(inner)):
            for walk in range(4):
                step, states[walk] = _move(codes[i], v, states[walk])
                letters[walk].append(step)
                if extras and extras[i]:
                    letters[walk].append("D" * extras[i])
    if last:
        for walk in range(4):
            while states[walk] not in (START, ASSISTANT):
                letters[walk].append("I")
                states[walk] = FOLLOW[states[walk]]
    return states, ["".join(x) for x in letters]


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): rows with planted faults, by crc32(conv:turn) % 20:
    0 drops the row (times 0), 1 empties its text, 2 takes out its . ! ?, 3 repeats it
    (times 2), 4 makes it the user's. A null is read as one space, in the key too; turn stays null."""
    rows = pick(conversations, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled("conv"), F.lit(":"), filled("turn"))) % 20
    return rows.select(
        "conv", "turn", F.when(fate == 4, F.lit("user")).otherwise(filled("role")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint").alias("times"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _facts(rows: DataFrame) -> DataFrame:
    """A narrow row per (conv, turn, role, digest of the text), with its number of
    repeats and whether an earlier turn has the same role and text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    facts = _digested(rows.filter("times > 0")).select(
        "conv", "turn", "role", "digest", "times", (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"))
    once = cut_lineage(facts.groupBy("conv", "turn", "role", "digest").agg(
        F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("initial").alias("initial")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = once.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).filter(
        "turns > 1").select(F.col("conv").alias("s_conv"), F.col("role").alias("s_role"), F.col("digest").alias("s_digest"), "first")
    same = F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("digest") == F.col("s_digest"))
    later = F.col("first").isNotNull() & ~F.coalesce(F.col("first"), place).eqNullSafe(place)
    return once.join(seen, same, "left").select("conv", "turn", "role", "digest", "times", "blank", "cut", "initial", later.alias("later"))


class _Block:
    """What is gathered of consecutive rows of one conversation."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.codes, self.extras = conv, number, bytearray(), []
        self.blank = self.repeated = self.cut = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn, times: int, blank: bool, cut: bool, initial: int, later: bool) -> None:
        self.codes.append(0 if blank or later else 1 + initial + 4 * cut)
        self.extras.append(times - 1)
        self.blank += times if blank else 0
        self.repeated += 0 if blank else times if later else times - 1
        self.cut += not blank and not later and cut
        if self.last is None:
            self.first = initial
        else:
            self.illegal += not _follows(self.last, initial)
        self.illegal += times - 1
        self.last = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def row(self) -> tuple:
        extras = self.extras if any(self.extras) else []
        return (self.conv, self.number, bytes(self.codes), extras, _matrix(bytes(self.codes), extras), self.first_turn, self.last_turn,
                [self.turns, self.blank, self.repeated, self.cut, self.illegal, self.first, self.last])


def _follows(one: int, two: int) -> bool:
    return (one, two) in ((0, 1), (1, 2), (2, 1))      # su, ua, au


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _streamed(df: DataFrame, schema: str, each) -> DataFrame:
    """`each(rows)`, a generator over all rows of a sorted partition as tuples, in batches of bounded size."""
    found = df.sparkSession.createDataFrame([], schema).schema
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in found])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for row in each(rows(batches)):
            waiting.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(waiting) >= 5000 or size > 4_000_000:
                yield _arrow(waiting, kinds)
                waiting, size = [], 0
        if waiting:
            yield _arrow(waiting, kinds)

    return df.mapInArrow(run, found)


def _blocks(facts: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of sorted rows; their numbers follow the order over all partitions."""
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, block = TaskContext.get().partitionId() << 32, None
        for conv, turn, times, blank, cut, initial, later in rows:
            if block is not None and (block.conv != conv or len(block.codes) >= block_rows):
                yield block.row()
                block = None
            if block is None:
                number, block = number + 1, _Block(conv, number)
            block.add(turn, times, blank, cut, initial, later)
        if block is not None:
            yield block.row()

    keys = ["conv", "turn", "role", "digest"]
    ordered = facts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "times", "blank", "cut", "initial", "later")
    conv, turn = (facts.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    return _streamed(ordered, f"conv {conv}, number bigint, codes binary, extras array<bigint>, matrix array<bigint>, first_turn {turn}, "
                              f"last_turn {turn}, counts array<bigint>", each)


def _checkpoints(blocks: DataFrame) -> DataFrame:
    """(number, after, last): costs to the end behind each block, from the matrices of its conversation read backwards."""
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, after = None, None
        for conv, number, matrix in rows:
            fresh = after is None or conv != now
            if fresh:
                now, after = conv, list(END)
            yield number, after, fresh
            after = _through(matrix, after)

    ordered = blocks.select("conv", "number", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("number"))
    return _streamed(ordered, "number bigint, after array<bigint>, last boolean", each)


def plan_repairs(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation of (conv, turn, role, text, times) that has rows.

    Rows go by turn, nulls first; rows of one turn by role, then by the text's md5. A
    row's first fault counts: blank, duplicate (role and text seen before), truncated.
    An empty role has no initial and is never kept. A null conversation is one too.
    """
    blocks = cut_lineage(_blocks(_facts(rows), block_rows))

    def walked(found: Iterator[tuple]) -> Iterator[tuple]:
        for conv, number, codes, extras, matrix, first_turn, last_turn, counts, after, last in found:
            states, letters = _walks(codes, extras, tuple(after), last)
            yield conv, number, _through(matrix, after)[START], states, letters, first_turn, last_turn, counts

    def joined(found: Iterator[tuple]) -> Iterator[tuple]:
        whole = None
        for conv, number, cost, states, letters, first_turn, last_turn, counts in found:
            if whole is None or whole["conv"] != conv:
                if whole is not None:
                    yield _summary(whole)
                whole = {"conv": conv, "cost": cost, "audit": [], "state": START, "low": None, "high": None, "turns": 0, "counts": [0] * 4, "last": None}
            whole["audit"].append(letters[whole["state"]])
            whole["state"] = states[whole["state"]]
            if first_turn is not None:
                whole["turns"] += counts[0] - (first_turn == whole["high"])
                whole["low"] = first_turn if whole["low"] is None else whole["low"]
                whole["high"] = last_turn
            whole["counts"] = [a + b for a, b in zip(whole["counts"], counts[1:5])]
            if whole["last"] is not None:
                whole["counts"][3] += not _follows(whole["last"], counts[5])
            whole["last"] = counts[6]
        if whole is not None:
            yield _summary(whole)

    conv, turn = (blocks.schema[c].dataType.simpleString() for c in ("conv", "first_turn"))
    walks = _streamed(blocks.join(_checkpoints(blocks), "number").select(
        "conv", "number", "codes", "extras", "matrix", "first_turn", "last_turn", "counts", "after", "last"),
        f"conv {conv}, number bigint, cost bigint, states array<int>, letters array<string>, first_turn {turn}, last_turn {turn}, "
        "counts array<bigint>", walked)
    return _streamed(walks.repartition("conv").sortWithinPartitions("conv", "number"),
                     f"conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string", joined)


def _summary(whole: dict) -> tuple:
    gaps = 0 if whole["low"] is None else whole["high"] - whole["low"] + 1 - whole["turns"]
    return (whole["conv"], gaps, *whole["counts"], whole["cost"], "".join(whole["audit"]))


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns of the repaired conversations, from 0;
    edit is K, R or I. A partition holds whole conversations, in order."""
    conv = rows.schema["conv"].dataType.simpleString()
    texts = _digested(rows.filter("times > 0")).select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "times", "text")
    audits = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("times"), F.col("audit").alias("text"))
    ordered = audits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select(
        "conv", "kind", "role", "times", "text")

    def each(found: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, at, state, place = None, "", 0, START, 0
        for row_conv, kind, role, times, text in found:
            if kind == 0:
                for _ in range(at, len(audit)):         # inserts behind the last row
                    state = FOLLOW[state]
                    yield conv, place, "I", ROLES[state], ""
                    place += 1
                conv, audit, at, state, place = row_conv, text, 0, START, 0
                continue
            for _ in range(times):
                while audit[at] == "I":
                    state, at = FOLLOW[state], at + 1
                    yield conv, place, "I", ROLES[state], ""
                    place += 1
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = SYSTEM if edit == "K" and role[:1] == "s" else FOLLOW[state]
                yield conv, place, edit, role if edit == "K" else ROLES[state], text
                place += 1
        for _ in range(at, len(audit)):
            state = FOLLOW[state]
            yield conv, place, "I", ROLES[state], ""
            place += 1

    return _streamed(ordered, f"conv {conv}, place bigint, edit string, role string, text string", each)


def digest_turns(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` lines joined by newlines, read from
    `repaired_turns` as they come, so that no conversation is held whole."""
    def each(found: Iterator[tuple]) -> Iterator[tuple]:
        now, digest = None, None
        for conv, place, role, text in found:
            if place == 0:
                if digest is not None:
                    yield now, digest.hexdigest()
                now, digest = conv, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if digest is not None:
            yield now, digest.hexdigest()

    conv = turns.schema["conv"].dataType.simpleString()
    return _streamed(turns.select("conv", "place", "role", "text"), f"conv {conv}, sha256 string", each)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of `rows`, those without a row left too (zeros, empty
    audit, hash of nothing): faults, cost, audit and repaired_sha256. An empty table stays empty."""
    plans = cut_lineage(plan_repairs(rows, block_rows))
    digests = digest_turns(repaired_turns(rows, plans))
    everyone = rows.select("conv").distinct()
    with_plan = everyone.join(plans.withColumnRenamed("conv", "p_conv"), everyone["conv"].eqNullSafe(F.col("p_conv")), "left")
    whole = with_plan.join(digests.withColumnRenamed("conv", "d_conv"), with_plan["conv"].eqNullSafe(F.col("d_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(F.col("conv").alias(conv_col), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
