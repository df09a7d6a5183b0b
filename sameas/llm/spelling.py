"""Spelling variants: words one edit apart, by a frontier that walks a trie kept as an edge table.

The trie of all words is a table of edges (node, label, child): chains without a branch are
one edge, nodes are 64-bit hashes of prefixes. A second trie holds the words backwards. A
state (word, position, node, edits) is joined with the edges of its node, level by level:
a label that equals the word's next letters keeps the edits, one that is a single edit away
spends the only one. A state that has spent its edit and used up its word in the node of a word
is a neighbour. The frontier ends when no state is left.

An edit in a word's second half leaves the first half as it is, one in the first half
the second half read backwards. So states start in the middle of their words, in both tries,
past the few crowded nodes at the top. Only the longer word of a pair, or the one
with the smaller letter, spends the edit. Nodes know which lengths and letters
follow below them; states that cannot end there are not written. Pairs found
are compared as whole words at the end, so that no hash decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sameas.llm.packing import pick
from sameas.session import cut_lineage

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
DAMAGED = 199           # every so many runs of letters loses one
HELD = 200_000          # words counted in a task before their counts are handed on
TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RUNS = re.compile("[a-zÀ-ÿ]+")


def _damaged(run: str, mark: int) -> str:
    place = mark % len(run)
    return run[:place] + run[place + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n) over whole texts: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where
    `damaged` divides the crc32 of `id:run`, the run's letter at crc32 % length is left
    out (0: never). Null texts have no word, a null id counts as empty."""
    source = pick(docs, id_col, text_col).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(RUNS.findall(text.encode().translate(TO_LOWER).decode()))
                if damaged:
                    start = zlib.crc32(f"{doc}:".encode())
                    for word in list(found):
                        mark = zlib.crc32(word.encode(), start)
                        if mark % damaged == 0:
                            n = found.pop(word)
                            held[_damaged(word, mark)] += n
                held.update(found)
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    return source.mapInArrow(run, "word string, n bigint").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _letter(word: Column, place: Column) -> Column:
    """A bit for the letter at a place from 1; none behind the end."""
    code = F.ascii(F.substr(word, place, F.lit(1)))
    return F.when(place <= F.length(word), F.call_function("shiftleft", F.lit(1).cast("bigint"), (code % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def _length_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(n, F.lit(63)).cast("int"))


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _both_ways(words: DataFrame) -> DataFrame:
    """(number, side, w, start): each word forwards and backwards, and where its states start."""
    n = F.length("word")
    start = lambda half: F.least(half.cast("int"), _last_start(n))
    return words.select("number", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), start(F.floor(n / 2)).alias("start")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), start(F.ceil(n / 2)).alias("start")))).alias("s")).select("number", "s.*")


def _last_start(n: Column) -> Column:
    """Two letters before the end at the latest, so that every edit is met on an edge."""
    return F.greatest(n - 2, F.lit(0))


def edge_table(sided: DataFrame) -> DataFrame:
    """(node, label, child, ends, lengths, next, second): edges of both tries below
    the depth where states start. `ends` marks a word; `lengths`, `next` and `second`
    are the lengths left and the letters at the next two places below the child."""
    n = F.length("w")
    depths = sided.select("number", "side", "w", "start", F.explode(F.sequence(F.least(F.floor(n / 2).cast("int"), _last_start(n)), n)).alias("depth"))
    # a row for each prefix: the word itself stays behind, its number goes on
    prefixes = depths.select(
        "number", "side", "depth", _node(F.col("side"), F.substr("w", F.lit(1), F.col("depth"))).alias("node"),
        (F.col("depth") == F.col("start")).alias("begins"), (F.col("depth") == n).alias("ends"),
        F.substr("w", F.col("depth") + 1, F.lit(1)).alias("letter"), _length_bit(n - F.col("depth")).alias("left"),
        _letter(F.col("w"), F.col("depth") + 1).alias("next"), _letter(F.col("w"), F.col("depth") + 2).alias("second"))
    nodes = prefixes.groupBy("node").agg(
        F.max("begins").alias("begins"), F.max("ends").alias("ends"), (F.min("letter") != F.max("letter")).alias("parts"),
        F.bit_or("left").alias("lengths"), F.bit_or("next").alias("next"), F.bit_or("second").alias("second")).filter("begins or ends or parts")
    chains = prefixes.select("number", "side", "depth", "node").join(nodes.drop("begins", "parts"), "node").groupBy("number", "side").agg(
        F.array_sort(F.collect_list(F.struct("depth", "node", "ends", "lengths", "next", "second"))).alias("chain"))
    steps = chains.join(sided.select("number", "side", "w"), ["number", "side"]).select("w", F.explode(F.arrays_zip(
        F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("b"))).alias("step"))
    return steps.select(
        F.col("step.a.node").alias("node"), F.col("step.b.node").alias("child"),
        F.substr("w", F.col("step.a.depth") + 1, F.col("step.b.depth") - F.col("step.a.depth")).alias("label"),
        *[F.col(f"step.b.{c}").alias(c) for c in ("ends", "lengths", "next", "second")]).dropDuplicates(["node", "child"])


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further that can still end."""
    joined = states.join(edges, "node")
    seg = lambda extra: F.substr("w", F.col("pos") + 1, F.length("label") + extra)
    to = lambda extra, edits: F.struct((F.col("pos") + F.length("label") + extra).alias("pos"), edits.alias("edits"))
    fresh = F.col("edits") == 0
    one = lambda extra: F.levenshtein(seg(extra), F.col("label"), 1) == 1
    moves = F.array(
        F.when(seg(0) == F.col("label"), to(0, F.col("edits"))),
        F.when(fresh & (F.length(seg(0)) == F.length("label")) & (seg(0) < F.col("label")) & one(0), to(0, F.lit(1))),
        F.when(fresh & (F.length(seg(1)) == F.length("label") + 1) & one(1), to(1, F.lit(1))))
    moved = joined.select("side", "w", F.col("child").alias("node"), F.inline(F.filter(moves, lambda m: m.isNotNull())),
                          "ends", "lengths", "next", "second")
    rest = F.length("w") - F.col("pos")
    fits = lambda bit, mask: (bit == 0) | (bit.bitwiseAND(F.col(mask)) != 0)
    # with its edit spent a word must end below the child with just the letters it has left
    spent = (_length_bit(rest).bitwiseAND(F.col("lengths")) != 0) & fits(_letter(F.col("w"), F.col("pos") + 1), "next") & fits(
        _letter(F.col("w"), F.col("pos") + 2), "second")
    return moved.filter((F.col("edits") == 0) & (rest > 0) | (F.col("edits") == 1) & spent).select(
        "side", "w", "pos", "node", "edits", ((F.col("edits") == 1) & (rest == 0) & F.col("ends")).alias("found"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of distinct words that differ by exactly one
    inserted, deleted or replaced letter. `words` is (word), each once, none empty.
    An empty table gives no pair."""
    sided = _both_ways(cut_lineage(words.select("word").withColumn("number", F.monotonically_increasing_id())))
    edges = cut_lineage(edge_table(sided))
    states = sided.select("side", "w", F.col("start").alias("pos"), _node(F.col("side"), F.substr("w", F.lit(1), F.col("start"))).alias("node"),
                          F.lit(0).alias("edits"))
    ended = None
    while True:
        reached = cut_lineage(_level(states, edges))
        done = reached.filter("found").select("side", "w", "node")
        ended = done if ended is None else ended.unionByName(done)
        states = reached.filter("not found").drop("found")
        if states.isEmpty():
            break
    targets = sided.select(_node(F.col("side"), F.col("w")).alias("node"), F.col("w").alias("v"))
    pairs = ended.join(targets, "node").filter(F.levenshtein("w", "v", 1) == 1)
    way = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    once = pairs.select(way("w").alias("word"), way("v").alias("near")).distinct()
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Ways double in each
    round, and counts grow fivefold with each form, so there are few."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        after = cut_lineage(now.join(step, now["root"] == step["via"], "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
                   least_count: int = LEAST_COUNT, ratio: int = RATIO, damaged: int = DAMAGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with enough letters and
    occurrences. form is the near word that occurs most (ties: the smallest) if it
    occurs `ratio` times as often, else null; root the last of a chain of forms, the word
    itself without one. An empty table, or one without such words, gives no row."""
    words = cut_lineage(count_words(docs, id_col, text_col, damaged).filter(
        (F.length("word") >= least_letters) & (F.col("n") >= least_count)))
    near = neighbours(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = cut_lineage(near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")))
    known = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    has = form_n >= ratio * F.col("n")
    formed = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"),
                                      F.when(has, form_n).alias("form_n")))
    roots = _followed(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
