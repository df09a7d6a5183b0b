"""TF-IDF vectors and the exact k-nearest-neighbour join on them.

Vocabulary and document frequencies come from side A only; B is projected onto
them. Weights are count * (ln((1+n)/(1+df)) + 1), rows have unit length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sameas.functions.text import text_fingerprint, tokens
from sameas.operators.copies import best_columns, nearest_by_value, top_k
from sameas.session import cut_lineage

SEED_WIDTH = 4            # first look: postings read per wanted neighbour
BLOCK_ROWS = 256          # postings of a block, about
PART_ROWS = 4096          # A rows of a token that meet a block in one task, about
LEVELS = 40               # half octaves of weight in which postings are kept
VOCABULARY = 200_000      # tokens sent to every task at most; more are joined
SLACK = 1e-7              # room for rounding in every pruning bound
READ_ROWS = 10_000_000    # meetings of postings that go through a shuffle as rows; where all are more, rows meet in tiles
TILE_ROWS = 16_384        # rows of a tile's side at most, about
TILE_NUMBERS = 1 << 22    # weights of a tile's side at most, about: 64 MB
DENSE_NUMBERS = 1 << 23   # weights of the frequent terms of a tile, kept as a matrix: 64 MB
DENSE_SHARE = 0.04        # of all pairs of a tile share a term kept so; adding up one posting costs as much as 25 products
SLICE_NUMBERS = 1 << 20   # sums of A rows kept at a time


def term_counts(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, token, tf). The texts move to their id's partition once; counting
    and the per-row norms then need no further shuffle of the longer token rows."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id")
    return (
        texts.select("id", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("id", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def inverse_frequencies(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, idf, term) over a corpus whose rows may have copies: `corpus` is every
    row (fp), `terms` the counts of one row per fp with its number of copies. `term`
    numbers the tokens, so that no later step moves or sorts their text."""
    n = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = terms.groupBy("token").agg(F.sum("copies").alias("df")).select(
        "token", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    return cut_lineage(found.withColumn("term", F.monotonically_increasing_id()))


def raw_weights(terms: DataFrame, idf: DataFrame, small: bool = False) -> DataFrame:
    """(id, term, w) before scaling; tokens outside the vocabulary are dropped. A
    vocabulary known to be `small` goes to the rows, which then stay where their id is."""
    return terms.join(F.broadcast(idf) if small else idf, "token").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def unit_weights(raw: DataFrame) -> DataFrame:
    """Scaled to length 1 per id."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("w", F.col("w") / norm)


def _corpus_weights(a: DataFrame, corpus: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """(weights of A before scaling, its vocabulary, whether that is small)."""
    terms_a = term_counts(a)
    if corpus is None:
        counted, corpus = terms_a.withColumn("copies", F.lit(1)), a
    else:
        copies = a.select("id", "fp").join(corpus.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "fp")
        counted = terms_a.join(copies.select("id", "copies"), "id")
    idf = inverse_frequencies(counted, corpus)
    small = idf.count() <= VOCABULARY
    return raw_weights(terms_a, idf, small), idf, small


def tfidf_vectors(a: DataFrame, b: DataFrame, corpus: DataFrame | None = None,
                  same_table: bool = False) -> tuple[DataFrame, DataFrame]:
    """Weights of A (unit length) and of B (not scaled); `a`, `b` are
    (id, text[, fp]). `corpus` is all of A when `a` holds one row per distinct text."""
    raw_a, idf, small = _corpus_weights(a, corpus)
    return unit_weights(raw_a), raw_a if same_table else raw_weights(term_counts(b), idf, small)


def _bags_in_place(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, terms, ws), unit length, of (id, text) with unique ids over a small vocabulary. Tokens
    are counted where their row lies: no text is moved, and no count of a token is a row."""
    listed = idf.select("token", "idf", "term").collect()
    vocabulary = pa.array([r["token"] for r in listed], pa.string())
    weight, term, size = np.array([r["idf"] for r in listed], float), np.array([r["term"] for r in listed], np.int64), max(1, len(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            at = pc.index_in(pc.list_flatten(batch.column(1)).cast(pa.string()), value_set=vocabulary)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), lengths)[known]
            slots, tf = np.unique(rows * size + pc.drop_null(at).to_numpy(), return_counts=True)
            row, place = slots // size, slots % size
            w = tf * weight[place]
            ws = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            held = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(held)
            ends = pa.array(np.r_[0, np.cumsum(held[some])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(term[place], pa.int64())),
                                              pa.ListArray.from_arrays(ends, pa.array(ws, pa.float64()))], ["id", "terms", "ws"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", tokens(F.col("text")).alias("held")).mapInArrow(run, f"id {kind}, terms array<bigint>, ws array<double>")


def _bags_of(one_b: DataFrame, b: DataFrame, idf: DataFrame, small: bool) -> DataFrame:
    """(id, terms, ws) of B, a row per distinct text in `one_b`; texts of a repeated id count as one."""
    counted = lambda df: _bags(unit_weights(raw_weights(term_counts(df), idf, small)))
    if not small:
        return counted(one_b)
    again = b.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("id").isNull()).select("id")
    if again.isEmpty():
        return _bags_in_place(one_b, idf)
    again = again.select(F.col("id").alias("again"))
    same = one_b["id"].eqNullSafe(again["again"])
    return _bags_in_place(one_b.join(again, same, "left_anti"), idf).unionByName(counted(one_b.join(again, same, "left_semi")))


def _posting_lists(wa: DataFrame, wb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, blocks) of the terms in both tables.

    lists: term, how many B rows hold it and, level by level of their weights, how many and the largest.
    blocks: (term, level, block, pa, held): the postings (b_id, wb) in arrays of about
    BLOCK_ROWS of one level. For a term that many A rows read, each block stands
    there once for every part `pa` of them, so no meeting is large.
    """
    level = F.least(F.floor(-2 * F.log2("w")), F.lit(LEVELS)).cast("int")
    levelled = wb.withColumn("level", F.greatest(level, F.lit(0)))
    readers = wa.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts_a"))
    counts = levelled.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("top"))
    lists = cut_lineage(counts.groupBy("term").agg(
        F.sum("n").alias("postings"), F.array_sort(F.collect_list(F.struct("level", "n", "top"))).alias("levels")).join(readers, "term"))
    small = lists.count() <= VOCABULARY
    n = F.filter("levels", lambda x: x["level"] == F.col("level"))[0]["n"]
    block = F.pmod(F.xxhash64("id"), F.ceil(n / BLOCK_ROWS)).cast("int")
    dealt = levelled.join(F.broadcast(lists) if small else lists, "term").select("term", "level", block.alias("block"), "parts_a", "id", "w")
    blocks = dealt.groupBy("term", "level", "block", "parts_a").agg(F.collect_list(F.struct(F.col("id").alias("b_id"), F.col("w").alias("wb"))).alias("held"))
    return lists, blocks.select("term", "level", "block", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)).alias("pa"), "held")


def _entries(wa: DataFrame, lists: DataFrame) -> DataFrame:
    """What each A row can read: (a_id, term, level, wa, n, gain, best, pa). A posting of the
    entry adds `gain` at most; a partner first met here, its rarest shared term, scores `best` at most."""
    rare_first = Window.partitionBy("a_id").orderBy(F.col("postings").desc(), F.col("term").desc())
    behind = F.sum(F.col("wa") * F.col("wa")).over(rare_first.rowsBetween(Window.unboundedPreceding, -1))
    known = wa.join(lists, "term").select(F.col("id").alias("a_id"), "term", F.col("w").alias("wa"), "postings", "levels", "parts_a")
    listed = known.withColumn("tail", F.sqrt(F.coalesce(behind, F.lit(0.0)))).withColumn("x", F.explode("levels"))
    gain = F.col("wa") * F.col("x.top")
    return listed.select("a_id", "term", "x.level", "wa", "x.n", gain.alias("gain"), (gain + F.col("tail")).alias("best"),
                         F.pmod(F.xxhash64("a_id"), "parts_a").cast("int").alias("pa"))


def _read(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, dot) over the postings of (a_id, term, level, block, pa, wa)."""
    met = entries.join(blocks, ["term", "level", "block", "pa"]).select("a_id", "wa", F.inline("held"))
    return met.groupBy("a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))


def _kth(scored: DataFrame, k: int, name: str) -> DataFrame:
    return top_k(scored.withColumnRenamed("dot", "score"), k).filter(F.col("rank") == k).select("a_id", F.col("score").alias(name))


def _meetings(wa: DataFrame, wb: DataFrame) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """How many pairs of postings share a term; (rows, weights) of each side."""
    held = lambda df, name: df.groupBy("term").agg(F.count(F.lit(1)).alias(name))
    met = held(wa, "na").join(held(wb, "nb"), "term").agg(F.sum(F.col("na") * F.col("nb"))).head()[0] or 0
    size = lambda df: tuple(df.agg(F.countDistinct("id"), F.count(F.lit(1))).head())
    of_a = size(wa)
    return met, of_a, of_a if wb is wa else size(wb)


def _parts(of_a: tuple[int, int], of_b: tuple[int, int], cores: int) -> tuple[int, int]:
    """Into how many parts the sides are dealt: as few as their sizes allow, every copy of
    a row being moved, but enough for every core to have a tile."""
    least = lambda rows, numbers: max(1, -(-rows // TILE_ROWS), -(-numbers // TILE_NUMBERS))
    parts = [least(*of_a), least(*of_b)]
    while parts[0] * parts[1] < cores:
        larger = int(of_b[0] / parts[1] >= of_a[0] / parts[0])
        if (of_a, of_b)[larger][0] < 256 * parts[larger]:
            break
        parts[larger] += 1
    return parts[0], parts[1]


def _bags(weights: DataFrame) -> DataFrame:
    """(id, terms, ws): one row per id."""
    bags = weights.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("bag"))
    return bags.select("id", F.col("bag.term").alias("terms"), F.col("bag.w").alias("ws"))


def _weights(bags: DataFrame) -> DataFrame:
    return bags.select("id", F.inline(F.arrays_zip("terms", "ws"))).toDF("id", "term", "w")


class _Side:
    """Rows of a part in the order of their ids: entry i is the weight ws[i] of terms[i] in row rows[i]."""

    def __init__(self, table: pa.Table):
        table = table.take(pc.sort_indices(table["id"], null_placement="at_start")).combine_chunks()
        flat = lambda name: pc.list_flatten(table[name]).to_numpy()
        self.ids, self.n = table["id"], table.num_rows
        self.terms, self.ws = flat("terms"), flat("ws")
        self.rows = np.repeat(np.arange(self.n), pc.list_value_length(table["terms"]).to_numpy())


def _tile(left: _Side, right: _Side, k: int) -> pa.Table:
    """(a_id, b_id, score) of the k best right rows of every left row that shares a term with one.

    A term that many pairs of the tile share is a column of two matrices whose product is added;
    postings of the others are added up one by one.
    """
    known, here = np.unique(right.terms, return_inverse=True)
    at = np.minimum(np.searchsorted(known, left.terms), max(len(known) - 1, 0))
    shared = known[at] == left.terms if len(known) else np.zeros(len(left.terms), bool)
    rows, at, ws = left.rows[shared], at[shared], left.ws[shared]
    held = np.bincount(here, minlength=len(known))
    share = np.bincount(at, minlength=len(known)) / max(left.n, 1) * (held / max(right.n, 1))
    frequent = np.argsort(-share)[:max(1, DENSE_NUMBERS // max(left.n, right.n, 1))]
    frequent = frequent[share[frequent] > DENSE_SHARE]
    column = np.full(len(known), -1)
    column[frequent] = np.arange(len(frequent))
    dense_b = np.zeros((right.n, len(frequent)))
    often = column[here] >= 0
    dense_b[right.rows[often], column[here[often]]] = right.ws[often]
    order = np.argsort(here, kind="stable")         # the postings of a term, one after the other
    post_rows, post_ws, begin = right.rows[order], right.ws[order], np.cumsum(held) - held

    height = max(1, SLICE_NUMBERS // max(right.n, 1))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, left.n, height):
        high = min(left.n, first + height)
        mine = slice(*np.searchsorted(rows, (first, high)))
        row, term, w = rows[mine] - first, at[mine], ws[mine]
        often = column[term] >= 0
        dense_a = np.zeros((high - first, len(frequent)))
        dense_a[row[often], column[term[often]]] = w[often]
        sums = (dense_a @ dense_b.T).ravel()
        row, term, w = row[~often], term[~often], w[~often]
        meets = held[term]
        chunk = (np.cumsum(meets) - meets) // SLICE_NUMBERS
        for now in np.split(np.arange(len(term)), np.flatnonzero(np.diff(chunk)) + 1):
            n = meets[now]
            if not n.sum():
                continue
            post = np.arange(n.sum()) + np.repeat(begin[term[now]] - (np.cumsum(n) - n), n)
            sums += np.bincount(np.repeat(row[now] * right.n, n) + post_rows[post], np.repeat(w[now], n) * post_ws[post], len(sums))
        a, b, score = best_columns(sums.reshape(high - first, right.n), k)
        some = score > 0
        found.append((a[some] + first, b[some], score[some]))
    a, b, score = (np.concatenate(c) for c in zip(*found))
    return pa.table([left.ids.take(pa.array(a)), right.ids.take(pa.array(b)), pa.array(score)], ["a_id", "b_id", "score"])


def _by_tiles(bags_a: DataFrame, bags_b: DataFrame, k: int, parts: tuple[int, int]) -> DataFrame:
    """The k best pairs per a_id and tile. A row goes to every part of the other side, so that
    no pair of rows is ever moved; a table with itself sends each row once to each part."""
    itself = bags_b is bags_a
    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    kinds = {"a_id": bags_a.schema["id"].dataType, "b_id": bags_b.schema["id"].dataType, "score": T.DoubleType()}
    bags_a, bags_b = dealt(bags_a, parts[0], "pa"), dealt(bags_b, parts[1], "pb")
    every = lambda first, last: F.explode(F.sequence(first, last))
    last = F.lit(parts[1] - 1)
    left = bags_a.withColumn("pb", every(F.col("pa") if itself else F.lit(0), last))
    right = bags_b.withColumn("pa", every(F.lit(0), F.col("pb") if itself else F.lit(parts[0] - 1)))

    def product(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        one, two = _Side(a), _Side(b)
        found = [_tile(one, two, k)]
        if itself and key[0].as_py() != key[1].as_py():
            found.append(_tile(two, one, k))
        return pa.concat_tables(found)

    columns, keys = ["pa", "pb", "id", "terms", "ws"], ["pa", "pb"]
    tiles = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).toDF(*columns).groupBy(*keys))
    return tiles.applyInArrow(product, T.StructType([T.StructField(c, t) for c, t in kinds.items()]))


def similarities(wa: DataFrame, wb: DataFrame, k: int, bags: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A superset of the k best pairs per a_id with exact scores. `bags` are the sides with one row per id, if at hand.

    Where more than READ_ROWS pairs of postings share a term, rows meet in tiles and nothing is moved
    for a pair. Else postings that cannot matter are not read:

    Postings lie in blocks of one token and level of weight, whose largest weight is
    known. A row first reads the blocks that can give it most; the k-th sum found is a floor for
    its list, since weights only add. Then it reads a block only if a partner first met there,
    with the block's largest weight and all that the row's more frequent tokens can add,
    reaches the floor. The sums give a higher floor; partners that can still reach it
    with what was not read are completed. A row reads all where that costs less
    than completing partners.
    """
    meetings, of_a, of_b = _meetings(wa, wb)
    if meetings > READ_ROWS:
        bags_a, bags_b = bags or (_bags(wa), _bags(wb))
        parts = _parts(of_a, of_b, wa.sparkSession.sparkContext.defaultParallelism)
        if wb is wa:
            bags_b, parts = bags_a, (max(parts), max(parts))
        return _by_tiles(bags_a, bags_b, k, parts)
    looked = SEED_WIDTH * k
    lists, blocks = _posting_lists(wa, wb)
    blocks = cut_lineage(blocks)
    entries = cut_lineage(_entries(wa, lists))
    by_gain = Window.partitionBy("a_id").orderBy(F.desc("gain"), "term", "level")
    size = F.least("n", F.lit(BLOCK_ROWS))
    first = entries.withColumn("before", F.sum(size).over(by_gain.rowsBetween(Window.unboundedPreceding, 0)) - size).filter(F.col("before") < looked)
    floor = _kth(_read(first.withColumn("block", F.lit(0)), blocks), k, "floor")

    # without a floor everything is read
    reach = F.col("floor").isNull() | (F.col("best") >= F.col("floor") - SLACK)
    rated = entries.join(floor, "a_id", "left").withColumn("reach", reach)
    here = Window.partitionBy("a_id")
    over = lambda value: F.sum(F.when(F.col("reach"), 0).otherwise(value)).over(here)
    cheap = over(F.col("n")) <= F.sum(F.when(F.col("reach"), F.col("n")).otherwise(0)).over(here) * over(F.lit(1))
    judged = cut_lineage(rated.withColumn("kept", F.col("reach") | cheap).drop("reach"))
    every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK_ROWS).cast("int") - 1))
    met = _read(judged.filter("kept").withColumn("block", every), blocks)
    skipped = judged.filter(~F.col("kept"))
    # a token adds its largest weight left out at most, all of them their length
    rest = skipped.groupBy("a_id", "term").agg(F.max("gain").alias("gain"), F.first("wa").alias("wa")).groupBy("a_id").agg(
        F.least(F.sum("gain"), F.sqrt(F.sum(F.col("wa") * F.col("wa")))).alias("rest"))
    if skipped.isEmpty():
        return met.withColumnRenamed("dot", "score")
    partial = cut_lineage(met.join(rest, "a_id", "left"))
    risen = _kth(partial.select("a_id", "b_id", "dot"), k, "risen")
    able = partial.join(risen, "a_id", "left").filter(
        F.col("rest").isNull() | F.col("risen").isNull() | (F.col("dot") + F.col("rest") >= F.col("risen") - SLACK))
    one = blocks.filter("pa = 0").select("term", "level", F.inline("held"))
    more = (
        able.filter(F.col("rest").isNotNull()).select("a_id", "b_id")
        .join(skipped.select("a_id", "term", "level", "wa"), "a_id").join(one, ["b_id", "term", "level"])
        .groupBy("a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("more"))
    )
    return able.join(more, ["a_id", "b_id"], "left").select(
        "a_id", "b_id", (F.col("dot") + F.coalesce("more", F.lit(0.0))).alias("score"))


def knn_tfidf(a: DataFrame, b: DataFrame, k: int = 20, metric: str = "cosine", same_table: bool = False,
              pad_to_k: bool = False) -> DataFrame:
    """(a_id, b_id, source, rank, score): for each A row the k nearest B rows.

    `a`, `b` are (id, text). Score is the cosine, or with metric "l2" the
    Euclidean distance of the unit vectors (same order). Only rows sharing a
    token with a_id are neighbours; `pad_to_k` fills up with the smallest ids.
    """
    side_a = a.select("id", "text").withColumn("fp", text_fingerprint(F.col("text")))
    side_b = side_a if same_table else b.select("id", "text").withColumn("fp", text_fingerprint(F.col("text")))

    def search(one_a: DataFrame, one_b: DataFrame, depth: int) -> DataFrame:
        raw_a, idf, small = _corpus_weights(one_a, side_a)
        bags_a = cut_lineage(_bags(unit_weights(raw_a)))     # read by every step below; survives lost executors
        bags_b = bags_a if same_table else cut_lineage(_bags_of(one_b, side_b, idf, small))
        wa = _weights(bags_a)
        return similarities(wa, wa if same_table else _weights(bags_b), depth, (bags_a, bags_b))

    near = nearest_by_value(side_a, side_b, k, search, same_table).filter(F.col("score") > 0)
    if pad_to_k:
        near = _pad(a, b, near, k, same_table)
    if metric == "l2":
        near = near.withColumn("score", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))))
    elif metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    return near.select("a_id", "b_id", F.lit("tfidf").alias("source"), "rank", "score")


def _pad(a: DataFrame, b: DataFrame, near: DataFrame, k: int, same_table: bool) -> DataFrame:
    """Lists shorter than k get the smallest ids not yet in them, at score 0.
    2k + 1 smallest ids are enough, whatever is already listed."""
    smallest = b.select("id").distinct().orderBy("id").limit(2 * k + 1).agg(F.collect_list("id").alias("ids")).scalar()
    short = (
        a.select(F.col("id").alias("a_id"))
        .join(near.groupBy("a_id").agg(F.count(F.lit(1)).alias("n")), "a_id", "left")
        .filter(F.coalesce("n", F.lit(0)) < k)
        .select("a_id", F.explode(smallest).alias("b_id"))
        .join(near.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    )
    if same_table:
        short = short.filter(F.col("a_id") != F.col("b_id"))
    filler = short.withColumn("score", F.lit(0.0))
    return top_k(near.select("a_id", "b_id", "score").unionByName(filler), k)
