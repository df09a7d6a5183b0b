"""Nearest text by edit distance, without comparing every pair.

Distances are tried in rounds with the limit t doubling; rows that found a partner
leave. B texts lie in bands of t + 1 lengths, so an A text looks into three bands at
most. Of a text whose band is q the first q (t + 1) letters are cut into t + 1 pieces of
q letters. t edits leave one of them whole, the i-th at most i places off (Li et
al., Pass-Join, PVLDB 2011), so a band is met by an equi-join on pieces; only ids and hashes of
pieces move, and candidates are looked up once. Where pieces would be shorter than
PIECE letters, or more than four for each letter, they select nothing: there the
rows of a band meet in slices of fixed size. In the first round texts of up to DELETED letters meet by an equi-join on what is left
when one letter or none is deleted: texts one edit apart share that, while many texts of a few common
words share half of their letters. In all ways counts of letter classes, which an
edit changes by one at most, rule pairs out before their distance is measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sameas.functions.text import text_fingerprint
from sameas.operators.copies import nearest_by_value
from sameas.session import cut_lineage, dealt

PIECE = 3               # letters of a piece at least
DELETED = 64            # letters of a text at most whose one-letter deletions are hashed
SLICE_ROWS = 512        # rows of a band that meet as many others in one task
# Any division into classes gives a true bound; these are frequent letters, digits, spaces and marks. All others are one class more.
CLASSES = ("e", "t", "a", "o", "i", "n", "s", "r", "l", "d", "c", "u", "m", " ", "01234", "56789", "EAOIU", "TNSRL", "#-_./,")


def letter_counts(text: Column) -> Column:
    """How many letters of each class a text has."""
    length = F.length(text)
    known = [length - F.length(F.translate(text, letters, "")) for letters in CLASSES]
    return F.array(*known, F.length(F.translate(text, "".join(CLASSES), "")))


def least_edits(left: Column, right: Column) -> Column:
    """A bound that no edit distance of texts with these letter counts falls below."""
    surplus = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0))), F.lit(0), lambda n, d: n + d)
    return F.greatest(surplus(left, right), surplus(right, left))


def _cut(band: Column, limit: int) -> Column:
    """Whether texts of a band are cut into pieces."""
    return (band >= PIECE) & (F.lit(limit + 1) <= 4 * band)


def _banded(a: DataFrame, limit: int) -> DataFrame:
    """A rows, once for each band that their partners can lie in."""
    low = F.floor(F.greatest(F.col("length") - limit, F.lit(0)) / (limit + 1))
    return a.withColumn("band", F.explode(F.sequence(low, F.floor((F.col("length") + limit) / (limit + 1)))))


def _by_pieces(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """(a_id, b_id) that share a piece at nearly the same place."""
    places = F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("place")
    piece = lambda at: F.xxhash64(F.substr("text", (at + 1).cast("int"), F.col("band").cast("int")))
    right = b.filter(_cut(F.col("band"), limit)).select(F.col("id").alias("b_id"), "band", "text", places).select(
        "b_id", "band", "place", piece(F.col("place") * F.col("band")).alias("piece"))
    start = F.col("place") * F.col("band")
    spans = _banded(a, limit).filter(_cut(F.col("band"), limit)).select(F.col("id").alias("a_id"), "band", "text", "length", places).withColumn(
        "low", start - F.least("place", start)).withColumn("high", F.least(start + F.col("place"), F.col("length") - F.col("band")))
    left = spans.filter(F.col("low") <= F.col("high")).withColumn("at", F.explode(F.sequence("low", "high"))).select(
        "a_id", "band", "place", piece(F.col("at")).alias("piece")).distinct()
    return dealt(left).join(dealt(right), ["band", "place", "piece"]).select("a_id", "b_id").distinct()


def _by_deletions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) that are equal without one letter or none of each: all that are one edit apart, and few others."""
    text, length = F.col("text"), F.col("length")
    left_over = lambda at: F.xxhash64(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, length)))
    end = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.explode(F.array_distinct(
        F.transform(F.sequence(F.lit(0), length), left_over))).alias("rest"))
    return dealt(end(a, "a")).join(dealt(end(b, "b")), "rest").select("a_id", "b_id").distinct()


def _by_slices(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """(a_id, a_text, b_id, b_text) of bands that are not cut, letters allowing it:
    A rows are dealt to slices and B rows go to each of them, and the other way round."""
    whole_a = _banded(a, limit).filter(~_cut(F.col("band"), limit))
    whole_b = b.filter(~_cut(F.col("band"), limit))
    count = lambda df, name: df.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias(name))
    # a row for each band: as many as lengths at most
    sizes = cut_lineage(count(whole_a, "parts_a").join(count(whole_b, "parts_b"), "band"))
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = whole_a.join(F.broadcast(sizes), "band").withColumn("sa", own("parts_a")).withColumn("sb", every("parts_b")).select(
        "band", "sa", "sb", F.col("id").alias("a_id"), F.col("text").alias("a_text"), F.col("letters").alias("a_letters"))
    right = whole_b.join(F.broadcast(sizes), "band").withColumn("sb", own("parts_b")).withColumn("sa", every("parts_a")).select(
        "band", "sa", "sb", F.col("id").alias("b_id"), F.col("text").alias("b_text"), F.col("letters").alias("b_letters"))
    return dealt(left).join(dealt(right), ["band", "sa", "sb"]).filter(least_edits(F.col("a_letters"), F.col("b_letters")) <= limit).select(
        "a_id", "a_text", "b_id", "b_text")


def _within(a: DataFrame, b: DataFrame, limit: int, same_table: bool) -> DataFrame:
    """(a_id, b_id, distance) of the nearest b at most `limit` edits away."""
    banded = b.withColumn("band", F.floor(F.col("length") / (limit + 1)))
    other = F.col("a_id") != F.col("b_id") if same_table else F.lit(True)
    end = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"), F.col("letters").alias(f"{name}_letters"))
    if limit == 1:      # a partner may have one letter more
        short = F.col("length") <= DELETED
        near = _by_deletions(a.filter(short), b.filter(F.col("length") <= DELETED + 1)).unionByName(_by_pieces(a.filter(~short), banded, limit))
    else:
        near = _by_pieces(a, banded, limit)
    found = near.filter(other).join(dealt(end(a, "a")), "a_id").join(dealt(end(b, "b")), "b_id").filter(
        least_edits(F.col("a_letters"), F.col("b_letters")) <= limit).select("a_id", "a_text", "b_id", "b_text")
    pairs = found.unionByName(_by_slices(a, banded, limit).filter(other))
    measured = pairs.select("a_id", "b_id", F.levenshtein("a_text", "b_text", limit).alias("distance"))
    best = measured.filter(F.col("distance") >= 0).groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("best"))
    return best.select("a_id", "best.b_id", "best.distance")


def _search(a: DataFrame, b: DataFrame, same_table: bool) -> DataFrame:
    longest = max(a.agg(F.max(F.length("text"))).head()[0] or 0, b.agg(F.max(F.length("text"))).head()[0] or 0)
    # few bytes, much measuring: keep every core busy, which sizes alone would not
    spark = a.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = lambda df: df.select("id", "text", F.length("text").alias("length"), letter_counts(F.col("text")).alias("letters"))
    spread = lambda df: cut_lineage(counted(df).repartition(width, "id"))
    waiting, found, limit = spread(a), None, 1
    others = waiting if same_table else spread(b)
    while True:
        hits = cut_lineage(_within(waiting, others, limit, same_table))
        found = hits if found is None else found.unionByName(hits)
        waiting = spread(waiting.join(hits.select(F.col("a_id").alias("id")), "id", "left_anti"))
        if limit >= longest or waiting.isEmpty():
            return found
        limit *= 2


def levenshtein_nearest(a: DataFrame, b: DataFrame, same_table: bool = False) -> DataFrame:
    """(a_id, b_id, distance): the nearest B text of every A text, the smaller id
    on ties. `a`, `b` are (id, text). Exact on whole texts."""
    side_a = a.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", text_fingerprint(F.col("text")))
    side_b = side_a if same_table else b.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "fp", text_fingerprint(F.col("text")))

    def search(one_a: DataFrame, one_b: DataFrame, depth: int) -> DataFrame:
        nearest = _search(one_a, one_b, same_table).select("a_id", "b_id", (-F.col("distance")).cast("double").alias("score"))
        if same_table:      # copies of a text are found through the text itself
            nearest = nearest.unionByName(one_a.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"),
                                                       F.lit(0.0).alias("score")))
        return nearest

    best = nearest_by_value(side_a, side_b, 1, search, same_table)
    return best.select("a_id", "b_id", (-F.col("score")).cast("int").alias("distance"))
