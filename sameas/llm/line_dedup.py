"""Lines that a site repeats: the share of a host's pages that contain a line.

Lines are counted by (host, line) once per page, so counting is a plain partial
aggregate whatever the size of a host. Only lines over the ratio travel back to the
pages: broadcast while their number stays under a bound, else by a join whose hosts
are spread over slots, so that one with a third of all pages is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sameas.session import cut_lineage

RATIO = 0.07              # share of the host's pages above which a line is boilerplate
LEAST_PAGES = 5           # and at least so many pages of the host
SLOTS = 64                # parts of a host in joins
BROADCAST_LINES = 100_000 # 8 bytes each
BLANKS = " \t\r"


def _key(line: Column) -> Column:
    """64-bit hash of the line without blanks at its ends, null for an empty line."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def _every_slot() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLOTS - 1).cast("bigint")))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines in more than `ratio` of a host's
    pages; `pages` is (host, text), `line` the key. A null host is a host of its own."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), _key))
    counted = (
        pages.select("host", F.explode(keys).alias("line")).filter(F.col("line").isNotNull())
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    )
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("host_pages")).withColumn("slot", _every_slot())
    same = F.col("host").eqNullSafe(F.col("h")) & (F.pmod("line", F.lit(SLOTS)) == F.col("slot"))
    return counted.join(totals, same).filter(F.col("pages") > F.lit(ratio) * F.col("host_pages")).select(
        "host", "line", "pages", "host_pages")


def drop_repeated_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source",
                        text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, the text without its boilerplate lines, and
    last the number of lines dropped (lines_dropped, with underscores added while
    that name is taken).

    The other lines keep their order and blanks; empty lines never count. Null texts
    stay null, a text all of whose lines go becomes empty. Repeated rows count as a
    page each. An empty table gives an empty result.
    """
    names = docs.columns
    counter = "lines_dropped"
    while counter.lower() in {n.lower() for n in names}:
        counter += "_"
    host, text = (f"c{names.index(n)}" for n in (host_col, text_col))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = cut_lineage(boilerplate_lines(plain.select(F.col(host).alias("host"), F.col(text).alias("text")), ratio, least_pages))
    # a host has at most (lines of its mean page) / ratio such lines
    lists = found.groupBy(F.col("host").alias("h")).agg(F.collect_list("line").alias("bad"))
    same = F.col(host).eqNullSafe(F.col("h"))
    if found.count() <= BROADCAST_LINES:
        joined = plain.join(F.broadcast(lists), same, "left")
    else:
        spread = plain.withColumn("part", F.pmod(F.xxhash64(text), F.lit(SLOTS)))
        joined = spread.join(lists.withColumn("slot", _every_slot()), same & (F.col("part") == F.col("slot")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("bad", _key(x)), F.lit(False)))
    out = joined.withColumn("kept", F.when(F.col("bad").isNotNull() & F.col(text).isNotNull(), kept))
    columns = [F.when(F.col("kept").isNull(), F.col(text)).otherwise(F.array_join("kept", "\n")).alias(n)
               if i == names.index(text_col) else F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("bigint")
    return out.select(*columns, dropped.alias(counter))
