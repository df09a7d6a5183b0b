"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block. A source of weight w (its share of all weights) must have
its j-th block (from 0) between its release floor(j / w) and its deadline
ceil((j + 1) / w). In each slot the released block with the earliest deadline goes.

Periods of slots are scheduled side by side, a row each. Up to the end of period k, after
T slots, a source has had floor(w T) blocks, or one more for the largest remainders, so that all add
up to T: each period deals what the weights are owed so far, and rounding never adds
up. Inside a period blocks keep the windows of their weights. At every period's
end each source is less than one block from its exact share. Where weights are fractions with a
small common period (whole numbers, or up to six decimals), periods are multiples of it,
nothing is rounded and the deviation is below one block in every slot. For other weights
the windows leave that to the earliest deadline: it is met in all weights tried but can
be missed by a fraction of a block between two ends.

Weights are whole numbers of units, 2**40 for all together, so that windows are exact. A tiny
source has a slot in some periods only; there is no bound on the number of
sources. Documents are numbered inside their sources by hash buckets with running
totals, so no source is ever sorted in one task, and a bucket learns the slots of its
blocks, so texts are not moved for them.

When a source runs out its slots stay empty; the others keep their order.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from sameas.functions.text import once
from sameas.session import cut_lineage

PERIOD = 1024          # slots of a period at least; more for more sources
BLOCK_ROWS = 8         # documents in a block
BUCKET_ROWS = 1000     # documents ranked together
UNITS = 2**40          # of all weights together, about
DECIMALS = 10**6       # weights that are whole in these are exact


def _common_period(shares: DataFrame) -> tuple[int, int] | None:
    """(units in one, common period) of weights that are whole in DECIMALS and have a period of at most four PERIODs."""
    whole = F.round(F.col("weight") * DECIMALS)
    exact = shares.agg(F.min((F.abs(F.col("weight") * DECIMALS - whole) < 1e-9 * whole) & (whole < 2**40)), F.min(whole)).head()
    if not exact[0] or exact[1] < 1:
        return None
    # gcds add up in any order; few distinct values of a bounded period
    values = [int(r[0]) for r in shares.select(whole).distinct().limit(4 * PERIOD + 1).collect()]
    if len(values) > 4 * PERIOD:
        return None
    one = reduce(gcd, values)
    total = int(shares.agg(F.sum(whole)).head()[0]) // one
    return (one, total) if total <= 4 * PERIOD else None


def _weighted(sizes: DataFrame, weights: DataFrame | None, power: float) -> DataFrame:
    """sizes (src, n) with their weight; every source must have one above 0."""
    if weights is None:
        return sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    given = weights.toDF("w_src", "weight").groupBy("w_src").agg(F.max(F.col("weight").cast("double")).alias("weight"), F.count(F.lit(1)).alias("times"))
    joined = sizes.join(given, sizes["src"].eqNullSafe(given["w_src"]), "left")
    bad = joined.filter(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0) | (F.col("weight") == float("inf")) | (F.col("times") > 1))
    named = [r["src"] for r in bad.select("src").orderBy("src").limit(5).collect()]
    if named:
        raise ValueError(f"sources without exactly one weight above 0, the first of them: {named}")
    return joined.select("src", "n", "weight")


def block_quotas(shares: DataFrame, total: int, period: int) -> DataFrame:
    """(frame, place, first, blocks, owed, units): the blocks that each source has in
    each period, from 0; owed is (first - exact share so far) in units. `shares` is
    (place, blocks, units), a row per source, with `total` units. Blocks behind a source's last are left out."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    ends = F.expr(f"(cast(blocks as decimal(20,0)) * {total} + cast(units as decimal(20,0)) * {period} - 1) div (cast(units as decimal(20,0)) * {period})")
    last = shares.agg(F.max(ends)).head()[0] or 0
    bounds = shares.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    passed = F.expr(f"cast(k as decimal(20,0)) * {period} * units")
    # windows of a boundary see one row per source
    owing = bounds.withColumn("low", F.expr(f"cast(k as decimal(20,0)) * {period} * units div {total}")).withColumn(
        "rest", (passed % F.lit(total).cast("decimal(38,0)")).cast("bigint"))
    here = Window.partitionBy("k")
    spare = F.col("k") * period - F.sum("low").over(here)
    ranked = owing.withColumn("spare", spare).withColumn("at", F.row_number().over(here.orderBy(F.desc("rest"), "place")))
    dealt = ranked.withColumn("quota", F.col("low") + F.when(F.col("at") <= F.col("spare"), 1).otherwise(0))
    sides = dealt.select("place", "blocks", "units", "quota", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("frame"), "k")
    start = F.max(F.when(F.col("frame") > F.col("k"), F.col("quota")))
    end = F.max(F.when(F.col("frame") == F.col("k"), F.col("quota")))
    framed = sides.filter((F.col("frame") > 0) & (F.col("frame") <= last)).groupBy("frame", "place", "blocks", "units").agg(
        start.alias("first"), F.least(end, F.col("blocks")).alias("upto"))
    owed = exact("first") * F.lit(total).cast("decimal(20,0)") - F.expr(f"cast(frame - 1 as decimal(18,0)) * {period} * units")
    return framed.filter(F.col("upto") > F.col("first")).select(
        "frame", "place", "first", (F.col("upto") - F.col("first")).cast("int").alias("blocks"), owed.cast("bigint").alias("owed"), "units")


def schedule(quotas: DataFrame, total: int, period: int) -> DataFrame:
    """(place, block, slot): earliest deadline first inside every period. A row per
    period, with the sources that have blocks in it."""
    def windows(x: Column) -> Column:
        behind = lambda i: x["owed"] + i * total
        return F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: F.struct(
            _exact_floor(behind(i), x["units"]).alias("release"), (-_exact_floor(-behind(i + 1), x["units"])).alias("deadline")))

    rows = quotas.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("place", "first", "blocks", "owed", "units"))).alias("sources"))
    opened = rows.select("frame", F.transform("sources", lambda x: F.struct(
        x["place"].alias("place"), x["first"].alias("first"), x["blocks"].alias("blocks"), windows(x).alias("windows"))).alias("sources"))
    every = F.aggregate("sources", F.lit(0), lambda n, x: n + x["blocks"])
    start = F.struct(F.transform("sources", lambda x: F.lit(0)).alias("done"), F.lit(0).alias("given"),
                     F.array().cast("array<struct<place:int,block:bigint>>").alias("row"))

    def step(state: Column, slot: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            at = F.get(state["done"], i)
            window = F.get(x["windows"], at)
            return F.when(at < x["blocks"], F.struct((window["release"] > slot).alias("early"), window["deadline"].alias("deadline"), i.alias("i")))

        def taken(i: Column) -> Column:
            source = F.get("sources", i)
            block = F.struct(source["place"].alias("place"), (source["first"] + F.get(state["done"], i)).alias("block"))
            return F.struct(F.transform(state["done"], lambda d, j: d + F.when(j == i, 1).otherwise(0)).alias("done"),
                            (state["given"] + F.when(i.isNotNull(), 1).otherwise(0)).alias("given"),
                            F.concat(state["row"], F.array(F.when(i.isNotNull(), block))).alias("row"))

        # a block goes before its release only where there are as many blocks as slots left
        goes = lambda best: best.isNotNull() & (~best["early"] | (F.col("every") - state["given"] >= period - slot))
        return once(F.array_min(F.transform("sources", entry)), lambda best: once(F.when(goes(best), best["i"]), taken))

    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(period - 1).cast("bigint"))
    dealt = opened.withColumn("every", every).select("frame", F.aggregate(steps, start, step)["row"].alias("row"))
    slots = dealt.select("frame", F.posexplode("row").alias("at", "x")).filter(F.col("x").isNotNull())
    return slots.select("x.place", "x.block", ((F.col("frame") - 1) * period + F.col("at")).cast("bigint").alias("slot"))


def _exact_floor(x: Column, y: Column) -> Column:
    """floor(x / y) of whole numbers below 2**63, without doubles."""
    return F.call_function("div", x - F.pmod(x, y), y)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, period: int = PERIOD,
                block_rows: int = BLOCK_ROWS, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of `docs` plus mix_block (number of the row's block in
    its source), mix_slot (its slot in the mix) and mix_row (its row in the block).
    Sorting by mix_slot, mix_row gives the mixture.

    `weights` is (source, weight): a source without exactly one weight above 0 is an
    error that names it, weights of other sources are ignored. Without `weights` a source
    weighs its number of rows to the given power. Inside a source rows are in the
    order of md5(seed:id), then id; rows that repeat an id stay, in any order. A null
    source is a source, a null id counts as empty. An empty table stays empty.
    """
    names = docs.columns
    at = {c: f"c{names.index(c)}" for c in (id_col, source_col)}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    sizes = cut_lineage(plain.groupBy(F.col(at[source_col]).alias("src")).agg(F.count(F.lit(1)).alias("n")))
    n_sources, n_rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    weighted = _weighted(sizes, weights, power)
    common = _common_period(weighted) if weights is not None and n_sources else None
    period = max(period, n_sources)
    if common:
        one, _ = common
        period = -(-period // common[1]) * common[1]
        units = (F.round(F.col("weight") * DECIMALS) / one).cast("bigint")
    else:
        top = weighted.agg(F.max("weight")).head()[0] or 1.0
        units = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("weight") / F.lit(top) * UNITS / max(1, n_sources) + 0.5))
    # one row per source
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("src").asc_nulls_first())
    shares = cut_lineage(weighted.select("src", F.ceil(F.col("n") / block_rows).cast("bigint").alias("blocks"), units.alias("units"),
                                         (F.row_number().over(by_name) - 1).cast("int").alias("place")))
    total = int(shares.agg(F.sum("units")).head()[0] or 1)
    slots = schedule(block_quotas(shares.select("place", "blocks", "units"), total, period), total, period)

    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))))
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(2**32))
    placed = (
        plain.join(shares.select("src", "place"), plain[at[source_col]].eqNullSafe(F.col("src")))
        .withColumn("digest", digest).withColumn("bucket", bucket)
    )
    totals = placed.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("place", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    blocks = F.sequence(F.floor(F.col("offset") / block_rows), F.floor((F.col("offset") + F.col("n") - 1) / block_rows))
    held = offsets.select("place", "bucket", "offset", F.explode(blocks).alias("block")).join(slots, ["place", "block"]).groupBy(
        "place", "bucket", "offset").agg(F.array_sort(F.collect_list(F.struct("block", "slot")))["slot"].alias("slots"))
    inside = Window.partitionBy("place", "bucket").orderBy("digest", at[id_col])
    ranked = placed.withColumn("inside", F.row_number().over(inside) - 1).join(held, ["place", "bucket"])
    number = F.col("offset") + F.col("inside")
    blocked = ranked.withColumn("block", F.floor(number / block_rows)).withColumn("mix_row", number % block_rows)
    slot = F.get("slots", (F.col("block") - F.floor(F.col("offset") / block_rows)).cast("int"))
    taken = {n.lower() for n in names}
    free = lambda n: n if n not in taken else free(n + "_")
    return blocked.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("block").cast("bigint").alias(free("mix_block")),
        slot.alias(free("mix_slot")), F.col("mix_row").cast("bigint").alias(free("mix_row")))
