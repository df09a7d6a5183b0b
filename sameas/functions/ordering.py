"""Orders over whole tables without sending a table through one task.

Each helper cuts the rows into buckets, works inside the buckets in parallel and
adds up a table of bucket totals whose size is fixed by the bucket count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sameas.session import cut_lineage

HASH_DIGITS = 4          # 16**4 buckets of evenly spread md5 values: 15 million rows each of 10**12
RANGE_ROWS = 100_000     # rows wanted between two approximate quantiles
MOST_RANGES = 10_000     # cuts that may reach the driver


def hash_key(seed, *cols) -> Column:
    """The only source of randomness: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                                      else c.cast("string") for c in cols]))


def hash_number(digest: Column) -> Column:
    """First 32 bits of a hex digest as BIGINT."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, keys: Sequence[str], seed, out: str = "rank",
              within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Exact shuffled position, 1-based, of every row (per `within` group).
    `total` names a column for the number of rows, which the buckets know."""
    within = list(within)
    digest, bucket = "__digest", "__bucket"
    marked = df.withColumn(digest, hash_key(seed, *keys)).withColumn(bucket, F.substring(digest, 1, HASH_DIGITS))
    totals = marked.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    known = [F.sum("__n").over(Window.partitionBy(*within)).alias(total)] if total else []
    offsets = totals.select(*within, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *known)
    inside = Window.partitionBy(*within, bucket).orderBy(digest, *keys)
    return (
        marked.withColumn("__pos", F.row_number().over(inside))
        .join(offsets, [*within, bucket])
        .withColumn(out, (F.col("__pos") + F.col("__before")).cast("bigint"))
        .drop(digest, bucket, "__pos", "__before")
    )


def _range_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Adds __bucket, which never decreases with `key`, cut at approximate
    quantiles, as many as the rows ask for. Only the cuts (at most MOST_RANGES
    numbers) reach the driver; they never change a result."""
    df = cut_lineage(df)     # read for the cuts, the totals and the rows
    ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    wanted = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(key, wanted, 10 * MOST_RANGES)).head()[0] or [] if wanted else []
    splits = [float("-inf"), *sorted(set(c for c in found if c == c) or {0.0}), float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol="__bucket", handleInvalid="keep").transform(df)


def running_totals(df: DataFrame, key: str, values: Sequence[str], descending: bool = False,
                   prefix: str = "cum_", total_prefix: str = "total_") -> DataFrame:
    """Adds prefix+v = sum of v over rows up to and including this one by `key`, and
    total_prefix+v = sum over all rows. `key` must be unique: aggregate by it first."""
    marked = _range_bucketed(df, key)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = marked.groupBy("__bucket").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = Window.orderBy(way("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__bucket", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values],
        *[F.sum(f"__t_{v}").over(Window.partitionBy()).alias(f"{total_prefix}{v}") for v in values])
    upto = Window.partitionBy("__bucket").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(offsets, "__bucket")
    return joined.select(*df.columns, *[(F.sum(v).over(upto) + F.col(f"__o_{v}")).alias(f"{prefix}{v}")
                                        for v in values], *[f"{total_prefix}{v}" for v in values])


def previous_point(df: DataFrame, key: str, tie: str, values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds prefix+v = v of the row before by (key, tie); null on the first row."""
    marked = _range_bucketed(df, key)
    order = F.struct(*dict.fromkeys([key, tie, *values]))
    lasts = marked.groupBy("__bucket").agg(F.max(order).alias("__last"))
    carried = lasts.select("__bucket", F.lag("__last").over(Window.orderBy("__bucket")).alias("__carry"))
    inside = Window.partitionBy("__bucket").orderBy(key, tie)
    joined = marked.join(carried, "__bucket").withColumn("__first", F.row_number().over(inside) == 1)
    return joined.select(*df.columns, *[
        F.when(F.col("__first"), F.col(f"__carry.{v}")).otherwise(F.lag(v).over(inside)).alias(f"{prefix}{v}")
        for v in values])
