"""Places of rows in an order, without one task that sees them all.

A deterministic sample of the keys gives boundaries; each row falls between two of
them, so it is numbered among its neighbours and moved by the number of rows in
the ranges before.  Nothing depends on partitioning or on how often a plan is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most (boundaries travel with the plan).
RANGE, RANGES = 1_000_000, 1_000


def places(rows: DataFrame, key: str, by: tuple[str, ...] = (), rows_per_range: int = RANGE) -> DataFrame:
    """``rows`` with _place: 0, 1, ... in the order of ``key`` (no nulls), apart for each combination of ``by``.

    Equal keys have places next to each other, in any order.
    """
    ranges = min(RANGES, -(-rows.count() // rows_per_range))
    sample = rows.select(key).distinct().orderBy(F.xxhash64(key), key).limit(20 * ranges)
    cuts = [r[0] for r in sample.orderBy(key).collect()][::20][1:] if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", place)
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    named = [F.col(b).alias(f"_by_{b}") for b in by]
    starts = starts.select(*named, F.col("_range").alias("_of"), "_start")
    same = F.col("_range") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key)) - 1
    numbered = ranged.withColumn("_own", own).join(starts, same)
    return numbered.select(*rows.columns, (F.col("_start") + F.col("_own")).cast("bigint").alias("_place"))


#: Numbers whose rows are summed one after another.
STRETCH = 1_000


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to each row in the order of ``order``, a column of distinct whole numbers.

    Two levels: sums of stretches of numbers are summed first, and each row adds what
    its own stretch has before it.  Stretches are summed side by side.
    """
    stretched = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH))
    to_end = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretched.groupBy("_stretch").agg(F.sum(value).alias("_sum")).select("_stretch", F.coalesce(F.sum("_sum").over(to_end), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stretched.withColumn("_own", own).join(before, "_stretch").select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
