"""Order between tasks: parents, failures and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parent(tasks: DataFrame, order: str, result: str, *within: str) -> DataFrame:
    """Adds parent: the result of the task before."""
    return tasks.withColumn("parent", F.lag(result).over(Window.partitionBy(*within).orderBy(order)))


def before_failure(tasks: DataFrame, order: list[str], failed: str, *within: str) -> DataFrame:
    """The rows before the first failed one; those behind it were never tried.

    The first failure of each sequence is found by aggregation, so a long
    sequence is not sorted in one task.
    """
    place = F.struct(*order)
    first = tasks.where(failed).groupBy(*within).agg(F.min(place).alias("_first"))
    both = tasks.join(first, list(within), "left")
    return both.where(F.col("_first").isNull() | (place < F.col("_first"))).drop("_first")


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def overridden(keys: DataFrame, overrides: DataFrame, on: str, column: str, default) -> DataFrame:
    """``column`` of the overrides where a key has one, else the default; unknown overrides are ignored."""
    return keys.join(overrides.select(on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def layered(layers: DataFrame) -> DataFrame:
    """k, v of the highest layer that has k, from (layer, k, v); a null value counts as set."""
    return layers.groupBy("k").agg(F.max_by("v", "layer").alias("v"))
