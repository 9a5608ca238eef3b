"""The task by group matrix of scores, in long form (task, group, score), and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scores(results: DataFrame, checkpoint: str = "last", metric: str = "map50_95") -> DataFrame:
    """The matrix from results (task, checkpoint, group, metric fields)."""
    return results.where(F.col("checkpoint") == checkpoint).select("task", "group", F.col(metric).cast("double").alias("score"))


def pivoted(matrix: DataFrame, groups: list[str], column: str = "{}.map50_95") -> DataFrame:
    """One row per task, a column per group; naming the groups saves a pass over the data."""
    wide = matrix.groupBy("task").pivot("group", groups).agg(F.first("score"))
    return wide.select("task", *[F.col(f"`{g}`").alias(column.format(g)) for g in groups])


def seen_mean(matrix: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """task, seen_mean, n; a task of ``tasks`` without scores has mean 0."""
    means = matrix.groupBy("task").agg(F.avg("score").alias("seen_mean"), F.count("score").alias("n"))
    if tasks is not None:
        means = tasks.select("task").join(means, "task", "left")
    return means.select("task", F.coalesce("seen_mean", F.lit(0.0)).alias("seen_mean"), F.coalesce("n", F.lit(0)).alias("n"))


def forgetting(matrix: DataFrame) -> DataFrame:
    """group, forgetting: the best score ever less the last, for the groups that the last task was tested on.

    One aggregation: a group's last score counts if it is of the last task, whose number stands beside all groups as one row.
    """
    last = matrix.agg(F.max("task").alias("_end"))
    bygroup = matrix.groupBy("group").agg(F.max("score").alias("best"), F.max_by("score", "task").alias("now"), F.max("task").alias("at"))
    return bygroup.crossJoin(F.broadcast(last)).where("at = _end").select("group", (F.col("best") - F.col("now")).alias("forgetting"))


def mean_forgetting(matrix: DataFrame) -> DataFrame:
    return forgetting(matrix).agg(F.coalesce(F.avg("forgetting"), F.lit(0.0)).alias("final_mean_forgetting"))


def running_forgetting(matrix: DataFrame) -> DataFrame:
    """task, group, forgetting as it was after each task."""
    w = Window.partitionBy("group").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return matrix.select("task", "group", (F.max("score").over(w) - F.col("score")).alias("forgetting"))


def evaluation_grid(checkpoints: DataFrame, tests: DataFrame) -> DataFrame:
    """Every checkpoint with every tested group: both are small tables of names."""
    return checkpoints.crossJoin(tests)


def evaluation_seconds(results: DataFrame) -> DataFrame:
    return results.groupBy("task").agg(F.sum(F.coalesce("evaluation_seconds", F.lit(0.0))).alias("evaluation_seconds"))
