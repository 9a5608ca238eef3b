"""What tasks cost.  Evaluation does not count as part of the method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def account(tasks: DataFrame) -> DataFrame:
    """Adds method_seconds and gpu_hours to (selection_seconds, training_seconds, devices, ...); nulls cost nothing."""
    zero = F.lit(0.0)
    method = F.coalesce("selection_seconds", zero) + F.coalesce("training_seconds", zero)
    return tasks.withColumn("method_seconds", method).withColumn("gpu_hours", C.gpu_hours(F.col("method_seconds"), F.col("devices")))


def estimate(selected: DataFrame, batch: int, epochs: int) -> DataFrame:
    """Adds images_read and optimizer_steps to (task, n)."""
    return selected.withColumn("images_read", F.col("n") * epochs).withColumn("optimizer_steps", C.optimizer_steps(F.col("n"), batch, epochs))
