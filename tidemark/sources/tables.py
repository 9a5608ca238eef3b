"""The driver's tables as samples, arrivals and metric logs.

A document is a sample: its source is the group, ``doc_id div 20`` deals the
splits, and the number in the source's name orders the arrivals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, group, split, image_path, relative, lang, doc_id, n_chars; the text stays behind."""
    docs = table(spark, folder, "documents")
    fold = F.expr("doc_id div 20 % 10")
    relative = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    split = F.when(fold == 0, "val").when(fold == 1, "test").otherwise("train")
    image = F.concat(F.lit("/data/"), F.col("source"), F.lit("/images/"), F.col("lang"), F.lit("/images/"), F.col("doc_id").cast("string"), F.lit(".a.jpg"))
    return docs.select(C.sample_id(F.col("source"), relative).alias("sample_id"), F.col("source").alias("group"), split.alias("split"), image.alias("image_path"), relative.alias("relative"), "lang", "doc_id", "n_chars")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """idx, group of each source, by the number in its name."""
    groups = table(spark, folder, "documents").select(F.col("source").alias("group")).distinct()
    return groups.select(F.substring("group", 4, 10).cast("int").alias("idx"), "group")


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """task (six-day buckets), group (event type), score (mean value)."""
    events = table(spark, folder, "events")
    task = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int")
    return events.groupBy(task.alias("task"), F.col("event_type").alias("group")).agg(F.round(F.avg("value"), 6).alias("score"))
