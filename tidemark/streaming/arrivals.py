"""Arrivals as a stream: each micro-batch of new samples extends the scopes that tasks see.

The order of arrivals is in the data (``idx``), never in the order of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import scope
from tidemark.sources import files
from tidemark.streaming import keys

SCHEMA = "sample_id string, group string, split string, idx int"
#: A stream whose ids and paths are checked names the images too.
CHECKED = SCHEMA + ", image_path string"


def source(spark: SparkSession, folder: str, files_per_batch: int | None = 1, schema: str = SCHEMA) -> DataFrame:
    """New Parquet files of samples below a folder; without ``files_per_batch`` all that are there are one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def counts(stream: DataFrame) -> DataFrame:
    """Running number of samples per group and split: a stateful aggregation with one row of state per pair."""
    return stream.groupBy("group", "split").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))


def follow(stream: DataFrame, registry: str, checkpoint: str, on_arrival: Callable[[DataFrame, int], None], rule: str = "all_seen") -> StreamingQuery:
    """Append each batch to the registry table and hand over the scope counts of all tasks so far.

    Beside each batch stand its sizes, a row per group, and only those are summed
    again with every batch.  A batch that is run again after a failure replaces its
    own partition of both, so it is not counted twice.
    """

    def arrive(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{registry}/batch={number}")
        on_arrival(_counted(batch.sparkSession, registry, number, SCHEMA, rule), number)

    return stream.writeStream.foreachBatch(arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counted(spark: SparkSession, registry: str, number: int, schema: str, rule: str) -> DataFrame:
    """Scope counts of all tasks after a batch that is in the registry: its sizes are put beside those of the batches before."""
    own = spark.read.schema(schema).parquet(f"{registry}/batch={number}")
    train = F.count(F.when(F.col("split") == "train", 1))
    own.groupBy("group").agg(F.min("idx").alias("idx"), train.alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{registry}-sizes/batch={number}")
    known = spark.read.schema("group string, idx int, n bigint").parquet(f"{registry}-sizes").groupBy("group").agg(F.min("idx").alias("idx"), F.sum("n").alias("n"))
    return scope.counts_of(known.select("group", "n"), known.select("group", "idx"), rule)


def follow_checked(stream: DataFrame, registry: str, checkpoint: str, on_arrival: Callable[[DataFrame, int], None], on_clash: Callable[[DataFrame, int], None] | None = None, rule: str = "all_seen") -> StreamingQuery:
    """As :func:`follow`, but a sample is taken only if no other claims its id or its path.

    ``stream`` has the columns of ``CHECKED`` and comes from :func:`keys.session`.
    Who came in an earlier batch keeps what it claims; of samples that come together
    and claim one key none is taken.  Clashes (kind, key, n, first_id) are kept in
    ``registry``-clashes, one partition per batch, and handed to ``on_clash``.  All
    tables of a batch replace what an earlier attempt at it has left, and state goes
    back to where the batch began, so a replayed batch takes and reports what it did
    the first time.
    """

    def arrive(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, f"{registry}-claims/batch={number}"
        batch.write.mode("overwrite").parquet(place)  # state is asked once; what follows reads the answer
        claimed = spark.read.schema(batch.schema).parquet(place)
        keys.accepted(claimed, stream.columns).write.mode("overwrite").parquet(f"{registry}/batch={number}")
        keys.clashes(claimed).write.mode("overwrite").parquet(f"{registry}-clashes/batch={number}")
        found = spark.read.schema("kind string, key string, n bigint, first_id string").parquet(f"{registry}-clashes/batch={number}")
        if on_clash is not None and not found.isEmpty():
            on_clash(found, number)
        on_arrival(_counted(spark, registry, number, CHECKED, rule), number)
        files.remove(spark, place)

    claimed = keys.claims(stream, "idx")
    return claimed.writeStream.outputMode("update").foreachBatch(arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clash_table(spark: SparkSession, registry: str) -> DataFrame:
    """kind, key, n, first_id after all batches: each key once, with all who claimed it."""
    told = spark.read.schema("kind string, key string, n bigint, first_id string, batch int").parquet(f"{registry}-clashes")
    return told.groupBy("kind", "key").agg(F.max("n").alias("n"), F.max_by("first_id", "batch").alias("first_id"))
