"""Who claims which id and which path, over all arrivals: the keys are the state of a stream.

Each sample claims two keys, its id and the owner key of its path.  Grouped by key
they tell how often a key is claimed; on a stream, that is one shuffle of what is
new and one look at the state per new key, however many have been seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.registry import require_none
from tidemark.sources import files

#: Kinds of keys, and what it means when two samples claim one.
KINDS = {"id": "sample ids occur twice", "owner": "images appear in more than one split"}
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that keeps state in RocksDB, on disk rather than in the executors' heaps."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set(_STORE, _ROCKS)
    return own


def claims(samples: DataFrame, order: str = "sample_id", path: str = "image_path") -> DataFrame:
    """kind, key, n, first: how many samples claim each key, and the first of them by ``order``, whole.

    A stream of samples gives the keys that a batch touches (output mode update),
    counted over all batches; a table gives all keys.  A null id or path claims
    nothing.
    """
    row = F.struct(F.col(order).alias("_order"), *samples.columns)
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in zip(KINDS, (F.col("sample_id"), C.owner_key(F.col(path))), strict=True)])
    each = samples.select(F.explode(keys).alias("k"), row.alias("row")).where("k.key is not null")
    return each.groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))


def clashes(claimed: DataFrame) -> DataFrame:
    """kind, key, n, first_id of keys that are claimed more than once."""
    return claimed.where("n > 1").select("kind", "key", "n", F.col("first.sample_id").alias("first_id"))


def accepted(claimed: DataFrame, columns: list[str]) -> DataFrame:
    """The samples of a batch that are the only ones, then or before, to claim their id and their path."""
    only = claimed.where("n = 1")
    ids, owners = only.where("kind = 'id'"), only.where("kind = 'owner'")
    return ids.select(*[F.col(f"first.`{c}`").alias(c) for c in columns]).join(owners.select(F.col("first.sample_id").alias("sample_id")), "sample_id", "left_semi").select(*columns)


class Watch:
    """Checks what lands below a folder against all that has landed there before.

    Each call of :meth:`check` takes the files that are new since the last one.
    """

    def __init__(self, spark: SparkSession, landed: str, schema, place: str):
        self.spark, self.landed, self.schema, self.place = session(spark), landed, schema, place

    def _query(self):
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(files.literal(self.landed))
        return clashes(claims(stream)).writeStream.outputMode("update").foreachBatch(self._keep)

    def _keep(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.place}/clashes/batch={number}")

    def check(self) -> None:
        """Raise if a new sample claims what another one, new or old, has claimed."""
        query = self._query().option("checkpointLocation", f"{self.place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        found = self.spark.read.schema("kind string, key string, n bigint, first_id string, batch int").parquet(f"{self.place}/clashes")
        for kind, message in KINDS.items():
            require_none(found.where(F.col("kind") == kind).select("key").distinct(), message)
