"""Intermediate tables in the folder that the cluster shares.

Every executor and the driver can read it (see :mod:`tidemark.sources.shared`), so a
table written there survives the loss of any executor and cuts the lineage of what
follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import new_place

_COLLECTED: list[list[Scratch]] = []


class Scratch:
    """Tables of one run of one operator, in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = new_place(spark, name)
        self._next = 0
        for made in _COLLECTED:
            made.append(self)

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.folder}/{self._next:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: what follows starts from the files."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path  # on the table itself: a list here would keep plans of the past alive
        return table

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables as :meth:`keep` returned them that nothing reads any more; others are left alone."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path is not None:
                self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this run, when its result has been written elsewhere."""
        self._delete(self.folder)


@contextmanager
def collected() -> Iterator[list[Scratch]]:
    """The folders that operators make inside, for who writes their results and then clears them."""
    made: list[Scratch] = []
    _COLLECTED.append(made)
    try:
        yield made
    finally:
        _COLLECTED.remove(made)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
