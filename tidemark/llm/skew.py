"""A join of rows with a table of one row per key, whatever share of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of all rows, and more than FEW: there are fewer hot keys than SHARE.
SHARE, FEW = 10_000, 1_000


def join_per_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``; ``how`` is inner or left.

    ``table`` has the number of rows of each key in column ``size``, ``total`` is
    the number of all rows.  Rows of hot keys stay where they are and meet their
    row of the table by a broadcast: at most ``SHARE`` keys can be hot, so what is
    broadcast has a bound of its own.  All others are shuffled, and none of their
    keys weighs more than a small part of a task.
    """
    hot = (F.col(size) > FEW) & (F.col(size) * SHARE > total)
    met = rows.join(F.broadcast(table.where(hot)), keys)
    cold = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return met.unionByName(cold.join(table.where(~hot), keys, how))
