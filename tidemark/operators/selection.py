"""Which samples a task trains on.

A policy takes a scope (role, group, sample_id) and returns (role, sample_id) with
the roles it distinguishes.  A seeded sample without replacement is the k smallest
by a keyed hash, so it has exactly k rows whatever the partitioning.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scope
from tidemark.operators.order import places
from tidemark.sources.shared import new_place


#: Of what a bound lets pass: 1 leaves too few with a chance of less than one in 10**9.
MARGIN = 1.0


def rank_key(seed: Column | int, ids: str = "sample_id") -> Column:
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", seed, F.col(ids)))


def sample_exactly(rows: DataFrame, k: int, seed: int, ids: str = "sample_id") -> DataFrame:
    """k rows (all, if fewer), the same for the same rows and seed: a top-k, never a full sort."""
    return rows.orderBy(rank_key(seed, ids), ids).limit(k)


def sample_per_task(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """The same for many tasks at once: ``rows`` has a column task, and a task's seed is ``seed`` + task."""
    w = Window.partitionBy("task").orderBy(rank_key(F.col("task") + seed), "sample_id")
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def replay_per_task(samples: DataFrame, arrivals: DataFrame, k: int, seed: int) -> DataFrame:
    """task, sample_id: what :func:`sample_per_task` takes from the history of each task under the rule all_seen.

    ``samples`` (group, sample_id) are the train samples, ``arrivals`` are (group,
    idx).  How many a history has follows from sizes of groups, so the k smallest
    keys of a task are below a bound of its own but for a chance of less than one in
    10**9: only keys below it leave the task that reads their group.  Those few are
    written; a history from which too few have come is gone through without a bound.
    """
    spark = samples.sparkSession
    sizes = samples.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    seen = scope.sees(arrivals, "all_seen").where("not is_current").select("task", "group")
    wanted = scope.counts_of(sizes, arrivals).select("task", F.col("history_count").alias("n"))
    share = (k + 8 * math.sqrt(k) + 16) * MARGIN / F.greatest(F.col("n"), F.lit(1))
    bound = F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * (1 << 52)))), 13, "0")).otherwise("g")  # above all digits
    dealt = seen.join(wanted.where("n > 0").withColumn("bound", bound), "task")
    key = rank_key(F.col("task") + seed)
    near = samples.select("group", "sample_id").join(dealt, "group").where(key <= F.col("bound")).select("task", "sample_id")
    path = new_place(spark, "replay")
    near.write.parquet(path)
    near = spark.read.schema(near.schema).parquet(path)
    found = near.groupBy("task").agg(F.count(F.lit(1)).alias("found"))
    short = wanted.join(found, "task", "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), "n")).select("task")
    if not short.isEmpty():
        rest = samples.select("group", "sample_id").join(seen.join(short, "task"), "group").select("task", "sample_id")
        near = near.join(short, "task", "left_anti").select("task", "sample_id").union(rest)
    return sample_per_task(near, k, seed).select("task", "sample_id")


def sample_as_numpy(rows: DataFrame, k: int, seed: int, ids: str = "sample_id") -> DataFrame:
    """The rows that ``numpy.random.default_rng(seed).choice(sorted ids, k, replace=False)`` takes.

    The driver draws k places among the n ids; the ids are numbered range by range.
    Only the places travel.
    """
    n = rows.count()
    drawn = np.random.default_rng(seed).choice(n, size=min(k, n), replace=False) if n and k else np.zeros(0, np.int64)
    wanted = rows.sparkSession.createDataFrame(pa.table({"_place": pa.array(drawn, pa.int64())}), "_place bigint")
    return places(rows, ids).join(wanted, "_place", "left_semi").select(*rows.columns)


class SelectionPolicy(ABC):
    """``params`` come from the configuration; unknown ones are errors."""

    name: str
    known: frozenset[str] = frozenset()

    def __init__(self, params: Mapping[str, Any] | None = None):
        self.params = dict(params or {})
        if extra := sorted(set(self.params) - self.known):
            raise ValueError(f"{self.name} does not know these params: {extra}")

    @abstractmethod
    def select(self, scope: DataFrame, seed: int) -> DataFrame:
        """(role, sample_id) of the selected samples."""

    def metadata(self, seed: int, counts: Mapping[str, int]) -> dict[str, Any]:
        return {"policy": self.name}


class Full(SelectionPolicy):
    """All candidates."""

    name = "full"

    def select(self, scope: DataFrame, seed: int) -> DataFrame:
        return scope.where("role = 'candidate'").select("role", "sample_id").distinct()


#: How a replay is drawn: as numpy does from the sorted ids, or by a keyed hash, which needs no order of all ids.
DRAWS = {"numpy": sample_as_numpy, "hash": sample_exactly}


class RandomReplay(SelectionPolicy):
    """The current samples and a seeded sample of the history, drawn as ``params.draw`` says (numpy, if it doesn't)."""

    name = "random_replay"
    known = frozenset({"replay_size", "draw"})

    def __init__(self, params: Mapping[str, Any] | None = None):
        super().__init__(params)
        self.size, self.draw = int(self.params.get("replay_size", 0)), self.params.get("draw", "numpy")
        if self.size < 1:
            raise ValueError("random_replay needs a positive replay_size")
        if self.draw not in DRAWS:
            raise ValueError(f"random_replay draws by {' or '.join(sorted(DRAWS))}, not {self.draw!r}")

    def select(self, scope: DataFrame, seed: int) -> DataFrame:
        ids = lambda role: scope.where(F.col("role") == role).select("sample_id").distinct()
        current = ids("current")
        history = ids("candidate").join(current, "sample_id", "left_anti")
        replay = DRAWS[self.draw](history, self.size, seed)
        return current.select(F.lit("current").alias("role"), "sample_id").union(replay.select(F.lit("replay").alias("role"), "sample_id"))

    def metadata(self, seed: int, counts: Mapping[str, int]) -> dict[str, Any]:
        return {"policy": self.name, "seed": seed, "requested_replay_size": self.size, "actual_replay_size": counts.get("replay", 0)}


POLICIES: dict[str, type[SelectionPolicy]] = {p.name: p for p in (Full, RandomReplay)}


def policy(name: str, params: Mapping[str, Any] | None = None) -> SelectionPolicy:
    if name not in POLICIES:
        raise ValueError(f"unknown selection policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[name](params)


class EpochPolicy(ABC):
    """How the selected samples are dealt to epochs."""

    name: str

    def __init__(self, params: Mapping[str, Any] | None = None):
        if params:
            raise ValueError(f"{self.name} takes no params: {sorted(params)}")

    @abstractmethod
    def plan(self, selected: DataFrame, epoch: int, seed: int) -> DataFrame: ...


class Static(EpochPolicy):
    """Every epoch sees all selected samples."""

    name = "static"

    def plan(self, selected: DataFrame, epoch: int, seed: int) -> DataFrame:
        return selected


EPOCH_POLICIES: dict[str, type[EpochPolicy]] = {Static.name: Static}


def epoch_policy(name: str, params: Mapping[str, Any] | None = None) -> EpochPolicy:
    if name not in EPOCH_POLICIES:
        raise ValueError(f"unknown epoch policy {name!r}; known: {', '.join(sorted(EPOCH_POLICIES))}")
    return EPOCH_POLICIES[name](params)
