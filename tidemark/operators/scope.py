"""What each task of a sequence may see.

Tasks are numbered by the arrival that starts them.  Under the rule ``all_seen``
the candidates of a task are the train samples of all groups that have arrived,
under ``current`` those of its own group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import running_sum
from tidemark.operators.registry import require_none

RULES = ("all_seen", "current")


def _known(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")


def numbered(groups: DataFrame, order: str) -> DataFrame:
    """idx (from 0) of each group by ``order``; the table has a row per group, so one task orders it."""
    return groups.withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)


def sees(arrivals: DataFrame, rule: str) -> DataFrame:
    """(task, group, is_current): the groups whose train samples a task may use.

    Each arrival carries the numbers of all tasks (one small row per group) and is
    dealt to those that see it, so no table is broadcast or counted.
    """
    _known(rule)
    tasks = F.collect_set("idx").over(Window.partitionBy())
    reach = (lambda t: t >= F.col("idx")) if rule == "all_seen" else (lambda t: t == F.col("idx"))
    dealt = arrivals.select("group", "idx", tasks.alias("_tasks")).select("group", "idx", F.explode(F.filter("_tasks", reach)).alias("task"))
    return dealt.select("task", "group", (F.col("idx") == F.col("task")).alias("is_current"))


def sizes(samples: DataFrame) -> DataFrame:
    """group, n: train samples of each group."""
    return samples.where("split = 'train'").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def counts(samples: DataFrame, arrivals: DataFrame, rule: str = "all_seen") -> DataFrame:
    """task, candidate_count, current_count, history_count: samples are counted per group before tasks meet them."""
    return counts_of(sizes(samples), arrivals, rule)


def counts_of(sizes: DataFrame, arrivals: DataFrame, rule: str = "all_seen") -> DataFrame:
    """The same from the sizes of the groups (group, n): a row per task, and a running sum over tasks for what has been seen."""
    _known(rule)
    n = F.coalesce("n", F.lit(0))
    own = arrivals.join(sizes, "group", "left").groupBy(F.col("idx").alias("task")).agg(F.sum(n).alias("current_count"))
    seen = running_sum(own, "task", "current_count", "candidate_count") if rule == "all_seen" else own.withColumn("candidate_count", F.col("current_count"))
    return seen.select("task", "candidate_count", "current_count", (F.col("candidate_count") - F.col("current_count")).alias("history_count"))


def collect_split(samples: DataFrame, groups: list[str], split: str) -> DataFrame:
    """Distinct (group, sample_id) of a split of some groups."""
    return samples.where((F.col("split") == split) & F.col("group").isin(*groups)).select("group", "sample_id").distinct()


def resolve(samples: DataFrame, current: list[str], candidate: list[str], validation: list[str], test: list[str]) -> DataFrame:
    """The scope of one task as (role, group, sample_id); history is candidate without current."""
    cur, cand = collect_split(samples, current, "train"), collect_split(samples, candidate, "train")
    parts = {
        "current": cur,
        "candidate": cand,
        "history": cand.join(cur.select("sample_id"), "sample_id", "left_anti").select("group", "sample_id"),
        "validation": collect_split(samples, validation, "val"),
        "test": collect_split(samples, test, "test"),
    }
    out = None
    for role, part in parts.items():
        part = part.select(F.lit(role).alias("role"), "group", "sample_id")
        out = part if out is None else out.union(part)
    return out


def overlaps(scope: DataFrame) -> DataFrame:
    """Ids that occur in more than one of candidate, validation and test."""
    ids = {role: scope.where(F.col("role") == role).select("sample_id") for role in ("candidate", "validation", "test")}
    pairs = (("candidate", "validation"), ("candidate", "test"), ("validation", "test"))
    found = None
    for a, b in pairs:
        both = ids[a].intersect(ids[b])
        found = both if found is None else found.union(both)
    return found.distinct()


def check(scope: DataFrame) -> None:
    """Current samples are candidates, and train, validation and test are disjoint."""
    role = lambda r: scope.where(F.col("role") == r).select("sample_id")
    require_none(role("current").join(role("candidate"), "sample_id", "left_anti"), "current samples are no candidates")
    require_none(overlaps(scope), "samples are in more than one of train, validation and test")


def known_groups(samples: DataFrame, wanted: list[tuple[str, str]]) -> None:
    """Every (group, split) that a scope names has samples."""
    spark = samples.sparkSession
    table = spark.createDataFrame(wanted, "group string, split string")
    lacking = table.join(samples.select("group", "split").distinct(), ["group", "split"], "left_anti")
    require_none(lacking.select(F.concat_ws(".", "group", "split").alias("name")), "unknown data group or split")
