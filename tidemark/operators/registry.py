"""The sample registry and its integrity checks.

Samples are a table (sample_id, group, split, ...).  Each check is a query for
violations; :func:`require_none` turns a non-empty one into an error that shows at
most five of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.order import places

#: Violations that an error shows; ids of a chunk.
SHOWN, CHUNK = 5, 10_000


class IntegrityError(ValueError):
    """A check found violations."""


def sample_records(files: DataFrame, group: Column | str, root: Column | str, split: Column | str) -> DataFrame:
    """Records of a table of absolute paths (path); group, root and split are texts or columns of it."""
    group, root, split = (F.lit(x) if isinstance(x, str) else x for x in (group, root, split))
    path = F.col("path")
    return files.select(
        C.sample_id(group, C.relative_path(path, root)).alias("sample_id"),
        path.alias("image_path"),
        C.label_path(path).alias("label_path"),
        group.alias("group"),
        split.alias("split"),
    )


def group_index(samples: DataFrame) -> DataFrame:
    """group, split, n and the first and last id, without gathering the ids."""
    return samples.groupBy("group", "split").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"))


def group_members(samples: DataFrame) -> DataFrame:
    """group, split and the ordered ids; one row holds all ids of a group's split."""
    return samples.groupBy("group", "split").agg(F.sort_array(F.collect_list("sample_id")).alias("ids"))


def member_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """group, split, chunk, first, ids, digest: the ordered ids in rows of ``size`` at most.

    ``first`` is the place of a chunk's first id among all of its group's split, so
    chunks side by side are the whole list and none needs the others; ``digest``
    tells whether two chunks hold the same ids.
    """
    placed = places(samples.select("group", "split", "sample_id"), "sample_id", ("group", "split"))
    chunk = F.floor(F.col("_place") / size)
    own = placed.groupBy("group", "split", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_place", "sample_id"))).alias("m"))
    ids = F.col("m.sample_id")
    return own.select("group", "split", "chunk", F.col("m")[0]["_place"].alias("first"), ids.alias("ids"), F.sha2(F.array_join(ids, "\n"), 256).alias("digest"))


def path_faults(samples: DataFrame, root: Column | str, path: str = "image_path") -> DataFrame:
    """sample_id, fault of the samples whose path has no place in a dataset: what :func:`sample_records` fails for, as rows."""
    root, at = F.lit(root) if isinstance(root, str) else root, F.col(path)
    outside = F.when(~F.startswith(at, F.concat(root, F.lit("/"))), "not below the dataset root")
    unlabelled = F.when(~at.rlike(C.IMAGES_FOLDER), "no images directory")
    return samples.select("sample_id", F.coalesce(outside, unlabelled, F.when(at.isNull(), "no path")).alias("fault")).where("fault is not null")


def empty_splits(samples: DataFrame, groups: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """group, split of the groups (group) and splits that have no sample."""
    wanted = groups.select("group", F.explode(F.array(*map(F.lit, splits))).alias("split"))
    return wanted.join(samples.select("group", "split").distinct(), ["group", "split"], "left_anti")


def duplicate_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shared_owners(samples: DataFrame, path: str = "image_path", by: str = "sample_id") -> DataFrame:
    """owner_key, n, first_id of paths that more than one sample claims."""
    return samples.groupBy(C.owner_key(F.col(path)).alias("owner_key")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("first_id")).where("n > 1")


def schema_matches(names: DataFrame) -> DataFrame:
    """group, n_names, matches_first from (group, place, names): is each list that of the first group?"""
    first = names.agg(F.min_by("names", "place").alias("first"))
    return names.crossJoin(F.broadcast(first)).select("group", F.size("names").cast("long").alias("n_names"), (F.col("names") == F.col("first")).alias("matches_first"))


def unknown_ids(ids: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    return ids.join(samples.select(key), key, "left_anti")


def bind(ids: DataFrame, samples: DataFrame, *payload: str) -> DataFrame:
    """Late binding: the ordered ids (pos, sample_id) with columns of their records.

    Duplicates among the ids stay; the order is that of ``pos``.
    """
    return ids.join(samples.select("sample_id", *payload), "sample_id").select("pos", "sample_id", *payload).orderBy("pos")


def require_none(violations: DataFrame, message: str, column: str | None = None) -> None:
    """Raise unless ``violations`` is empty."""
    column = column or violations.columns[0]
    shown = [str(r[0]) for r in violations.select(column).orderBy(column).limit(SHOWN).collect()]
    if shown:
        raise IntegrityError(f"{message}: {', '.join(shown)}")


def check(samples: DataFrame, path: str = "image_path") -> None:
    """Ids are unique and no image belongs to two samples."""
    require_none(duplicate_ids(samples), "sample ids occur twice", "sample_id")
    require_none(shared_owners(samples, path), "images appear in more than one split", "owner_key")
