"""Image datasets as tables of paths; pixels and labels are never read.

A dataset is described by a YAML file with its root, class names, and for each
split an entry or a list of entries: a folder, a manifest (``.txt``) or an image.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import parse
from tidemark.functions import columns as C
from tidemark.operators.registry import SHOWN, IntegrityError, check, sample_records
from tidemark.sources import files, listing
from tidemark.sources.shared import new_place

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Descriptor:
    path: str
    root: str
    names: tuple[str, ...]
    splits: Mapping[str, tuple[str, ...]]


def class_names(value: Any) -> tuple[str, ...]:
    """A list of names, or a mapping whose keys count from 0."""
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return tuple(value)
    if not isinstance(value, Mapping):
        raise ValueError("names must be a list, or a mapping from class numbers")
    numbered = {int(k): str(v) for k, v in value.items()}
    if len(numbered) != len(value) or set(numbered) != set(range(len(value))):
        raise ValueError("class numbers must run from 0 without gaps")
    return tuple(numbered[i] for i in range(len(numbered)))


def describe(spark: SparkSession, path: str) -> Descriptor:
    payload = parse(files.get_text(spark, path)) or {}
    if not isinstance(payload, dict):
        raise ValueError(f"not a mapping: {path}")
    if lacking := [k for k in (*SPLITS, "names") if k not in payload]:
        raise ValueError(f"{path} lacks {lacking[0]!r}")
    folder = posixpath.dirname(path)
    root = posixpath.normpath(posixpath.join(folder, str(payload.get("path", folder))))
    entries = {s: tuple(payload[s] if isinstance(payload[s], list) else [payload[s]]) for s in SPLITS}
    return Descriptor(path, root, class_names(payload["names"]), entries)


def normal(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes."""
    empty = F.array().cast("array<string>")
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def _absolute(line: Column, base: Column) -> Column:
    return normal(F.when(F.startswith(line, F.lit("/")), line).otherwise(F.concat(base, F.lit("/"), line)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The paths that a manifest of one file or of a folder of parts lists; relative ones start at the manifest's folder."""
    found = spark.read.text(files.literal(path)).select(C.strip(F.col("value")).alias("line")).where("line <> ''")
    return found.select(_absolute(F.col("line"), F.lit(posixpath.dirname(path))).alias("path"))


def listed(entries: DataFrame, before: str, place: str) -> DataFrame:
    """entry, path of all images that entries (entry, path) stand for.

    A folder stands for the images below it, a manifest for the paths that it lists,
    whatever their suffix, and an image for itself; anything else is an error.
    """
    kinds = _kept(listing.kinds(entries, before), f"{place}/kinds")
    faults = [r["path"] for r in kinds.where("kind = 'none'").orderBy("path").limit(SHOWN).collect()]
    if faults:
        raise FileNotFoundError(f"neither a folder, a manifest nor an image: {', '.join(faults)}")
    of = lambda kind: kinds.where(F.col("kind") == kind)
    walked = listing.walk(of("folder"), before, f"{place}/levels").where(C.is_image(F.col("path")))
    told = listing.lines(of("manifest"), before).select("entry", _absolute(F.col("line"), F.regexp_replace("path", "/[^/]*$", "")).alias("path"))
    return of("image").select("entry", "path").union(walked).union(told)


def _through_driver(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """The same for a store that only the JVM reaches."""
    found = []
    for entry, path in entries.collect():
        kind = path.rpartition(".")[2].lower()
        if files.is_folder(spark, path):
            found += [(entry, x) for x in files.below(spark, path) if x.rpartition(".")[2].lower() in C.IMAGE_SUFFIXES]
        elif files.is_file(spark, path) and kind == "txt":
            found += [(entry, x if "://" in x or x.startswith("/") else posixpath.join(posixpath.dirname(path), x)) for line in files.get_text(spark, path).splitlines() if (x := line.strip())]
        elif files.is_file(spark, path) and kind in C.IMAGE_SUFFIXES:
            found.append((entry, path))
        else:
            raise FileNotFoundError(f"neither a folder, a manifest nor an image: {path}")
    return spark.createDataFrame(found, listing.ENTRY)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def catalogue(spark: SparkSession, specs: Mapping[str, Descriptor]) -> DataFrame:
    """The records of all groups: one table of entries, whatever their number, and one plan."""
    place = new_place(spark, "catalogue")
    rows = [(name, spec.root, split, posixpath.normpath(posixpath.join(spec.root, entry))) for name, spec in specs.items() for split in SPLITS for entry in spec.splits[split]]
    columns = [*map(list, zip(*rows, strict=True))] or [[]] * 4
    entries = spark.createDataFrame(pa.table([pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["entry", "group", "root", "split", "path"]))
    roots = {spec.root for spec in specs.values()}
    stores = {listing.store(spark, root) for root in roots}
    asked = entries.select("entry", "path")
    if len(stores) == 1 and all(listing.reachable(next(iter(stores)) + root if root.startswith("/") else root) for root in roots):
        found = listed(asked, next(iter(stores)), place)
    else:
        found = _through_driver(spark, asked)
    named = found.join(entries.drop("path"), "entry").select("group", "root", "split", "path").distinct()
    named = _kept(named, f"{place}/images")
    wanted = spark.createDataFrame(pa.table({"group": [g for g in specs for _ in SPLITS], "split": [*SPLITS] * len(specs)}))
    lacking = wanted.join(named.select("group", "split"), ["group", "split"], "left_anti").orderBy("group", "split").limit(SHOWN).collect()
    if lacking:
        raise IntegrityError(f"no images in {', '.join(str(list(specs[g].splits[s])) + f' ({s} of {g})' for g, s in lacking)}")
    return sample_records(named, F.col("group"), F.col("root"), F.col("split"))


def entry(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The images of one entry below ``root``."""
    path = posixpath.normpath(posixpath.join(root, name))
    return listed(spark.createDataFrame([(0, path)], listing.ENTRY), listing.store(spark, path), new_place(spark, "entry")).select("path")


def split_files(spark: SparkSession, root: str, entries: tuple[str, ...]) -> DataFrame:
    """Distinct paths that manifests, also folders of parts, list; none at all is an error."""
    found = None
    for name in entries:
        part = manifest(spark, posixpath.join(root, name))
        found = part if found is None else found.union(part)
    if found is None or found.isEmpty():
        raise IntegrityError(f"no images in {', '.join(entries) or 'an empty list'}")
    return found.distinct()


def group(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, Descriptor]:
    """The records of one dataset."""
    spec = describe(spark, path)
    return catalogue(spark, {name: spec}), spec


def same_names(first: Descriptor, other: Descriptor, name: str) -> None:
    if first.names != other.names:
        raise IntegrityError(f"label schema mismatch: group {name!r} has {list(other.names)}, not {list(first.names)}")


def registry(spark: SparkSession, catalog: Mapping[str, str]) -> tuple[DataFrame, tuple[str, ...]]:
    """Records of all groups of a catalog, checked, and the class names that they share."""
    if not catalog:
        raise IntegrityError("the catalog has no groups")
    specs = {name: describe(spark, path) for name, path in catalog.items()}
    first = next(iter(specs.values()))
    for name, spec in specs.items():
        same_names(first, spec, name)
    records = catalogue(spark, specs)
    check(records)
    return records, first.names
