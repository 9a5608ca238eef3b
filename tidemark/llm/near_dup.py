"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1.  One pass over the texts gives each row the size and a 128-bit digest of its
    shingle set and the band keys of its SuperMinHash signature.
2.  Rows with equal sets are one class and go on as its smallest id, so a group
    of exact copies, however large, is one member from here on.
3.  Classes that share a band key are candidates.  Within a bucket no list of all
    pairs is made: each member is tried against the bucket's centre, the member that
    meets most others, and the tried pairs that hold join components.  Where a
    centre's members still form several components, only those pairs are tried
    that can hold: see :func:`_beside_centre`.  No link in a bucket is lost.
4.  A link counts if the full sets pass ``100 * both >= percent * either``.
5.  Components come from distributed hooking, after a union-find in each
    partition has thinned the links to a forest.

Joins on a bucket or on a centre are salted by the number of rows that meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.graph import components
from tidemark.llm.scratch import Scratch, free_name
from tidemark.llm.skew import join_per_key

#: 20 bands of 4: two sets of similarity 0.8 share none with probability 3e-5.
BANDS, ROWS = 20, 4
#: Rows of a bucket, and members of a centre with their sets, that meet in one salt.
BUCKET_SALT, CENTRE_SALT = 100_000, 2_000
#: Members of a centre with one difference that meet in one salt.
DIFFERENCE_SALT = 500

_SKETCH = "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, bands array<bigint>"


def _sketch(k: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, end, data, offsets in kernels.text_slices(texts):
                sets, at = kernels.shingles(*kernels.word_hashes(data, offsets), k)
                n = np.diff(at)
                keys = kernels.band_keys(kernels.superminhash(sets, at, bands * rows), rows)
                keys = keys[n > 0]
                cuts = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mix(sets ^ np.uint64(seed))))) for seed in (0x51ED270B, 0xC2B2AE3D27D4EB4F)]
                digests = [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first).cast(pa.int64()), pa.array(n), *digests, lists], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                sets, at = kernels.shingles(*kernels.word_hashes(data, offsets), k)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), lists], schema=schema)

    return run


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition; the links that joined two trees stay."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = parent[x]
        return x

    for batch in batches:
        stay = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                stay.append(i)
        yield batch.take(pa.array(stay, pa.int64()))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id bigint, text).

    Words are runs of other than ASCII white space, A-Z in lower case.  A text
    with fewer than ``k`` words has one shingle; one without words, or a null
    text, has none and is linked with nothing.  ``component_id`` is the smallest
    id that links reach, ``kept`` whether it is the row's own.  Rows that share an
    id are one document if their sets are equal, else all their links count for
    that id; a row with a null id has a null component, is kept, and links
    nothing.  An empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near_dup")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.keep(texts.mapInArrow(_sketch(k, bands, rows), _SKETCH), "sketch")

    full = sketch.where("n_shingles > 0 and doc_id is not null")
    heads = full.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = scratch.keep(heads, "heads")
    first = full.join(heads.select(F.col("head").alias("doc_id"), "digest_a", "digest_b"), ["doc_id", "digest_a", "digest_b"], "left_semi")
    posts = first.dropDuplicates(["doc_id", "digest_a", "digest_b"]).select(F.explode("bands").alias("key"), "doc_id", F.col("n_shingles").alias("n"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.keep(shared, "shared")
    posts = scratch.keep(join_per_key(posts, shared, ["key"], bands * heads.count(), "size"), "posts")

    near = _components_of(posts, texts, k, percent, scratch)
    scratch.drop(posts)
    copies = join_per_key(full, heads.where("n > 1"), ["digest_a", "digest_b"], sketch.count(), "n")
    same = copies.where("doc_id <> head").select(F.col("doc_id").alias("_row"), "head", "n")
    where = heads.where("n > 1").select(F.col("head").alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    where = where.join(near, "node", "full_outer").select("node", "n", F.coalesce("component", "node").alias("component"))
    where = scratch.keep(where, "where")
    members = join_per_key(same.drop("n"), where.where("n is not null").withColumnRenamed("node", "head"), ["head"], sketch.count(), "n")
    member = where.select(F.col("node").alias("_row"), "component").union(members.select("_row", "component"))
    member = member.groupBy("_row").agg(F.min("component").alias("component"))
    out = sketch.select("doc_id", "n_shingles").join(member, F.col("doc_id") == F.col("_row"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components_of(posts: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the classes that links join, from their posts (key, doc_id, n, size)."""
    met_by = posts.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    met_by = scratch.keep(met_by, "members")
    sets = texts.join(met_by.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id bigint, shingles array<bigint>")
    sets = scratch.keep(sets, "sets")
    done = [met_by, sets]  # tables that only the links need

    def with_sets(pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b, ...) with both sets; a centre that meets many members is met in parts."""
        members, centres = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        fans = scratch.keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")).where(F.col("fan") > CENTRE_SALT), "fans")
        if fans.isEmpty():
            return pairs.join(members, "b").join(centres, "a")
        salts = F.coalesce(F.ceil(F.col("fan") / CENTRE_SALT), F.lit(1).cast("bigint"))
        salted = join_per_key(pairs, fans, ["a"], pairs.count(), "fan", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("fan")
        copies = centres.join(fans, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("fan")
        return salted.join(members, "b").join(copies, ["a", "salt"]).drop("salt")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) whose full sets are similar enough."""
        both = F.size(F.array_intersect("sa", "sb"))
        done.append(pairs := scratch.keep(pairs, "pairs"))
        held = with_sets(pairs).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        return held.select("a", "b").mapInArrow(thinned, "a bigint, b bigint")

    first = F.struct(F.negative("meets"), "doc_id")
    salts = F.ceil(F.col("size") / BUCKET_SALT)
    centres = posts.join(met_by, "doc_id").groupBy("key").agg(F.min_by(F.struct("doc_id", "n"), first).alias("c"), F.max("size").alias("size"))
    centres = centres.select("key", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    met = posts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts)).join(centres, ["key", "salt"]).select(F.col("c.doc_id").alias("a"), F.col("c.n").alias("na"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), "size")
    met = scratch.keep(met.groupBy("a", "b", "na", "nb").agg(F.max("size").alias("size")), "met")
    done.append(met)
    links = scratch.keep(linked(met.where(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")), "links")
    classes = components(links, scratch)

    # Buckets of two are settled by their one pair.
    named = classes.select(F.col("node").alias("b"), F.col("component").alias("_c"))
    named = met.where("size > 2").join(named, "b", "left").select("a", "b", F.coalesce("_c", "b").alias("component"))
    done.append(named := scratch.keep(named, "named"))
    open_ = named.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    open_ = scratch.keep(open_.select("a", "n"), "centres")
    groups = scratch.keep(join_per_key(named, open_, ["a"], named.count(), "n").drop("n").where("a <> b"), "open")
    if not groups.isEmpty():
        more = linked(_beside_centre(with_sets(groups), percent, scratch))
        classes = components(scratch.keep(links.union(more), "links"), scratch)
    scratch.drop(*done, groups, links)
    return classes


def _beside_centre(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of members of one centre, of different components, that can be similar enough.

    Let a member x differ from its centre c by the shingles it lacks and those it
    has besides.  The common part of x and y is then |x and c| + |y and c| - |c|
    plus the number of differences they share, so they are similar enough only if
    they share at least T = -(g(x) + g(y)) / 2(100 + p) differences, where
    g(x) = 2(100 + p)|x and c| - (100 + p)|c| - 2p|x| and p is the percentage.
    Of the differences of x in order of rarity, one of the first |diff(x)| - T + 1
    must then be among the first |diff(y)| - T + 1 of y.  At least one of the two
    is not linked with c (else they are in one component), which makes T larger
    than h = ((100 - p)|c| - g) / 2(100 + p) of the other: so at least the first
    |diff| - h of one side meet the differences of members apart from c.  Before any
    meet, each side is cut by the T that it needs with the greatest g that a partner
    of its centre has, and members that share a difference are met in salts.  The
    differences that make near copies of c are mostly rare, so a group with many
    members that are not similar to each other gives few pairs.  Where members share
    most differences at random just below the limit, no bound tells them apart, and
    the pairs that meet still grow with their square.
    """
    p = percent
    rows = members.select("a", "b", "component", F.size("sa").alias("na"), F.array_except("sa", "sb").alias("lacks"), F.array_except("sb", "sa").alias("has"), F.size("sb").alias("nb"))
    rows = rows.withColumn("both", F.col("nb") - F.size("has"))
    rows = rows.selectExpr(
        "a", "b", "component", "concat(transform(lacks, x -> ~x), has) as diff",
        f"2L * {100 + p} * both - {100 + p}L * na - {2 * p}L * nb as g", f"{100 + p}L * both < {p}L * (na + nb) as apart", f"{100 - p}L * na as top",
    )
    rows = rows.selectExpr("a", "b", "component", "size(diff) as d", "g", "apart", f"floor((top - g) / {2 * (100 + p)}.0D) as h", "explode(diff) as x")
    rows = scratch.keep(rows, "differences")
    total = rows.count()
    common = scratch.keep(rows.groupBy("a", "x").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common")
    rows = join_per_key(rows, common, ["a", "x"], total, "f")
    # Differences of one member only come first and meet nobody.
    rows = rows.selectExpr("*", "d - count(*) over (partition by a, b) + row_number() over (partition by a, b order by f, x) as place")
    rows = scratch.keep(rows, "places")
    # What each side needs of the best partner that its centre has for it.
    best = scratch.keep(rows.groupBy("a").agg(F.max("g").alias("best"), F.max(F.when(F.col("apart"), F.col("g"))).alias("best_apart"), F.count(F.lit(1)).alias("n")), "best")
    rows = join_per_key(rows, best, ["a"], rows.count(), "n")
    need = lambda g, other: f"(-floor(({g} + {other}) / {2 * (100 + p)}.0D))"
    names, salts = ("b", "component", "d", "g", "place"), f"ceil(f / {DIFFERENCE_SALT})"
    left = rows.where(f"place <= d - h and place <= d - {need('g', 'best_apart')} + 1").selectExpr("a", "x", f"explode(sequence(0L, {salts} - 1)) as salt", *[f"{n} as l_{n}" for n in names])
    right = rows.where(f"apart and place <= d - {need('g', 'best')} + 1").selectExpr("a", "x", f"pmod(xxhash64(b), {salts}) as salt", *[f"{n} as r_{n}" for n in names])
    both = need("l_g", "r_g")
    pairs = left.join(right, ["a", "x", "salt"]).where(f"l_component <> r_component and l_place <= l_d - {both} + 1 and r_place <= r_d - {both} + 1")
    return pairs.select(F.least("l_b", "r_b").alias("a"), F.greatest("l_b", "r_b").alias("b")).distinct()


def keep_first(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row of ``docs`` of each group of near copies; all columns stay.

    Five-word shingles and a similarity of 0.8.  Each row is judged by its own text,
    whatever its id: of a group the row with the smallest id stays, one without an id
    only if none has one; of rows that share an id, or have none, the one whose text
    and columns have the smallest digest.  Rows without words all stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near_dup")
    uid, doc, rank = (free_name(docs, x) for x in ("_uid", "_doc", "_rank"))
    # Numbers are fixed by being written: what follows reads them from the files.
    rows = scratch.keep(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    found = groups(rows.select(F.col(uid).alias("doc_id"), "text"), k=5, percent=80, scratch=scratch)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    named = rows.select(F.col(uid).alias(doc), F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*hashed), uid).alias(rank))
    # Only rows that a link joins to another are ranked.
    found = scratch.keep(found, "found")
    sizes = scratch.keep(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes")
    linked = join_per_key(found, sizes, ["component_id"], found.count(), "_n").drop("_n").join(named, F.col("doc_id") == F.col(doc))
    first = linked.groupBy("component_id").agg(F.min(rank).alias("_first"))
    stay = first.select(F.col(f"_first.{uid}").alias(doc))
    gone = scratch.keep(linked.select(doc).join(stay, doc, "left_anti"), "gone")
    return rows.join(gone, F.col(uid) == F.col(doc), "left_anti").drop(uid)
