"""Nearest neighbours by inner product with a permutation index.

Each vector is represented by its ``LISTED`` nearest pivots in order.  Vectors
are dealt to blocks, and each block has an inverted file: for every pivot the
place at which each vector of the block lists it.  A query walks the files of
its own pivots; what two vectors list in common gives the footrule distance of
their lists (a pivot that one of them does not list counts as listed last).  The
nearest part of each block by footrule is ranked again by the exact inner
product.  Nothing is left out of the index; the share that is ranked again
(``RERANKED``) sets recall.

Inner products are made angles first: each vector gets one more component, so that
all have the length of the longest, and a query gets 0 there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Pivots: the bounded sample that the index is fitted on; pivots in a vector's list.
PIVOTS, LISTED = 256, 64
#: Share of a block that is ranked again; at least twice as many as are asked for.
RERANKED = 0.3
#: Vectors and queries that meet in one task.
BLOCK, QUERIES = 8192, 8192
#: Share of vectors that are wholly in a block's matrix, and entries of that matrix at most; what few longer ones have beyond stands apart.
LONGEST, ENTRIES = 0.99, 1 << 23


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, one per id.

    Null ids, null, zero and empty vectors and those with a null or non-finite
    component take no part.  A vector that is shorter than others counts as having
    zeros behind its end.  Of rows that share an id the one with the smallest vector
    stays.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The first ``dims`` components of each vector as a row, and by row what longer ones have beyond."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dims:
        return flat.reshape(-1, dims), {}
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    tails = {i: flat[ends[i] - sizes[i] + dims : ends[i]] for i in np.flatnonzero(sizes > dims).tolist()}
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat[np.arange(len(flat)) - np.repeat(ends - sizes, sizes) < dims]
    return out, tails


def permutations(x: np.ndarray, pivots: np.ndarray, longest: float, listed: int, query: bool = False) -> np.ndarray:
    """The nearest pivots of each row, nearest first (rows x listed)."""
    length = np.sqrt((x * x).sum(axis=1))
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest * longest - length * length, 0))
    near = x @ pivots[:, :-1].T + more[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, :listed].astype(np.uint8)


def search_block(
    ids: np.ndarray, x: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, q: np.ndarray, query_lists: np.ndarray, k: int, pivots: int,
    tails: dict[int, np.ndarray] | None = None, query_tails: dict[int, np.ndarray] | None = None,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (id, ids, scores) of its nearest in a block, nearest first, ties to the smaller id.

    ``tails`` are components of single rows beyond those in ``x`` and ``q``: rows that
    have such are always ranked for a query that has them too.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, lists = ids[order], x[order], lists[order]
    place = {int(old): new for new, old in enumerate(order)} if tails else {}
    tails = {place[row]: tail for row, tail in (tails or {}).items()}
    n, listed = lists.shape
    files = np.zeros((pivots, n), np.uint8)  # per pivot: the weight of the place where each vector lists it
    rows = np.arange(n)
    for place in range(listed):
        files[lists[:, place], rows] = listed - place
    some = min(n, max(2 * k, -int(-n * RERANKED // 1)))
    out, least, common = [], np.empty(n, np.uint8), np.empty(n, np.uint16)
    with np.errstate(over="ignore", invalid="ignore"):
        for number, (query, vector, pivot_list) in enumerate(zip(query_ids, q, query_lists, strict=True)):
            # The footrule distance is a constant less twice this sum over the common pivots.
            common[:] = 0
            for place, pivot in enumerate(pivot_list.tolist()):
                np.minimum(files[pivot], np.uint8(listed - place), out=least)
                common += least
            if some < n:
                key = common.astype(np.int64) * n + (n - 1 - rows)
                picked = np.sort(np.argpartition(key, n - some)[n - some :])
            else:
                picked = rows
            beyond = (query_tails or {}).get(number)
            if beyond is not None and tails:
                picked = np.union1d(picked, list(tails))
            picked = picked[ids[picked] != query]
            scores = (x[picked] * vector).sum(axis=1)
            if beyond is not None:
                for at, row in enumerate(picked.tolist()):
                    if row in tails:
                        n_both = min(len(beyond), len(tails[row]))
                        scores[at] += (beyond[:n_both] * tails[row][:n_both]).sum()
            best = np.argsort(-np.where(np.isnan(scores), -np.inf, scores), kind="stable")[:k]
            out.append((query, ids[picked[best]], scores[best]))
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Queries are the usable vectors whose id is divisible by ``every``, candidates
    all others.  Fewer than k candidates are all returned; a query without any
    has no rows; an empty table gives an empty result.  Scores are what double
    precision gives; one that is no number, as of two overflows, is the last.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    rows = scratch.keep(rows, "vectors")
    most = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    dims, total, asked, top = rows.agg(F.percentile_approx(F.size("embedding"), LONGEST, 10_000), F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), most).first()
    if not total:
        return spark.createDataFrame([], schema)
    # The index looks at the first components, as many as all but a few vectors have; scores take all.
    head = F.slice("embedding", 1, dims)
    # The index looks at vectors divided by the largest component, so that no length overflows.
    longest = rows.agg(F.max(F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + (x / top) * (x / top))))).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * PIVOTS).select(head).collect()
    points = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        points[i, : len(r[0])] = r[0]
    own = np.unique(points, axis=0, return_index=True)[1]
    points = points[np.sort(own)[:PIVOTS]] / top
    more = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    pivots = np.column_stack((points, more))
    kind = rows.schema["embedding"].dataType.simpleString()
    fits = max(1, ENTRIES // max(dims, 1))  # vectors whose matrix a task can hold
    listed, blocks, parts = min(LISTED, len(pivots)), -(-total // min(BLOCK, fits)), max(1, -(-asked // min(QUERIES, fits)))

    def listing(query: bool):
        out = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32() if kind == "array<float>" else pa.float64())), ("list", pa.binary())])

        def run(batches):
            for batch in (b.slice(i, fits) for b in batches for i in range(0, len(b), fits)):
                found = permutations(_matrix(batch.column("embedding"), dims)[0] / top, pivots, longest, listed, query)
                lists = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.arange(len(found) + 1, dtype=np.int32) * listed), pa.py_buffer(np.ascontiguousarray(found))])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding").cast(out.field(1).type), lists], schema=out)

        return run

    def table(df: DataFrame, query: bool, n: int, own: str, other: str, copies: int) -> DataFrame:
        named = df.select("vec_id", "embedding").mapInArrow(listing(query), f"vec_id bigint, embedding {kind}, list binary")
        named = named.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        return named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return names.empty_table()
        unpack = lambda t: (t["vec_id"].to_numpy(), _matrix(t["embedding"], dims), np.frombuffer(b"".join(t["list"].to_pylist()), np.uint8).reshape(len(t), listed))
        (ids, (x, tails), lists), (asked_ids, (q, query_tails), query_lists) = unpack(left), unpack(right)
        found = search_block(ids, x, lists, asked_ids, q, query_lists, k, len(pivots), tails, query_tails)
        sizes = [len(f[1]) for f in found]
        return pa.table([pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]))], schema=names)

    left = table(rows, False, blocks, "block", "part", parts)
    right = table(rows.where(F.col("vec_id") % every == 0), True, parts, "part", "block", blocks)
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    ranked = met.selectExpr("query_id", "int(row_number() over (partition by query_id order by if(isnan(score), null, score) desc nulls last, vec_id)) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
