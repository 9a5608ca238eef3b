"""Importance resampling toward a target distribution.

1.  Features (runs of one and two words) are hashed to buckets.  Counts of the
    documents and of the target texts give each bucket a gain, an array that
    weighs a document by the mean gain of its features.
2.  Weights with Gumbel noise are scores: the highest are a sample without
    replacement.  Each task sorts its eligible documents into a run, which is
    written.
3.  Boundaries from a bounded sample cut all runs into ranges of scores, and the
    sizes of ranges, counted exactly, say where each begins.  In a range the parts
    of all runs are merged by a tournament tree, which gives ranks.  Ranges below
    the draw are not merged, and in the range where it ends the tree stops after
    the exact number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.scratch import Scratch

BUCKETS, SEED = 10_000, 7
#: Words that an eligible document has at least; per cent of the eligible ones that are drawn.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes up to which a word is hashed beside others; rows of the sample for each range.
LONG, SAMPLED = 64, 8
#: Partial counts that reach the driver.
PARTS = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The crc32 of spans of bytes, each going on from a crc32 before it."""
    state = ~start
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    order = order[np.count_nonzero(size > LONG) :]
    at, own, sizes = begin[order], state[order], size[order]
    ends = np.searchsorted(-sizes, -np.arange(1, LONG + 1), "right")  # spans of at least so many bytes
    for step, live in enumerate(ends.tolist()):
        if not live:
            break
        own[:live] = _CRC[(own[:live] ^ data[at[:live] + step]) & np.uint32(0xFF)] ^ (own[:live] >> np.uint32(8))
    state[order] = own
    out = ~state
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(start[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text of each word, crc32 of each word, crc32 of each word and its next; of a text's last word that is no feature)."""
    data = kernels.FOLD[data]
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    begin = np.flatnonzero(starts)
    size = np.flatnonzero(ends) + 1 - begin
    n = np.diff(np.searchsorted(begin, offsets))
    one = crc32_spans(data, begin, size, np.zeros(len(begin), np.uint32))
    spaced = ~one
    spaced = ~(_CRC[(spaced ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (spaced >> np.uint32(8)))
    two = crc32_spans(data, begin[1:], size[1:], spaced[:-1])
    return n, np.repeat(np.arange(len(n)), n), one, two


def _pairs(owner: np.ndarray) -> np.ndarray:
    """Is the word behind a word one of the same text?"""
    return owner[1:] == owner[:-1]


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernels.text_slices(batch.column("text")):
                _, owner, one, two = features(data, offsets)
                for hashes in (one, two[_pairs(owner)]):
                    total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def _added(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                total += np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: counted in tasks, added in a fixed number of tasks, then here."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(buckets), "counts binary")
    added = parts.repartition(PARTS).mapInArrow(_added(buckets), "counts binary")
    return sum((np.frombuffer(r[0], np.int64) for r in added.collect()), np.zeros(buckets, np.int64))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more likely each bucket is in the target, both smoothed by one feature a bucket."""
    s, t = source + 1.0, target + 1.0
    return np.floor(1000 * np.log(t * float(source.sum() + len(source)) / (s * float(target.sum() + len(target))))).astype(np.int64)


def _weigh(gain: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                n, owner, one, two = features(data, offsets)
                own = gain[one % buckets]
                own[:-1] += np.where(_pairs(owner), gain[two % buckets], 0)
                at = np.concatenate(([0], np.cumsum(n)))
                sums = np.concatenate(([0], np.cumsum(own)))
                many = n + np.maximum(n - 1, 0)
                weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(many, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), pa.array(n), pa.array(many), pa.array(weight)], schema=schema)

    return run


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score of every row of ``docs``; an id that is null draws as an empty one."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_weigh(gain), "doc_id bigint, words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


class Tournament:
    """A tree of losers over sorted runs of keys: ``winner`` is the run with the smallest head."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.losers = [-1] * self.size
        heads = [*range(len(runs)), *[-1] * (self.size - len(runs))]
        while len(heads) > 1:
            base, won = len(heads) // 2, []
            for i in range(base):
                a, b = heads[2 * i], heads[2 * i + 1]
                if self._before(b, a):
                    a, b = b, a
                self.losers[base + i] = b
                won.append(a)
            heads = won
        self.winner = heads[0] if runs else -1

    def _before(self, a: int, b: int) -> bool:
        """Does the head of run a come before that of run b?  A run that is over, or none (-1), comes last."""
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        return b < 0 or self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of all keys in order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            won = self.winner
            yield won, self.at[won]
            self.at[won] += 1
            node = (self.size + won) // 2
            while node:  # the match is played again on the way up only
                if self._before(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.winner = won


#: The order of the draw: highest score first, then the smaller id, rows without one last, then the run and the place in it.
def _keys(batch: pa.RecordBatch) -> list[tuple]:
    ids = batch.column("doc_id").to_pylist()
    return [(-s, i is None, i or 0, q) for s, i, q in zip(batch.column("score").to_pylist(), ids, batch.column("seq").to_pylist(), strict=True)]


def _ranged(cuts: list[tuple]):
    """The range of each row: cuts are the first keys of ranges 1, 2, ..."""
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("range", pa.array([bisect_right(cuts, key) for key in _keys(batch)], pa.int32()))

    return run


def _merged(starts: dict[int, int], draws: int):
    """Rows of ranges, sorted by range and seq, with their ranks."""

    def ranks(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, of = _keys(rows), rows.column("seq").to_numpy() >> 33
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(rows)]
        begin = starts[rows.column("range")[0].as_py()]
        rank: list[int | None] = [None] * len(rows)
        if begin < draws:
            for place, (own, at) in enumerate(Tournament([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), begin + 1):
                rank[cuts[own] + at] = place
                if place == draws:
                    break
        names = ["doc_id", "n_features", "weight", "score"]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(rank, pa.int64())], names=[*names, "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("range")[0].as_py() != own[a]:
                    yield ranks(pa.concat_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield ranks(pa.concat_batches(held))

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id bigint, text).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are
    drawn, highest scores first, ties to the smaller id; ``rank`` counts them from
    1 and is null for all others.  Null and empty texts have no features and weigh
    0.  A null id draws as an empty one and comes last among ties; repeated rows
    are drawn each for itself.  An empty target weighs by the documents alone.  An
    empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    first = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = scored(docs, target, seed).withColumn("eligible", F.col("words") >= least_words).drop("words")
    # The number is given after the sort: its upper bits are the run, its lower ones the place in it.
    runs = scratch.keep(rows.sortWithinPartitions(*first).withColumn("seq", F.monotonically_increasing_id()), "runs")
    plain = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    eligible = runs.where("eligible").drop("eligible")
    total = eligible.count()
    draws = percent * total // 100
    ranges = -(-isqrt(total) // 4)
    sample = eligible.orderBy(F.xxhash64("doc_id", "seq"), "seq").limit(SAMPLED * ranges).select("score", "doc_id", "seq").toArrow()
    cuts = sorted(k for b in sample.to_batches() for k in _keys(b))[::SAMPLED][1:]
    kinds = "doc_id bigint, n_features bigint, weight bigint, score bigint, seq bigint, range int"
    ranged = eligible.mapInArrow(_ranged(cuts), kinds)
    sizes = dict(ranged.groupBy("range").agg(F.count(F.lit(1))).collect())
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part] = before
        before += sizes[part]
    last = max((p for p, start in starts.items() if start < draws), default=-1)
    met = ranged.where(F.col("range") <= last).repartition("range").sortWithinPartitions("range", "seq")
    merged = met.mapInArrow(_merged(starts, draws), "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint")
    return merged.unionByName(plain(ranged.where(F.col("range") > last))).unionByName(plain(runs.where("not eligible")))
