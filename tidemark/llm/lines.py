"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus, by (doc_id, line number), is equal
or at most one edit (insertion, deletion or substitution of a character) away.
Texts that share an id, or have none, are told apart by a digest of the text, which
also orders their lines of one number.

1.  One pass gives each line a 128-bit BLAKE2b digest, for which no two texts can
    be made equal; equal lines become one, held by the earliest.
2.  One edit leaves the first or the last half of the longer line whole.  Each
    distinct line posts hashes of its halves; only lines that share one go on.
3.  Those lines emit the hashes of their deletion variants, without each character
    that the shared half allows to differ.  A line and its variant meet where one
    character is missing, two variants without the same place where one is
    replaced.  A bucket needs its earliest member of each kind only, so it is
    pre-aggregated and never listed pair by pair.  Its members are distinct lines
    that differ in one place, so it is no larger than a line's length times the
    alphabet, however common a line is.
4.  The pairs (line, earliest partner) are verified by the edit distance of their
    texts.

Variants are hashed as polynomials modulo 2**61 - 1 at two points that each run
draws at random, so that lines can't be made to share a bucket.  Lines without a
word are not judged and stay.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.kernels import mix
from tidemark.llm.scratch import Scratch, free_name
from tidemark.llm.skew import join_per_key

#: Default of the shortest line, in characters, that a near match may take: any.
MIN_CHARS = 0
#: Kinds of emitted rows: the line itself, without one character, without one place, and its text.
FULL, GAP, PLACE, TEXT = 0, 1, 2, 3
#: Bits of the shared halves: the first (1) or last (2) half of a line as long as this, of one longer by one (4, 8).

_U = np.uint64
_BLANKS = " \t\n\v\f\r"
#: Variants of a batch.
_BATCH = 1 << 19


def _half_keys(line: str) -> list[int]:
    n = len(line)
    keys = []
    for size in (n, n + 1):
        half = size // 2
        keys.append(xxhash.xxh3_64_intdigest(line[:half], seed=2 * size))
        keys.append(xxhash.xxh3_64_intdigest(line[n - (size - half) :], seed=2 * size + 1))
    return keys


_LINES = "doc_id bigint, row bigint, line_no bigint, a bigint, b bigint, halves array<bigint>"


def _list_lines(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line_no", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                raw = data.tobytes()
                doc, number, digests, halves, cuts = [], [], [], [], [0]
                for i, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for n, line in enumerate(raw[begin:stop].decode().split("\n")):
                        if line.strip(_BLANKS):
                            doc.append(i)
                            number.append(n)
                            digests.append(blake2b(line.encode(), digest_size=16).digest())
                            if len(line) >= min_chars:
                                halves += _half_keys(line)
                            cuts.append(len(halves))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.array(halves, np.uint64).view(np.int64)))
                ids, keys = (batch.column(c).slice(first, end - first).take(pa.array(doc, pa.int64())) for c in ("doc_id", "row"))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(number, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], schema=schema)

    return run


# polynomials modulo 2**61 - 1

PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return x - _P * (x >= _P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below the prime."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(_U(2) * a1 * b1 + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ...: n of them."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _times(out[:more], np.full(more, pow(base, have, PRIME), np.uint64))
        have += more
    return out


class _Hasher:
    """Hashes of lines that stand one after another, whole or without a character, at one point."""

    def __init__(self, points: np.ndarray, base: int):
        n = len(points)
        terms = _times(points.astype(np.uint64) + _U(1), _powers(base, n)) if n else np.zeros(0, np.uint64)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (terms >> _U(31), terms & _LOW31)]
        self.sums = _reduced(_times(_reduced(sums[0]), np.full(n + 1, 1 << 31, np.uint64)) + _reduced(sums[1]))
        self.down = _powers(pow(base, -1, PRIME), n + 1)

    def _between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _reduced(self.sums[end] + (_P - self.sums[begin]))

    def whole(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _times(self._between(begin, end), self.down[begin])

    def without(self, begin: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        after = _times(self._between(at + 1, end), np.full(len(at), self.down[1] if len(self.down) > 1 else 1, np.uint64))
        return _times(_reduced(self._between(begin, at) + after), self.down[begin])


def _tag(kind: int, n: np.ndarray) -> np.ndarray:
    return mix(n.astype(np.uint64) * _U(8) + _U(kind + 1))


_VARIANTS = "doc_id bigint, row bigint, line_no bigint, kind int, key bigint, proof int, line string"


def _list_variants(bases: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (kind, key, proof) of the lines named in ``want`` (line number * 16 + bits of the shared sides)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line_no", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("proof", pa.int32()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = batch.column("want")
            rows, numbers, sides, lines, size = [], [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                split = text.as_py().split("\n")
                for want in wants[i].as_py():
                    number, side = divmod(want, 16)
                    if number >= len(split):  # no line of this text
                        continue
                    rows.append(i)
                    numbers.append(number)
                    sides.append(side)
                    lines.append(split[number])
                    size += len(split[number])
                    if size >= _BATCH:
                        yield from _variants(batch, rows, numbers, sides, lines, bases, schema)
                        rows, numbers, sides, lines, size = [], [], [], [], 0
            if rows:
                yield from _variants(batch, rows, numbers, sides, lines, bases, schema)

    return run


def _variants(batch: pa.RecordBatch, rows: list[int], numbers: list[int], sides: list[int], lines: list[str], bases: tuple[int, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    hashers = [_Hasher(points, b) for b in bases]
    n = np.array([len(x) for x in lines], np.int64)
    end, side = np.cumsum(n), np.array(sides, np.int64)
    begin = end - n
    row, number = np.array(rows, np.int64), np.array(numbers, np.int64)

    def out(line: np.ndarray, kind: int, keys: list[np.ndarray], tag: np.ndarray, text: list[str] | None = None) -> pa.RecordBatch:
        names = [batch.column(c).take(pa.array(row[line])) for c in ("doc_id", "row")]
        nothing = pa.nulls(len(line), pa.int64()), pa.nulls(len(line), pa.int32())
        hashed = nothing if text is not None else (pa.array(mix(keys[0] ^ tag).view(np.int64)), pa.array((mix(keys[1] ^ tag) >> _U(33)).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*names, pa.array(number[line]), pa.array(np.full(len(line), kind, np.int32)), *hashed, pa.array(text, pa.string()) if text is not None else pa.nulls(len(line), pa.string())], schema=schema)

    every = np.arange(len(lines))
    yield out(every, TEXT, [], every, lines)
    short = np.flatnonzero(side & 12)
    yield out(short, FULL, [h.whole(begin[short], end[short]) for h in hashers], _tag(FULL, n[short]))
    # The places that may differ: behind a shared first half, before a shared last half.
    half = n // 2
    lo, hi = np.where(side & 2, 0, half), np.where(side & 1, n, half)
    count = np.where(side & 3, hi - lo, 0)
    upto = np.cumsum(count)
    for start in range(0, int(upto[-1]), _BATCH):
        k = np.arange(start, min(start + _BATCH, int(upto[-1])))
        line = np.searchsorted(upto, k, "right")
        place = k - (upto - count)[line] + lo[line]
        spans = [h.without(begin[line], begin[line] + place, end[line]) for h in hashers]
        yield out(line, GAP, spans, _tag(FULL, n[line] - 1))
        yield out(line, PLACE, spans, _tag(PLACE, n[line]) ^ mix(place.astype(np.uint64) + _U(7)))


def _row(text: str = "text") -> Column:
    """The key of a row beside its id: 60 bits of the SHA-256 of its text."""
    return F.conv(F.left(F.sha2(F.col(text).cast("string").cast("binary"), 256), F.lit(15)), 16, 10).cast("bigint")


def judge(docs: DataFrame, scratch: Scratch | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, kept, keeper_doc_id, keeper_line_no, distance: a row for each line with a word.

    Lines are what line feeds separate, counted from 0.  ``distance`` is 0 or 1
    for a line that goes and null for one that stays; the keeper is the earliest
    line one edit away if that is earlier than all equal lines, or else the
    earliest equal line.  A null text has no lines; a null id counts as the smallest.
    Rows that share both id and text have the same lines, which stay or go
    together; rows that share an id but not the text are judged each by its own lines.
    Lines of fewer than ``min_chars`` characters go for equal lines only.  An empty
    table gives an empty result.
    """
    return _judge_rows(docs, scratch, min_chars).drop("row")


def _judge_rows(docs: DataFrame, scratch: Scratch | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """What :func:`judge` gives, and ``row``, which tells texts of one id apart."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").where("text is not null").select("doc_id", _row().alias("row"), "text")
    lines = scratch.keep(texts.mapInArrow(_list_lines(min_chars), _LINES), "lines")
    order = F.struct("doc_id", "line_no", "row")
    distinct = lines.groupBy("a", "b").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves"))
    distinct = scratch.keep(distinct, "distinct")

    posts = distinct.select("first.doc_id", "first.row", "first.line_no", F.posexplode("halves").alias("side", "half"))
    shared = scratch.keep(posts.groupBy("half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    open_ = join_per_key(posts, shared, ["half"], 4 * distinct.count(), "_n").groupBy("doc_id", "row", "line_no").agg(F.bit_or(F.expr("1L << side")).alias("sides"))
    want = open_.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.expr("line_no * 16 + sides"))).alias("want"))
    asked = texts.join(want, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "want")
    bases = (secrets.randbelow(PRIME - 2**32) + 2**31, secrets.randbelow(PRIME - 2**32) + 2**31)
    emitted = scratch.keep(asked.mapInArrow(_list_variants(bases), _VARIANTS), "variants")

    variants = emitted.where(f"kind <> {TEXT}").select("key", "proof", "kind", "doc_id", "row", "line_no")
    met = variants.groupBy("key", "proof").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "proof")
    variants = scratch.keep(variants.join(met, ["key", "proof"], "left_semi"), "met")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, order))
    buckets = variants.groupBy("key", "proof").agg(least(FULL).alias("f"), least(GAP).alias("g"), least(PLACE).alias("p"))
    partner = F.when(F.col("kind") == FULL, F.col("g")).when(F.col("kind") == GAP, F.col("f")).otherwise(F.col("p"))
    pairs = variants.join(buckets, ["key", "proof"]).select(order.alias("own"), partner.alias("with_")).where("with_ < own").distinct()
    words = emitted.where(f"kind = {TEXT}").select(order.alias("o"), "line").dropDuplicates(["o"])
    pairs = pairs.join(words.select(F.col("o").alias("own"), F.col("line").alias("la")), "own").join(words.select(F.col("o").alias("with_"), F.col("line").alias("lb")), "with_")
    near = pairs.where(F.levenshtein("la", "lb", 1) == 1).groupBy(F.col("own").alias("first")).agg(F.min("with_").alias("near"))

    named = distinct.join(near, "first", "left").where("n > 1 or near is not null").select("a", "b", "first", "near", "n")
    named = scratch.keep(named, "named")
    scratch.drop(distinct, emitted, variants)
    # Rows of a very common line stay where they are.
    out = join_per_key(lines.select("doc_id", "row", "line_no", "a", "b"), named, ["a", "b"], lines.count(), "n", "left")
    equal = F.when(order != F.col("first"), F.col("first"))
    keeper = F.coalesce("near", equal)
    return out.select(
        "doc_id",
        "row",
        "line_no",
        keeper.isNull().alias("kept"),
        F.coalesce(keeper, order)["doc_id"].alias("keeper_doc_id"),
        F.coalesce(keeper, order)["line_no"].alias("keeper_line_no"),
        F.when(F.col("near").isNotNull() & equal.isNull(), 1).when(equal.isNotNull(), 0).alias("distance"),
    )


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose numbers the last column lists; the other columns as they are."""
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if gone and text is not None:
                lines = text.split("\n")
                for i in gone:
                    if i < len(lines):
                        lines[i] = None
                text = "\n".join(x for x in lines if x is not None)
            texts.append(text)
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
        yield batch.select(batch.schema.names[:-1])


def drop_repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the lines that go; all rows and columns stay.

    A text that loses all its lines becomes empty; ``n_chars``, where it is a
    column, follows the text.
    """
    doc, row, lost = (free_name(docs, x) for x in ("_doc", "_row", "_gone"))
    gone = _judge_rows(docs, scratch=scratch).where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost))
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (_row() == F.col(row)), "left").drop(doc, row)
    out = both.mapInArrow(_rebuild, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
