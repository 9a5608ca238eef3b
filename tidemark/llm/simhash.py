"""Near-duplicate groups by SimHash fingerprints that differ in few bits.

1.  One pass over the texts gives each row a 64-bit fingerprint: a bit is 1 if it
    is 1 in more than half of the hashes of the text's shingles, repeats included.
2.  Rows of one fingerprint are one class, known by its smallest id, so a group of
    exact copies is one member from here on.
3.  Fingerprints are cut into blocks.  Two that differ in at most ``bits`` bits
    agree in all blocks but ``bits`` of them, so each fingerprint is posted under
    every choice of blocks that may be left, and only those under one post meet.
    What meets is verified by its Hamming distance.
4.  A crowded post, as a family of near copies makes one, lists no pairs: see
    :func:`_in_crowds`.  No link is lost there.
5.  Components come from distributed hooking, after a union-find in each partition
    has thinned the links to a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.graph import components
from tidemark.llm.near_dup import thinned
from tidemark.llm.scratch import Scratch
from tidemark.llm.skew import join_per_key

SEED = 42
#: Blocks of a fingerprint beside those that may differ: with 2 bits there are 10 posts of 38 bits or so.
AGREEING = 3
#: Fingerprints of a post up to which its pairs are listed; beyond, each would meet more than the values beside it.
CROWD = 64
#: Shingles whose bits are counted at a time.
PART = 1 << 15


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z in lower case, with one space behind each; begin and end of each word, and the first word of each text."""
    data = kernels.FOLD[data]
    word = ~kernels.SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    before = np.cumsum(starts) - 1  # every word before a byte has left one space
    begin = np.flatnonzero(starts)
    out = np.full(int(word.sum()) + len(begin), 0x20, np.uint8)
    place = np.cumsum(word) - 1 + before
    out[place[word]] = data[word]
    first = place[begin]
    return out, first, np.append(first[1:], len(out)) - 1, np.searchsorted(begin, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each text; 0 of one without words."""
    text, begin, end, at = _joined(data, offsets)
    buffer = text.tobytes()
    n = np.diff(at)
    sets = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(sets)))
    # Shingle i of a text begins with its word i and ends with the k-th from there, or the text's last.
    owner = np.repeat(np.arange(len(n)), sets)
    word = at[owner] + np.arange(len(owner)) - to[owner]
    first, last = begin[word], end[np.minimum(word + k, at[owner + 1]) - 1]
    ones = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(owner), PART):
        high = min(low + PART, len(owner))
        hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(first[low:high].tolist(), last[low:high].tolist(), strict=True)), np.uint64, high - low)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[low:high]
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_ = 2 * ones > sets[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                prints = pa.array(fingerprints(data, offsets, k).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), prints], schema=schema)

    return run


def _masks(bits: int) -> list[int]:
    """The bits of each post: every choice of ``AGREEING`` of the blocks."""
    blocks = np.array_split(np.arange(64), AGREEING + bits)
    return [sum(1 << int(b) for block in chosen for b in block) for chosen in combinations(blocks, AGREEING)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def groups(docs: DataFrame, k: int = 3, bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id bigint, text).

    Words are runs of other than ASCII white space, A-Z in lower case; shingles are
    hashed by XXH64 with seed 42.  A text with fewer than ``k`` words has one
    shingle, all of them; one without words, or a null text, has fingerprint 0 and
    is linked like any other.  ``bits`` (at most 2) is the distance up to which
    fingerprints link, ``component_id`` the smallest id that links reach.  Repeated
    rows have the same result; rows that share an id with different texts link all
    that their texts link.  A row with a null id has a fingerprint, a null
    component, and links nothing.  An empty table gives an empty result; other
    columns are ignored.
    """
    if not 0 <= bits <= 2:
        raise ValueError(f"fingerprints link at 0, 1 or 2 bits, not {bits}")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.keep(texts.mapInArrow(_sketch(k), "doc_id bigint, print bigint"), "sketch")
    rows = sketch.count()
    named = sketch.where("doc_id is not null")
    classes = scratch.keep(named.groupBy("print").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), "classes")

    links = _links(classes, bits, scratch)
    # Ids of rows with different texts are nodes between the classes of these.
    torn = named.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("doc_id")
    torn = join_per_key(named.join(torn, "doc_id", "left_semi"), classes, ["print"], rows, "n").where("head <> doc_id")
    links = links.union(torn.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))).mapInArrow(thinned, "a bigint, b bigint")
    found = components(scratch.keep(links, "links"), scratch)

    where = classes.join(found, F.col("head") == F.col("node"), "left").select("print", "n", F.coalesce("component", "head").alias("component"))
    where = scratch.keep(where.where("n > 1 or component is not null"), "where")
    out = join_per_key(sketch, where, ["print"], rows, "n", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def _links(classes: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(a, b): heads of classes whose fingerprints differ in at most ``bits`` bits, enough of them to join what all join."""
    masks = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(_masks(bits))])
    posts = classes.select("print", "head", F.explode(masks).alias("m"))
    posts = posts.select(F.col("m.choice").alias("choice"), F.col("print").bitwiseAND(F.col("m.mask")).alias("block"), "print", "head")
    posts = scratch.keep(posts, "posts")
    shared = posts.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.keep(shared, "shared")
    met = scratch.keep(join_per_key(posts, shared, ["choice", "block"], posts.count(), "size"), "met")
    scratch.drop(posts)
    few = met.where(F.col("size") <= CROWD)
    left = few.select("choice", "block", F.col("print").alias("p"), F.col("head").alias("a"))
    right = few.select("choice", "block", F.col("print").alias("q"), F.col("head").alias("b"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= bits
    pairs = left.join(right, ["choice", "block"]).where((F.col("p") < F.col("q")) & near).select("a", "b")
    crowd = met.where(F.col("size") > CROWD).select("print", "head").distinct()
    return scratch.keep(pairs.union(_in_crowds(crowd, bits)).mapInArrow(thinned, "a bigint, b bigint"), "pairs")


def _in_crowds(crowd: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that join whatever links of distinct fingerprints (print, head) join.

    Two fingerprints differ in at most 2 bits only if some value differs from each
    of both in at most 1.  So each is sent to itself and the 64 values beside it;
    there at most 65 can meet, however large the crowd, and all that meet differ in
    at most 2 bits, so linking the smallest with each of the others is enough.  For
    smaller ``bits`` the smallest is linked with those that are near enough, and
    the members of a place are few, so all their pairs are compared.
    """
    beside = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    places = crowd.select(F.explode(F.concat(F.array("print"), beside)).alias("at"), "print", "head")
    met = places.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("print", "head"))).alias("m")).where("size(m) > 1")
    if bits == 2:
        linked = met.select(F.col("m")[0].alias("x"), F.explode(F.slice("m", 2, 65)).alias("y"))
    else:
        linked = met.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    return linked.where(F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= bits).where("x.print < y.print").select(F.col("x.head").alias("a"), F.col("y.head").alias("b"))
