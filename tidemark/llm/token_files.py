"""Files of token ids, coded by the range coder of :mod:`tidemark.llm.rangecoder`.

A file is Parquet with a row per segment: part, segment, n_ids and the payload.
Parts are ranges of doc_id, segments ascend within a part, and a segment holds
whole documents in ascending order, so any segment can be read alone.

Payload, all numbers little-endian:

    4 bytes  b"TMTK"
    u32 x 4  version (3), documents, blocks, chapters
    u64      ids of the part before this segment
    i64 each doc_id (0 if null);  u8 each: 1 if it is null;  u32 each: number of ids
    u32 x 3  of each block: ids, words, CRC-32 of its ids as u32
    u32 x 2  of each chapter: blocks, bytes of its prior
    bytes    the prior of each chapter: its ids, their frequencies, first weights
    u32 each the words of all blocks
    u32      CRC-32 of all that

Each block of up to ``BLOCK`` ids has a coder and adaptive models of its own, which
start from its chapter's prior and nothing else; ids may be any below 2**32.  A
segment is one chapter, but for one with more different ids than a prior can state
(one document may hold millions): its blocks are dealt to chapters of ``CHAPTER``.
The blocks of a chapter are coded side by side, ``LANES`` at a time, so a document
of any length takes its ids and payload and no more than that many coders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels, rangecoder
from tidemark.llm.scratch import Scratch
from tidemark.llm.tokens import encoder

MAGIC, VERSION = b"TMTK", 3
BLOCK = 1024
#: Blocks of a chapter where a segment has more different ids than a prior takes: all of their ids may differ.
CHAPTER = rangecoder.MOST_IDS // BLOCK
#: Ids after which a segment ends, with the slice of documents that reaches them: its blocks mostly fit side by side.
SEGMENT = 3 << 20
#: Blocks that are coded side by side at most.
LANES = 4096
#: Parts up to which their table is broadcast; beyond, it is joined.
BROADCAST_PARTS = 100_000
#: Parts whose ranges are told apart by their cuts.
PART_CUTS = 1_000

_FILE = "part int, segment bigint, n_ids bigint, payload binary"
_DOCS = "doc_id bigint, part int, offset bigint, n_tokens bigint, ids binary"


class CorruptFile(ValueError):
    """A segment or block whose checksum does not fit."""


class Segment:
    """Whole documents with their ids, to be packed or as unpacked."""

    def __init__(self, before: int):
        self.before = before
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.ids: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        """Documents and their ids, one document after another."""
        self.doc_ids += doc_ids
        self.sizes += sizes
        self.ids.append(ids)
        self.total += len(ids)

    def flat(self) -> np.ndarray:
        return np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)


def pack(segment: Segment) -> bytes:
    """The payload of a segment."""
    flat = segment.flat().astype("<u4")
    blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
    fits = len(flat) <= rangecoder.MOST_IDS or rangecoder.different(flat) <= rangecoder.MOST_IDS
    chapters = [blocks] if fits else [blocks[i : i + CHAPTER] for i in range(0, len(blocks), CHAPTER)]
    coded = [rangecoder.encode(own, LANES) for own in chapters]
    stated, words = [prior.to_bytes() for prior, _ in coded], [w for _, own in coded for w in own]
    table = [x for b, w in zip(blocks, words, strict=True) for x in (len(b), len(w), zlib.crc32(b))]
    body = b"".join(
        [
            MAGIC,
            struct.pack("<4IQ", VERSION, len(segment.doc_ids), len(blocks), len(chapters), segment.before),
            np.array([d or 0 for d in segment.doc_ids], "<i8").tobytes(),
            np.array([d is None for d in segment.doc_ids], "u1").tobytes(),
            np.array(segment.sizes, "<u4").tobytes(),
            np.array(table, "<u4").tobytes(),
            np.array([x for own, said in zip(chapters, stated, strict=True) for x in (len(own), len(said))], "<u4").tobytes(),
            *stated,
            *[w.astype("<u4").tobytes() for w in words],
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(payload: bytes) -> Segment:
    """The segment of a payload; raises CorruptFile."""
    if payload[:4] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise CorruptFile("a segment's checksum or mark does not fit")
    version, docs, blocks, chapters, before = struct.unpack_from("<4IQ", payload, 4)
    if version != VERSION:
        raise CorruptFile(f"version {version} is not known")
    at = 4 + struct.calcsize("<4IQ")
    ids = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    lengths, words, sums = np.frombuffer(payload, "<u4", 3 * blocks, at + 13 * docs).reshape(-1, 3).astype(np.int64).T
    at += 13 * docs + 12 * blocks
    own, stated = np.frombuffer(payload, "<u4", 2 * chapters, at).reshape(-1, 2).astype(np.int64).T
    at += 8 * chapters
    try:
        coded = np.split(np.frombuffer(payload, "<u4", int(words.sum()), at + int(stated.sum())), np.cumsum(words)[:-1]) if blocks else []
        decoded, first = [], 0
        for count, said in zip(own.tolist(), stated.tolist(), strict=True):
            prior = rangecoder.Prior.from_bytes(payload[at : at + said])
            decoded += rangecoder.decode(prior, coded[first : first + count], lengths[first : first + count], LANES)
            at, first = at + said, first + count
    except (IndexError, ValueError, zlib.error) as error:
        raise CorruptFile("a block can't be decoded") from error
    for block, crc in zip(decoded, sums.tolist(), strict=True):
        if zlib.crc32(block.astype("<u4")) != crc:
            raise CorruptFile("a block's checksum does not fit")
    segment = Segment(before)
    segment.add([None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)], sizes.tolist(), np.concatenate(decoded) if blocks else np.zeros(0, np.uint32))
    return segment


def _packer(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        now, number = Segment(0), 0

        def row(segment: Segment) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "segment": number, "n_ids": segment.total, "payload": pack(segment)}], schema=schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                ids, at = enc.encode_bytes(data, offsets)
                sizes = np.diff(at) + 1
                own = np.full(len(ids) + len(sizes), end_id, np.uint32)
                inside = np.ones(len(own), bool)
                inside[np.cumsum(sizes) - 1] = False
                own[inside] = ids
                now.add(doc_ids[first:end], sizes.tolist(), own)
                if now.total >= SEGMENT:
                    yield row(now)
                    now, number = Segment(now.before + now.total), number + 1
                    kernels.release()
        if now.doc_ids:
            yield row(now)

    return run


def _ranged(texts: DataFrame, parts: int) -> DataFrame:
    """``texts`` dealt to parts that are ranges of doc_id, nulls in the first.

    The cuts are percentiles of the ids alone, so the texts are not read to find
    them; beyond PART_CUTS parts Spark finds the ranges from a sample of the rows.
    """
    if parts > PART_CUTS:
        return texts.repartitionByRange(parts, F.asc("doc_id"))
    shares = [i / parts for i in range(1, parts)]
    cuts = texts.agg(F.percentile_approx("doc_id", shares, 1000 * parts)).first()[0] if shares else None
    below = F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("doc_id")) if cuts else F.array()
    return texts.repartitionById(parts, F.size(below))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, parts: int | None = None) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    A null text is empty, so it has the end id only; null ids come first; rows
    that share an id stay apart, in the order of a hash of their texts.  ``path``
    names the vocabulary file, of any size, which every executor has.  An end id
    that is no unsigned 32-bit number raises ValueError.
    """
    if not 0 <= end_id < 1 << 32:
        raise ValueError(f"end id {end_id} is no unsigned 32-bit number")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text")
    inorder = _ranged(texts, parts).sortWithinPartitions("doc_id", F.xxhash64("text"))
    inorder.mapInArrow(_packer(path, end_id), _FILE).write.option("compression", "uncompressed").parquet(folder)


def _unpacker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    for batch in batches:
        for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
            segment = unpack(payload.as_py())
            sizes = np.array(segment.sizes, np.int64)
            ends = np.cumsum(sizes)
            flat = segment.flat().astype("<u4")
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.concatenate(([0], ends)) * 4).astype(np.int32)), pa.py_buffer(flat)])
            columns = [pa.array(segment.doc_ids, pa.int64()), pa.array([part] * len(sizes), pa.int32()), pa.array(segment.before + ends - sizes), pa.array(sizes), ids]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            kernels.release()


def read(spark: SparkSession, folder: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (u32) of every document in the files."""
    files = spark.read.schema(_FILE).parquet(folder)
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = starts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as first")
    starts = (scratch or Scratch(spark, "token_files")).keep(starts, "starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts
    docs = files.select("part", "payload").mapInArrow(_unpacker, _DOCS)
    return docs.join(starts, "part").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")
