"""BPE encoding and decoding with content-defined chunks that are encoded once.

A rolling hash over the last 32 bytes cuts texts where it has nine set low bits,
so the same passage in two documents is cut at the same places whatever stands
before it.  A worker keeps the ids of the chunks it has met and encodes a new
chunk only, from its first to its last safe cut (see :func:`tidemark.llm.tokens.cuts`).

The join of two chunks is repaired: the text between the last safe cut of one and
the first of the next is encoded again by the library as it is, together with the
parts next to it on both sides, whose ids both chunks know already.  They must
agree, id for id; if they don't, the join is widened by a part on each side and
encoded again until they do, or until the chunks are used up and the text is
encoded whole.  At last the ids are decoded and must give the bytes of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import kernels
from tidemark.llm.tokens import PIECE, Decoder, Encoder, cuts, decoder, encoder, pieces_of

#: A cut where these bits of the rolling hash are set: chunks of 512 bytes on average.
CUT = np.uint32(0x1FF << 23)
#: Chunks, and joins, a worker remembers before it starts over; about 600 bytes each.
REMEMBERED = 60_000
#: Joins of more bytes are not remembered.
LONG_JOIN = 1024

_GEAR = np.random.Generator(np.random.PCG64(32)).integers(0, 1 << 32, 256, dtype=np.uint32)
SCHEMA = "doc_id bigint, ids binary, decoded string"


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end (exclusive): by content, on character boundaries, and at the end of each text."""
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        rolled[shift:] += rolled[:-shift] << np.uint32(shift)
    ends = np.flatnonzero((rolled & CUT) == CUT) + 1
    for _ in range(3):
        inside = ends < len(data)
        ends[inside] += (data[ends[inside]] & 0xC0) == 0x80
    return np.unique(np.concatenate((ends, offsets[1:])))


def _window(left: tuple | None, right: tuple | None, reach: int, cut: list[int], begin: int, end: int) -> tuple[int, int]:
    """The join of two chunks (first and last safe cut, ids) of a text, with ``reach`` parts of either."""
    a = begin if left is None else cut[max(left[1] - reach, left[0])]
    b = end if right is None else cut[min(right[0] + reach, right[1])]
    return a, b


class ChunkCoder:
    """Ids of texts, chunk by chunk; one per worker process."""

    def __init__(self, enc: Encoder, dec: Decoder):
        self.enc, self.dec = enc, dec
        self._ids: dict[bytes, np.ndarray] = {}
        self._joins: dict[bytes, np.ndarray] = {}
        self._kind = np.uint16 if enc.top < 65536 else np.uint32
        self.encoded = self.reused = self.widened = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` and where each text's begin; long texts go piece by piece."""
        if not self.enc.by_unit:
            return self.enc.encode_bytes(data, offsets)
        raw, limits = data.tobytes(), offsets.tolist()
        special = [s for s in self.enc.special if s in raw]
        if not special and len(data) <= 2 * PIECE:
            return self._encode(data, offsets)
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        # Texts with the text of a special token are the library's; those between them go together.
        marked = [i for i, (a, b) in enumerate(zip(limits, limits[1:], strict=False)) if special and any(s in raw[a:b] for s in special)]
        first = 0
        for i in [*marked, len(limits) - 1]:
            own = offsets[first : i + 1]
            if i > first and limits[i] - limits[first] <= 2 * PIECE:
                ids, at = self._encode(data[limits[first] : limits[i]], own - own[0])
                parts.append(ids)
                sizes += np.diff(at).tolist()
            else:
                for a, b in zip(limits[first:i], limits[first + 1 : i + 1], strict=True):
                    pieces = [self._encode(p, np.array([0, len(p)]))[0] for p in pieces_of(data[a:b])]
                    parts += pieces
                    sizes.append(sum(map(len, pieces)))
            if i < len(limits) - 1:
                parts += self._plain(raw[limits[i] : limits[i + 1]])
                sizes.append(len(parts[-1]))
            first = i + 1
        return (np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)), np.cumsum([0, *sizes])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for memory in (self._ids, self._joins):
            if len(memory) > REMEMBERED:
                memory.clear()
        raw = data.tobytes()
        ends = chunk_ends(data, offsets)
        begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        inside = np.zeros(len(data) + 1, bool)
        inside[cuts(data)] = True
        inside[offsets[1:] - 1] = False  # what follows a text's last blank is not its own
        inside[offsets] = inside[ends] = False
        safe = np.flatnonzero(inside)
        lo, hi = np.searchsorted(safe, begins, "right"), np.searchsorted(safe, ends)
        doc = np.searchsorted(offsets, begins, "right") - 1
        # Chunks with two parts between safe cuts, one for either join: (text, first and last place in safe, digest).
        whole = np.flatnonzero(hi - lo >= 3)
        chunks = [(d, f, t - 1, blake2b(raw[b:e], digest_size=16).digest()) for d, f, t, b, e in zip(doc[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), begins[whole].tolist(), ends[whole].tolist(), strict=True)]
        cut = safe.tolist()
        new = {key: raw[cut[f] : cut[t]] for _, f, t, key in chunks if key not in self._ids}
        ids, at = self.enc.encode_bytes(np.frombuffer(b"".join(new.values()), np.uint8), np.cumsum([0, *map(len, new.values())]))
        self._ids |= {key: ids[a:b].astype(self._kind) for key, a, b in zip(new, at[:-1].tolist(), at[1:].tolist(), strict=True)}
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        parts: list[np.ndarray] = []
        bounds = np.zeros(len(offsets), np.int64)
        limits = offsets.tolist()
        owned: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in limits[1:]]
        for d, f, t, key in chunks:
            owned[d].append((f, t, self._ids[key]))
        self._join_all([raw[a:b] for d, own in enumerate(owned) for left, right in zip([None, *own], [*own, None], strict=True) for a, b in [_window(left, right, 1, cut, limits[d], limits[d + 1])]])
        for d, own in enumerate(owned):
            own = self._joined(raw, limits[d], limits[d + 1], cut, own)
            parts += own
            bounds[d + 1] = bounds[d] + sum(map(len, own))
        out = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
        return self._checked(raw, offsets, out, bounds)

    def _joined(self, raw: bytes, begin: int, end: int, cut: list[int], chunks: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
        """Ids of one text, part by part: its joins and what its chunks (first and last safe cut, ids) have between them."""
        out: list[np.ndarray] = []
        skip = 0  # ids of the present chunk that the join before it has given
        for left, right in zip([None, *chunks], [*chunks, None], strict=True):
            reach = 1
            while True:
                # The join, with ``reach`` parts of either chunk that both sides know.
                a, b = _window(left, right, reach, cut, begin, end)
                ids = self._join(raw[a:b])
                known_left = 0 if left is None else self._agree(left[2], ids, cut[left[1]] - a, True)
                known_right = 0 if right is None else self._agree(right[2], ids, b - cut[right[0]], False)
                if known_left is not None and known_right is not None:
                    break
                if (left is None or a == cut[left[0]]) and (right is None or b == cut[right[1]]):
                    return self._plain(raw[begin:end])
                reach *= 2
                self.widened += 1
            if left is not None:
                if len(left[2]) - known_left < skip:
                    return self._plain(raw[begin:end])
                out.append(left[2][skip : len(left[2]) - known_left])
            out.append(ids)
            skip = known_right
        return out

    def _plain(self, raw: bytes) -> list[np.ndarray]:
        return [np.array(self.enc.plain([raw.decode()])[0], np.uint32)]

    def _join_all(self, joins: list[bytes]) -> None:
        """Encode all joins that are not remembered in one call."""
        new = [j for j in dict.fromkeys(joins) if j not in self._joins and len(j) <= LONG_JOIN]
        self._joins |= {j: np.array(i, self._kind) for j, i in zip(new, self.enc.plain([j.decode() for j in new]), strict=True)}

    def _join(self, raw: bytes) -> np.ndarray:
        return self._joins[raw] if raw in self._joins else np.array(self.enc.plain([raw.decode()])[0], self._kind)

    def _agree(self, chunk: np.ndarray, join: np.ndarray, size: int, left: bool) -> int | None:
        """How many ids of a chunk a join has too, over ``size`` bytes at the chunk's end or begin; None where they differ."""
        lengths = self.enc.lengths
        covered, n = 0, 0
        while covered < size and n < len(chunk):
            n += 1
            covered += int(lengths[chunk[-n if left else n - 1]])
        if covered != size or n > len(join):
            return None
        same = np.array_equal(chunk[len(chunk) - n :], join[:n]) if left else np.array_equal(chunk[:n], join[len(join) - n :])
        return n if same else None

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(i, np.uint32) for i in self.enc.plain(texts)]
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.cumsum([0, *map(len, ids)])

    def _checked(self, raw: bytes, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, those of texts that don't decode to their bytes encoded whole."""
        back, cut = self.dec.bytes_of(ids, at)
        if back.tobytes() == raw:
            return ids, at
        parts = []
        decoded = back.tobytes()
        for i in range(len(at) - 1):
            own = raw[offsets[i] : offsets[i + 1]]
            if decoded[cut[i] : cut[i + 1]] == own:
                parts.append(ids[at[i] : at[i + 1]])
            else:
                parts.append(self._whole([own.decode()])[0])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders[path] = ChunkCoder(encoder(path), decoder(path))
    return _coders[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text of every row.

    A null text counts as empty and has no ids.  Rows are coded one by one, so
    repeated rows and null ids keep their rows; other columns are ignored.
    ``path`` names the vocabulary file, which every executor must have.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for first, end, data, offsets in kernels.text_slices(batch.column("text")):
                ids, at = own.encode(data, offsets)
                raw, cut = own.dec.bytes_of(ids, at)
                lists = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                texts = _texts(raw, cut)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), lists, texts], schema=schema)

    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text")
    return texts.mapInArrow(run, SCHEMA)


def _texts(raw: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A string column over UTF-8 bytes; bytes that are not UTF-8 are replaced as the library does."""
    column = pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw)])
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        data = raw.tobytes()
        column = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
    return column
