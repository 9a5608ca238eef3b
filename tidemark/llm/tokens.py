"""Exact BPE ids of many texts from the tokenizers library, each distinct unit encoded once.

For a byte-level tokenizer without normaliser whose pre-tokens are those of the
usual pattern (contractions, letters, digits, other signs, white space), a text
may be cut at some places whatever stands around them, and the ids of the parts,
one after another, are the ids of the text:

*   before a blank that a character other than white space follows: the blank
    begins a pre-token there, and white space before it ends one;
*   between an ASCII letter and one of ``.,;:!?``: a run of letters ends there;
*   between an ASCII letter and a line feed after a sign that is no white space:
    a line feed alone is a pre-token.

Texts are cut into units there, and a worker remembers the ids of the units it has
met, in a hash table over numpy arrays; a unit costs no Python object.  Units are
told apart by 128 bits of a hash whose keys each process draws at random, so texts
can't be made to collide.  Texts with the text of a special token, and all texts
of other kinds of tokenizers, are encoded as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.kernels import span_hashes

#: A task has one core; the library would take all of the machine's.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Units a worker remembers before it drops those it has met less often; about 70 bytes each.
REMEMBERED = 1_000_000
_SLOTS = 1 << 21

#: New units that are encoded as one text.
TOGETHER = 60
#: Bytes of texts that are cut into units at a time.
PIECE = 1 << 20
#: Units of more bytes are remembered apart, by their bytes.
LONG = 64

_U = np.uint64
_KEYS = np.frombuffer(os.urandom(32), np.uint64) | _U(1)

def _kinds() -> bytes:
    """What each byte may be, as bits: a letter, one of .,;:!?, no white space, safe behind a blank, a blank, a line feed."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
    kinds[[ord(c) for c in ".,;:!?"]] |= _SIGN
    kinds[0x21:0x7F] |= _SOLID
    # Neither white space nor the lead of a white-space character.
    kinds[[b for b in range(0x21, 256) if b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3)]] |= _SAFE_NEXT
    kinds[0x20] |= _BLANK
    kinds[0x0A] |= _FEED
    return kinds.tobytes()


_LETTER, _SIGN, _SOLID, _SAFE_NEXT, _BLANK, _FEED = (np.uint8(1 << i) for i in range(6))
_KINDS = _kinds()


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut, whatever its other parts are, in ascending order."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    may = np.zeros(len(data), np.uint8)
    # A bit of what stands before is moved onto that of what stands behind; both must be set.
    np.bitwise_and(kinds[:-1] >> 1, kinds[1:], out=may[:-1])
    may[:-1] &= _SAFE_NEXT
    own = kinds[:-1] << 1
    own &= kinds[1:]
    own &= _SIGN
    may[1:] |= own
    feed = (kinds[1:-1] & _FEED) >> 3
    feed &= kinds[:-2]
    feed &= kinds[2:] << 2
    may[2:] |= feed
    may[0] = 0
    return np.flatnonzero(may)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Units:
    """Numbers of units by the hashes of their bytes (the first not 0): open addressing in arrays."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.number = np.zeros(_SLOTS, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 for one that is not known."""
        slot = (one & _U(_SLOTS - 1)).view(np.int64)
        out = np.full(len(one), -1, np.int64)
        live = np.arange(len(one))
        while len(live):
            there = self.one.take(slot)
            hit = (there == one) & (self.two.take(slot) == two)
            out[live[hit]] = self.number.take(slot[hit])
            on = np.flatnonzero(~hit & (there != 0))
            live, slot, one, two = live[on], slot[on] + 1 & _SLOTS - 1, one[on], two[on]
        return out

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the n units, by number."""
        used = np.flatnonzero(self.one)
        out = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for own, kept in zip(out, (self.one, self.two), strict=True):
            own[self.number[used]] = kept[used]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, first: int) -> None:
        """Number units that are not known and differ from each other from ``first`` on."""
        number = np.arange(first, first + len(one), dtype=np.int32)
        slot = (one & _U(_SLOTS - 1)).view(np.int64)
        while len(one):
            free = np.flatnonzero(self.one.take(slot) == 0)
            self.number[slot[free]] = number[free]
            own = free[self.number[slot[free]] == number[free]]  # of several that meet in a slot the last one
            self.one[slot[own]], self.two[slot[own]] = one[own], two[own]
            stay = np.ones(len(one), bool)
            stay[own] = False
            one, two, number, slot = one[stay], two[stay], number[stay], slot[stay] + 1 & _SLOTS - 1


class Encoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # units are remembered here; the library's memory of words only costs time
            self.tokenizer.model._resize_cache(0)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.by_unit = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
        )
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: The largest id, and the bytes that each id stands for.
        self.top = max(names.values())
        self.lengths = np.zeros(self.top + 1, np.int64)
        self.lengths[list(names.values())] = [len(n) for n in names]
        self._forget()

    def _forget(self) -> None:
        self._units, self._long = _Units(), {}
        self._start, self._length, self._met = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self._flat = np.zeros(1 << 16, np.uint32)
        self._count = self._used = 0

    def _thin(self) -> None:
        """Keep the units that were met more often than the rest, at most half of them."""
        met = self._met[: self._count]
        least = max(2, int(np.partition(met, len(met) // 2)[len(met) // 2]) + 1)
        stay = np.flatnonzero(met >= least)
        one, two = (own[stay] for own in self._units.hashes(self._count))
        met, sizes, starts = met[stay] // 2, self._length[stay].astype(np.int64), self._start[stay].astype(np.int64)
        ids = self._flat[_spans(starts, sizes)]
        self._forget()
        self._store(one, two, ids, sizes)
        self._met[: len(stay)] = met

    def _store(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, first = len(one), self._count
        while first + n > len(self._start):
            self._start, self._length, self._met = (np.concatenate((x, np.zeros_like(x))) for x in (self._start, self._length, self._met))
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        self._start[first : first + n] = self._used + np.cumsum(sizes) - sizes
        self._length[first : first + n] = sizes
        self._flat[self._used : self._used + len(ids)] = ids
        self._units.add(one, two, first)
        self._used += len(ids)
        self._count += n

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one unit after another, and how many each has.

        A unit that begins with a blank may follow any other, so many of them are
        encoded as one text and told apart by the bytes that their ids stand for.
        """
        together = np.array([u[:1] == b" " for u in units], bool)
        joined = [u for u, ok in zip(units, together.tolist(), strict=True) if ok]
        alone = [u for u, ok in zip(units, together.tolist(), strict=True) if not ok]
        texts = [b"".join(joined[i : i + TOGETHER]).decode() for i in range(0, len(joined), TOGETHER)]
        parts = self.plain(texts + [u.decode() for u in alone])
        first = np.array([i for own in parts[: len(texts)] for i in own], np.int64)
        ends = np.cumsum([len(u) for u in joined], dtype=np.int64)
        upto = np.cumsum(self.lengths[first])
        stop = np.searchsorted(upto, ends)
        if len(ends) and not np.array_equal(upto[stop], ends):
            raise AssertionError("the ids of a unit go beyond it")
        sizes = np.zeros(len(units), np.int64)
        sizes[together] = np.diff(stop, prepend=-1)
        sizes[~together] = [len(p) for p in parts[len(texts) :]]
        places = np.zeros(len(units), np.int64)
        places[together] = (np.cumsum(sizes[together]) - sizes[together]) if len(joined) else 0
        rest = np.array([i for own in parts[len(texts) :] for i in own], np.int64)
        places[~together] = len(first) + np.cumsum(sizes[~together]) - sizes[~together]
        return np.concatenate((first, rest))[_spans(places, sizes)].astype(np.uint32), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), one text after another, and where each text's begin."""
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts in UTF-8 that stand one after another; long texts go piece by piece."""
        if len(offsets) == 1:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.by_unit:
            raw = data.tobytes()
            return _join([np.array(i, np.uint32) for i in self.plain([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])])
        raw = data.tobytes() if any(data.tobytes().find(s) >= 0 for s in self.special) else b""
        parts: list[np.ndarray] = []
        marked = np.array([any(s in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]) if raw else np.zeros(len(offsets) - 1, bool)
        if not marked.any() and len(data) <= 2 * PIECE:
            return self._encode(data, offsets)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if marked[i]:
                parts.append(np.array(self.plain([raw[a:b].decode()])[0], np.uint32))
                continue
            pieces = [self._encode(p, np.array([0, len(p)]))[0] for p in pieces_of(data[a:b])]
            parts.append(np.concatenate(pieces) if pieces else np.zeros(0, np.uint32))
        return _join(parts)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._count > REMEMBERED:
            self._thin()
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts(data)] = True
        edge[offsets[1:] - 1] = False  # what follows a text's last blank is not its own
        edge[offsets] = True
        begin = np.flatnonzero(edge)
        begin, size = begin[:-1], np.diff(begin)
        one, two = span_hashes(data, begin, np.minimum(size, LONG), _KEYS)
        np.maximum(one, _U(1), out=one)
        code = self._units.find(one, two)
        long = np.flatnonzero(size > LONG)
        code[long] = -2
        new = np.flatnonzero(code == -1)
        if len(new):
            _, first, same = np.unique(one[new], return_index=True, return_inverse=True)
            at = new[first]
            if not np.array_equal(two[at][same], two[new]):  # one half of a hash is not enough
                _, first, same = np.unique(np.stack((one[new], two[new]), axis=1), axis=0, return_index=True, return_inverse=True)
                at = new[first]
            raw = data.tobytes()
            ids, sizes = self._ids_of([raw[b : b + n] for b, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)])
            code[new] = self._count + same
            self._store(one[at], two[at], ids, sizes)
        self._met[: self._count] += np.bincount(np.maximum(code, 0), minlength=self._count)
        code[long] = 0
        lengths, starts = self._length[code].astype(np.int64), self._start[code].astype(np.int64)
        flat = self._flat
        if len(long):
            raw = data.tobytes()
            found = self._of_long([raw[b : b + n] for b, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)])
            lengths[long] = own = np.array([len(f) for f in found])
            starts[long] = self._used + np.cumsum(own) - own
            flat = np.concatenate((self._flat[: self._used], *found))
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        return flat[_spans(starts, lengths)], bounds[np.searchsorted(begin, offsets)]

    def _of_long(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of units of more than LONG bytes."""
        if len(self._long) > REMEMBERED // 50:
            self._long.clear()
        new = [u for u in dict.fromkeys(units) if u not in self._long]
        fresh = dict(zip(new, (np.array(i, np.uint32) for i in self.plain([u.decode() for u in new])), strict=True))
        self._long |= {u: i for u, i in fresh.items() if len(u) <= 16 * LONG}
        return [fresh[u] if u in fresh else self._long[u] for u in units]


def pieces_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about PIECE bytes that may be encoded one by one."""
    begin = 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data):
            look = data[max(begin, end - PIECE) : min(end + 2, len(data))]
            found = cuts(look)
            if len(found) and (cut := int(found[-1]) + max(begin, end - PIECE)) > begin:
                end = cut
                break
            end = min(end + PIECE, len(data))
        yield data[begin:end]
        begin = end


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), at


class Decoder:
    """Bytes of ids of a byte-level vocabulary, for many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer: Tokenizer | None = Tokenizer.from_file(path)
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if not self.byte_level:
            return
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = []
        for i in range(max(names) + 1):
            name = names.get(i, "")
            raw.append(bytes(back[c] for c in name) if all(c in back for c in name) else name.encode())
        self._length = np.array([len(r) for r in raw], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(raw), np.uint8)
        self.tokenizer = None  # tables are enough, and the library's take much more memory

    def bytes_of(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, one after another, and where each text's begin."""
        if not self.byte_level:
            texts = self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], skip_special_tokens=False)
            raw = [t.encode() for t in texts]
            return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        lengths = self._length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self._flat[np.repeat(self._start[ids] - ends + lengths, lengths) + np.arange(total)]
        return data, np.concatenate((np.zeros(1, np.int64), ends))[at]


_workers: dict[tuple[type, str], Encoder | Decoder] = {}


def _of_worker(kind: type, path: str):
    if (kind, path) not in _workers:
        _workers[kind, path] = kind(path)
    return _workers[kind, path]


def encoder(path: str) -> Encoder:
    """This worker process's encoder for a vocabulary file."""
    return _of_worker(Encoder, path)


def decoder(path: str) -> Decoder:
    return _of_worker(Decoder, path)
