"""Vectorised text kernels over Arrow string columns.

The bytes of many texts are treated as one array, so a word costs no Python
object.  Slices of a batch are small (about a megabyte of text) whatever the
batch size; only a longer single text makes a larger slice.

Words are hashed eight bytes a round by keyed multiplications whose high bits are
folded back, so no structure of a text makes words collide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: Bytes of texts whose words are hashed at a time, and bytes of a word from which it is hashed by BLAKE2b.
WINDOW_BYTES, LONG_WORD = 1 << 22, 1024
#: Elements of sets that are sketched at a time.
PART = 1 << 18
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def keys_of(seed: int) -> np.ndarray:
    """Four odd 64-bit keys."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 4, dtype=np.uint64) | _U(1)


def release() -> None:
    """Give freed memory back to the system, where the C library can; large arrays else stay with the process."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers with well-spread bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column; nulls are empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def span_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of spans of bytes under four keys, eight bytes a round."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    one, two = keys[0] + size.astype(np.uint64), keys[1] ^ size.astype(np.uint64)
    live = None
    left, at = size, begin
    while True:
        chunk = words[at] & _MASKS.take(left, mode="clip")
        a, b = (one, two) if live is None else (one[live], two[live])
        a = (a ^ chunk) * keys[2]
        a ^= a >> _U(29)
        b = (b + chunk) * keys[3]
        b ^= b >> _U(32)
        if live is None:
            one, two = a, b
        else:
            one[live], two[live] = a, b
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        left, at = left[more] - 8, at[more] + 8
    one = one * keys[3]
    one ^= one >> _U(31)
    two = two * keys[2]
    two ^= two >> _U(30)
    return one, two


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the place of each text's first word.

    A long text is gone through in windows that end behind white space, so what is
    kept of it is a number for each word.
    """
    keys = keys_of(20) if keys is None else keys
    out, begins, first = [], [], 0
    while first < len(data):
        end = min(first + WINDOW_BYTES, len(data))
        while end < len(data) and not SPACE[data[end - 1]]:
            end = min(end + 1 + int(np.argmax(SPACE[data[end : end + WINDOW_BYTES]])) if SPACE[data[end : end + WINDOW_BYTES]].any() else end + WINDOW_BYTES, len(data))
        lo, hi = np.searchsorted(offsets, (first, end))
        own, at = _word_hashes(data[first:end], offsets[lo:hi] - first, fold, keys)
        out.append(own)
        begins.append(at + first)
        first = end
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.searchsorted(begin, offsets)


def _word_hashes(data: np.ndarray, edges: np.ndarray, fold: bool, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of words; ``edges`` are places where a text begins."""
    if fold:
        data = FOLD[data]
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    begin = np.flatnonzero(starts)
    size = np.flatnonzero(ends) + 1 - begin
    one, two = span_hashes(data, begin, np.minimum(size, LONG_WORD), keys)
    hashes = one ^ (two << _U(1))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8, key=keys.tobytes()).digest(), "little")
    return mix(hashes), begin


def shingles(words: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, one after another, and where each text's begin.

    A text with one to k - 1 words has one shingle, all its words; one without words has none.
    """
    n = np.diff(places)
    rolled = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        top = len(words) - k + 1
        for j in range(k):
            rolled[:top] = rolled[:top] * _MULTIPLIER + words[j : j + top]
        rolled[:top] = mix(rolled[:top])
    out, at = [], np.zeros(len(n) + 1, np.int64)
    for i, (begin, count) in enumerate(zip(places[:-1].tolist(), n.tolist(), strict=True)):
        if count >= k:
            own = np.unique(rolled[begin : begin + count - k + 1])
        elif count:
            whole = np.full(1, count, np.uint64)
            for w in words[begin : begin + count]:
                whole = whole * _MULTIPLIER + w
            own = mix(whole)
        else:
            own = rolled[:0]
        out.append(own)
        at[i + 1] = at[i] + len(own)
    return (np.concatenate(out) if out else rolled[:0]), at


def superminhash(elements: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts x m) of sets given one after another.

    In step j an element puts j plus a random fraction in the j-th place of its
    own random permutation of the m places; a place keeps its minimum.  After step
    j nothing later can lower a place that holds less than j + 1, so a set whose
    places all do is done: large sets need one or two steps, not m.  Values are
    fixed-point numbers: j in the upper 16 bits, the fraction in the lower 48.
    """
    texts = len(at) - 1
    full = np.full((texts, m), np.iinfo(np.uint64).max, np.uint64)
    flat = full.reshape(-1)
    owner = np.repeat(np.arange(texts, dtype=np.int32), np.diff(at))

    def draws(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The places j to m - 1 that step j picks for elements, and its values there."""
        draw = mix(elements + _U((j + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
        return j + ((draw & _U(0xFFFF)) * _U(m - j) >> _U(16)).astype(np.int64), (draw >> _U(16)) | _U(j << 48)

    # The first step takes elements a part at a time; most large sets are done with it.
    for first in range(0, len(elements), PART):
        part = slice(first, first + PART)
        place, value = draws(elements[part], 0)
        np.minimum.at(flat, owner[part] * np.int64(m) + place, value)
    open_ = (full.max(axis=1, initial=0) >= _U(1 << 48))[owner]
    live, owner = elements[open_], owner[open_]
    place = draws(live, 0)[0]
    turn = np.tile(np.arange(m, dtype=np.uint16), (len(live), 1))  # each element's permutation, as far as it is shuffled
    turn[np.arange(len(live)), place] = 0
    turn[:, 0] = place
    for j in range(1, m):
        if not len(live):
            break
        pick, value = draws(live, j)
        row = np.arange(len(live))
        place = turn[row, pick].astype(np.int64)
        turn[row, pick] = turn[:, j]
        turn[:, j] = place
        np.minimum.at(flat, owner * np.int64(m) + place, value)
        open_ = (full.max(axis=1) >= _U((j + 1) << 48))[owner]
        if not open_.all():
            live, owner, turn = live[open_], owner[open_], turn[open_]
    return full


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(texts x bands) keys: equal where all ``rows`` values of a band are equal."""
    texts, m = signatures.shape
    bands = signatures[:, : m // rows * rows].reshape(texts, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _MULTIPLIER + bands[:, :, j])
    return key.view(np.int64)
