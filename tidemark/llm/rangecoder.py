"""Adaptive context-mixing range coder for blocks of token ids.

Many blocks are coded side by side: each is a lane with its own coder and its own
adaptive models, all reset at its start, and one step codes one id of every lane.

Three models predict the next id.  Order 2 and order 1 are tables of what
followed the last two ids and the last id before, with a count of how often that
has held in a row.  Order 0 is the frequency of each id in the segment, which the
segment's :class:`Prior` states.  The three are mixed: an id's interval belongs
to the order-2 prediction, to the order-1 prediction, or is shared by order 0
among all ids.  The weights of the mix adapt in each lane after each id, apart for
each of 32 states (confidence of both tables, whether they agree); a reset sets
them to the shares that the prior states.

Coding is a range coder with a 62-bit range and 32-bit words; the encoder keeps
carries in its words and settles them at the end.  A step is one interval of
2**28 parts, whatever model it comes from.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Parts of the whole interval, as a power of two; lowest range, word size.
BITS, LEAST, WORD = 28, 30, 32
#: Entries of the prediction tables of a lane.
FIRST, SECOND = 1 << 8, 1 << 9
#: An entry is id << 2 | confidence: 0 nothing seen, 1 seen or just replaced, 2 held once, 3 held more often.
CONFIDENCE = 3
STATES = 32
#: Weights are 16-bit; each id moves its state's by a 32nd of the way.
RATE = 5
#: Ids below this are looked up in an array, others by search.
DENSE = 1 << 22
#: Different ids that a prior takes, so that each has a part of order 0.
MOST_IDS = 1 << 19
_ENTRY = np.int32


def different(ids: np.ndarray) -> int:
    """How many different ids there are."""
    return int(np.count_nonzero(np.bincount(ids)) if len(ids) and int(ids.max()) < DENSE else len(np.unique(ids)))


class Prior:
    """What a segment states before its blocks: its ids, their frequencies, the weights at a reset."""

    def __init__(self, alphabet: np.ndarray, size: np.ndarray, weights: np.ndarray | None = None):
        self.alphabet = alphabet
        #: Order 0 has 2**bits parts, each id at least one; the mix has the rest of BITS.
        self.bits = min(max(len(alphabet).bit_length() + 4, 14), 20)
        if len(alphabet) > MOST_IDS:
            raise ValueError(f"a prior takes {MOST_IDS} different ids, not {len(alphabet)}")
        self.size = size
        self.start = np.cumsum(size) - size
        self.weights = np.zeros((2, STATES), np.int64) if weights is None else weights
        self._place: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        if len(ids) and int(ids.max()) < DENSE:
            counts = np.bincount(ids)
            alphabet = np.flatnonzero(counts)
            counts = counts[alphabet]
        else:
            alphabet, counts = np.unique(ids, return_counts=True)
        own = cls(alphabet, np.zeros(len(alphabet), np.int64))
        if len(alphabet):
            spare = (1 << own.bits) - len(alphabet)
            own.size = 1 + counts * spare // len(ids)
            own.size[own.size.argmax()] += (1 << own.bits) - own.size.sum()
            own.start = np.cumsum(own.size) - own.size
        return own

    def to_bytes(self) -> bytes:
        steps = np.diff(self.alphabet.astype(np.int64), prepend=0)
        raw = b"".join(x.astype("<u4").tobytes() for x in (np.array([len(steps)]), steps, self.size, self.weights.reshape(-1)))
        planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()  # like bytes stand together
        return zlib.compress(planes, 6)

    @classmethod
    def from_bytes(cls, packed: bytes) -> Prior:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.tobytes()
        numbers = np.frombuffer(raw, "<u4").astype(np.int64)
        n = int(numbers[0])
        if len(numbers) != 1 + 2 * n + 2 * STATES:
            raise ValueError("a prior of another length")
        return cls(np.cumsum(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 :].reshape(2, STATES))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where each id stands in the alphabet."""
        if len(self.alphabet) and int(self.alphabet[-1]) < DENSE:
            if self._place is None:
                self._place = np.zeros(int(self.alphabet[-1]) + 1, np.int32)
                self._place[self.alphabet] = np.arange(len(self.alphabet))
            return self._place[ids]
        return np.searchsorted(self.alphabet, ids)

    def table(self) -> np.ndarray:
        """start << 32 | size of each place in the alphabet."""
        return self.start.astype(np.int64) << 32 | self.size

    def slots(self) -> np.ndarray:
        """The place in the alphabet of each part of order 0."""
        return np.repeat(np.arange(len(self.size)), self.size)


class _Tables:
    """Order-1 and order-2 predictions of all lanes, over places in the alphabet; -1 stands for none."""

    def __init__(self, lanes: int):
        self.first = np.full(lanes * FIRST, -4, _ENTRY)
        self.second = np.full(lanes * SECOND, -4, _ENTRY)
        self.lane1, self.lane2 = np.arange(lanes) * FIRST, np.arange(lanes) * SECOND
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def ask(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictions of order 2 and 1 and the state of the first n lanes."""
        last = self.last[:n]
        self.at1 = last & FIRST - 1
        self.at1 += self.lane1[:n]
        self.at2 = last * 37
        self.at2 += self.before[:n]
        self.at2 &= SECOND - 1
        self.at2 += self.lane2[:n]
        e1, e2 = self.first.take(self.at1, mode="clip"), self.second.take(self.at2, mode="clip")
        one, two = e1 >> 2, e2 >> 2
        e1 &= CONFIDENCE
        e2 &= CONFIDENCE
        state = e2 << 2
        state += e1
        state <<= 1
        state += one == two
        self.c1, self.c2 = e1, e2
        return two, one, state

    def learn(self, n: int, ids: np.ndarray, held2: np.ndarray, held1: np.ndarray) -> None:
        """Take in the ids that followed, which order 2 and order 1 held or not."""
        fresh = ids.astype(_ENTRY) if ids.dtype != _ENTRY else ids.copy()
        fresh <<= 2
        fresh += 1
        for table, at, sure, held in ((self.second, self.at2, self.c2, held2), (self.first, self.at1, self.c1, held1)):
            np.minimum(sure, CONFIDENCE - 1, out=sure)
            sure *= held
            sure += fresh
            table[at] = sure
        self.before, self.last = self.last, self.before
        self.last[:n] = ids


#: What a step adds to the weights by who held: nobody, order 1, order 2.  Weights stay above 255, so that a prediction
#: always has a part, and their sum below 65,088, so that order 0 always has one.
_GAIN = np.array([8 << 32 | 8, 8 << 32 | 2024, 2024 << 32 | 8], np.int64)
_FIELDS = np.int64(2047 << 32 | 2047)


class _Weights:
    """Weights of order 2 (upper 32 bits) and order 1 (lower) of all lanes and states; order 0 has the rest."""

    def __init__(self, lanes: int, prior: Prior):
        two, one = 256 + prior.weights * 64_000 // 65_536
        self.pair = np.tile(two << 32 | one, lanes)
        self.lane = np.arange(lanes, dtype=np.int64) * STATES
        self.shift = 16 - (BITS - prior.bits)

    def ask(self, n: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.at = self.lane[:n] + state
        self.now = self.pair.take(self.at, mode="clip")
        f1 = self.now & 0xFFFF
        f1 >>= self.shift
        return self.now >> 32 + self.shift, f1

    def learn(self, who: np.ndarray) -> None:
        loss = self.now >> RATE
        loss &= _FIELDS
        self.now -= loss
        self.now += _GAIN.take(who, mode="clip")
        self.pair[self.at] = self.now


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest to the shortest, and how many are at work in each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    working = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(longest), "right")
    return order, working


class _Choice:
    """The intervals of a step: order 2 at the bottom, order 1 above it, order 0 from there to the top."""

    def __init__(self, lanes: int, prior: Prior):
        self.bits, self.whole = prior.bits, 1 << BITS - prior.bits
        self.starts, self.sizes = (np.zeros((3, lanes), np.int64) for _ in range(2))
        self.lane, self.row = np.arange(lanes), lanes

    def cell(self, n: int, who: np.ndarray) -> np.ndarray:
        """Where the choice of each lane stands in a table of three rows of lanes."""
        out = who * self.row
        out += self.lane[:n]
        return out

    def interval(self, n: int, cell: np.ndarray, f2: np.ndarray, f1: np.ndarray, both: np.ndarray, order0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the chosen interval; ``both`` is the sum of the predictions' parts, ``order0`` start << 32 | size of the id."""
        rest = self.whole - both
        both = both << self.bits
        np.multiply(order0 >> 32, rest, out=self.starts[0, :n])
        self.starts[0, :n] += both
        np.left_shift(f2, self.bits, out=self.starts[1, :n])
        order0 &= 0xFFFFFFFF
        np.multiply(order0, rest, out=self.sizes[0, :n])
        np.left_shift(f1, self.bits, out=self.sizes[1, :n])
        self.sizes[2, :n] = self.starts[1, :n]
        return self.starts.take(cell, mode="clip"), self.sizes.take(cell, mode="clip")


class Blocks:
    """Blocks of one segment on their way into words.

    Weights of the prior are the shares with which predictions held over all
    ``groups`` of blocks, so all are looked at before the first is coded.
    """

    def __init__(self, blocks: list[np.ndarray], prior: Prior):
        self.prior = prior
        lengths = np.array([len(b) for b in blocks], np.int64)
        self.order, self.working = _lanes(lengths)
        self.lengths = lengths
        ids = np.zeros((len(blocks), len(self.working)), np.int32)
        ids[np.arange(len(self.working))[None, :] < lengths[self.order][:, None]] = prior.places(np.concatenate([blocks[i] for i in self.order.tolist()])) if blocks else 0
        self.ids = np.ascontiguousarray(ids.T)
        del ids
        self.state = np.zeros(self.ids.shape, np.int8)
        #: Whose prediction an id takes: 2 of order 2, 1 of order 1 if order 2 doesn't hold, 0 of order 0.
        self.who = np.zeros(self.ids.shape, np.int8)
        tables = _Tables(len(blocks))
        for step, n in enumerate(self.working.tolist()):
            own = self.ids[step, :n]
            two, one, state = tables.ask(n)
            held2, held1 = own == two, own == one
            self.state[step, :n] = state
            np.maximum(held2.view(np.int8) << 1, held1.view(np.int8), out=self.who[step, :n])
            tables.learn(n, own, held2, held1)

    def shares(self) -> np.ndarray:
        """(order 2 held, order 1 held, times) x state."""
        seen = np.arange(self.ids.shape[1])[None, :] < self.working[:, None]
        key = self.state[seen].astype(np.int64) * 3 + self.who[seen]
        counts = np.bincount(key, minlength=3 * STATES).reshape(STATES, 3)
        return np.stack((counts[:, 2], counts[:, 1], counts.sum(axis=1)))

    def words(self) -> list[np.ndarray]:
        """The words (u32) of each block."""
        prior, lanes, steps = self.prior, self.ids.shape[1], len(self.working)
        weights = _Weights(lanes, prior)
        width = steps + 4
        flat, base = np.zeros(lanes * width, np.int64), np.arange(lanes) * width
        low, span, to = np.zeros(lanes, np.int64), np.full(lanes, (1 << LEAST + WORD) - 1, np.int64), base.copy()
        choice, table = _Choice(lanes, prior), prior.table()
        for step, n in enumerate(self.working.tolist()):
            f2, f1 = weights.ask(n, self.state[step, :n])
            who = self.who[step, :n].astype(np.int64)
            weights.learn(who)
            start, size = choice.interval(n, choice.cell(n, who), f2, f1, f2 + f1, table.take(self.ids[step, :n], mode="clip"))
            part = span[:n] >> BITS
            start *= part
            size *= part
            low[:n] += start
            span[:n] = size
            full = (size < 1 << LEAST).nonzero()[0]
            bottom, where = low.take(full), to.take(full)
            flat[where] = bottom >> LEAST
            bottom &= (1 << LEAST) - 1
            bottom <<= WORD
            low[full] = bottom
            span[full] = size.take(full) << WORD
            where += 1
            to[full] = where
        flat[to] = low >> LEAST
        flat[to + 1] = (low & (1 << LEAST) - 1) << 2
        to += 2
        words = flat.reshape(lanes, width)[:, : int((to - base).max(initial=0))]
        while (carry := words >> WORD).any():
            words &= (1 << WORD) - 1
            words[:, :-1] += carry[:, 1:]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
        for lane, i in enumerate(self.order.tolist()):
            out[i] = words[lane, : to[lane] - base[lane]].astype(np.uint32)
        return out


def encode(blocks: list[np.ndarray], lanes: int = 2048) -> tuple[Prior, list[np.ndarray]]:
    """The prior of a segment and the words (u32) of each of its blocks, ``lanes`` blocks side by side."""
    prior = Prior.of(np.concatenate(blocks) if blocks else np.zeros(0, np.int64))
    groups = [blocks[i : i + lanes] for i in range(0, len(blocks), lanes)]
    counts, ready = np.zeros((3, STATES), np.int64), None
    for group in groups:
        ready = Blocks(group, prior)
        counts += ready.shares()
    prior.weights = counts[:2] * 65_535 // np.maximum(counts[2], 1)
    if ready is not None and len(groups) == 1:
        return prior, ready.words()
    return prior, [w for group in groups for w in Blocks(group, prior).words()]


def decode(prior: Prior, blocks: list[np.ndarray], lengths: np.ndarray, lanes: int = 2048) -> list[np.ndarray]:
    """The ids of each block from its words and its number of ids."""
    if len(blocks) > lanes:
        return [b for i in range(0, len(blocks), lanes) for b in decode(prior, blocks[i : i + lanes], lengths[i : i + lanes], lanes)]
    order, working = _lanes(lengths)
    count, steps = len(blocks), len(working)
    ids = np.zeros((steps, count), np.int32)
    tables, weights = _Tables(count), _Weights(count, prior)
    slots, table, choice, whole = prior.slots(), prior.table(), _Choice(count, prior), 1 << BITS - prior.bits
    guesses = np.zeros((3, count), np.int64)
    width = max((len(b) for b in blocks), default=0) + 3
    words = np.zeros((count, width), np.int64)
    for lane, i in enumerate(order.tolist()):
        words[lane, : len(blocks[i])] = blocks[i]
    flat = words.reshape(-1)
    code = (words[:, 0] << LEAST) | (words[:, 1] >> WORD - LEAST)
    # The code is LEAST + WORD bits; the bits of a word that were cut off come with the next one.
    spare = words[:, 1] & (1 << WORD - LEAST) - 1
    span, to = np.full(count, (1 << LEAST + WORD) - 1, np.int64), np.arange(count) * width + 2
    for step, n in enumerate(working.tolist()):
        two, one, state = tables.ask(n)
        f2, f1 = weights.ask(n, state)
        both = f2 + f1
        now, part = code[:n], span[:n] >> BITS
        t = (now.view(np.uint64) // part.view(np.uint64)).view(np.int64)
        part_of = t >> prior.bits
        who = (part_of < f2).astype(np.int64)
        who += part_of < both
        t -= both << prior.bits
        # Exact in floating point: both numbers are below 2**28.  Damaged words may lead anywhere; clipping keeps that inside.
        guesses[0, :n] = slots.take((t / (whole - both)).astype(np.int64), mode="clip")
        guesses[1, :n], guesses[2, :n] = one, two
        cell = choice.cell(n, who)
        start, size = choice.interval(n, cell, f2, f1, both, table.take(guesses[0, :n], mode="clip"))
        own = guesses.take(cell, mode="clip")
        start *= part
        size *= part
        now -= start
        span[:n] = size
        empty = (size < 1 << LEAST).nonzero()[0]
        where = to.take(empty)
        word, bits = flat.take(where), code.take(empty) << WORD
        bits |= spare.take(empty) << LEAST
        bits |= word >> WORD - LEAST
        code[empty] = bits
        spare[empty] = word & (1 << WORD - LEAST) - 1
        span[empty] = size.take(empty) << WORD
        to[empty] = where + 1
        weights.learn(who)
        tables.learn(n, own, own == two, own == one)
        ids[step, :n] = own
    byblock = prior.alphabet.astype(np.uint32).take(np.ascontiguousarray(ids.T), mode="wrap") if count and len(prior.alphabet) else ids.T.astype(np.uint32)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * count
    for lane, i in enumerate(order.tolist()):
        out[i] = byblock[lane, : lengths[i]]
    return out
