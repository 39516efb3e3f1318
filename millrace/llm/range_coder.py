"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

All blocks of a segment are coded side by side: step t codes token t of every block with arrays over the blocks. Blocks
share no state that changes, so each can be decoded by itself, given the segment's head; a segment has two copies of it, and damage to
a block, or to one copy, leaves all other blocks readable (``decode_blocks``).

* Order 0: how often each id occurs in the segment. The head holds these frequencies; they are every block's first state, and each id
  that a block codes by them becomes more frequent in that block; what has come is counted every ``LAG`` tokens.
* Order 1: after each id an id that is expected, and how sure that is. It starts from the head, too, and adapts.
* Order 2: the same after each pair of ids; it starts empty.

A token is coded as one of three outcomes, "what order 2 expects", "what order 1 expects", or neither, and then, if neither, by
order 0 as the block has it by then. The probability of the first two is mixed from what all three orders say: each has an adaptive probability in its
own context (how sure the prediction is, or how frequent the expected id is at all), these are added up as log-odds
under weights that a block learns as it goes on, and the sum is turned back into a probability. All of it is integer arithmetic,
so any two machines agree.
"""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal

import numpy as np

MAGIC = b"MRC5"
#: Tokens in a block, which is coded with a fresh model.
BLOCK_TOKENS = 2048
#: Blocks encoded side by side, at most. With the 3,000 to 4,000 ids of a usual segment their models take about 45 KB each, so a worker which also holds
#: a tokenizer and texts stays small. Decoding has neither and takes twice as many.
GROUP = 1024
HEADER = "<4sIIII"  # magic, block length, blocks, tokens, bytes of the head; the end of a segment is the length of its last copy

SLOTS = 1 << 12  # predictions kept per block and order
SURE = 8  # levels of confidence
STATE = 62  # bits of the coder's interval
WORD = 16
TOP = 1 << (STATE - WORD)
LEAST = 1 << 40  # the interval is kept at least this long
FLAG_BITS, ID_BITS = 15, 18
BOOST = 500  # by how much (of 1 << ID_BITS) an id becomes more frequent in a block that codes it
MOST = 255  # times that one id does
LAG = 64  # tokens after which a block counts what it has coded
FAN = 32  # children of an inner node of the tree of frequencies
NODES = 4096  # nodes at most; with no more ids than that each is a node of its own
PAIRS = 1 << 18  # pairs from which the head's expected successors are taken
U = np.uint64
FLAG_SHIFT, WORD_SHIFT = U(FLAG_BITS), U(WORD)
_TOP, _LEAST, _MASK = U(TOP), U(LEAST), U((1 << STATE) - 1)

#: Log-odds (256 to the unit, from -2047 to 2047) to a probability of 4096, and back.
SQUASH = np.array([min(4095, max(1, int(4096 / (1 + (Decimal(-z) / 256).exp())))) for z in range(-2047, 2048)], dtype=np.int32)
STRETCH = (np.searchsorted(SQUASH, np.arange(4096), side="right") - 2048).clip(-2047, 2047).astype(np.int32)
#: Of a prediction by confidence, if wrong, then if right: the next confidence, and whether the id that came takes its place.
LEVEL = np.array([1, 1, *(k >> 1 for k in range(2, SURE)), *range(1, SURE), SURE - 1], dtype=np.int64)
TAKES = np.arange(2 * SURE) < 2


class Prior:
    """What the head of a segment says: frequencies of ids (of 1 << ID_BITS) and an expected successor of each."""

    def __init__(self, ids: np.ndarray, frequency: np.ndarray, successor: np.ndarray) -> None:
        self.ids, self.successor = ids.astype(np.int64), successor.astype(np.int64)
        self.frequency = np.zeros(1 << 16, dtype=np.int64)
        self.frequency[self.ids] = frequency
        self.place = np.zeros(1 << 16, dtype=np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        # Ids stand in a tree of three levels: inner nodes, ``FAN`` nodes in each, and leaves, which have the sums of the siblings before.
        self.fan = fan = max(1, -(-len(self.ids) // NODES))
        self.nodes = FAN * max(1, -(-len(self.ids) // (fan * FAN)))
        self.leaves = np.zeros(self.nodes * fan, dtype=np.int32)
        self.leaves[: len(self.ids)] = self.frequency[self.ids]
        grouped = self.leaves.reshape(self.nodes, fan)
        self.upto_3 = np.cumsum(grouped, axis=1, dtype=np.int32)
        self.before_3 = self.upto_3 - grouped
        rank = np.frexp(np.maximum(self.frequency, 1).astype(float))[1] - 1  # exact: the position of the highest bit
        self.rank = np.minimum(rank, 15).astype(np.int64)

    @classmethod
    def of(cls, tokens: np.ndarray) -> Prior:
        counts = np.bincount(tokens, minlength=1 << 16)
        ids = np.flatnonzero(counts)
        total, many = 1 << ID_BITS, counts[ids]
        frequency = 1 + many * (total - len(ids)) // max(1, many.sum())
        if len(ids):
            frequency[many.argmax()] += total - frequency.sum()
        at = np.arange(0, len(tokens) - 1, max(1, len(tokens) // PAIRS))
        pairs, seen = np.unique(tokens[at].astype(np.int64) << 16 | tokens[at + 1], return_counts=True)
        pairs = pairs[np.argsort(seen, kind="stable")]
        successor = np.zeros(1 << 16, dtype=np.int64)
        successor[pairs >> 16] = pairs & 0xFFFF  # of several the most frequent is set last
        return cls(ids, frequency, successor[ids])

    def pack(self) -> bytes:
        # Steps between ids; low bytes stand apart from high ones, which are mostly zero.
        parts = (np.diff(self.ids, prepend=0).astype("<u2"), self.frequency[self.ids].astype("<u4"), self.successor.astype("<u2"))
        return zlib.compress(b"".join(p.view(np.uint8).reshape(len(p), p.itemsize).T.tobytes() for p in parts), 9)

    @classmethod
    def unpack(cls, head: bytes) -> Prior:
        raw = zlib.decompress(head)
        n = len(raw) // 8
        planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
        steps, frequency, successor = (np.ascontiguousarray(planes[a:b].T).view(f"<u{b - a}").reshape(n) for a, b in ((0, 2), (2, 6), (6, 8)))
        return cls(np.cumsum(steps, dtype=np.int64), frequency, successor)


def _rows(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return table.take(rows, axis=0, mode="clip")


class Frequencies:
    """How frequent each id is in each block: what the head says, and ``BOOST`` for each time that the block has coded it.

    What the blocks have coded is counted every ``LAG`` tokens. The nodes of the head's tree hold, for every block, where their
    interval starts, block after block in one rising array; leaves hold how often they were counted. So finding the id of a value is one
    binary search for its inner node, a comparison with its children, and, if ids outnumber ``NODES``, a sum within the node.
    """

    def __init__(self, blocks: int, prior: Prior) -> None:
        self.prior, self.fan, self.nodes = prior, prior.fan, prior.nodes
        self.node_size = np.tile(prior.leaves.reshape(self.nodes, self.fan).sum(axis=1, dtype=np.int32), (blocks, 1))
        self.counts = np.zeros((blocks * self.nodes, self.fan), dtype=np.uint8)
        self.leaf_before = (np.arange(self.fan) < np.arange(self.fan)[:, None]).astype(np.uint8)
        self.held: list[np.ndarray] = []
        self.starts = np.zeros(blocks * self.nodes + 1, dtype=np.int32)
        self.leaf_row = np.arange(blocks, dtype=np.int64) * self.fan
        self._settle()

    def _settle(self) -> None:
        np.cumsum(self.node_size.reshape(-1), dtype=self.starts.dtype, out=self.starts[1:])
        edges = self.starts[:: self.nodes].astype(np.int64)
        totals = np.diff(edges)
        if totals.min(initial=0) < 0:  # the sum went over; that of one block alone cannot
            self.starts = self.starts.astype(np.int64)
            return self._settle()
        self.row_start, self.totals = edges[:-1], totals.view(np.uint64)
        self.first = np.ascontiguousarray(self.starts[:-1:FAN])

    def interval(self, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each row's id."""
        place = _rows(self.prior.place, ids)
        if self.fan == 1:
            at = rows * self.nodes + place
            start = _rows(self.starts, at).astype(np.int64)
            at += 1
            size = _rows(self.starts, at) - start
            start -= _rows(self.row_start, rows)
            return start.view(np.uint64), size.view(np.uint64)
        node, c = np.divmod(place, self.fan)
        at = rows * self.nodes + node
        leaf = _rows(self.counts, at)
        many = np.take_along_axis(leaf, c[:, None], axis=1)[:, 0]
        leaf *= _rows(self.leaf_before, c)
        start = _rows(self.starts, at) - _rows(self.row_start, rows)
        start += _rows(self.prior.before_3.reshape(-1), place)
        start += BOOST * leaf.sum(axis=1, dtype=np.int32)
        return start.view(np.uint64), (_rows(self.prior.leaves, place) + many * np.int64(BOOST)).view(np.uint64)

    def find(self, rows: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id in whose interval each row's value lies, with start and size."""
        place, start, size = self.locate(rows, value)
        return _rows(self.prior.ids, place), start, size

    def locate(self, rows: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``find``, but with the id's place instead of the id."""
        row_start = _rows(self.row_start, rows)
        value = (value.view(np.int64) + row_start).astype(self.starts.dtype)
        at = np.searchsorted(self.first, value, side="right") - 1
        beyond = _rows(self.starts[:-1].reshape(-1, FAN), at) > value[:, None]
        at *= FAN
        at += (beyond.argmax(axis=1) - 1) % FAN  # no child beyond: the last one
        start = _rows(self.starts, at)
        node = at - rows * self.nodes
        if self.fan == 1:
            at += 1
            size = (_rows(self.starts, at) - start).astype(np.uint64)
            return node, (start - row_start).view(np.uint64), size
        upto = np.cumsum(_rows(self.counts, at), axis=1, dtype=np.int32)
        upto *= BOOST
        upto += _rows(self.prior.upto_3, node)
        c = (upto > (value - start)[:, None]).argmax(axis=1)
        place = node * self.fan + c
        at *= self.fan
        at += c
        size = _rows(self.prior.leaves, place) + _rows(self.counts.reshape(-1), at) * np.int64(BOOST)
        start = start + _rows(upto.reshape(-1), self.leaf_row[: len(rows)] + c) - size - row_start
        return place, start.view(np.uint64), size.view(np.uint64)

    def hold(self, rows: np.ndarray, places: np.ndarray) -> None:
        """These rows' blocks have coded the ids at these places, which ``count`` is to know."""
        self.held.append(rows * (self.nodes * self.fan) + places)

    def count(self) -> None:
        """Count the ids held since this was last called; none more than ``MOST`` times in a block."""
        leaves, times = np.unique(np.concatenate(self.held), return_counts=True) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held.clear()
        flat = self.counts.reshape(-1)
        before = flat[leaves].astype(np.int64)
        after = np.minimum(before + times, MOST)
        flat[leaves] = after
        np.add.at(self.node_size.reshape(-1), leaves // self.fan, (BOOST * (after - before)).astype(np.int32))
        self._settle()


class Model:
    """State of all blocks' models, advanced by one token at a time. Arrays that have one row per order are used in one go.

    Ids are known by their places among the segment's, so that a prediction takes 16 bits where there are few.
    """

    def __init__(self, blocks: int, prior: Prior) -> None:
        self.n, self.prior, self.zero = n, _, _ = blocks, prior, Frequencies(blocks, prior)
        self.rows = rows = np.arange(blocks, dtype=np.int64)
        many = len(prior.ids)
        every = np.append(prior.ids, 0)  # before a block's first id stands one more place
        self.slot, self.slot_before = (every * 40503 >> 4) & (SLOTS - 1), every * 27767 >> 3
        row = np.zeros(SLOTS, dtype=np.uint16 if many <= 1 << 13 else np.uint32)  # place << 3 | confidence
        order = np.argsort(prior.frequency[prior.ids], kind="stable")  # of ids in one slot the most frequent is set last
        row[self.slot[order]] = prior.place[prior.successor[order]] << 3 | 1
        # Predictions of order 1, then of order 2.
        self.guesses = np.zeros(2 * blocks * SLOTS, dtype=row.dtype)
        self.guesses[: blocks * SLOTS].reshape(blocks, SLOTS)[:] = row
        self.guess_row = np.arange(2 * blocks, dtype=np.int64).reshape(2, blocks) * SLOTS
        sure = np.arange(SURE)
        start = np.repeat((65536 * (sure + 0.5) / (sure + 1.5)).astype(np.int64), 2)
        # Probabilities (of 65536): a row per context, a column per block; contexts of order 2, of order 1, of order 0.
        self.p = np.repeat(np.concatenate([start, start, np.full(32, 20_000)]).astype(np.int32), blocks)
        self.p_row = np.array([[0], [2 * SURE], [4 * SURE]]) * blocks + rows
        self.p_other = np.full(SURE * SURE * blocks, 20_000, dtype=np.int32)
        self.weights = np.full(3 * SURE * blocks, 26_000, dtype=np.int32)
        self.weight_row = np.array([[0], [SURE], [2 * SURE]]) * blocks + rows
        self.rank = prior.rank[prior.ids] * 2 * blocks
        self.last = self.before = np.full(blocks, many, dtype=np.int64)
        self.at, self.contexts = np.empty((2, n), dtype=np.int64), np.empty((3, n), dtype=np.int64)
        self.bounds = np.zeros((4, n), dtype=np.int32)
        self.bounds[3] = 1 << FLAG_BITS

    def predict(self) -> None:
        at, n = self.at, self.n
        at[0] = _rows(self.slot, self.last)
        np.add(at[0], _rows(self.slot_before, self.before), out=at[1])
        at[1] &= SLOTS - 1
        at += self.guess_row
        held = _rows(self.guesses, at).astype(np.int64)
        self.sure, self.guess = sure, guess = held & 7, held >> 3
        self.first, self.second = guess[0], np.where(sure[1] > 0, guess[1], guess[0])
        self.agree = self.first == self.second
        # The outcome "what order 2 expects": log-odds from all orders under the block's weights.
        contexts = self.contexts
        np.multiply(sure[::-1], 2 * n, out=contexts[:2])
        contexts[2] = _rows(self.rank, self.second)
        contexts += self.agree * n
        contexts += self.p_row
        self.held = _rows(self.p, contexts)
        self.said = _rows(STRETCH, self.held >> 4)
        self.weight_at = sure[1] * n + self.weight_row
        self.weight = _rows(self.weights, self.weight_at)
        total = self.said * self.weight
        total = (total[0] + total[1] + total[2]) >> 16
        np.maximum(total, -2047, out=total)
        np.minimum(total, 2047, out=total)
        total += 2047
        self.chance = _rows(SQUASH, total)
        # The outcome "what order 1 expects", if order 2 expects something else.
        self.apart = rows = np.flatnonzero(~self.agree)
        first = self.bounds[1] = self.chance << (FLAG_BITS - 12)
        self.bounds[2] = first
        self.other = (sure[0][rows] * SURE + sure[1][rows]) * n + rows
        self.held_other = _rows(self.p_other, self.other)
        self.bounds[2, rows] += np.maximum(((1 << FLAG_BITS) - first[rows]) * self.held_other >> 16, 1)

    def interval(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, among 1 << FLAG_BITS, of each block's outcome: 0 order 2, 1 order 1, 2 neither."""
        at = outcome * self.n + self.rows
        bounds = self.bounds.reshape(-1)
        start = _rows(bounds, at)
        at += self.n
        return start.astype(np.uint64), (_rows(bounds, at) - start).astype(np.uint64)

    def update(self, places: np.ndarray, outcome: np.ndarray) -> None:
        """Move probabilities, weights and predictions towards what has come."""
        yes = (outcome == 0).astype(np.int32)
        change = self.said * (((yes << 12) - self.chance) * 7)
        change += 0x2000
        change >>= 14
        self.weight += change
        self.weights[self.weight_at.reshape(-1)] = self.weight.reshape(-1)
        np.subtract(yes * 65408 + 64, self.held, out=change)
        change >>= 5
        change += self.held
        self.p[self.contexts.reshape(-1)] = change.reshape(-1)
        outcome = outcome[self.apart]
        missed = np.flatnonzero(outcome)
        held = self.held_other[missed]
        self.p_other[self.other[missed]] = held + (((outcome[missed] == 1) * 65408 + 64 - held) >> 5)
        # Right: surer by one; wrong: half as sure; wrong and not sure: the new id takes the place.
        state = self.sure + SURE * (self.guess == places)
        held = np.where(_rows(TAKES, state), places, self.guess)
        held <<= 3
        held |= _rows(LEVEL, state)
        self.guesses[self.at.reshape(-1)] = held.reshape(-1)
        self.before, self.last = self.last, places


def _shift_out(low: np.ndarray, length: np.ndarray, emit) -> None:
    """Renormalise: while the interval is too short, ``emit(rows)`` and shift a word."""
    rows = (length < _LEAST).nonzero()[0]
    while len(rows):
        a, b = low.take(rows, mode="clip"), length.take(rows, mode="clip")
        apart = ((a ^ (a + b)) >= _TOP).nonzero()[0]
        if len(apart):
            b[apart] = _LEAST - (a[apart] & (_LEAST - U(1)))
        emit(rows, a)
        a <<= WORD_SHIFT
        a &= _MASK
        b <<= WORD_SHIFT
        np.minimum(b, _MASK - a, out=b)
        low[rows], length[rows] = a, b
        rows = rows[b < _LEAST]


def _narrow(low: np.ndarray, length: np.ndarray, part: tuple[np.ndarray, np.ndarray], shift: np.uint64) -> None:
    """Narrow each interval to a part of it (start and size, among 1 << shift)."""
    start, size = part
    length >>= shift
    low += length * start
    length *= size


def encode(ids: np.ndarray, block_tokens: int = BLOCK_TOKENS) -> bytes:
    """Token ids (0 to 65535) as a segment."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("token ids must be from 0 to 65535")
    ids = ids.astype(np.uint16)
    blocks = -(-len(ids) // block_tokens)
    crcs = checksums(ids, block_tokens)
    padded = np.zeros(blocks * block_tokens, dtype=np.uint16)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(blocks, block_tokens).T)
    del padded
    tail = len(ids) - (blocks - 1) * block_tokens if blocks else 0
    prior = Prior.of(ids)
    if blocks and tail < block_tokens:  # padding repeats an id that the segment has
        steps[tail:, -1] = ids[0]
    head, pieces = prior.pack(), []
    groups = -(-blocks // GROUP)
    for k in range(groups):  # as even as can be: a step costs a small group nearly as much as a large one
        group = steps[:, -(-blocks * k // groups) : -(-blocks * (k + 1) // groups)]
        pieces += _encode(group, prior, tail if k == groups - 1 else block_tokens)
    sizes = np.array([len(p) for p in pieces], dtype="<u4").tobytes()
    guide = struct.pack(HEADER, MAGIC, block_tokens, blocks, len(ids), len(head)) + head + sizes + np.array(crcs, dtype="<u4").tobytes()
    guide += struct.pack("<I", zlib.crc32(guide))
    return guide + b"".join(pieces) + guide + struct.pack("<I", len(guide))


def _encode(steps: np.ndarray, prior: Prior, tail: int) -> list[bytes]:
    """Blocks, a column each, coded side by side; the last one has ``tail`` tokens."""
    block_tokens, blocks = steps.shape
    model = Model(blocks, prior)
    low, length = np.zeros(blocks, dtype=np.uint64), np.full(blocks, (1 << STATE) - 1, dtype=np.uint64)
    width = 1024
    out, used = np.zeros((blocks, width), dtype=np.uint16), np.zeros(blocks, dtype=np.int64)

    def emit(rows, low):
        at = used.take(rows, mode="clip")
        out.reshape(-1)[rows * width + at] = low >> U(STATE - WORD)
        at += 1
        used[rows] = at

    ending, upto, zero = (0, 0), block_tokens if blocks > 1 else tail, model.zero
    for begin in range(0, upto, LAG):
        # Counts stand still until a window of LAG tokens ends, so its intervals of order 0 are found at once.
        tokens = steps[begin : min(begin + LAG, upto)].astype(np.int64)
        every = np.tile(model.rows, len(tokens))
        starts, sizes = (x.reshape(tokens.shape) for x in zero.interval(every, tokens.reshape(-1)))
        missed = np.empty(tokens.shape, dtype=bool)
        places = _rows(prior.place, tokens)
        for t, place in enumerate(places, begin):
            if t % 64 == 0 and used.max(initial=0) + 64 * 4 > width:
                out = np.hstack([out, np.zeros((blocks, 1024), dtype=np.uint16)])
                width += 1024
            model.predict()
            outcome = np.where(place == model.second, 0, 2 - (place == model.first))
            miss = np.equal(outcome, 2, out=missed[t - begin])
            _narrow(low, length, model.interval(outcome), FLAG_SHIFT)
            part = length // zero.totals
            low += np.where(miss, part * starts[t - begin], 0)
            np.multiply(part, sizes[t - begin], out=length, where=miss)
            _shift_out(low, length, emit)
            model.update(place, outcome)
            if t == tail - 1:  # the last block ends here; what follows it is padding
                ending = (int(low[-1]), int(used[-1]))
        zero.hold(every[missed.reshape(-1)], places[missed])
        if len(tokens) == LAG:
            zero.count()
    pieces = []
    for i in range(blocks):
        at, words = (int(low[i]), int(used[i])) if i < blocks - 1 else ending
        flush = [(at << 2 >> s) & 0xFFFF for s in (48, 32, 16, 0)]
        pieces.append(out[i, :words].astype("<u2").tobytes() + struct.pack("<4H", *flush))
    return pieces


def checksums(ids: np.ndarray, block_tokens: int) -> list[int]:
    """The checksum of every block's ids as little-endian unsigned 32-bit integers."""
    return [zlib.crc32(ids[first : first + block_tokens].astype("<u4").tobytes()) for first in range(0, len(ids), block_tokens)]


def _guide(segment: bytes, at: int) -> tuple[int, ...] | None:
    """What the copy of the guide at this place says, if it is whole: the header's numbers and its own length."""
    fixed = struct.calcsize(HEADER)
    if at < 0 or len(segment) < at + fixed or segment[at : at + 4] != MAGIC:
        return None
    _, block_tokens, blocks, total, head = struct.unpack_from(HEADER, segment, at)
    length = fixed + head + 8 * blocks
    whole = segment[at : at + length]
    if segment[at + length : at + length + 4] != struct.pack("<I", zlib.crc32(whole)):
        return None
    return block_tokens, blocks, total, head, length + 4


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; raises ``ValueError`` if a block does not match its checksum or no copy of the head does."""
    found = decode_blocks(segment)
    bad = [i for i, ids in enumerate(found) if ids is None]
    if bad:
        raise ValueError(f"blocks {bad} do not match their checksums")
    return np.concatenate([np.zeros(0, dtype=np.uint16), *found])


def decode_blocks(segment: bytes) -> list[np.ndarray | None]:
    """The ids of each block of a segment, None for blocks that do not match their checksum.

    The first copy of the head is used, or the last one if that is damaged; raises ``ValueError`` if both are.
    """
    last = len(segment) - 4 - (struct.unpack("<I", segment[-4:])[0] if len(segment) >= 4 else 0)
    at = next((place for place in (0, last) if _guide(segment, place)), None)
    if at is None:
        raise ValueError("not a token segment, or both copies of its head are damaged")
    block_tokens, blocks, total, head, length = _guide(segment, at)
    fixed = struct.calcsize(HEADER)
    prior = Prior.unpack(segment[at + fixed : at + fixed + head])
    sizes = np.frombuffer(segment, dtype="<u4", count=blocks, offset=at + fixed + head).astype(np.int64)
    crcs = np.frombuffer(segment, dtype="<u4", count=blocks, offset=at + fixed + head + 4 * blocks)
    raw = segment[length : length + int(sizes.sum())]
    if len(segment) != 2 * length + 4 + int(sizes.sum()):
        raise ValueError("a token segment is cut short")
    body = np.r_[np.frombuffer(raw, dtype="<u2"), np.zeros(8, dtype="<u2")]
    ends = np.cumsum(sizes // 2)
    tail = total - (blocks - 1) * block_tokens if blocks else 0
    out, begins = np.zeros((block_tokens, blocks), dtype=np.uint16), ends - sizes // 2
    for first in range(0, blocks, 2 * GROUP):
        upto = first + 2 * GROUP
        _decode(out[:, first:upto], body, begins[first:upto], prior, tail if upto >= blocks else block_tokens)
    ids = np.ascontiguousarray(out.T).reshape(-1)[:total]
    good = [crc == crcs[i] for i, crc in enumerate(checksums(ids, block_tokens))]
    return [ids[i * block_tokens : (i + 1) * block_tokens] if ok else None for i, ok in enumerate(good)]


def _decode(out: np.ndarray, body: np.ndarray, cursor: np.ndarray, prior: Prior, tail: int) -> None:
    """Blocks decoded side by side into the columns of ``out``, from the words of ``body`` where ``cursor`` says."""
    block_tokens, blocks = out.shape
    limit, model = len(body) - 1, Model(blocks, prior)
    low, length = np.zeros(blocks, dtype=np.uint64), np.full(blocks, (1 << STATE) - 1, dtype=np.uint64)
    code = np.zeros(blocks, dtype=np.uint64)
    for k in range(4):
        code = code << U(WORD) | body[np.minimum(cursor + k, limit)].astype(np.uint64)
    cursor = cursor + 4  # 64 bits have been read and the interval has 62: the last two stand behind until the next word

    def emit(rows, low):
        at = cursor.take(rows, mode="clip")
        word = body.take(at, mode="clip").astype(np.uint64)
        at += 1
        cursor[rows] = at
        held = code.take(rows, mode="clip")
        held <<= U(WORD)
        held |= word
        code[rows] = held

    flag_limit, zero = U((1 << FLAG_BITS) - 1), model.zero
    for t in range(block_tokens if blocks > 1 else tail):
        model.predict()
        ahead = (code >> U(2)) - low
        value = np.minimum(ahead // (length >> FLAG_SHIFT), flag_limit).astype(np.int32)
        outcome = (value >= model.bounds[1]).astype(np.int64) + (value >= model.bounds[2])
        ahead += low
        _narrow(low, length, model.interval(outcome), FLAG_SHIFT)
        ahead -= low
        place = np.where(outcome == 0, model.second, model.first)
        # Order 0 is asked for all blocks, which costs less than to pick out the most of them that need it.
        miss = outcome == 2
        part = length // zero.totals
        missed, begin, many = zero.locate(model.rows, np.minimum(ahead // part, zero.totals - U(1)))
        np.copyto(place, missed, where=miss)
        low += np.where(miss, part * begin, 0)
        np.multiply(part, many, out=length, where=miss)
        zero.hold(model.rows[miss], place[miss])
        if t % LAG == LAG - 1:
            zero.count()
        out[t] = _rows(prior.ids, place)
        _shift_out(low, length, emit)
        model.update(place, outcome)
