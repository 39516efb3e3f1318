"""Bit-sliced Hamming comparison: bit planes stored vertically, distances in carry-save bitwise counters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Planes between two looks at which words can be abandoned.
STRIDE = 16
#: Runs up to this length are compared together by offset; longer ones by queries against a block.
SHORT_RUN = 64
QUERIES = 64


def planes_of(fingerprints: np.ndarray) -> np.ndarray:
    """(n, words) uint64 to (64 * words, ceil(n / 64) + 1) uint64: bit r of word w of a plane belongs to row 64w + r."""
    n, words = fingerprints.shape
    bits = np.unpackbits(np.ascontiguousarray(fingerprints).view(np.uint8).reshape(n, 8 * words), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    whole = np.zeros((64 * words, ((n + 63) // 64 + 1) * 8), dtype=np.uint8)
    whole[:, : packed.shape[1]] = packed
    return whole.view(np.uint64)


def pack(flags: np.ndarray) -> np.ndarray:
    """Booleans to words of 64, lowest bit first, along the last axis (which must be a multiple of 64)."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def within(differing: Callable[[int, np.ndarray], np.ndarray], n_planes: int, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of pair bits that differ in at most ``radius`` planes: positions in ``alive`` and their bits.

    ``differing(plane, at)`` gives the pairs that differ in that plane for the words at positions ``at``. A counter of k
    bit planes starts at 2^k - 1 - radius, so it overflows at the first difference too many. Two planes at a time are
    added by a carry-save adder; words whose pairs have all overflowed are abandoned.
    """
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    at = np.flatnonzero(alive)
    live = alive[at]
    counter = [np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(size)]
    over = np.zeros(len(at), dtype=np.uint64)
    for plane in range(0, n_planes, 2):
        if not len(at):
            break
        x, y, ones = differing(plane, at), differing(plane + 1, at), counter[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        counter[0] = half ^ y
        for k in range(1, size):
            carry, counter[k] = carry & counter[k], counter[k] ^ carry
        over |= carry
        if plane % STRIDE == STRIDE - 2:
            live &= ~over
            keep = live != 0
            if not keep.all():
                at, live, over = at[keep], live[keep], over[keep]
                counter = [c[keep] for c in counter]
    live = live & ~over
    keep = live != 0
    return at[keep], live[keep]


def bit_positions(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and position of the bit, for every set bit."""
    return np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


class Labels:
    """Classes of rows; a class is named by its first row."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            to = np.arange(len(self.of))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := to[to], to):
                to = up
            self.of = to[self.of]


def link_runs(keys: np.ndarray, fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows are sorted by key. Links rows of one key within ``radius``: (row, first row of its class), for rows not first.

    Every pair of a run is either compared or already in one class.
    """
    n = len(keys)
    labels = Labels(n)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, n])
    end = np.repeat(starts + lengths, lengths)
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    planes = planes_of(fingerprints)
    _by_offset(planes, end, short, radius, labels, int(lengths[lengths <= SHORT_RUN].max(initial=1)))
    for start, length in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
        _by_query(planes_of(fingerprints[start : start + length]), int(start), int(length), radius, labels)
    row = np.flatnonzero(labels.of != np.arange(n))
    return row, labels.of[row]


def _by_offset(planes: np.ndarray, end: np.ndarray, wanted: np.ndarray, radius: int, labels: Labels, longest: int) -> None:
    """Compare each row with the one ``offset`` further on, for all short runs of the block at once."""
    n = len(end)
    rows = np.arange(n)
    padded = np.zeros((planes.shape[1] - 1) * 64, dtype=bool)
    for offset in range(1, longest):
        padded[:n] = wanted & (rows + offset < end)
        skip, shift = divmod(offset, 64)
        last = planes.shape[1] - 1

        def differing(plane, at, skip=skip, shift=shift, last=last):
            row, ahead = planes[plane], np.minimum(at + skip, last)
            moved = row[ahead] >> np.uint64(shift)
            if shift:
                moved |= row[np.minimum(ahead + 1, last)] << np.uint64(64 - shift)
            return row[at] ^ moved

        at, bits = within(differing, len(planes), pack(padded), radius)
        word, bit = bit_positions(bits)
        i = at[word] * 64 + bit
        labels.join(i, i + offset)


def _by_query(planes: np.ndarray, start: int, n: int, radius: int, labels: Labels) -> None:
    """Compare ``QUERIES`` rows at a time with a whole long run; pairs that are in one class already are left out."""
    words = (n + 63) // 64
    rows = start + np.arange(n)
    bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, :n]
    for first in range(0, n, QUERIES):
        query = np.arange(first, min(n, first + QUERIES))
        flags = np.zeros((len(query), words * 64), dtype=bool)
        flags[:, :n] = (labels.of[rows][None, :] != labels.of[start + query][:, None]) & (rows[None, :] > start + query[:, None])
        if not flags.any():
            continue
        ones = np.where(bits[:, query], np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))

        def differing(plane, at, ones=ones):
            return planes[plane][at % words] ^ ones[plane][at // words]

        at, found = within(differing, len(planes), pack(flags).ravel(), radius)
        word, bit = bit_positions(found)
        labels.join(start + query[at[word] // words], start + (at[word] % words) * 64 + bit)
