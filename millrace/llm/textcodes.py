"""Texts as arrays of code points, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

#: Characters that a task holds as arrays at a time; a longer text is a piece of its own.
PIECE_CHARS = 1 << 20
TABLE_SIZE = 0x110000


def pieces(texts: list[str], limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters together, or one text."""
    first = total = 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def every_character() -> str:
    """All characters but the surrogates, in order."""
    codes = np.r_[0:0xD800, 0xE000:TABLE_SIZE].astype("<u4")
    return codes.tobytes().decode("utf-32-le")


def matching(pattern: str) -> np.ndarray:
    """For every code point whether it matches ``pattern``, which may repeat."""
    table = np.zeros(TABLE_SIZE, dtype=bool)
    for m in regex.finditer(pattern, every_character()):
        a, b = (p if p < 0xD800 else p + 0x800 for p in (m.start(), m.end()))
        table[a:b] = True
    return table


def lower_letters() -> np.ndarray:
    """For every code point its simple lower case if it is a letter, else 32 (a space)."""
    table = np.where(matching(r"\p{L}+"), np.arange(TABLE_SIZE), 32).astype(np.uint32)
    for c in np.flatnonzero(matching(r"[\p{Lu}\p{Lt}]+")).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table
