"""Word-shingle sets of whole texts as sorted 64-bit hashes, computed with numpy over many texts at once.

Words are the runs of other characters than the six ASCII blanks, with A-Z lower-cased. A set holds the hashes of
the distinct five-word shingles; a text of one to four words has one shingle, the whole sequence; a text without
words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BACK = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES[_BLANK] = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns lists of UTF-8 texts into lists of sorted distinct shingle hashes."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 1 << 18)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BACK)]))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self._grow(len(joined))
        blank = _BLANK[joined]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(_VALUES[joined] * self.powers[: len(joined)])
            words = _mix((sums[ends - 1] - sums[starts - 1]) * self.inverses[starts])
            shingles = words[: max(0, len(words) - WORDS + 1)].copy()
            for k in range(1, WORDS):
                shingles = _mix(shingles) + words[k : len(words) - WORDS + 1 + k]
            shingles = _mix(shingles)
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, bounds)
        out = []
        for i in range(len(texts)):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= WORDS:
                row = np.sort(shingles[lo : hi - WORDS + 1])
                out.append(row[np.concatenate([[True], row[1:] != row[:-1]])])
            elif hi > lo:
                value = np.full(1, hi - lo, np.uint64)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        value = _mix(value) + w
                out.append(_mix(value))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, or one larger row."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


_SHINGLER = Shingler()


def text_sets(column, most: int = 1 << 18) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) over an Arrow string column, about a quarter of a megabyte of text at a time; null is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(binary).to_numpy(zero_copy_only=False)
    for lo, hi in slices(sizes, most):
        yield lo, _SHINGLER.sets(binary.slice(lo, hi - lo).to_pylist())
