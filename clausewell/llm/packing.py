"""Sum-of-squares online packing of token sequences.

Each partition packs its documents on its own, in one pass and without a shuffle. Whole windows are cut off a
document first. Its rest goes to the fill level (an empty window among them) that keeps the sum over levels of
squared counts of partially filled windows smallest; a level array holds the counts. When a partition ends, or more
than ``most_open`` windows are open, the open windows are cut and joined, so that at most one window per partition
stays partly empty. Memory is the open windows alone, and a retried task gives the same sequences.

Defined cases: null text is the empty text, whose document is the end id alone; a document of any length is cut
freely and every id lies in one piece; repeated rows are packed as often as they occur; an empty table gives no
pieces; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clausewell.llm.token_cache import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class LevelArray:
    """Open windows by fill level, and the rule that picks one."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The level whose window, grown by ``size``, raises the sum of squared counts least; 0 opens a window. Ties go to the fullest."""
        last = self.window - size
        if last == 0:
            return 0
        cost = 2 * (self.counts[size:] - self.counts[: last + 1]) + 2
        cost[0] = 2 * self.counts[size] + 1
        cost[last] = 1 - 2 * self.counts[last]  # a full window leaves the levels
        cost[1:][self.counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return int(last - np.argmin(cost[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put the piece into a window; the window's pieces once it is full."""
        level = self.choose(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.counts[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        return None

    def drain(self) -> list[list]:
        """All open windows, fullest first."""
        found = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.counts[:] = 0
        self.open = {}
        return found


def cut_and_join(windows: list[list], window: int) -> Iterator[list]:
    """The pieces of open windows as full windows, and one last window with what is left."""
    now, room = [], window
    for doc, start, ids, total in (p for pieces in windows for p in pieces):
        while len(ids):
            now.append((doc, start, ids[:room], total))
            start, ids, room = start + len(now[-1][2]), ids[room:], room - len(now[-1][2])
            if not room:
                yield now
                now, room = [], window
    if now:
        yield now


def pack_documents(documents: Iterator[tuple[int | None, np.ndarray]], window: int, most_open: int) -> Iterator[list]:
    """Sequences, each a list of (doc_id, start, ids, doc_tokens), for documents as they come."""
    levels, is_open = LevelArray(window), 0
    for doc, ids in documents:
        whole = len(ids) - len(ids) % window
        for start in range(0, whole, window):
            yield [(doc, start, ids[start : start + window], len(ids))]
        if whole < len(ids):
            before = levels.counts.sum()
            full = levels.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
            is_open += int(levels.counts.sum() - before)
            if full:
                yield full
            elif is_open > most_open:
                *done, rest = cut_and_join(levels.drain(), window)
                yield from done
                size = sum(len(p[2]) for p in rest)
                is_open = int(size < window)
                if size == window:
                    yield rest
                else:
                    levels.counts[size] += 1
                    levels.open[size] = [rest]
    yield from cut_and_join(levels.drain(), window)


def pack(docs: DataFrame, path: str, keep_blanks: bool = True, end_id: int = 1, window: int = 2048, most_open: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the piece's ids, from which sequences are assembled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, keep_blanks, end_id)
        first = TaskContext.get().partitionId() << 36

        def documents():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), coder.each(batch.column(1)), strict=True)

        rows: list[tuple] = []
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for number, pieces in enumerate(pack_documents(documents(), window, most_open)):
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + number, offset))
                if with_ids:
                    kept.append(ids)
                offset += len(ids)
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
                kept.clear()
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
