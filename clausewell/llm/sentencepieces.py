"""SentencePiece encoding and decoding in numpy batches.

A text is cut into chunks that no piece can cross (before a run of word marks), and every distinct chunk is encoded
once while a worker's cache holds it; all methods share its cuts and lattice. Chunks of equal length advance together as rows of one matrix of code points; a substring's 64-bit
hash, taken from prefix hashes, is looked up in the sorted keys of all pieces.

* ``viterbi``: the best segmentation by the sum of piece scores. At each end position the candidates of all lengths
  are tried for all rows at once, and a vectorised maximum stores score and backpointer.
* ``merges``: for files of the byte-pair type, whose ids the library finds by repeated best merges; a best path is
  not the same there. All rows lose one symbol a round, so they stay of equal length.

Chunks of more than ``LONG`` characters, which hold no blank, are too few to advance together. They are cut where no
piece can cross, which no path and no merge sees, and each part is walked position by position: a best path over the
pieces that start there, and merges from a heap. Both take time in proportion to the text (times its logarithm for
merges) and about 200 bytes a character of the longest part.

Characters without a piece become their UTF-8 bytes' pieces where the model has these, else the unknown id. Decoding
joins pieces, turns marks into spaces and drops the leading one. A text that itself holds the mark U+2581 decodes
with spaces there, as in the library.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausewell.llm.token_cache import ChunkEncoder, Store

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_P = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
UNKNOWN_PENALTY = 10.0
LONG = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PieceTable:
    """Pieces of a model file as sorted hash keys with ids and scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = np.array([bytes_at[b] for b in range(256)], np.int64) if len(bytes_at) == 256 else None
        self.byte_of = {i: b for b, i in bytes_at.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.longest = max(len(self.pieces[i]) for i in plain)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _P)]))
            keys = np.array([self._key(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        self.scores = np.array([model.get_score(i) for i in plain], np.float32)[order]
        self.gains = self.scores.astype(np.float64).tolist()
        self.floor = np.float32(self.scores.min() - UNKNOWN_PENALTY)
        #: Where the keys with given 20 leading bits begin, and how many share them at most.
        slots = np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.first, self.crowd = slots.astype(np.int32), int(np.diff(np.append(slots, len(self.keys))).max())
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        self.spelt_lengths = np.array([len(x) for x in spelt], np.int64)
        self.spelt_starts = np.cumsum(self.spelt_lengths) - self.spelt_lengths
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def _key(self, piece: str) -> np.uint64:
        value = np.uint64(0)
        for c in piece:
            value = value * _P + np.uint64(ord(c) + 1)
        return _mix(np.array([value + np.uint64(len(piece))], np.uint64))[0]

    def prefix(self, points: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of code points: value * P + point + 1 at every step."""
        rows, n = points.shape
        out = np.zeros((rows, n + 1), np.uint64)
        with np.errstate(over="ignore"):
            if n <= LONG:
                for j in range(n):
                    out[:, j + 1] = out[:, j] * _P + points[:, j].astype(np.uint64) + np.uint64(1)
            else:  # the same as a sum of steps over powers of P, which has an inverse modulo 2^64
                back = np.cumprod(np.full(n, _BACK))
                sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * back, axis=1)
                out[:, 1:] = sums * np.cumprod(np.full(n, _P))
        return out

    def probe(self, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Places in ``keys`` of substrings of one size given by the prefix hashes at both ends, -1 where no piece is."""
        with np.errstate(over="ignore"):
            wanted = _mix(end - start * self.powers[size] + np.uint64(size))
        at = self.first[(wanted >> np.uint64(44)).astype(np.int64)]
        out = np.full(wanted.shape, -1, np.int32)
        for k in range(self.crowd):
            near = np.minimum(at + k, len(self.keys) - 1)
            out = np.where(self.keys[near] == wanted, near, out)
        return out

    def lattice(self, chunks: list[str]) -> np.ndarray:
        """[row, start, size - 1]: the piece of every substring of chunks of one length, -1 where there is none."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(len(chunks), -1)
        prefix = self.prefix(points)
        n = points.shape[1]
        out = np.full((len(chunks), n, min(n, self.longest)), -1, np.int32)
        for size in range(1, out.shape[2] + 1):
            out[:, : n - size + 1, size - 1] = self.probe(prefix[:, : n - size + 1], prefix[:, size:], size)
        return out

    def spell(self, chunks: list[str], lattice: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segmentations, joined, and each one's number; ``cuts[row, j]`` tells that a piece starts at j. Characters without a piece are spelt in bytes."""
        row, start = np.nonzero(cuts)
        fresh = np.concatenate([row[1:] != row[:-1], [True]])
        size = np.where(fresh, cuts.shape[1], np.concatenate([start[1:], [0]])) - start
        at = lattice[row, start, np.minimum(size, lattice.shape[2]) - 1]
        ids, lengths = self.ids[at], np.bincount(row, minlength=len(chunks))
        if (at >= 0).all():
            return ids, lengths
        out = np.split(ids, np.cumsum(lengths)[:-1])
        for r in np.unique(row[at < 0]):
            mine = row == r
            own: list[int] = []
            for place, j in zip(at[mine].tolist(), start[mine].tolist(), strict=True):
                if place >= 0:
                    own.append(int(self.ids[place]))
                elif self.bytes is not None:
                    own.extend(int(self.bytes[b]) for b in chunks[r][j].encode())
                elif not own or own[-1] != self.unknown:
                    own.append(self.unknown)
            out[r] = np.array(own, np.int64)
            lengths[r] = len(own)
        return np.concatenate(out), lengths


def viterbi(table: PieceTable, chunks: list[str], lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of chunks of one length; of equal scores the longest last piece wins."""
    rows, length = lattice.shape[:2]
    best = np.full((rows, length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    back = np.ones((rows, length + 1), np.int32)
    for j in range(1, length + 1):
        best[:, j] = best[:, j - 1] + table.floor
        for size in range(min(j, lattice.shape[2]), 0, -1):
            at = lattice[:, j - size, size - 1]
            score = np.where(at >= 0, best[:, j - size] + table.scores[at], -np.inf)
            better = score > best[:, j]
            best[:, j] = np.where(better, score, best[:, j])
            back[:, j] = np.where(better, size, back[:, j])
    cuts, j = np.zeros((rows, length), bool), np.full(rows, length)
    live = np.arange(rows)
    while len(live):
        j[live] -= back[live, j[live]]
        cuts[live, j[live]] = True
        live = live[j[live] > 0]
    return table.spell(chunks, lattice, cuts)


def merges(table: PieceTable, chunks: list[str], lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by repeated best merges (highest score, then leftmost) of chunks of one length."""
    length, most = lattice.shape[1:]
    cuts = np.zeros(lattice.shape[:2], bool)
    rows, bounds = np.arange(len(chunks)), np.tile(np.arange(length + 1), (len(chunks), 1))
    while len(rows):
        n = bounds.shape[1] - 1
        size = bounds[:, 2:] - bounds[:, :-2]
        at = lattice[rows[:, None], bounds[:, :-2], np.minimum(size, most) - 1]
        score = np.where((at >= 0) & (size <= most), table.scores[at], -np.inf)
        pick = np.argmax(score, 1) if n > 1 else np.zeros(len(rows), np.int64)
        going = np.isfinite(score[np.arange(len(rows)), pick]) if n > 1 else np.zeros(len(rows), bool)
        done = rows[~going]
        cuts[np.repeat(done, n), bounds[~going, :-1].ravel()] = True
        rows, bounds = rows[going], bounds[going]
        keep = np.ones(bounds.shape, bool)
        keep[np.arange(len(rows)), pick[going] + 1] = False
        bounds = bounds[keep].reshape(len(rows), n)
    return table.spell(chunks, lattice, cuts)


def long_parts(chunk: str, lattice: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """A long chunk cut where no piece crosses, each part with its rows of the lattice [start, size - 1]."""
    sizes = np.arange(1, lattice.shape[1] + 1)
    reach = np.arange(len(chunk)) + np.where(lattice >= 0, sizes, 1).max(1)
    cuts = np.flatnonzero(np.maximum.accumulate(reach) <= np.arange(1, len(chunk) + 1)) + 1
    at = 0
    for end in cuts.tolist():
        yield chunk[at:end], lattice[at:end]
        at = end


def _pieces_at(lattice: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Per start the bounds of its entries in two lists: sizes, and places among the keys."""
    start, size = np.nonzero(lattice >= 0)
    return np.searchsorted(start, np.arange(len(lattice) + 1)).tolist(), (size + 1).tolist(), lattice[start, size].tolist()


def walk_best(table: PieceTable, part: str, lattice: np.ndarray) -> np.ndarray:
    """Where the pieces of the best path of one part start; the order of equals is that of ``viterbi``."""
    bounds, sizes, places = _pieces_at(lattice)
    gains, floor = table.gains, float(table.floor)
    n = len(part)
    best, back = [float("-inf")] * (n + 1), [1] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        here = best[at]
        if here + floor >= best[at + 1]:
            best[at + 1], back[at + 1] = here + floor, 1
        for k in range(bounds[at], bounds[at + 1]):
            end, score = at + sizes[k], here + gains[places[k]]
            if score > best[end]:
                best[end], back[end] = score, sizes[k]
    cuts, at = np.zeros(n, bool), n
    while at:
        at -= back[at]
        cuts[at] = True
    return cuts


def walk_merges(table: PieceTable, part: str, lattice: np.ndarray) -> np.ndarray:
    """Where the symbols of one part start after all merges, the best score first, then the leftmost."""
    n, most = lattice.shape
    places, gains = memoryview(np.ascontiguousarray(lattice).ravel()), table.gains
    size, before, cuts = [1] * n, list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int, one: int, two: int) -> None:
        if one + two <= most and (place := places[i * most + one + two - 1]) >= 0:
            heapq.heappush(heap, (-gains[place], i, one, two))

    for i in range(n - 1):
        offer(i, 1, 1)
    while heap:
        _, i, one, two = heapq.heappop(heap)
        j = i + one
        if not cuts[i] or size[i] != one or not cuts[j] or size[j] != two:
            continue  # one of the two has merged since
        size[i], cuts[j] = one + two, False
        after = i + size[i]
        if after < n:
            before[after] = i
            offer(i, size[i], size[after])
        if before[i] >= 0:
            offer(before[i], size[before[i]], size[i])
    return np.array(cuts)


def long_ids(table: PieceTable, chunk: str, lattice: np.ndarray, walk) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one long chunk, its parts walked one after the other, and their number."""
    cuts = [walk(table, part, rows) for part, rows in long_parts(chunk, lattice[0])]
    return table.spell([chunk], lattice, np.concatenate(cuts)[None, :])


WALKS = {viterbi: walk_best, merges: walk_merges}


class PieceEncoder(ChunkEncoder):
    """Whole texts to ids by one or more of the methods, which share cuts and lattices, and back."""

    def __init__(self, path: str, *methods):
        self.table, self.methods = PieceTable(path), methods
        super().__init__(self._chunks, self._encode, len(self.table.pieces) > 1 << 16, None, forms=len(methods))

    def _encode(self, fresh: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        order = np.argsort(sizes, kind="stable")  # chunks of one length follow one another
        found: list[list] = [[] for _ in self.methods]
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            until = int(np.searchsorted(sizes, size, "right", sorter=order))
            end = min(until, at + max(1, 60_000 // size)) if size <= LONG else at + 1
            chunks = [fresh[k] for k in order[at:end].tolist()]
            lattice = self.table.lattice(chunks)
            for own, method in zip(found, self.methods, strict=True):
                own.append(long_ids(self.table, chunks[0], lattice, WALKS[method]) if size > LONG else method(self.table, chunks, lattice))
            at = end
        out = []
        for own in found:
            held = Store(np.int64)
            held.add(0, *map(np.concatenate, zip(*own, strict=True)))
            back = np.argsort(order)
            out.append((held.of(back)[0], held.lengths[back]))
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(MARK, " ")
        if "  " in marked or marked[0] == " " or marked[-1] == " ":
            return CHUNK.findall(MARK + marked.replace(" ", MARK))
        return [MARK + x for x in marked.split(" ")]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the text of ids; control pieces are dropped."""
        table = self.table
        lengths = table.spelt_lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = table.spelt[np.arange(total) + np.repeat(table.spelt_starts[ids] - ends + lengths, lengths)]
        return flat.tobytes().removeprefix(b" ")


_ENCODERS: dict[tuple, PieceEncoder] = {}


def piece_encoder(path: str, *methods) -> PieceEncoder:
    """One encoder per Python worker and choice of methods."""
    key = (path, *(m.__name__ for m in methods))
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, *methods)
    return _ENCODERS[key]


SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, n_merged bigint, merged_crc32 bigint, round_trip boolean"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: number and CRC-32 of the best path's ids and of the merged ids, and whether decoding the best
    path gives the text back (its marks read as spaces). ``with_ids`` adds the best path's ids.

    Null text is the empty text, which has no ids; repeated rows are encoded each; other columns are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path, viterbi, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                one, two = coder.encode_forms(texts)
                crc = lambda rows: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64())
                size = lambda rows: pa.array([len(x) for x in rows], pa.int64())
                same = [coder.decode(x) == t.replace(MARK, " ").encode() for x, t in zip(one, texts, strict=True)]
                columns = [part.column(0), size(one), crc(one), size(two), crc(two), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in one], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
