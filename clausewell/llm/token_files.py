"""Token-id files: Arrow IPC files of fixed-size-list batches.

Every file holds rows of ``length`` ids and as many mask bits, so row r of a batch starts at byte r * length * width of
one buffer: a reader maps the file and slices ids and mask, without copying or parsing. Documents follow one another
without gaps, in ascending doc_id order over all files; a file's last row is padded and its padding masked out. A second
small file beside it lists its documents (doc_id, start in the file, number of ids). Ids of vocabularies of up to 65,536
entries take two bytes.

A first pass over ids and lengths gives the ranges of doc_id, one per file; their number grows with the texts. Texts are
then encoded where they stand, once, and only their ids, half a text's size, are dealt by these ranges. A task writes
its file under the shared folder, first under the attempt's name and then moved, so a retried or speculative task leaves
the same one.

Defined cases: null text is the empty text, whose ids are the end id alone; repeated rows keep one entry each, next to
each other; null ids come first; texts of any length are encoded whole; an empty table writes no files; other columns
are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewell.llm.common import Scratch
from clausewell.llm.token_cache import encoder

FILES = "part int, path string, n_docs bigint, n_tokens bigint"
BATCH_ROWS = 64
#: Bytes of text of one file on average, some 60 million ids.
FILE_TEXT = 1 << 28


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FileWriter:
    """Appends id arrays to one file of fixed-size rows; ``finish`` pads the last row."""

    def __init__(self, sink, width: pa.DataType, length: int):
        self.length, self.width = length, width
        self.schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH_ROWS * self.length:
            self._write(self.size - self.size % (BATCH_ROWS * self.length))

    def _write(self, size: int, padding: int = 0) -> None:
        flat = np.concatenate(self.held)
        self.held, self.size = [flat[size:]], len(flat) - size
        flat = np.concatenate([flat[:size], np.zeros(padding, flat.dtype)]).astype(self.width.to_pandas_dtype())
        mask = np.arange(len(flat)) < size
        for at in range(0, len(flat), BATCH_ROWS * self.length):
            end = at + BATCH_ROWS * self.length
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:end]), self.length) for x in (flat, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def finish(self) -> None:
        if self.size:
            self._write(self.size, -self.size % self.length)
        self.writer.close()


class FileReader:
    """Random access to a written file; ``ids`` slices the mapped buffers and copies only across batch borders."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per = BATCH_ROWS * self.length
        self.at, self.flat = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy()
        return self.flat

    def row(self, r: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of row ``r``, both Arrow slices of the mapped file."""
        batch, k = self.file.get_batch(r // BATCH_ROWS), r % BATCH_ROWS
        return tuple(batch.column(j).values.slice(k * self.length, self.length) for j in (0, 1))

    def held(self) -> int:
        """The number of ids that no mask hides."""
        return sum(self.file.get_batch(k).column(1).values.true_count for k in range(self.file.num_record_batches))

    def ids(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, batch by batch."""
        while size:
            k, at = divmod(start, self.per)
            part = self._batch(k)[at : at + size]
            yield part
            start, size = start + len(part), size - len(part)


def ranges(docs: DataFrame, files: int | None) -> np.ndarray:
    """Upper bounds of the ranges of doc_id, all but the last; the driver sees one number per file."""
    spark = docs.sparkSession
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT))
    if files < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(10_000, 20 * files)).alias("at")).first()["at"]
    return np.unique(np.array(found or [], np.int64))


def write_files(docs: DataFrame, scratch: Scratch, path: str, keep_blanks: bool, end_id: int, length: int = 2048, files: int | None = None) -> DataFrame:
    """Write all documents; one row per file."""
    folder, bounds, kind = scratch.path("tokens"), ranges(docs, files), encoder(path, keep_blanks, end_id).kind
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, keep_blanks, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                known = pc.is_valid(rows.column(0)).to_numpy(zero_copy_only=False)
                parts = np.where(known, np.searchsorted(bounds, pc.fill_null(rows.column(0), 0).to_numpy()), 0)
                found = pa.array([x.astype(kind).tobytes() for x in coder.each(rows.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), rows.column(0), found], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, ids, sizes = None, [], []

        def done() -> pa.RecordBatch:
            out.finish()
            stream.close()
            counts, name = np.array(sizes, np.int64), f"{root}/part-{now:06d}"
            index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": np.cumsum(counts) - counts, "n_tokens": counts})
            with fs.open_output_stream(f"{name}-{attempt}.index.tmp") as sink, pa.ipc.new_file(sink, index.schema) as writer:
                writer.write_table(index)
            fs.move(f"{name}-{attempt}.index.tmp", f"{name}.index.arrow")
            fs.move(f"{name}-{attempt}.tmp", f"{name}.arrow")
            row = {"part": [now], "path": [f"{folder}/part-{now:06d}"], "n_docs": [len(ids)], "n_tokens": [out.total]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for part, key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, ids, sizes = part, [], []
                    stream = fs.open_output_stream(f"{root}/part-{part:06d}-{attempt}.tmp")
                    out = FileWriter(stream, pa.from_numpy_dtype(kind), length)
                found = np.frombuffer(found.as_buffer(), kind)
                out.add(found)
                ids.append(key)
                sizes.append(len(found))
        if now is not None:
            yield done()

    coded = docs.select("doc_id", "text").mapInArrow(encode, "part int, doc_id bigint, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", F.xxhash64("ids"))
    return scratch.save(dealt.mapInArrow(write, FILES), "files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    The running start needs one row per file in order, a table as small as the list of files.
    """
    starts = files.withColumn("first", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                local = type(fs).__name__ == "LocalFileSystem"
                where = (lambda name: pa.memory_map(name)) if local else fs.open_input_file  # noqa: E731, B023
                with where(f"{path}.index.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                with where(f"{path}.arrow") as source:
                    reader, sums = FileReader(source), []
                    if reader.held() != row["n_tokens"]:
                        raise ValueError(f"masks and index of {path} disagree")
                    for start, size in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
                        crc = 0
                        for part in reader.ids(start, size):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    del reader
                yield pa.RecordBatch.from_arrays(
                    [index["doc_id"].combine_chunks(), pa.array(index["start"].to_numpy() + row["first"]), index["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts.select("path", "first", "n_tokens").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
