"""Token ids in fixed-width packed files with block offsets.

A file holds the ids of consecutive documents in the fewest bits that the vocabulary
needs. Layout, little-endian:

    payload    blocks of ``BLOCK`` ids, each id in ``bits`` bits, 64 ids in ``bits`` words
    documents  doc_id int64[n_docs], has_id uint8[n_docs], n_ids uint64[n_docs]
    blocks     byte offset of each block and of the payload's end, uint64[n_blocks + 1]
    footer     n_docs, n_ids, n_blocks, bits, block uint64 each, then the magic bytes

Any id's block and bit follow from its index, so a reader fetches only the blocks a
document touches and unpacks them with whole-array shifts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder, written
from .common import keyed_text, steps
from .units import ENCODE_BYTES, encoder

MAGIC = b"LOOMIDS1"
BLOCK = 8192
_FOOTER = struct.Struct("<5Q8s")


def width(vocabulary: int) -> int:
    """Bits an id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, a multiple of 64 of them, to ``bits`` 64-bit words per 64 ids."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), bits), dtype="<u8")
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        words[:, at] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    ids = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        lane = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, at + 1] << np.uint64(64 - shift))
        ids[:, i] = lane & mask
    return ids.reshape(-1)


class Writer:
    """Streams documents into one file; memory holds a few blocks and 17 bytes a document."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, 0
        self.docs, self.sizes, self.offsets = [], [], []
        self.pending, self.held, self.total = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.pending.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= 16 * BLOCK:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), dtype="<u4")
        rest, ids = ids[n:], ids[:n]
        if len(ids) % BLOCK:
            ids = np.concatenate([ids, np.zeros(-len(ids) % BLOCK, dtype="<u4")])
        data = pack(ids, self.bits)
        size = BLOCK * self.bits // 8
        self.offsets += range(self.at, self.at + len(data), size)
        self.out.write(data)
        self.at += len(data)
        self.pending, self.held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        known = [d is not None for d in self.docs]
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array(known, dtype="u1").tobytes())
        self.out.write(np.array(self.sizes, dtype="<u8").tobytes())
        self.out.write(np.array([*self.offsets, self.at], dtype="<u8").tobytes())
        self.out.write(_FOOTER.pack(len(self.docs), self.total, len(self.offsets), self.bits,
                                    BLOCK, MAGIC))


class Reader:
    """Random access to a file's documents."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        n, self.total, blocks, self.bits, self.block, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        file.seek(size - _FOOTER.size - 8 * (blocks + 1) - 17 * n)
        doc_ids = np.frombuffer(file.read(8 * n), dtype="<i8")
        known = np.frombuffer(file.read(n), dtype="u1")
        self.sizes = np.frombuffer(file.read(8 * n), dtype="<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), dtype="<u8").astype(np.int64)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known)]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, -(-stop // self.block)
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last] - self.offsets[first]))
        return unpack(data, self.bits)[start - first * self.block:stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i] + self.sizes[i]))

    def crcs(self, span: int = 32 * BLOCK) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, n_ids, crc32) of each document, from one forward read of the blocks."""
        low = high = 0
        held = np.zeros(0, dtype="<u4")
        for doc_id, start, n in zip(self.doc_ids, self.starts.tolist(), self.sizes.tolist()):
            at, crc = start, 0
            while at < start + n:
                if at >= high:
                    low = at - at % self.block
                    high = min(low + span, self.total)
                    held = self.ids(low, high)
                stop = min(start + n, high)
                crc = zlib.crc32(held[at - low:stop - low].tobytes(), crc)
                at = stop
            yield doc_id, start, n, crc


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Write every text's ids, in ascending order of the id column, and return the manifest.

    Texts are dealt by sampled ranges of the id and encoded after it, so a task writes one
    file of consecutive documents. A file appears under its name only when complete and a
    repeated task writes the same content again, so lost executors and speculative copies
    do no harm. Null text: only the end id. Rows without an id come first; equal ids stay
    separate documents. An empty table gives an empty manifest.

    Manifest: path, shard, n_docs, n_ids, base (ids in earlier files).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        coder, writer, target = encoder(tokenizer), None, None
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in steps(batch, "text", ENCODE_BYTES):
                coded = coder.encode(part.column("text"), end_id)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coded.to_pylist()):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        target = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                        bits = width(max(coder.vocabulary, end_id + 1))
                        writer = Writer(fs.open_output_stream(target), bits)
                    writer.add(doc_id, np.frombuffer(ids, coder.kind).astype("<u4").tobytes())
        if writer is not None:
            writer.close()
            writer.out.close()
            fs.move(target, f"{root}/{shard:06d}.ids")
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{shard:06d}.ids"], "shard": pa.array([shard], pa.int32()),
                "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    # many rows may share an id or lack one: the text's hash parts them
    mark = F.xxhash64("text")
    laid = keyed_text(docs, id_col, text_col).repartitionByRange("doc_id", mark) \
        .sortWithinPartitions("doc_id", mark)
    manifest = written(laid.mapInArrow(run, "path string, shard int, n_docs long, n_ids long"),
                       "packed-ids-manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/packed-ids-{uuid.uuid4().hex}"


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    rows = []
                    for doc_id, start, n, crc in Reader(file, file.size()).crcs():
                        rows.append((doc_id, base + start, n, crc))
                        if len(rows) == 20_000:
                            yield _digest_batch(rows)
                            rows = []
                    if rows:
                        yield _digest_batch(rows)

    files = max(1, manifest.count())
    return manifest.select("path", "base", "shard").repartitionByRange(files, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id and its ids as array<int>, for jobs that want the ids themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    reader = Reader(file, file.size())
                    for i, doc_id in enumerate(reader.doc_ids):
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([doc_id], pa.int64()),
                            "ids": pa.array([reader.document(i).astype(np.int32)],
                                            pa.list_(pa.int32()))})

    files = max(1, manifest.count())
    return manifest.select("path", "shard").repartitionByRange(files, "shard").mapInArrow(
        run, "doc_id long, ids array<int>")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])
