"""Token ids in fixed-width bit-packed files: written by range-partitioned tasks, read back by file.

A file holds, one after another: the magic bytes, blocks of ``BLOCK`` ids packed in the minimum number of bits that the
vocabulary needs, an index (document ids with a null mark, first id of each document, byte offset of each block) and a footer of fixed size that
says where the index starts. Any range of ids is read by seeking to its blocks and unpacking them with numpy.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch, crc32_of
from teleproof.llm.tokens import encoder, vocabulary_size

MAGIC = b"PACKEDIDS1"
BLOCK = 65_536
FOOTER = struct.Struct("<QQQQQ")  # ids, documents, blocks, bits, start of the index


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel()


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, be it local, shared or remote."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class PackedWriter:
    """Appends documents to one file; holds one unfinished block and the index in memory."""

    def __init__(self, out, bits: int) -> None:
        self.out, self.bits, self.rest = out, bits, []
        self.held = self.total = 0
        self.docs, self.nulls, self.starts, self.offsets = [], [], [], []
        self.out.write(MAGIC)
        self.place = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            held = np.concatenate(self.rest)
            whole = len(held) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self.block(held[k : k + BLOCK])
            self.rest, self.held = [held[whole:]], len(held) - whole

    def block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def close(self) -> None:
        if self.held:
            self.block(np.concatenate(self.rest))
        self.offsets.append(self.place)
        for column, kind in ((self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(FOOTER.pack(self.total, len(self.docs), len(self.offsets) - 1, self.bits, self.place))


class PackedReader:
    """Random access to one file: ``ids(a, b)`` reads the blocks that hold the ids from ``a`` up to ``b`` and no others."""

    def __init__(self, uri: str) -> None:
        system, path = at(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.total, self.n_docs, blocks, self.bits, index = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        data = self.file.read_at(size - FOOTER.size - index, index)
        kinds = (("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs), ("<u8", blocks + 1))
        columns = []
        for kind, count in kinds:
            columns.append(np.frombuffer(data, kind, count))
            data = data[count * np.dtype(kind).itemsize :]
        docs, nulls, starts, self.offsets = columns
        self.docs = [None if gone else doc for doc, gone in zip(docs.tolist(), nulls.tolist())]
        self.starts = [*starts.tolist(), self.total]

    def ids(self, first: int, stop: int) -> np.ndarray:
        if first >= stop:
            return np.zeros(0, "<u4")
        low, high = first // BLOCK, (stop - 1) // BLOCK + 1
        data = self.file.read_at(int(self.offsets[high] - self.offsets[low]), int(self.offsets[low]))
        parts = [unpack(data[int(self.offsets[k] - self.offsets[low]) : int(self.offsets[k + 1] - self.offsets[low])],
                        self.bits, min(BLOCK, self.total - k * BLOCK)) for k in range(low, high)]
        return np.concatenate(parts)[first - low * BLOCK : stop - low * BLOCK]

    def documents(self, step: int = 4_194_304) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document in file order, its first id and its ids; reads about ``step`` ids at a time."""
        k = 0
        while k < self.n_docs:
            stop = k + 1
            while stop < self.n_docs and self.starts[stop + 1] - self.starts[k] <= step:
                stop += 1
            ids = self.ids(self.starts[k], self.starts[stop])
            for j in range(k, stop):
                yield self.docs[j], self.starts[j], ids[self.starts[j] - self.starts[k] : self.starts[j + 1] - self.starts[k]]
            k = stop

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Encode ``doc_id, text`` and write packed files in ascending ``doc_id`` order, one file per task.

    Returns one row per file: ``path, n_docs, n_ids, n_nulls, first_doc, part``; the files follow each other by ``part``. The texts are dealt by ranges of ``doc_id`` before they are
    encoded, so each is encoded once and its ids are written where they were made. A task that runs twice writes two files,
    of which only the one it reports counts. Null text: the end id alone; null ``doc_id``: first; equal ``doc_id``: by text.
    """
    bits = bits_for(vocabulary_size(tokenizer))
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, seen = encoder(tokenizer), None, []
        for batch in batches:
            if writer is None:
                path = f"{folder}/ids-{uuid.uuid4().hex}.bin"
                system, place = at(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
                writer = PackedWriter(out, bits)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc, np.frombuffer(words.encode(text.as_py()) + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            seen = [d for d, gone in zip(writer.docs, writer.nulls) if not gone]
            yield pa.RecordBatch.from_pydict({
                "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.total], "n_nulls": [sum(writer.nulls)],
                "first_doc": pa.array([seen[0] if seen else None], pa.int64()),
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            })

    # Ranges of the id alone would put all rows of a repeated id into one task; text splits them.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return ordered.mapInArrow(write, "path string, n_docs long, n_ids long, n_nulls long, first_doc long, part int")


def read_token_files(files: DataFrame) -> DataFrame:
    """The documents of packed files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all files before."""
    order = Window.orderBy("part")
    placed = files.withColumn("base", F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", F.coalesce("base", F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = PackedReader(path), []
                for doc, start, ids in reader.documents():
                    rows.append((doc, base + start, len(ids), crc32_of(ids)))
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition("path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` as packed token files in the shared folder and return its documents as read back from them."""
    scratch = Scratch(docs.sparkSession, "token-files")
    files = scratch.keep(write_token_files(docs, tokenizer, scratch.path("files"), end_id), "manifest")
    return read_token_files(files)
