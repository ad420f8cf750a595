"""Bounded-space online packing of token documents into sequences of a fixed size.

Every task keeps a fixed number of open windows. A document goes to the open window that it fills best; if none has room the
fullest window is emitted, filled up with the head of the document where enough room is left to make a cut worthwhile. Windows
still open when a task ends are merged with those of other tasks, best fit again, in rounds of bounded groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch, crc32_of
from teleproof.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"
MERGE_GROUP = 1_024


class OpenWindows:
    """At most ``limit`` windows of ``size`` ids, ordered by the room they have left."""

    def __init__(self, size: int, limit: int, least_cut: int, first_id: int) -> None:
        self.size, self.limit, self.least_cut, self.next_id = size, limit, least_cut, first_id
        self.room: list[tuple[int, int]] = []

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, k: int, length: int) -> tuple[int, int]:
        """Take ``length`` ids into the k-th window; returns its id and the offset there."""
        room, window = self.room.pop(k)
        if room > length:
            insort(self.room, (room - length, window))
        return window, self.size - room

    def place(self, length: int) -> Iterator[tuple[int, int, int]]:
        """Where a document of ``length`` ids goes: length, window and offset of each piece."""
        if length > self.size and self.room and self.room[0][0] >= self.least_cut:
            head = self.room[0][0]
            yield head, *self.put(0, head)
            length -= head
        while length >= self.size:
            yield self.size, self.new(), 0
            length -= self.size
        while length:
            k = bisect_left(self.room, (length, -1))
            if k < len(self.room):
                yield length, *self.put(k, length)
                return
            if len(self.room) < self.limit:
                window = self.new()
                insort(self.room, (self.size - length, window))
                yield length, window, 0
                return
            head = self.room[0][0]
            if self.least_cut <= head:
                yield head, *self.put(0, head)
                length -= head
            else:
                self.room.pop(0)


def pack_tokens(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], size: int = 2_048, open_windows: int = 64,
                least_cut: int = 48) -> DataFrame:
    """Pack all ``doc_id, text`` of ``docs``; ``encode()`` is called once in a task and gives the function from text to ids.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. The offsets of a sequence run without
    gaps from 0 and each id of a document lies in exactly one piece. Documents without ids have no piece. Rows that repeat
    are packed as often as they come. Memory of a task: one batch, its open windows, nothing that grows with the input.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encode()
        windows = OpenWindows(size, open_windows, least_cut, TaskContext.get().partitionId() << 40)
        waiting: dict[int, list[list]] = {}  # the pieces of the windows that are open
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, start = memoryview(to_ids(text.as_py())), 0
                total = len(ids) // 4
                for length, window, offset in windows.place(total):
                    crc = crc32_of(ids[4 * start : 4 * (start + length)])
                    waiting.setdefault(window, []).append([doc, start, length, crc, total, window, offset])
                    start += length
            still = {w for _, w in windows.room}
            for window in [w for w in waiting if w not in still]:
                rows += [(*p, False) for p in waiting.pop(window)]
            if rows:
                yield piece_batch(rows)
        if waiting:
            yield piece_batch([(*p, True) for group in waiting.values() for p in group])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(wanted.mapInArrow(run, PIECES), "pieces")
    moved = merge_leftovers(pieces, size, scratch)
    placed = pieces.join(moved, "window", "left")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("sequence_id", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, still_open = zip(*rows)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(still_open, pa.bool_())], names)


def merge_leftovers(pieces: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Join windows that tasks left open; returns ``window, sequence_id, shift`` of those that moved."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["used", "window"], ascending=[False, True])
        room, into, shift, filled = [], [], [], {}
        for window, used in zip(group.window.tolist(), group.used.tolist()):
            k = bisect_left(room, (used, -1))
            target, left = (room.pop(k)[::-1] if k < len(room) else (window, size))
            into.append(target)
            shift.append(size - left)
            insort(room, (left - used, target))
            filled[target] = size - left + used
        return pd.DataFrame({"window": group.window, "into": into, "shift": shift, "filled": [filled[w] for w in into]})

    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("used"))
    moved, turn = None, 0
    while True:
        left = scratch.keep(left, f"left-{turn}")
        groups = -(-left.count() // MERGE_GROUP)
        key = F.pmod(F.xxhash64("window"), F.lit(max(groups, 1)))
        step = left.groupBy(key.alias("part")).applyInPandas(merge, "window long, into long, shift long, filled long")
        step = scratch.keep(step, f"step-{turn}")
        if moved is None:
            moved = step.select("window", F.col("into").alias("sequence_id"), "shift")
        else:
            again = step.select(F.col("window").alias("sequence_id"), F.col("into"), F.col("shift").alias("more"))
            moved = moved.join(again, "sequence_id", "left").select(
                "window", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        moved = scratch.keep(moved, f"moved-{turn}")
        if groups <= 1:
            return moved
        # Best fit leaves at most one window of a group half full or less, so the rounds shrink by the size of a group.
        left = step.where(F.col("filled") * 2 <= size).groupBy(F.col("into").alias("window")).agg(F.max("filled").alias("used"))
        turn += 1


def word_ids(tokenizer: str, end_id: int) -> Callable[[], Callable[[str | None], bytes]]:
    """Ids of a vocabulary of the tokenizers library with ``end_id`` after them."""
    end = int(end_id).to_bytes(4, "little")

    def start() -> Callable[[str | None], bytes]:
        words = encoder(tokenizer)
        return lambda text: words.encode(text) + end

    return start


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2_048) -> DataFrame:
    """``pack_tokens`` with that vocabulary; null text is an empty one, so its document is the end id alone."""
    return pack_tokens(docs, word_ids(tokenizer, end_id), size)


def padding(pieces: DataFrame, size: int) -> DataFrame:
    """``sequences, ids, padding`` of a packing, the padding as a share of all places."""
    return pieces.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("ids")).withColumn(
        "padding", 1 - F.col("ids") / (F.col("sequences") * np.int64(size).item())
    )
