"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of 2^64 positions; a row lies where the hash of its text falls and belongs to the next point clockwise. Rows
enter in ring order. Shards have capacities that add up to the number of rows and differ by one at most; a row whose shard is full goes on clockwise to
the next shard with room. Rows between two points all try the same shards in the same order, so the count of rows in each such arc decides where
it is cut: the driver walks arcs (shards times ``points`` of them, whatever the number of rows), the rows are only ranked and cut.

Rows of equal text share a position. They stay in one shard unless it fills up among them; at most ``shards`` - 1 cuts come in the whole ring.

Defined results: a null text is empty (one byte of size); rows repeat as they come, in an order of their own; no row is lost; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch

#: Points of a shard on the ring. With 1,024 the arcs of a shard add up to its share within about 3 %.
POINTS = 1_024


def position(text: Column) -> Column:
    """Where a text lies on the ring, as a signed number whose order is clockwise."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Ring:
    """Points in clockwise order and the shard that owns each."""

    at: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(shards: int, points: int = POINTS) -> Ring:
        """A shard's points depend on its number alone, so one more shard only adds points."""
        names = [(int(hashlib.md5(f"{s}:{k}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for k in range(points)]
        at, owner = zip(*sorted(names))
        return Ring(np.array(at, np.int64), np.array(owner, np.int64))

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        """Arc 0 ends at the first point; what lies past the last point is an arc of its own, which belongs to the first point too."""
        return np.searchsorted(self.at, positions)

    def cut(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of ring ranks with a shard each, from the rows in every arc: first ranks, shards, first slots in the shard."""
        n, shards = int(counts.sum()), int(self.owner.max()) + 1
        room = [n // shards + (s < n % shards) for s in range(shards)]
        taken, starts, owners, slots, rank = [0] * shards, [], [], [], 0
        for arc, left in enumerate(counts.tolist()):
            step = arc % len(self.owner)
            while left:
                shard = int(self.owner[step])
                here = min(left, room[shard] - taken[shard])
                if here:
                    starts.append(rank)
                    owners.append(shard)
                    slots.append(taken[shard])
                    taken[shard] += here
                    rank, left = rank + here, left - here
                step = (step + 1) % len(self.owner)
        return np.array(starts, np.int64), np.array(owners, np.int64), np.array(slots, np.int64)


def shard_rows(docs: DataFrame, shards: int = 16, points: int = POINTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row's shard and its place there, without gaps from 0.

    ``size`` is the UTF-8 length of the text plus one, ``text_crc32`` its unsigned checksum. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    scratch, ring = Scratch(spark, "sharding"), Ring.of(shards, points)
    held = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    keys = scratch.keep(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.length(held) + 1).cast("long").alias("size"), F.crc32(held).alias("text_crc32"),
        position(F.col(f"`{text}`")).alias("at"), F.monotonically_increasing_id().alias("tie"),
    ), "keys")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array(ring.arcs(batch.column("at").to_numpy())), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(done, done + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], ["doc_id", "size", "text_crc32", "arc", "part", "place"])
            done += n

    kinds = {f.name: f.dataType.simpleString() for f in keys.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, size long, text_crc32 long, arc long, part long, place long"
    # Ties of position are told apart down to the single row, so copies of one text spread over many ranges.
    around = keys.repartitionByRange("at", "doc_id", "tie").sortWithinPartitions("at", "doc_id", "tie")
    ranked = scratch.keep(around.mapInArrow(numbered, schema), "ranked")
    counts = np.zeros(len(ring.at) + 1, np.int64)
    for arc, n in ranked.groupBy("arc").count().collect():
        counts[arc] = n
    starts, owners, slots = ring.cut(counts)
    parts = ranked.groupBy("part").agg(F.max("place").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.join(parts.select("part", before.alias("before")), "part")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(starts, rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(owners[k].astype(np.int32)), pa.array(slots[k] + rank - starts[k])],
                ["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    ranks = placed.select("doc_id", "size", "text_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranks.mapInArrow(assigned, f"doc_id {kinds['doc_id']}, size long, text_crc32 long, shard int, slot long")
