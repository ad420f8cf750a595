"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A rotation is three rounds of random signs and a Walsh-Hadamard transform. A hash is the coordinate of largest size with its sign;
a table joins ``JOINED`` of them. Every vector enters its own bucket and the next likeliest ones of each table. Pairs that meet in a
bucket are compared in double precision; a pair that meets more than once counts where it meets first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch, components
from teleproof.llm.vectors import bounds, by_length, classes, matrix, runs, takes_part, usable

JOINED, CHOICES = 2, 3
#: Members of a bucket that are compared in one block; fuller buckets are cut into blocks, all pairs of which are compared.
FULL = 1_024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, brought to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers ``[row, table, probe]``, the likeliest first; -1 where short vectors have fewer buckets than probes."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    out = np.full((len(unit), tables, probes), -1, np.int64)
    for table in range(tables):
        cost = np.zeros((len(unit), 1))
        code = np.zeros((len(unit), 1), np.int64)
        for _ in range(JOINED):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :CHOICES]
            top = np.take_along_axis(size, best, 1)
            number = 2 * best + (np.take_along_axis(y, best, 1) < 0)
            lost = (top[:, :1] - top) ** 2
            cost = (cost[:, :, None] + lost[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * (2 * width) + number[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, table, : order.shape[1]] = np.take_along_axis(code, order, 1)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Which pairs of rows with bucket numbers ``a`` and ``b`` meet in no earlier table and in no smaller bucket of this one."""
    early = ((a[:, :table, :, None] == b[:, :table, None, :]) & (a[:, :table, :, None] >= 0)).any(axis=(1, 2, 3))
    here = ((a[:, table, :, None] == b[:, table, None, :]) & (a[:, table, :, None] >= 0)).any(axis=2)
    return ~early & (np.where(here, a[:, table], np.iinfo(np.int64).max).min(axis=1) == bucket)


def links(points: DataFrame, least: float, tables: int, probes: int, seed: int, scratch: Scratch) -> DataFrame:
    """``cid, n_links, root`` per bucket and member with links: copies of its partners, and the smallest member of its group there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_length(batches, 2):
            e = matrix(batch.column(2))
            found = codes(e / np.linalg.norm(e, axis=1, keepdims=True), tables, probes, seed)
            n, each = len(e), tables * probes
            real = found.ravel() >= 0
            row = np.repeat(np.arange(n), each)[real]
            table = np.tile(np.repeat(np.arange(tables), probes), n)[real]
            flat = pa.array(found.reshape(n, -1).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns[:2]), pa.array(table.astype(np.int32)), pa.array(found.ravel()[real].astype(np.int32)),
                 batch.column(2).take(pa.array(row)), flat.take(pa.array(row))],
                ["cid", "copies", "tab", "bucket", "e", "codes"],
            )

    vector = points.schema["e"].dataType.simpleString()
    kind = f"cid long, copies long, tab int, bucket int, e {vector}, codes array<int>"
    dealt = scratch.keep(points.select("cid", "copies", "e").mapInArrow(deal, kind), "dealt")
    size = F.size("e").alias("width")
    full = dealt.groupBy("tab", "bucket", size).agg(F.count("*").alias("n")).where(F.col("n") > FULL)
    full = scratch.keep(full.select("tab", "bucket", "width", F.ceil(F.col("n") / FULL).cast("int").alias("blocks")), "full")
    met = dealt.withColumn("width", F.size("e")).join(full, ["tab", "bucket", "width"], "left")
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    pair = F.xxhash64("tab", "bucket", "width", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(pair.alias("pair"), "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cid", "copies", "tab", "bucket", "e", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "pair"):
            group = group.combine_chunks()
            keys, own, low, high, cid, copies, tab, bucket = (group.column(k).to_numpy() for k in range(8))
            out = []
            for a, b in bounds(keys):
                if b - a < 2:
                    continue
                part = group.slice(a, b - a).combine_chunks()
                e, numbers = matrix(part.column("e").chunk(0)), matrix(part.column("codes").chunk(0)).astype(np.int64).reshape(b - a, tables, probes)
                unit = e / np.linalg.norm(e, axis=1, keepdims=True)
                left = np.flatnonzero(own[a:b] == low[a])
                right = np.flatnonzero(own[a:b] == high[a])
                near = np.argwhere(unit[left] @ unit[right].T >= least)
                i, j = left[near[:, 0]], right[near[:, 1]]
                keep = (i < j) if low[a] == high[a] else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                ids = cid[a:b]
                order = np.argsort(ids, kind="stable")
                rank = np.argsort(order, kind="stable")
                root = rank.copy()
                while True:
                    before = root.copy()
                    np.minimum.at(root, i, before[j])
                    np.minimum.at(root, j, before[i])
                    root = np.minimum(root, root[order[root]])
                    if (root == before).all():
                        break
                links_of = np.zeros(b - a, np.int64)
                for s in range(0, len(i), 65_536):
                    p, q = i[s : s + 65_536], j[s : s + 65_536]
                    new = first_meeting(numbers[p], numbers[q], int(tab[a]), int(bucket[a]))
                    np.add.at(links_of, p[new], copies[a:b][q[new]])
                    np.add.at(links_of, q[new], copies[a:b][p[new]])
                linked = np.flatnonzero((links_of > 0) | (root != rank))
                out.append((ids[linked], links_of[linked], ids[order[root[linked]]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["cid", "n_links", "root"])

    dealt_out = met.repartition("pair").sortWithinPartitions("pair")
    return scratch.keep(dealt_out.mapInArrow(compare, "cid long, n_links long, root long"), "links")


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 8, probes: int = 3, seed: int = 11) -> DataFrame:
    """One row per row of ``vec_id, embedding``: ``vec_id, n_links, component_id, kept``.

    Links join vectors of one length whose cosine in double precision is ``least`` or more, as far as they meet in a bucket. Equal vectors
    always link; they are hashed once and counted by their copies. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without id, link with nothing and stand alone. A component's id is the smallest ``vec_id`` in it. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "near-vectors")
    rows = scratch.keep(usable(vectors), "rows")
    points = scratch.keep(classes(rows), "classes")
    found = links(points, least, tables, probes, seed, scratch)
    counted = found.groupBy("cid").agg(F.sum("n_links").alias("n"))
    joined = components(found.where("cid != root").select("cid", "root"), scratch).withColumnRenamed("node", "cid")
    scratch.free("dealt")
    named = points.join(counted, "cid", "left").join(joined, "cid", "left").select(
        "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")
    )
    named = scratch.keep(named, "named")
    linked = rows.join(named, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~takes_part()).select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
