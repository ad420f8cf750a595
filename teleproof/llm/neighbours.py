"""Approximate nearest neighbours: a neighbour graph built by NN-descent in Spark joins, searched greedily.

The graph starts from vectors that lie together when sorted by random hyperplanes. In every round each vector's neighbours, in both
directions, are introduced to each other: a join brings their vectors together, and whoever is nearer than a known neighbour takes its place.
A query starts at its own place in the graph and goes on, round by round, to the neighbours of the nearest it has not yet visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch
from teleproof.llm.vectors import bounds, classes, runs, usable

TREES, LEAF, PLANES = 8, 128, 12


def stacked(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of vectors of one length as a matrix in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def precision(points: DataFrame) -> str:
    """How components of ``e`` are stored: as they come, float or double."""
    return "<f4" if points.schema["e"].dataType.elementType.simpleString() == "float" else "<f8"


def compact(points: DataFrame) -> DataFrame:
    """``cid, h``: vectors as bytes, unscaled, so that none takes the precision of another."""
    kind = precision(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.asarray(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.binary())], ["cid", "h"])

    return points.select("cid", "e").mapInArrow(run, "cid long, h binary")


def closest(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest ``v`` of each ``u``, ties to the smaller; one shuffle."""
    order = Window.partitionBy("u").orderBy("d", "v")
    alone = edges.repartition("u").dropDuplicates(["u", "v"])
    return alone.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def leaves(short: DataFrame, kind: str, most: int, seed: int) -> DataFrame:
    """First edges ``u, v, d``: vectors in one stretch of ``LEAF`` when sorted by the sides of random hyperplanes they are on."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(1), kind)
            for tree in range(TREES):
                planes = np.random.default_rng([seed, tree]).normal(size=(x.shape[1], PLANES + 1))
                y = x @ planes
                code = (y[:, :PLANES] > 0) @ (1 << np.arange(PLANES)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int32)), pa.array(y[:, PLANES]), *batch.columns], ["tree", "code", "y", "cid", "h"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "tree"):
            cid = group.column("cid").to_numpy()
            h = stacked(group.column("h").combine_chunks(), kind)
            out = []
            for k in range(0, len(cid), LEAF):
                k = max(0, min(k, len(cid) - LEAF))
                ids, x = cid[k : k + LEAF], h[k : k + LEAF]
                d = squares(x, x)
                np.fill_diagonal(d, np.inf)
                best = np.argsort(d, axis=1, kind="stable")[:, : min(most, len(ids) - 1)]
                out.append((np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["u", "v", "d"])

    sorted_ = short.mapInArrow(sides, "tree int, code int, y double, cid long, h binary")
    sorted_ = sorted_.repartitionByRange("tree", "code", "y").sortWithinPartitions("tree", "code", "y", "cid")
    return sorted_.mapInArrow(meet, "u long, v long, d double")


def introduce(batches: Iterator[pa.RecordBatch], kind: str, most: int) -> Iterator[pa.RecordBatch]:
    """Distances among the neighbours of each ``u``, as far as they beat the farthest neighbour that one of the two has."""
    for group in runs(batches, "u"):
        u, v, worst = (group.column(c).to_numpy() for c in ("u", "v", "worst"))
        h = stacked(group.column("h").combine_chunks(), kind)
        out = []
        for a, b in bounds(u):
            if b - a < 2:
                continue
            d = squares(h[a:b], h[a:b])
            np.fill_diagonal(d, np.inf)
            d[d >= worst[a:b, None]] = np.inf
            best = np.argpartition(d, most, axis=1)[:, :most] if b - a > most else np.broadcast_to(np.arange(b - a), d.shape)
            near = np.take_along_axis(d, best, 1)
            i, j = np.nonzero(near < np.inf)
            if len(i):
                out.append((v[a:b][i], v[a:b][best[i, j]], near[i, j].astype(np.float64)))
        if out:
            a, b, d = (np.concatenate(c) for c in zip(*out))
            _, once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (a, b, d)], ["u", "v", "d"])


def graph(short: DataFrame, kind: str, scratch: Scratch, neighbours: int = 20, rounds: int = 6, settle: float = 0.002, seed: int = 3) -> DataFrame:
    """``u, v, d``: the neighbours of each vector of ``cid, h`` after at most ``rounds`` rounds, or when a round shortens the distances by less than
    the share ``settle``. Both directions of a vector are cut to the nearest ``neighbours``, as NN-descent does; the graph is approximate."""
    now = scratch.keep(closest(leaves(short, kind, neighbours // 2, seed), neighbours), "graph-0")
    before = None
    for turn in range(1, rounds + 1):
        total = now.agg(F.sum("d"), F.count("*")).first()
        if not total[1] or (before and before[1] == total[1] and before[0] - total[0] <= settle * before[0]):
            break
        before = total
        worst = now.groupBy("u").agg(F.count("*").alias("n"), F.max("d").alias("far"))
        worst = worst.select(F.col("u").alias("v"), F.when(F.col("n") < neighbours, float("inf")).otherwise(F.col("far")).alias("worst"))
        back = closest(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), neighbours)
        members = now.union(back).select("u", "v").distinct()
        known = short.withColumnRenamed("cid", "v").join(worst, "v", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        met = members.join(known, "v").select("u", "v", "worst", "h").repartition("u").sortWithinPartitions("u")
        offered = met.mapInArrow(lambda batches: introduce(batches, kind, 8), "u long, v long, d double")
        now = scratch.keep(closest(now.union(offered), neighbours), f"graph-{turn}")
        scratch.free(f"graph-{turn - 1}")
    return now


def euclidean(a: Column, b: Column) -> Column:
    apart = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))


def search(points: DataFrame, edges: DataFrame, starts: DataFrame, scratch: Scratch, beam: int = 160, step: int = 24) -> DataFrame:
    """``q, cid, d``: what each query ``q`` of ``starts`` (ids of points) has visited, with exact distances.

    In a round a query visits the neighbours of its ``step`` nearest points not gone on from, among its ``beam`` nearest; it ends when
    there are none.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct().withColumnsRenamed({"u": "cid", "v": "next"})
    both = scratch.keep(both, "both")
    asked = scratch.keep(starts.join(points.select(F.col("cid").alias("q"), F.col("e").alias("qe")), "q"), "asked")
    parts = [scratch.keep(starts.select("q", F.col("q").alias("cid"), F.lit(0.0).alias("d")), "seen-0")]
    order, inside = Window.partitionBy("q").orderBy("d", "cid"), Window.partitionBy("q", "gone").orderBy("d", "cid")
    ahead, turn = parts[0].withColumn("gone", F.lit(False)), 0
    while True:
        turn += 1
        # What is once beyond the beam never comes back into it, so a round needs no more of what was seen than its ids.
        front = ahead.withColumn("place", F.row_number().over(order)).where(F.col("place") <= beam)
        front = front.withColumn("turn", F.row_number().over(inside)).select("q", "cid", "d", "gone", (~F.col("gone") & (F.col("turn") <= step)).alias("now"))
        front = scratch.keep(front, f"front-{turn}")
        scratch.free(f"front-{turn - 1}")
        going = front.where("now").select("q", "cid")
        if going.isEmpty():
            return reduce(DataFrame.union, parts)
        met = going.join(both, "cid").select("q", F.col("next").alias("cid")).distinct()
        met = met.join(reduce(DataFrame.union, parts).select("q", "cid"), ["q", "cid"], "left_anti")
        found = met.join(points.select("cid", "e"), "cid").join(asked, "q").select("q", "cid", euclidean(F.col("e"), F.col("qe")).alias("d"))
        parts.append(scratch.keep(found, f"seen-{turn}"))
        ahead = front.select("q", "cid", "d", (F.col("gone") | F.col("now")).alias("gone")).union(parts[-1].withColumn("gone", F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, most: int = 10, neighbours: int = 20, beam: int = 160) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``most`` nearest rows found for each row of ``vec_id, embedding`` where ``is_query``, itself apart.

    Ties go to the smaller ``vec_id``. All rows that take part (see ``usable``) are indexed: equal vectors once, with their ``most + 1`` smallest ids,
    which are all that a list of ``most`` can hold. Vectors of another length than the most frequent one take no part. Rows that repeat
    an id and vector count once. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.keep(usable(vectors), "rows")
    width = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    rows = rows.where(F.size("e") == (width[0] if width else 0))
    points = scratch.keep(classes(rows).select("d1", "d2", "cid", "e"), "points")
    short = scratch.keep(compact(points), "short")
    edges = graph(short, precision(points), scratch, neighbours)
    named = rows.select("vec_id", "d1", "d2").distinct().join(points.select("d1", "d2", "cid"), ["d1", "d2"])
    by_id = Window.partitionBy("cid").orderBy("vec_id")
    members = named.select("cid", "vec_id").withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most + 1).drop("place")
    asking = scratch.keep(named.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")), "asking")
    visited = search(points, edges, asking.select("q").distinct(), scratch, beam)
    by_distance = Window.partitionBy("q").orderBy("d", "cid")
    top = visited.withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= most + 1)
    # Equal distances beyond the last place: all classes as far as the last one kept stay in.
    last = top.groupBy("q").agg(F.max("d").alias("far"))
    top = visited.join(last, "q").where("d <= far").select("q", "cid", "d")
    found = asking.join(top, "q").join(members, "cid").where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
