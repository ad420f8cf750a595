"""SimHash near-duplicates: fingerprints of word shingles, linked through tables of distances to pivot fingerprints.

The pivots are a base fingerprint and, for each block of bits, ``VARIANTS`` fingerprints that differ from the base inside this
block only. The distance of a fingerprint to such a pivot, less its distance to the base, depends on its bits in that block
alone. Two fingerprints that differ in at most ``k`` bits differ in at most ``k`` blocks, so they have equal differences for all
pivots of at least ``BLOCKS - k`` blocks: equality of these coordinates deals out the candidates. No distance to any pivot may
differ by more than ``k`` between the two, which discards most pairs, and the bits of the rest are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch, components

SEED = 42
BLOCKS, VARIANTS = 5, 8
#: Distinct fingerprints of one bucket that are compared among themselves; fuller buckets go by shared neighbours.
CROWD = 2_048


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles of a text, as often as they come.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; shingles are ``width`` words in a row, joined by a
    space. Fewer words: all of them make one shingle. None, or a null text: no shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[:-width].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (stops[width - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set if over half of the shingle hashes have it set; zero without a shingle."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, bits`` of every whole text; the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, bits long")


def pivots(seed: int = 7) -> tuple[int, list[list[int]]]:
    """The base and, block by block, the fingerprints that differ from it there; as signed longs."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(-(2**63), 2**63 - 1))
    groups = []
    for bits in np.array_split(np.arange(64), BLOCKS):
        flips = [rng.permutation(bits)[: len(bits) // 2] for _ in range(VARIANTS)]
        masks = [np.bitwise_or.reduce(np.uint64(1) << f.astype(np.uint64)).astype(np.uint64) for f in flips]
        groups.append([int((np.uint64(base % 2**64) ^ m).view(np.int64)) for m in masks])
    return base, groups


def distance(bits: Column, other: int) -> Column:
    return F.bit_count(bits.bitwiseXOR(F.lit(other)))


def within_bucket(bits: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """The smallest member of each fingerprint's group inside one bucket, a group being what links join."""
    least = np.arange(len(bits))
    near = np.zeros((len(bits), len(bits)), bool)
    for k in range(len(bits)):
        close = (np.abs(table[k:] - table[k]) <= most).all(axis=1)
        at = np.flatnonzero(close) + k
        at = at[np.bitwise_count(bits[at] ^ bits[k]) <= most]
        near[k, at] = near[at, k] = True
    while True:
        lower = np.where(near, least[None, :], len(bits)).min(axis=1)
        lower = lower[lower]
        if (lower == least).all():
            return least
        least = lower


def links(classes: DataFrame, most: int, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints whose components are those of all links of at most ``most`` bits.

    ``classes`` has the distinct fingerprints as ``bits``. Each bucket emits a member and the smallest of its group there, never all
    pairs. A bucket of more than ``crowd`` fingerprints is not compared: its members are sent to every fingerprint one bit
    away (itself too), where those that meet differ by two bits at most; with ``most`` over 2, to all within half of it.
    """
    base, groups = pivots()
    own = F.col("bits")
    at_base = distance(own, base)
    block = [[distance(own, p) - at_base for p in group] for group in groups]
    keys = [F.xxhash64(F.lit(k), *(c for b in kept for c in block[b])) for k, kept in enumerate(combinations(range(BLOCKS), BLOCKS - most))]
    dealt = classes.select(own, F.explode(F.array(*keys)).alias("key"))
    reference = np.array([base, *(p for group in groups for p in group)], np.int64).view(np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys = rest_bits = np.zeros(0, np.int64)
        for batch in [*batches_and_end(batches)]:
            last = batch is None
            if not last:
                rest_keys = np.concatenate([rest_keys, batch.column(0).to_numpy()])
                rest_bits = np.concatenate([rest_bits, batch.column(1).to_numpy()])
            cuts = np.flatnonzero(np.diff(rest_keys)) + 1
            edges = np.concatenate([[0], cuts, [len(rest_keys)] if last else []]).astype(np.int64)
            sizes = np.diff(edges)
            a, b = [], []
            for k in np.flatnonzero(sizes > 1).tolist():
                bits = np.unique(rest_bits[edges[k] : edges[k + 1]])
                if len(bits) > crowd:
                    a += [bits]
                    b += [None]
                    continue
                raw = bits.view(np.uint64)
                least = within_bucket(raw, np.bitwise_count(raw[:, None] ^ reference[None, :]).astype(np.int16), most)
                moved = np.flatnonzero(least != np.arange(len(bits)))
                a += [bits[moved]]
                b += [bits[least[moved]]]
            if a:
                left = np.concatenate(a)
                none = np.concatenate([np.full(len(x), y is None) for x, y in zip(a, b)])
                right = np.concatenate([x if y is None else y for x, y in zip(a, b)])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=none)], ["a", "b"])
            done = int(edges[-1])
            rest_keys, rest_bits = rest_keys[done:], rest_bits[done:]

    found = dealt.select("key", "bits").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return found


def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def shared_neighbours(crowded: DataFrame, most: int) -> DataFrame:
    """Links of ``bits`` by the fingerprints that two of them are both near to: each with the smallest that meets it there."""
    flips = [0, *(1 << k if k < 63 else -(2**63) for k in range(64))]
    reached = crowded
    for _ in range(-(-most // 2)):
        grown = F.explode(F.array(*(F.col("z").bitwiseXOR(F.lit(f)) for f in flips)))
        reached = reached.withColumn("z", F.coalesce("z", "bits") if "z" in reached.columns else F.col("bits"))
        reached = reached.select("bits", grown.alias("z")).distinct()
    least = reached.groupBy("z").agg(F.min("bits").alias("low"), F.count("*").alias("n")).where("n > 1")
    pairs = reached.join(least, "z").where("bits != low").select(F.col("bits").alias("a"), F.col("low").alias("b")).distinct()
    return pairs


def grouped(made: DataFrame, scratch: Scratch, most: int, crowd: int) -> DataFrame:
    """``bits, first_doc, component`` for every fingerprint of ``doc_id, bits``; the component is the smallest fingerprint that links reach."""
    classes = scratch.keep(made.groupBy("bits").agg(F.min("doc_id").alias("first_doc")), "classes")
    found = scratch.keep(links(classes, most, crowd), "links")
    pairs = found.where("b IS NOT NULL")
    crowded = found.where("b IS NULL").select(F.col("a").alias("bits")).distinct()
    if not crowded.isEmpty():
        pairs = pairs.union(shared_neighbours(crowded, most))
    joined = components(pairs, scratch)
    groups = classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first_doc", F.coalesce("component", "bits").alias("component")
    )
    return scratch.keep(groups, "groups")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, crowd: int = CROWD) -> DataFrame:
    """``doc_id, bits, component_id`` for every row of ``docs``; ``component_id`` is the smallest ``doc_id`` that links reach.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat share a class, whose members are never
    paired. A component of rows without ``doc_id`` has a null id. Only columns ``doc_id`` and ``text`` are read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.keep(fingerprints(docs, width), "fingerprints")
    groups = grouped(made, scratch, most, crowd)
    first = groups.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = scratch.keep(groups.join(first, "component").select("bits", "component_id"), "named")
    return made.join(named, "bits").select("doc_id", "bits", "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with hashes ``_d1, _d2`` of whole rows; those of equal rows are equal, and of others in effect never."""
    whole = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return docs.withColumns({"_d1": F.xxhash64(*whole), "_d2": F.xxhash64(F.lit(1), *whole)})


def first_rows(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The row of ``docs`` that comes first in each ``component`` of ``rows`` (``doc_id, d1, d2, component``), one if it repeats.

    Smaller ids come first, rows without one last, then smaller hashes. The minimum of a group is made before the shuffle.
    """
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d1", "d2")).alias("x"))
    kept = scratch.keep(first.select(F.col("x.d1").alias("_d1"), F.col("x.d2").alias("_d2")), "kept")
    return row_keys(docs).join(kept, ["_d1", "_d2"], "left_semi").dropDuplicates(["_d1", "_d2"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_per_group(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """``docs`` with one row of each component among those with an id: that of the smallest ``doc_id``; of rows that share it, the one of the smallest hash.

    Rows without ``doc_id`` cannot be named and stay.
    """
    scratch = Scratch(docs.sparkSession, "one-per-group")
    named = row_keys(docs.where("doc_id IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), width) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits)], ["doc_id", "d1", "d2", "bits"])

    wanted = named.select(F.col("doc_id").cast("long").alias("doc_id"), "_d1", "_d2", F.col("text").cast("string").alias("text"))
    made = scratch.keep(wanted.mapInArrow(run, "doc_id long, d1 long, d2 long, bits long"), "fingerprints")
    unnamed = docs.where("doc_id IS NULL")
    both = made.select("doc_id", "bits").union(fingerprints(unnamed, width))
    groups = grouped(both, scratch, most, CROWD)
    return first_rows(docs, made.join(groups.select("bits", "component"), "bits"), scratch).union(unnamed)
