"""Ranked lexical search over posting lists with range-maximum tables.

``build_index`` turns documents into segments: a task inverts the documents it reads, a bounded number of tokens at a time, so the index
needs no shuffle. ``search`` sends the lists of the asked terms to one task for each segment and block of items. There every list gets a sparse
table of range maxima. A document interval is bounded by the sum of the maxima of the item's lists inside it; the interval of the greatest bound is
cut at the document of its greatest impact, which is scored, and the search ends when no interval can reach the k-th score.

Defined results: a null or empty text has no terms and is not counted; an item without a known term has no rows; repeated rows are documents of
their own; equal scores go by ascending ``doc_id``, a null id last; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof.llm.common import Scratch

#: A segment ends when it holds so many tokens or documents.
SEGMENT_TOKENS, SEGMENT_DOCS = 2_000_000, 16_384
#: Items searched by one task in one segment.
BLOCK_ITEMS = 32
#: Intervals opened at a time.
STEP = 64

# ASCII digits and letters and all bytes of other characters belong to terms; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Numbered(dict):
    """Numbers for words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Segment:
    """Documents of one task on their way into posting lists."""

    def __init__(self, number: int) -> None:
        self.number, self.words = number, Numbered()
        self.ids, self.sizes, self.tokens, self.n_tokens = [], [], [], 0

    def add(self, doc_id: pa.Scalar, text: bytes | None) -> None:
        found = terms_of(text)
        if found:
            self.tokens.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
            self.ids.append(doc_id)
            self.sizes.append(len(found))
            self.n_tokens += len(found)

    def full(self) -> bool:
        return self.n_tokens >= SEGMENT_TOKENS or len(self.ids) >= SEGMENT_DOCS

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row for the documents (ids and lengths), then one for each term (documents by position and occurrences)."""
        if not self.ids:
            return
        ids, sizes = pa.array(self.ids, kind), np.array(self.sizes, np.int32)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        keys = np.concatenate(self.tokens).astype(np.int64) * len(ids) + np.repeat(position, sizes)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts, keys = np.diff(first, append=len(keys)).astype(np.int32), keys[first]
        words, places = np.divmod(keys, len(ids))
        starts = np.append(np.flatnonzero(np.diff(words, prepend=-1)), len(words)).astype(np.int32)
        yield pa.record_batch(
            [pa.array([self.number]), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int32())),
             pa.array([sizes[order]], pa.list_(pa.int32())),
             pa.ListArray.from_arrays(pa.array([0, len(ids) - ids.null_count], pa.int32()), ids.take(pa.array(order)))],
            NAMES,
        )
        names, places = list(self.words), places.astype(np.int32)
        for a in range(0, len(names), 16_384):
            b = min(a + 16_384, len(names))
            ends, held = pa.array(starts[a : b + 1] - starts[a]), slice(starts[a], starts[b])
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[held])) for x in (places, counts)]
            yield pa.record_batch(
                [pa.array(np.full(b - a, self.number)), pa.array(names[a:b], pa.binary()), *lists, pa.nulls(b - a, pa.list_(kind))], NAMES
            )


NAMES = ["segment", "term", "positions", "counts", "ids"]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Posting lists: ``segment, term, positions, counts, ids``.

    A term's row holds the positions of its documents in the segment and its occurrences there. The row without a term holds the segment's
    ``ids``, ascending (null ids, which come last, left out), and in ``counts`` the lengths of its documents in terms. Segment numbers are unique in
    one run of the plan: write the table before use.
    """
    kind = docs.schema[doc_id].dataType
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("positions", numbers),
        T.StructField("counts", numbers), T.StructField("ids", T.ArrayType(kind)),
    ])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Segment(TaskContext.get().partitionId() << 33)
        held = pa.int64()
        for batch in batches:
            held = batch.column(0).type
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now.add(one, text)
                if now.full():
                    yield from now.rows(held)
                    now = Segment(now.number + 1)
        yield from now.rows(held)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(invert, schema)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``block, item, item_id, term``: the different terms of each item, items numbered and dealt into blocks. Write the table before use."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("item", T.LongType()),
        T.StructField("item_id", items.schema[item_id].dataType), T.StructField("term", T.BinaryType()),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(item // BLOCK_ITEMS, item, one, t) for t in sorted(set(terms_of(text)))]
                item += 1
            kinds = [pa.int64(), pa.int64(), batch.column(0).type, pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["block", "item", "item_id", "term"])

    return items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(split, schema)


class Lists:
    """The posting lists of some terms in one segment, end to end, each with its sparse table of range maxima."""

    def __init__(self, places: list[np.ndarray], impacts: list[np.ndarray], n_docs: int) -> None:
        self.n_docs = n_docs
        self.place, self.impact = np.concatenate(places).astype(np.int64), np.concatenate(impacts)
        longest = max(map(len, places))
        self.keys = np.repeat(np.arange(len(places), dtype=np.int64) * n_docs, [len(p) for p in places]) + self.place
        # table[k, p]: where the greatest of the 2**k impacts from p on stands; entries over the end of a list are never read.
        self.table = np.zeros((longest.bit_length(), len(self.keys)), np.int32)
        self.table[0] = np.arange(len(self.keys))
        for k in range(1, len(self.table)):
            h = len(self.keys) - (1 << k) + 1
            left, right = self.table[k - 1, :h], self.table[k - 1, (1 << (k - 1)) : (1 << (k - 1)) + h]
            self.table[k, :h] = np.where(self.impact[right] > self.impact[left], right, left)
        self.level = np.frexp(np.arange(longest + 1))[1] - 1

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impacts of the list ranges ``[a, b)`` and where they stand; 0 for an empty range."""
        filled = b > a
        k = self.level[np.where(filled, b - a, 1)]
        x, y = self.table[k, np.where(filled, a, 0)], self.table[k, np.where(filled, b - (1 << k), 0)]
        at = np.where(self.impact[y] > self.impact[x], y, x)
        return np.where(filled, self.impact[at], 0), at

    def best(self, terms: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The ``most`` documents of the highest sums above 0 over ``terms`` as (score, position), equal sums by position."""
        base = terms.astype(np.int64) * self.n_docs
        heap: list[tuple[int, int, int, int]] = []
        found: list[tuple[int, int]] = []

        def alive(bound: int, lo: int) -> bool:
            return bound > 0 and (len(found) < most or (bound, -lo) > found[0])

        def push(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            value, at = self.maxima(a, b)
            bound, strongest = value.sum(axis=1), value.argmax(axis=1)
            cut = self.place[at[np.arange(len(at)), strongest]]
            for entry in zip((-bound).tolist(), lo.tolist(), hi.tolist(), cut.tolist()):
                if alive(-entry[0], entry[1]):
                    heapq.heappush(heap, entry)

        whole = np.array([[0], [self.n_docs]])
        push(*whole, *np.searchsorted(self.keys, base + whole[:, :, None]))
        step = 1
        while heap and alive(-heap[0][0], heap[0][1]):
            opened = []
            while heap and len(opened) < step and alive(-heap[0][0], heap[0][1]):
                opened.append(heapq.heappop(heap))
            _, lo, hi, cut = np.array(opened).T
            a, at, b = np.searchsorted(self.keys, base + np.stack([lo, cut, hi])[:, :, None])
            held = self.keys[np.minimum(at, len(self.keys) - 1)] == base + cut[:, None]
            score = np.where(held, self.impact[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1)
            for one in zip(score.tolist(), (-cut).tolist()):
                if len(found) < most:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)
            push(np.concatenate([lo, cut + 1]), np.concatenate([cut, hi]), np.concatenate([a, at + held]), np.concatenate([at, b]))
            step = min(step * 2, STEP)
        return [(score, -place) for score, place in sorted(found, reverse=True)]


def search(index: DataFrame, terms: DataFrame, scratch: Scratch, most: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``most`` best documents of each item; ``index`` and ``terms`` are written tables.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its impact in a document weight * ((10^9 tf) div (1000 tf + 8 m)) with
    m = 10 + (90 n N) div L: N documents with a term, L their terms, n one document's terms, df and tf as usual.
    """
    held = index.where("term IS NULL").select("segment", "ids", F.col("counts").alias("sizes"))
    total = held.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n_docs, n_terms = total[0] or 0, total[1] or 1
    # Only the lists of asked terms leave the index: one a segment for each block that asks.
    wanted = terms.groupBy("term", "block").agg(F.collect_list("item").alias("items"))
    lists = index.where("term IS NOT NULL").select("segment", "term", "positions", "counts")
    hits = scratch.keep(lists.join(wanted, "term"), "hits")
    spread = hits.groupBy("term", "block").agg(F.sum(F.size("positions")).alias("df"))
    weight = F.expr(f"CAST(floor(1000 * ln((2 * CAST({n_docs} AS DOUBLE) + 2) / (2 * df + 1))) AS BIGINT)").alias("weight")
    weighted = hits.join(spread.select("term", "block", weight), ["term", "block"]).select("segment", "block", "items", "weight", "positions", "counts")
    places = hits.select(F.col("segment").alias("of"), F.col("block").alias("asking")).distinct()
    sides = places.join(held, places["of"] == held["segment"]).select("of", "asking", "ids", "sizes")
    id_kind = held.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_kind), T.StructField("score", T.LongType())])

    def best(found: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(found):
            ids, sizes = side["ids"].iloc[0], np.asarray(side["sizes"].iloc[0], np.int64)
            damp = 8 * (10 + 90 * sizes * n_docs // n_terms)
            places = [np.asarray(p, np.int64) for p in found["positions"]]
            counts = [np.asarray(c, np.int64) for c in found["counts"]]
            impacts = [w * (1_000_000_000 * c // (1000 * c + damp[p])) for w, p, c in zip(found["weight"], places, counts)]
            lists, of_item = Lists(places, impacts, len(sizes)), {}
            for number, items in enumerate(found["items"]):
                for item in items:
                    of_item.setdefault(item, []).append(number)
            rows = [(item, ids[place] if place < len(ids) else None, score) for item, numbers in of_item.items() for score, place in lists.best(np.array(numbers), most)]
        return pd.DataFrame({
            "item": pd.Series([r[0] for r in rows], dtype="int64"), "doc_id": pd.Series([r[1] for r in rows], dtype=object),
            "score": pd.Series([r[2] for r in rows], dtype="int64"),
        })

    found = weighted.groupBy("segment", "block").cogroup(sides.groupBy("of", "asking")).applyInPandas(best, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    named = terms.select("item", "item_id").distinct()
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """Index ``docs`` (``doc_id, text``) and rank them for every row of ``items`` (``item_id, text``)."""
    scratch = Scratch(docs.sparkSession, "lexical")
    index, terms = scratch.keep(build_index(docs), "index"), scratch.keep(item_terms(items), "terms")
    return search(index, terms, scratch, most)
