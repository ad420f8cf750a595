"""Removal of every byte that lies in a string of ``LENGTH`` bytes which starts anywhere else too.

Where could two equal windows of ``length`` bytes be? Of all runs of ``gram`` bytes in a window the one with the smallest hash is its anchor;
equal windows have equal anchors at equal places. So windows are dealt by the hash of their anchor, and anchors that come once are
done. Neighbouring windows with one anchor form a context, kept once with the number of its copies.

Each shard orders its contexts by external induced sorting. Suffix tuples (group, text from the anchor on) go through a priority
queue that spills sorted runs to disk; this is the base of the recursion, one level deep because no comparison is longer than a window. From the suffixes at
anchors those one byte further left are induced, again and again: sorted by group, new byte and old rank, the common-prefix values carried
along as minima over what lay between. A window is repeated if its suffix shares ``length`` bytes with that of another text
or if its own text has copies.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch

LENGTH, GRAM = 400, 200
PIECE = 1 << 18  # windows looked at together; a task holds some hundred bytes for each
#: Different contexts of one anchor that are sorted in one task; more are dealt again by the bytes of shorter window runs.
CROWD = 200
BLOCK = 16
BASE = 0x9E3779B97F4A7C15
CONTEXT = "key long, c1 long, c2 long, weight long, right long, windows long, crowded boolean, body binary"


def anchored(pieces: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """For each piece: hash of the anchor, first window, number of windows and distance of the anchor from the first window."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(pieces) else 0
    windows = n - length + 1
    if windows < 1:
        return [none for _ in pieces]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    powers = np.full(n + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[n:0:-1], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * powers[: n - gram + 1] * np.uint64(pow(BASE, -n, 2**64))
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = length - gram + 1
    padded = np.concatenate([ranked, np.full(-len(ranked) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    behind = np.minimum.accumulate(padded, axis=1).ravel()[span - 1 : span - 1 + windows]
    at = (np.minimum(ahead, behind) & low).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:windows]
    inside = np.arange(windows) + length <= ends[piece]
    change = np.ones(windows, bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, windows))
    good = inside[first]
    first, count = first[good], count[good]
    anchor, owner = at[first], piece[first]
    key = hashes[anchor].view(np.int64)
    start = ends[owner] - sizes[owner]
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [(key[a:b], first[a:b] - start[a:b], count[a:b], anchor[a:b] - first[a:b]) for a, b in zip(cuts, cuts[1:])]


def identified(docs: DataFrame) -> DataFrame:
    """``d1, d2`` stand for what ``doc_id`` and ``text`` hold together; rows that repeat share them."""
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id")
    return docs.select(F.xxhash64(doc, text).alias("d1"), F.xxhash64(text, doc, F.lit(1)).alias("d2"), text.cast("binary").alias("body"))


def occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Every context of every document: where it is and 128 bits of hash for its bytes."""
    names = ["d1", "d2", "key", "c1", "c2", "start", "windows", "right"]

    def emit(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names]
        for (d1, d2, offset, body), (key, first, count, right) in zip(held, anchored([h[3] for h in held], length, gram)):
            hashes = [xxhash.xxh3_128_digest(body[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist())]
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            for column, value in zip(columns, (np.full(len(key), d1), np.full(len(key), d2), key, both[:, 0], both[:, 1], first + offset, count, right)):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for d1, d2, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = body.as_py()
                for offset in range(0, max(len(body) - length + 1, 0), PIECE):
                    piece = body[offset : offset + PIECE + length - 1]
                    if size + len(piece) > 2 * PIECE:
                        yield emit(held)
                        held, size = [], 0
                    held.append((d1, d2, offset, piece))
                    size += len(piece)
        if held:
            yield emit(held)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


class DiskQueue:
    """A priority queue of fixed-size records ordered by their bytes; beyond ``limit`` bytes it spills sorted runs to disk."""

    def __init__(self, width: int, limit: int = 48 << 20) -> None:
        self.width, self.limit, self.held, self.size = width, limit, [], 0
        self.folder, self.runs = tempfile.TemporaryDirectory(), []

    def push(self, records: np.ndarray) -> None:
        """``records``: rows of ``width`` bytes."""
        self.held.append(records)
        self.size += records.nbytes
        if self.size > self.limit:
            self.spill()

    def sorted(self, records: np.ndarray) -> np.ndarray:
        order = np.argsort(np.ascontiguousarray(records).view(f"S{self.width}").ravel(), kind="stable")
        return records[order]

    def spill(self) -> None:
        path = f"{self.folder.name}/{len(self.runs)}"
        self.sorted(np.concatenate(self.held)).tofile(path)
        self.runs.append(path)
        self.held, self.size = [], 0

    def pop_all(self) -> Iterator[np.ndarray]:
        """All records in order, block by block; equal bytes do not straddle blocks only if they fit one."""
        if not self.runs:
            if self.held:
                yield self.sorted(np.concatenate(self.held))
            return
        if self.held:
            self.spill()
        block = max(1, self.limit // (len(self.runs) + 1) // self.width)
        files = [np.memmap(p, np.uint8, "r").reshape(-1, self.width) for p in self.runs]
        places, loaded = [0] * len(files), [f[:0] for f in files]
        while True:
            for k, f in enumerate(files):
                if not len(loaded[k]) and places[k] < len(f):
                    loaded[k] = np.array(f[places[k] : places[k] + block])
                    places[k] += len(loaded[k])
            tails = [x[-1].tobytes() for k, x in enumerate(loaded) if len(x) and places[k] < len(files[k])]
            if not any(map(len, loaded)):
                return
            bound = min(tails, default=None)
            taken = []
            for k, x in enumerate(loaded):
                cut = len(x) if bound is None else int(np.searchsorted(x.view(f"S{self.width}").ravel(), np.array([bound], f"S{self.width}"), "right")[0])
                taken.append(x[:cut])
                loaded[k] = x[cut:]
            yield self.sorted(np.concatenate(taken))

    def close(self) -> None:
        self.folder.cleanup()


def induce(group: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """From suffixes at anchors to those further left: for each distance, the rows whose window there is repeated.

    Rows come in order of ``group`` and ``right`` (the bytes from the anchor on). ``left[:, o - 1]`` is the byte ``o`` before the anchor; a row
    has windows at distances ``low`` to ``high``.
    """
    common = np.where((right[1:] != right[:-1]).any(axis=1), (right[1:] != right[:-1]).argmax(axis=1), right.shape[1])
    row = np.arange(len(group))  # suffix tuples in order: row, group, common prefix with the one before
    part = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    prefix = np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])
    for o in range(int(high.max(initial=-1)) + 1):
        stay = high[row] >= o
        if o:
            size = np.bincount(part)
            stay &= (size[part] > 1) | (weight[row] > 1)
        if not stay.all():
            row, part, prefix = row[stay], part[stay], lowered(prefix, np.flatnonzero(stay), part)
        if not len(row):
            return
        if o:
            new = left[row, o - 1]
            order = np.lexsort((new, part)) if len(row) else row
            prefix = between(prefix, order, part, new)
            row, part, new = row[order], part[order], new[order]
            start = np.concatenate([[True], (part[1:] != part[:-1]) | (new[1:] != new[:-1])])
            part = np.cumsum(start) - 1
        alone = prefix < length - o
        run = np.cumsum(alone) - 1
        valid = low[row] <= o
        copies = np.bincount(run, weight[row] * valid)
        found = row[valid & (copies[run] > 1)]
        if len(found):
            yield o, found


def minima(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest value of ``prefix`` from ``first + 1`` up to ``last``, for ``first < last``."""
    ends = np.append(prefix, prefix.dtype.type(0))
    return np.minimum.reduceat(ends, np.stack([first + 1, last + 1], axis=1).ravel())[::2]


def lowered(prefix: np.ndarray, kept: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Common prefixes after rows between have left; the first of a part has none."""
    out = np.full(len(kept), -1)
    if len(kept) > 1:
        out[1:] = np.where(part[kept[1:]] == part[kept[:-1]], minima(prefix, kept[:-1], kept[1:]), -1)
    return out


def between(prefix: np.ndarray, order: np.ndarray, part: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in the new order, where both have the same part and new byte."""
    out = np.full(len(order), -1)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = np.flatnonzero((part[a] == part[b]) & (new[a] == new[b]))
        if len(same):
            out[same + 1] = minima(prefix, a[same], b[same])
    return out


def sort_shard(batches: Iterator[pa.RecordBatch], length: int, gram: int, limit: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """Contexts of a shard in any order to the runs of repeated windows in them: ``c1, c2, low, high``, counted from the first window."""
    reach = length - gram
    head = 8 + length  # what the queue orders by, then c1, c2, weight, right, windows and the bytes before the anchor
    width = head + 40 + reach
    queue = DiskQueue(width, limit)
    for batch in batches:
        rows = np.zeros((batch.num_rows, width), np.uint8)
        key, c1, c2, weight, right, windows = (batch.column(k).to_numpy() for k in range(6))
        rows[:, :8] = key.astype(">i8").view(np.uint8).reshape(-1, 8)
        rows[:, head : head + 40] = np.stack([c1, c2, weight, right, windows], axis=1).astype("<i8").view(np.uint8).reshape(-1, 40)
        for k, (body, a) in enumerate(zip(batch.column(7), right.tolist())):
            data = np.frombuffer(body.as_buffer(), np.uint8)
            after = data[a : a + length]
            rows[k, 8 : 8 + len(after)] = after
            rows[k, head + 40 : head + 40 + a] = data[:a][::-1]
        queue.push(rows)
    rest = np.zeros((0, width), np.uint8)
    for block in queue.pop_all():
        block = np.concatenate([rest, block])
        keys = np.ascontiguousarray(block[:, :8]).view(">i8").ravel()
        cut = int(np.flatnonzero(keys == keys[-1])[0])  # the last group may go on in the next block
        yield from sort_block(block[:cut], head, length)
        rest = block[cut:]
    yield from sort_block(rest, head, length)
    queue.close()


def sort_block(rows: np.ndarray, head: int, length: int, step: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Whole groups, in portions of about ``step`` rows."""
    if not len(rows):
        return
    keys = np.ascontiguousarray(rows[:, :8]).view(">i8").ravel()
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    begin = 0
    while begin < len(keys):
        end = int(bounds[max(np.searchsorted(bounds, begin + step, "right") - 1, np.searchsorted(bounds, begin, "right"))])
        part, group = rows[begin:end], keys[begin:end]
        numbers = np.ascontiguousarray(part[:, head : head + 40]).view("<i8")
        c1, c2, weight, right, windows = numbers.T
        # A text that came twice, because its document did, stands once.
        fresh = np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (group[1:] != group[:-1])])
        part, group, numbers = part[fresh], group[fresh], numbers[fresh]
        c1, c2, weight, right, windows = numbers.T
        seen_o, seen_row = [], []
        for o, found in induce(group, part[:, 8:head], part[:, head + 40 :], right - windows + 1, right, weight, length):
            seen_o.append(np.full(len(found), o))
            seen_row.append(found)
        if seen_o:
            o, row = np.concatenate(seen_o), np.concatenate(seen_row)
            at = right[row] - o
            order = np.lexsort((at, row))
            at, row = at[order], row[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[row[first]], c2[row[first]], at[first], at[last])], ["c1", "c2", "low", "high"])
        begin = end


def split_runs(contexts: DataFrame, block: int, length: int) -> DataFrame:
    """Contexts dealt again: their windows by blocks of equal distance to the anchor, keyed by the bytes that all windows of a block share."""
    names = ["k1", "k2", "b1", "b2", "c1", "c2", "weight", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            key, c1, c2, weight, right, windows = (batch.column(k).to_pylist() for k in range(6))
            lows = batch.column(8).to_pylist() if batch.num_columns > 8 else [0] * batch.num_rows
            highs = batch.column(9).to_pylist() if batch.num_columns > 8 else [n - 1 for n in windows]
            for k, body in enumerate(batch.column(7)):
                body, a = body.as_py(), right[k]
                at = lows[k]
                while at <= highs[k]:
                    near = (a - at) // block * block  # distances near .. near + block - 1
                    last = min(a - near, highs[k])
                    core = body[max(0, a - near) : a - (near + block - 1) + length]
                    hashed = np.frombuffer(xxhash.xxh3_128_digest(core + near.to_bytes(4, "little") + key[k].to_bytes(8, "little", signed=True)), "<i8")
                    whole = np.frombuffer(xxhash.xxh3_128_digest(body[at : last + length]), "<i8")
                    rows.append((*hashed.tolist(), *whole.tolist(), c1[k], c2[k], weight[k], at, last))
                    at = last + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return contexts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def crowded_marks(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated windows of contexts whose anchor has too many different ones, as ``c1, c2, low, high``.

    Blocks of windows whose shared bytes come once are done. Where all texts of a block are equal its windows are repeated. Other blocks are
    taken window by window, equal windows being counted before they are shuffled.
    """
    def judged(parts: DataFrame, name: str) -> DataFrame:
        parts = scratch.keep(parts.dropDuplicates(["c1", "c2", "low"]), name)
        whole = parts.groupBy("k1", "k2").agg(
            F.sum("weight").alias("copies"), (F.min(F.struct("b1", "b2")) != F.max(F.struct("b1", "b2"))).alias("mixed")
        ).where("copies > 1")
        whole = scratch.keep(whole, f"{name}-shared")
        return parts.join(whole, ["k1", "k2"]).select("c1", "c2", "low", "high", "mixed")

    blocks = scratch.keep(judged(split_runs(contexts, BLOCK, length), "parts"), "blocks")
    mixed = blocks.where("mixed").select("c1", "c2", "low", "high")
    mixed = mixed.groupBy("c1", "c2").agg(F.collect_list(F.struct("low", "high")).alias("runs"))  # as many as a context has blocks
    again = contexts.dropDuplicates(["c1", "c2"]).join(mixed, ["c1", "c2"]).select(*contexts.columns, F.explode("runs").alias("run"))
    again = again.select(*contexts.columns, "run.low", "run.high")
    single = judged(split_runs(again, 1, length), "windows")
    return blocks.where("NOT mixed").select("c1", "c2", "low", "high").union(single.select("c1", "c2", "low", "high"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, memory: int = 48 << 20) -> DataFrame:
    """``d1, d2, spans``: for each document (see ``identified``) that holds repeated strings, the byte runs they cover, as found."""
    texts = identified(docs)
    found = scratch.keep(occurrences(texts, length, gram), "occurrences")
    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    twice = scratch.keep(twice, "twice")  # written, so that a join with a hot key can be split
    found = scratch.keep(found.join(twice, "key"), "candidates")
    scratch.free("occurrences", "twice")
    place = F.struct("d1", "d2", "start")
    once = found.groupBy("key", "c1", "c2", "right", "windows").agg(F.count("*").alias("weight"), F.min(place).alias("at"))
    once = scratch.keep(once, "once")
    crowds = once.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") > crowd).alias("crowded"))
    crowds = scratch.keep(crowds, "crowds")
    wanted = once.join(crowds, "key").select(
        "at.d1", "at.d2", F.struct("key", "c1", "c2", "weight", "right", "windows", "crowded", F.col("at.start").alias("start")).alias("wanted")
    )
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_list("wanted").alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, wanted in zip(batch.column(0), batch.column(1)):
                body, rows = body.as_py(), wanted.as_py()
                columns = [[r[c] for r in rows] for c in ("key", "c1", "c2", "weight", "right", "windows", "crowded")]
                bodies = [body[r["start"] : r["start"] + r["windows"] + length - 1] for r in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(bodies, pa.binary())], [c.split()[0] for c in CONTEXT.split(", ")])

    contexts = texts.join(wanted, ["d1", "d2"]).select("body", "wanted").mapInArrow(cut, CONTEXT)
    contexts = scratch.keep(contexts, "contexts")
    scratch.free("once", "crowds")
    shards = contexts.where("NOT crowded").repartition("key")
    marks = shards.mapInArrow(lambda batches: sort_shard(batches, length, gram, memory), "c1 long, c2 long, low long, high long")
    marks = scratch.keep(marks, "marks")
    crowded = contexts.where("crowded")
    if not crowded.isEmpty():
        marks = marks.union(scratch.keep(crowded_marks(crowded, length, scratch), "crowded-marks"))
    # The windows of a context start less than ``length`` bytes apart, so what they cover is one run: an occurrence meets one row.
    marks = scratch.keep(marks.groupBy("c1", "c2").agg(F.min("low").alias("low"), F.max("high").alias("high")), "runs")
    spans = found.join(marks, ["c1", "c2"]).select(
        "d1", "d2", F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + length).alias("b")).alias("span")
    )
    spans = scratch.keep(spans.groupBy("d1", "d2").agg(F.collect_set("span").alias("spans")), "spans")
    scratch.free("candidates", "contexts", "marks", "crowded-marks", "runs", "parts", "blocks", "windows")
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    return b"".join([*kept, body[at:]])


def whole_letters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same runs without the parts of letters that they cut."""
    inner = []
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            inner.append((a, b))
    return inner


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, memory: int = 48 << 20) -> DataFrame:
    """``docs`` with ``text`` less its repeated bytes, and ``kept`` (the remaining bytes), ``n_bytes, n_removed, spans``.

    A byte goes if a string of ``length`` bytes that covers it starts at another place in any document or in its own; strings are judged on the
    input. ``text`` keeps letters that a run cuts, ``kept`` and ``spans`` are exact. Null and empty text: empty, nothing removed, and
    ``text`` stays as it is. Rows that repeat are each other's copies. Other columns pass through; columns of the new names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, scratch, length, length // 2, crowd, memory)
    new = ["kept", "n_bytes", "n_removed", "spans"]
    base = docs.drop(*new)
    hidden = ["_d1", "_d2"]
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id")
    keyed = base.withColumns({"_d1": F.xxhash64(doc, text), "_d2": F.xxhash64(text, doc, F.lit(1))})
    joined = keyed.join(spans.withColumnsRenamed({"d1": "_d1", "d2": "_d2"}), hidden, "left").select(*base.columns, "spans")
    place, names = base.columns.index("text"), [*base.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, sizes, gone, runs = [], [], [], [], []
            for text, found in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                text, found = text.as_py(), found.as_py()
                body = (text or "").encode("utf-8", "surrogatepass")
                cut = merged([(s["a"], s["b"]) for s in found or []])
                left = without(body, cut)
                texts.append(text if not cut else without(body, whole_letters(body, cut)).decode("utf-8", "surrogatepass"))
                kept.append(left)
                sizes.append(len(body))
                gone.append(len(body) - len(left))
                runs.append([{"a": a, "b": b} for a, b in cut])
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            columns += [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in base.schema]
    return joined.mapInArrow(run, ", ".join([*fields, "kept binary, n_bytes long, n_removed long, spans array<struct<a: long, b: long>>"]))


def sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
