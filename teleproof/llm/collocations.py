"""Phrase collocations by Rabin-Karp fingerprints.

One scan for each phrase length: numpy prefix polynomials give every n-gram of a chunk of documents its 64-bit fingerprint, chunks send each different
fingerprint once with its count, and the sums tell which can be frequent. Those set the bits of a filter of fixed size. The next scan
looks only at n-grams both of whose parts passed it (a phrase is no more frequent than its parts), and spells out the frequent n-grams of
the length before: every fingerprint of a chunk points to an occurrence there, all others are compared with it against the text, and the text at the
pointer goes out with the count. Counts that decide anything are sums by text, so a collision of fingerprints costs work and changes no result; nor does a
full filter, which only lets more fingerprints be counted.

Defined results: a null text is empty, a null language ``und``; words are cut at spaces and tabs only and keep all other characters; documents repeat as
they come; equal scores go by count, then by the bytes of the phrase; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch
from teleproof.llm.lexical import Numbered

#: Bytes of text taken together in one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: Words hashed at a time.
SLICE_WORDS = 65_536
#: Words up to so many bytes are compared eight bytes at a time, all at once.
LONG_WORD = 64
#: Bits of the filter of frequent fingerprints, as a power of two: 16 MB whatever the input.
FILTER_BITS = 27
#: Parts in which a language is ranked before the last ranking.
SALTS = 64

# Ends of pieces become one character, tabs a space; A-Z are lower-cased.
SPACE, END = b" ", b"."
FOLD = bytes(ord(END) if chr(c) in ".,;:!?\n\v\f\r" else ord(SPACE) if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that powers have inverses modulo 2^64

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least the first ``n`` powers of ``base`` modulo 2^64, kept by each worker."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others: low bits of a polynomial modulo 2^64 depend on low bits only."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefixes(symbols: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of the polynomial: a range has the fingerprint (prefix[end] - prefix[start]) / base^start."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(base, len(symbols))[: len(symbols)], out=out[1:])
    return out


def of_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the words at ``[starts, ends)``, which follow one another in ``text``."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), SLICE_WORDS):
        lo, hi = starts[a : a + SLICE_WORDS], ends[a : a + SLICE_WORDS]
        prefix = prefixes(text[lo[0] : hi[-1]].astype(np.uint64) + np.uint64(1), BYTE_BASE)
        from_here = lo - lo[0]
        out[a : a + SLICE_WORDS] = (prefix[hi - lo[0]] - prefix[from_here]) * powers(inverse(BYTE_BASE), len(prefix))[from_here]
    return mixed(out)


def same_words(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Are the words of ``sizes`` bytes at ``a`` and at ``b`` equal byte by byte? ``text`` goes on for eight bytes after the last word."""
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    out, rest, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while done < LONG_WORD and len(rest := rest[sizes[rest] > done]):
        spare = np.maximum(8 - (sizes[rest] - done), 0).astype(np.uint64) * np.uint64(8)
        out[rest] &= ((eight[a[rest] + done] ^ eight[b[rest] + done]) << spare) == 0
        done += 8
    for k in rest[sizes[rest] > done].tolist():
        out[k] &= bool((text[a[k] : a[k] + sizes[k]] == text[b[k] : b[k] + sizes[k]]).all())
    return out


def grouped(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal fingerprints together, and where groups begin in it.

    The lower bits give way to the index, so that plain numbers are sorted; few groups hold more than one fingerprint.
    """
    bits = np.uint64(max(len(prints) - 1, 1).bit_length())
    keys = ((prints >> bits) << bits) | np.arange(len(prints), dtype=np.uint64)
    keys.sort()
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    high = keys >> bits
    return order, np.append(True, high[1:] != high[:-1])[: len(keys)]


class Chunk:
    """The words of some documents, found and hashed as arrays."""

    def __init__(self) -> None:
        self.langs = Numbered()
        self.texts, self.numbers, self.size = [], [], 0

    def add(self, lang: str, text: bytes | None) -> None:
        self.texts.append((text or b"").translate(FOLD))
        self.numbers.append(self.langs[lang])
        self.size += len(self.texts[-1]) + 1

    def close(self) -> None:
        bounds = np.cumsum([0, *(len(t) + 1 for t in self.texts)])
        self.text = np.frombuffer(END.join([*self.texts, END * 8]), np.uint8)
        self.texts = []
        ended = self.text == END[0]
        inside = ~(ended | (self.text == SPACE[0]))
        edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.cumsum(ended, dtype=np.int32)[self.starts]
        self.lang = np.repeat(np.array(self.numbers, np.int32), np.diff(np.searchsorted(self.starts, bounds)))
        self.lang_names = list(self.langs)
        self.symbols = of_words(self.text, self.starts, self.ends)
        self.prefix = prefixes(self.symbols, WORD_BASE)
        names = [x.encode() for x in self.lang_names]
        ends = np.cumsum([len(x) + 1 for x in names])
        self.seeds = of_words(np.frombuffer(SPACE.join([*names, b""]), np.uint8), ends - [len(x) + 1 for x in names], ends)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams inside pieces start, and their fingerprints, which depend on the language too."""
        n = max(len(self.starts) - size + 1, 0)
        starts = np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])
        prints = (self.prefix[starts + size] - self.prefix[starts]) * powers(inverse(WORD_BASE), n)[starts]
        return starts, mixed(prints + np.uint64(size) * self.seeds[self.lang[starts]])

    def number_words(self) -> None:
        """Equal words get equal numbers (``ids``, the words at ``first``): words of one group are compared with one of them byte by byte."""
        order, new = grouped(self.symbols)
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new) - 1
        self.first = order[new]
        sizes, pointer = self.ends - self.starts, self.first[self.ids]
        if (sizes != sizes[pointer]).any() or not same_words(self.text, self.starts, self.starts[pointer], sizes).all():
            whole = self.text.tobytes()
            words = np.array([whole[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())], object)
            _, self.first, self.ids = np.unique(words, return_index=True, return_inverse=True)

    def texts_of(self, at: np.ndarray, size: int) -> list[bytes]:
        """The phrases of ``size`` words at ``at``, their words joined by single spaces."""
        ids = np.stack([self.ids[at + j] for j in range(size)], axis=1)
        used, where = np.unique(ids, return_inverse=True)
        whole, first = self.text.tobytes(), self.first[used]
        names = [whole[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist())]
        return [SPACE.join([names[i] for i in gram]) for gram in where.reshape(ids.shape).tolist()]

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        return np.logical_and.reduce([self.lang[a] == self.lang[b], *(self.ids[a + j] == self.ids[b + j] for j in range(size))])

    def spelled(self, starts: np.ndarray, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that stand for the different n-grams at ``starts`` and their counts; equal fingerprints are verified against the words."""
        order, new = grouped(prints)
        at = starts[order]
        pointer = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        if not self.same(at, pointer, size).all():
            order = np.lexsort([*(self.ids[at + j] for j in range(size)), self.lang[at]])
            at = at[order]
            new = np.append(True, ~self.same(at[1:], at[:-1], size))[: len(at)]
        first = np.flatnonzero(new)
        return at[first], np.diff(first, append=len(at))


def passed(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slots = prints >> np.uint64(64 - FILTER_BITS)
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


NAMES = ["print", "lang", "words", "phrase", "n"]
SCHEMA = "print long, lang string, words int, phrase string, n long"


def counted(docs: DataFrame, size: int, longest: int, frequent) -> DataFrame:
    """One scan: fingerprints of n-grams of ``size`` words with their counts by chunk, and the frequent ones a word shorter by text.

    ``frequent`` is the broadcast filter of the scan before, none for the first, which counts the words of each language instead.
    """

    def rows(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        chunk.close()
        if frequent is None:
            n = np.bincount(chunk.lang, minlength=len(chunk.lang_names))
            yield pa.record_batch([pa.nulls(len(n), pa.int64()), pa.array(chunk.lang_names), pa.array(np.zeros(len(n), np.int32)), pa.nulls(len(n), pa.string()), pa.array(n)], NAMES)
            starts, prints = chunk.grams(size)
        else:
            chunk.number_words()
            bits = np.frombuffer(frequent.value, np.uint8)
            starts, prints = chunk.grams(size - 1)
            held = passed(bits, prints)
            starts, prints = starts[held], prints[held]
            at, n = chunk.spelled(starts, prints, size - 1)
            for a in range(0, len(at), 65_536):
                some = at[a : a + 65_536]
                langs = [chunk.lang_names[i] for i in chunk.lang[some].tolist()]
                yield pa.record_batch([
                    pa.nulls(len(some), pa.int64()), pa.array(langs, pa.string()), pa.array(np.full(len(some), size - 1, np.int32)),
                    pa.array(chunk.texts_of(some, size - 1), pa.binary()).cast(pa.string()), pa.array(n[a : a + 65_536]),
                ], NAMES)
            if size > longest:
                return
            left = np.zeros(len(chunk.starts) + 1, bool)
            left[starts] = True
            starts, prints = chunk.grams(size)
            both = left[starts] & left[starts + 1]
            prints = prints[both]
        prints, n = np.unique(prints, return_counts=True)
        for a in range(0, len(prints), 65_536):
            some = prints[a : a + 65_536].view(np.int64)
            yield pa.record_batch([
                pa.array(some), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.string()), pa.array(n[a : a + 65_536]),
            ], NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                chunk.add(lang.as_py(), text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    yield from rows(chunk)
                    chunk = Chunk()
        if chunk.size:
            yield from rows(chunk)

    return docs.mapInArrow(scan, SCHEMA)


def filter_of(prints: DataFrame) -> bytes:
    """A bit for each value that the upper ``FILTER_BITS`` bits of some fingerprint have; its size does not depend on their number."""
    slot = F.shiftrightunsigned("print", 64 - FILTER_BITS) + 1
    made = prints.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    width = 4_096
    bits = bytearray(1 << (FILTER_BITS - 3))
    for bucket, some in made.toLocalIterator():
        bits[(bucket - 1) * width : bucket * width] = some
    return bytes(bits)


def phrases(docs: DataFrame, scratch: Scratch, least: int, longest: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times in their language (``lang, words, phrase, f``), and each language's words (``lang, n``)."""
    spark = docs.sparkSession
    asked = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.col(f"`{text}`").cast("binary"))
    frequent, found, totals = None, [], None
    for size in range(1, longest + 2):
        # One shuffle for both kinds of rows, so that a scan leaves nothing but what is frequent. It comes first: chunks have summed what they could.
        keys = ["print", "lang", "words", "phrase"]
        sums = counted(asked, size, longest, frequent).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))
        held = scratch.keep(sums.where((F.col("n") >= least) | (F.col("words") == 0)), f"level-{size}")
        if size == 1:
            totals = held.where("words = 0").select("lang", "n")
        else:
            found.append(held.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("f")))
            frequent.destroy()
        if size <= longest:
            frequent = spark.sparkContext.broadcast(filter_of(held.where("print IS NOT NULL")))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every, totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` strongest phrases of two words and more.

    A phrase of a occurrences, cut into parts of l and r, has the score (2,000,000 a) div (l + r); the lowest cut counts, of equal ones the first.
    Phrases inside a longer one with at least 80 % of their occurrences go.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    every, totals = phrases(docs, scratch, least, longest)
    named = every.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = named.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    left = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn(
        # Decimals of 38 digits: the product may pass 64 bits.
        "score", F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0))) div CAST(l + r AS DECIMAL(20, 0))"),
    )
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = named.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    widest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(widest, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(100 AS DECIMAL(18, 0)) * longer < CAST(80 AS DECIMAL(18, 0)) * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", (F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
