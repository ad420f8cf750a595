"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Each word is a number whose high bits rank it by rarity and whose low bits are a hash, so sorted numbers are
words in order of rarity. Lines that could reach the wanted Jaccard share one of the rarest words of each (prefix filter); a pair is looked at
only if its lengths, the places of the shared word (positional filter) and a parity bitmap of the words allow enough overlap, and then its
word sets are compared. Lines with an ordinary word meet there directly. Where a word is crowded, every line first meets the earliest one that
has it; only lines without a match meet all earlier ones, so a large group of near copies is not paired with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch

RANK_BITS = 16
#: High bits of a word's number by which lines meet; words that agree in these only cost a comparison.
KEY_BITS = 31
#: Lines with one rare word that meet each other directly.
CROWD = 128
#: White space inside a line, as in a regular expression.
SPACE = r" \t\x0B\f\r"


def parts(text: Column, also: str = "") -> Column:
    """A text split at white space, and at the character ``also``; some parts may be empty. Splitting at one blank needs no regular expression."""
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"))
    plain = F.replace(text, F.lit(also), F.lit(" ")) if also else text
    return F.when(odd, F.split(text, f"[{SPACE}{also}]+")).otherwise(F.split(plain, " "))


def words(line: Column) -> Column:
    """The different words of a line, as hashes; words end at spaces, tabs and other ASCII white space."""
    return F.array_distinct(F.array_remove(F.transform(parts(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit((1 << RANK_BITS) - 1))


def rarity(texts: DataFrame) -> Column:
    """For each of 2^16 hash buckets of words its rank by how often its words come in all lines, in the high bits; an array constant of that size."""
    counted = texts.select(F.explode(parts(F.col("text"), "\n")).alias("word")).where("word != ''")
    counted = counted.groupBy(bucket(F.xxhash64("word")).alias("bucket")).count().orderBy("count", "bucket").select("bucket")
    order = [r.bucket for r in counted.collect()]  # at most 2^16 rows
    rank = [0] * (1 << RANK_BITS)
    for k, b in enumerate(order):
        rank[b] = k << (63 - RANK_BITS)
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<long>")


def ordered(line: Column, rank: Column) -> Column:
    """The words of a line as numbers, the rarest first."""
    return F.sort_array(F.transform(words(line), lambda w: rank[bucket(w)].bitwiseOR(F.shiftrightunsigned(w, RANK_BITS + 1))))


def bitmap(numbers: Column) -> Column:
    """64 parities; two sets that differ in d words differ in at most d of them."""
    one = F.lit(1).cast("long")
    bit = lambda w: F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w)))


def least_overlap(sizes: Column, least: float) -> Column:
    return F.ceil(sizes * (least / (1 + least)) - F.lit(1e-9))


def meets(later: DataFrame, earlier: DataFrame, least: float) -> DataFrame:
    """Candidate pairs ``a, b``, ``a`` the later, of postings with one word that pass all filters.

    Both sides are asked for the same columns and no filter looks at one side alone, so that a table meets itself out of one shuffle.
    """
    x, y = later.alias("x"), earlier.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    overlap = least_overlap(sizes, least)
    reach = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    fits = (F.col("y.seq") < F.col("x.seq")) & (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - F.lit(1e-9)) & (reach >= overlap)
    fits = fits & (F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= sizes - 2 * overlap)
    return x.join(y, (F.col("x.word") == F.col("y.word")) & fits).select(F.col("x.seq").alias("a"), F.col("y.seq").alias("b")).distinct()


def plausible(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs whose rare words allow enough overlap: up to the last rare word that both lines reach, all words of both are known."""
    side = lambda t: known.select(F.col("seq").alias(t), F.col("n").alias(f"n_{t}"), F.col("rare").alias(f"rare_{t}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.col("n_a") + F.col("n_b")
    last = F.least(F.element_at("rare_a", -1), F.element_at("rare_b", -1))
    # Keys can be shared by different words, also within a line, so only keys that the other line lacks are counted, and not the last one.
    lacking = lambda these, those: F.size(F.array_except(F.filter(these, lambda w: w < last), those))
    return both.where(lacking("rare_a", "rare_b") + lacking("rare_b", "rare_a") <= sizes - 2 * least_overlap(sizes, least)).select("a", "b")


def matched(pairs: DataFrame, classes: DataFrame, texts: DataFrame, rank: Column, least: float, scratch: Scratch, name: str) -> DataFrame:
    """``seq`` of the later lines of pairs whose Jaccard is at least ``least``; the word sets are read again from the texts, each text once."""
    known = classes.select("seq", "at", "n", "rare").join(pairs.select(F.explode(F.array("a", "b")).alias("seq")).distinct(), "seq")
    known = scratch.keep(known, f"known-{name}")
    pairs = scratch.keep(plausible(pairs, known, least), f"plausible-{name}")
    asked = known.select("seq", "at").join(pairs.select(F.explode(F.array("a", "b")).alias("seq")).distinct(), "seq")
    asked = asked.groupBy("at.d1", "at.d2").agg(F.collect_list(F.struct("at.pos", "seq")).alias("asked"))
    asked = scratch.keep(asked, f"asked-{name}")  # written, so that its size is known
    scratch.free(f"known-{name}")
    found = texts.select("d1", "d2", "text").join(asked, ["d1", "d2"]).select(F.split("text", "\n").alias("lines"), F.explode("asked").alias("asked"))
    sets = found.select("asked.seq", F.col("lines")[F.col("asked.pos")].alias("line"))
    sets = sets.select("seq", ordered(F.col("line"), rank).alias("words")).dropDuplicates(["seq"])
    sets = scratch.keep(sets, f"sets-{name}")
    scratch.free(f"asked-{name}")
    side = lambda t: sets.select(F.col("seq").alias(t), F.col("words").alias(f"words_{t}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = both.where(common / (F.size("words_a") + F.size("words_b") - common) >= least)
    done = scratch.keep(alike.select(F.col("a").alias("seq")).distinct(), f"done-{name}")
    scratch.free(f"sets-{name}", f"plausible-{name}")
    return done


def similar(classes: DataFrame, texts: DataFrame, rank: Column, least: float, scratch: Scratch) -> DataFrame:
    """``seq`` of the classes with an earlier one whose Jaccard is at least ``least``."""
    postings = classes.select("seq", "n", "bits", F.posexplode("rare").alias("p", "word"))
    crowded = scratch.keep(postings.groupBy("word").count().where(F.col("count") > CROWD).select("word"), "crowded")
    scratch.free()
    if crowded.isEmpty():
        pairs = scratch.keep(meets(postings, postings, least), "pairs-first")
        scratch.free()
        return matched(pairs, classes, texts, rank, least, scratch, "first")
    rest = postings.join(crowded, "word", "left_anti")
    pairs = scratch.keep(meets(rest, rest, least), "pairs-ordinary")
    scratch.free()
    crowd = scratch.keep(postings.join(crowded, "word"), "crowd")
    # The place of the word in the earliest line is left open, which only weakens the filter.
    earliest = crowd.groupBy("word").agg(F.min(F.struct("seq", "n", "bits")).alias("y")).select("word", "y.*", F.lit(0).alias("p"))
    pairs = scratch.keep(pairs.union(meets(crowd, earliest, least)), "pairs-first")
    scratch.free("pairs-ordinary", "crowded")
    done = matched(pairs, classes, texts, rank, least, scratch, "first")
    pairs = scratch.keep(meets(crowd.join(done, "seq", "left_anti"), crowd, least), "pairs-rest")
    scratch.free("crowd", "pairs-first")
    return done.union(matched(pairs, classes, texts, rank, least, scratch, "rest")).distinct()


def repeated_lines(docs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``d1, d2, gone``: for documents with lines to remove, the places of these lines."""
    text = F.col("text").cast("string")
    texts = docs.where(text.isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("d1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("d2")
    )
    rank = rarity(texts)
    line = texts.select("doc_id", "d1", "d2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Words are made once: a filter on them would be pushed below the projection and make them again.
    line = line.where(F.col("line").rlike(f"[^{SPACE}]"))
    at = F.struct("doc_id", "pos", "d1", "d2").alias("at")
    line = line.select(at, ordered(F.col("line"), rank).alias("words"))
    n = F.size("words")
    shown = n - F.ceil(n * least - F.lit(1e-9)).cast("int") + 1
    rare = F.transform(F.slice("words", 1, shown), lambda w: F.shiftright(w, 63 - KEY_BITS).cast("int"))
    line = line.select("at", F.xxhash64("words").alias("cid"), n.alias("n"), bitmap(F.col("words")).alias("bits"), rare.alias("rare"))
    line = scratch.keep(line, "lines")
    # Lines with the same words have the same n, bits and rare words.
    same = [F.first(c).alias(c) for c in ("n", "bits", "rare")]
    classes = line.groupBy("cid").agg(F.min("at").alias("at"), F.count("*").alias("copies"), *same)
    order = ["at.doc_id", "at.pos", "at.d1", "at.d2", "cid"]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order)
    # In this order the number is larger for a later line; it stands for the line from here on.
    classes = scratch.keep(classes.withColumn("seq", F.monotonically_increasing_id()), "classes")
    line = scratch.keep(line.select("at", "cid"), "places")
    scratch.free("lines")
    gone = similar(classes, texts, rank, least, scratch).withColumn("similar", F.lit(True))
    judged = classes.select("seq", "cid", "at", "copies").join(gone, "seq", "left").where("copies > 1 OR similar")
    judged = judged.select("cid", F.col("at").alias("kept"), F.coalesce("similar", F.lit(False)).alias("similar"))
    judged = scratch.keep(judged, "judged")
    scratch.free("classes")
    removed = line.join(judged, "cid").where(F.col("similar") | ~F.col("at").eqNullSafe(F.col("kept")))
    removed = removed.groupBy("at.d1", "at.d2").agg(F.sort_array(F.collect_set("at.pos")).alias("gone"))
    removed = scratch.keep(removed, "removed")
    scratch.free("places", "judged")
    return removed


def dedup_lines(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``removed_lines`` (their places from 0); columns of these names are replaced.

    A line goes if an earlier one, kept or not, in any document, has a word set with a Jaccard of ``least`` or more to its own. Earlier means a smaller
    ``doc_id`` (null first), then a smaller place; documents that share an id are in order of place, then hash. Lines without a word stay. Null text: no lines, stays null; an empty one
    has one line. Rows that repeat both ``doc_id`` and ``text`` count as one document and get the same result. Other columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.drop("n_lines", "removed_lines")
    text = F.col("text").cast("string")
    gone = repeated_lines(docs, least, scratch).withColumnsRenamed({"d1": "_d1", "d2": "_d2", "gone": "_gone"})
    keyed = base.withColumns({"_d1": F.xxhash64("doc_id", text), "_d2": F.xxhash64(text, "doc_id", F.lit(1))})
    joined = keyed.join(gone, ["_d1", "_d2"], "left").withColumn("_lines", F.split("text", "\n"))
    lines = F.col("_lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    left = F.array_join(F.transform(places, lambda k: F.element_at(lines, k + 1)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in base.columns]
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*columns, count.alias("n_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("removed_lines"))
