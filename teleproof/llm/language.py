"""Language identification by the nearest of several clustered centroids per language.

A text is a vector of hashed letter n-grams (one to three letters, words marked by spaces) weighted by TF-IDF and brought to length
one. Per language a spherical k-means over a bounded sample gives a few centroids; a text takes the language of the centroid with the highest
cosine. A text that lies much farther from its centroid than any learned one is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleproof.llm.common import Scratch

FEATURES = 8_192
STEP = 1 << 20  # letters counted at a time
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram comes in the whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    isletter = letter_table()[points]
    if not isletter.any():
        return None
    keep = isletter.copy()
    keep[1:] |= isletter[:-1]  # one space after each word, none for further signs
    letters = np.where(isletter, points, 32)[keep].astype(np.uint32)
    letters = np.concatenate([[32], letters, [32] * int(letters[-1] != 32)]).astype(np.uint32)
    total = np.zeros(FEATURES, np.int64)
    for k in range(0, len(letters), STEP):
        c = letters[k : k + STEP + 2]
        first, second = c[:-2] * np.uint32(0x9E3779B1), c[1:-1] * np.uint32(0x85EBCA77)
        three = first ^ np.left_shift(second, 7) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        for grams in (first, first ^ np.left_shift(second, 7), three):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(19), minlength=FEATURES)
    return total


def unit(weights: np.ndarray) -> np.ndarray:
    return weights / np.maximum(np.linalg.norm(weights, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """``centroids[k]`` stands for ``languages[k]``; a text whose cosine to it is below ``least[k]`` is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        return unit(np.log1p(np.array(rows, np.float32)) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        found = [counts(t) for t in texts]
        at = [k for k, x in enumerate(found) if x is not None]
        language = np.full(len(texts), UNDETERMINED, object)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        if at and self.languages:
            near = self.vectors([found[k] for k in at]) @ self.centroids.T
            best = near.argmax(axis=1)
            cosine = near[np.arange(len(at)), best].astype(np.float64)
            language[at] = np.array(self.languages, object)[best]
            score[at], rejected[at] = np.clip(cosine, 0, 1), cosine < self.least[best]
        return language.tolist(), score, rejected


def clusters(vectors: np.ndarray, wanted: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a spherical k-means begun from texts far from each other, and the centroid of each vector."""
    centers = unit(vectors.mean(axis=0, keepdims=True))
    while len(centers) < min(wanted, len(vectors)):
        centers = np.concatenate([centers, vectors[[(vectors @ centers.T).max(axis=1).argmin()]]])
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        centers = np.array([unit(vectors[own == k].mean(axis=0)) if (own == k).any() else centers[k] for k in range(len(centers))])
    return centers, (vectors @ centers.T).argmax(axis=1)


def fit(labelled: DataFrame, per_language: int = 1_500, centroids: int = 4, slack: float = 0.5) -> Centroids:
    """Learn from ``doc_id, text, lang``: at most ``per_language`` texts of each language, those whose ``doc_id`` has the smallest hash.

    Rows without language or without a letter teach nothing. A text is later rejected if its cosine is below ``slack`` times the
    smallest cosine of a learned text of the same language to its own centroid.
    """
    scratch = Scratch(labelled.sparkSession, "language")
    usable = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    # A little more than is asked for, by a bound on the hash that follows from the counts; so no task meets a whole language.
    share = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    bound = {r["lang"]: (per_language + 6 * per_language**0.5) / r["count"] for r in usable.groupBy("lang").count().collect()}
    if not bound:
        return Centroids(np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), [], np.zeros(0))
    bounds = F.create_map(*(F.lit(x) for pair in bound.items() for x in pair))
    order = Window.partitionBy("lang").orderBy("share", "doc_id", F.xxhash64("text"))
    near = usable.withColumn("share", share).where(F.col("share") < bounds[F.col("lang")])
    sample = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).drop("place", "share")
    sample = scratch.keep(sample, "sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = counts(text.as_py())
                if found is not None:
                    seen, n = seen + (found > 0), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tolist()], pa.list_(pa.int64()))], ["n", "seen"])

    parts = sample.select("text").mapInArrow(frequencies, "n long, seen array<long>")
    parts = parts.select(F.col("n"), F.posexplode("seen").alias("feature", "seen")).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    found = {r.feature: (r.n, r.seen) for r in parts.collect()}
    n = np.array([found.get(k, (0, 0)) for k in range(FEATURES)], np.float64)
    idf = np.log((1 + n[:, 0]) / (1 + n[:, 1])).astype(np.float32) + np.float32(1)
    model = Centroids(idf, np.zeros((0, FEATURES), np.float32), [], np.zeros(0))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        rows = [x for x in map(counts, group.text) if x is not None]
        if not rows:
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        vectors = model.vectors(rows)
        centers, own = clusters(vectors, centroids)
        cosine = (vectors @ centers.T)[np.arange(len(own)), own]
        used = sorted(set(own.tolist()))
        return pd.DataFrame({
            "lang": group.lang.iloc[0], "centroid": [centers[k].astype(np.float32).tobytes() for k in used],
            "least": slack * float(cosine.min()),
        })

    learned = sample.groupBy("lang").applyInPandas(learn, "lang string, centroid binary, least double").collect()
    learned.sort(key=lambda r: (r.lang, r.centroid))
    scratch.free("sample")
    if learned:
        model.centroids = np.array([np.frombuffer(r.centroid, np.float32) for r in learned])
        model.languages, model.least = [r.lang for r in learned], np.array([r.least for r in learned])
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with ``lang_pred, lang_score, lang_rejected``, columns of these names replaced; only ``text`` is looked at.

    Null text or one without a letter: ``und``, score 0, rejected. Equal cosines: the first centroid in order of language. Without
    learned centroids every text is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "lang_score", "lang_rejected"]
    kept = docs.drop(*names)
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                language, score, rejected = shared.value.predict(part.column(place).to_pylist())
                columns = [*part.columns, pa.array(language, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string, lang_score double, lang_rejected boolean"]))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of ``doc_id`` as text leaves remainder 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_open(docs: DataFrame) -> Centroids:
    """``fit`` on the documents that are not held out."""
    return fit(docs.where(~held_out()))
