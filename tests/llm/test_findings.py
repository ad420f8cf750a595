"""What the reviewer of round 3 found in the operators of training data, on small inputs."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from llm.test_duplicates import joined, slow_fingerprint
from llm.test_near_copies import alike, edited, slow_set
from teleproof.llm import neighbours, repeats
from teleproof.llm.common import Scratch


def test_rounds_of_a_search_write_what_is_new(spark, sf, monkeypatch):
    """All that a query had seen was joined and written again in every round."""
    rng, rows = np.random.default_rng(5), {}
    vectors = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(400)], "vec_id long, embedding array<double>")
    keep = Scratch.keep

    def counted(self, df, name):
        made = keep(self, df, name)
        rows[name] = made.count() if name.startswith(("seen-", "front-")) else 0
        return made

    monkeypatch.setattr(Scratch, "keep", counted)
    found = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, neighbours=10, beam=30).collect()
    assert len(found) == 40
    seen, front = ([n for name, n in rows.items() if name.startswith(kind)] for kind in ("seen-", "front-"))
    assert len(seen) > 2 and sum(seen) <= 4 * 400 and max(front) <= 4 * 30


def test_memory_of_anchors():
    body = np.random.default_rng(2).integers(0, 256, 2 * repeats.PIECE, np.uint8).tobytes()
    tracemalloc.start()
    repeats.anchored([body], repeats.LENGTH, repeats.GRAM)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


def test_pipeline_stage_links_by_fingerprints_and_by_shingles(spark, sf):
    """stage ``simhash`` had no SimHash; links of both kinds make one grouping."""
    import corpus_pipeline

    tail = " ".join(f"w{k}" for k in range(60))
    loop = "a b c " * 400
    # Fingerprints link 7 and 3, shingles 3 and 5; neither links 7 and 5.
    texts = [*edited(), (3000 + 7, loop), (3000 + 3, loop + tail), (3000 + 5, "a b c a b c a b c " + tail), (4000, "quite another text of some words")]
    sets, bits = {d: slow_set(t) for d, t in texts}, {d: slow_fingerprint(t) for d, t in texts}
    near = lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 2
    same = lambda a, b: alike(sets[a], sets[b])
    assert near(3007, 3003) and not same(3007, 3003) and same(3003, 3005) and not near(3003, 3005) and not near(3007, 3005)
    want = sorted(set(joined(sorted(sets), lambda a, b: near(a, b) or same(a, b)).values()))
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([tuple({"doc_id": d, "text": t}.get(c) for c in schema.names) for d, t in texts], schema)
    kept = corpus_pipeline.simhash(spark, docs, sf)
    assert kept.columns == schema.names and sorted(r.doc_id for r in kept.collect()) == want and 3003 in want and 3007 not in want
