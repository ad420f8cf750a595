from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf(spark):
    from teleproof.llm.common import ship

    ship(spark)
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture
def frame(spark, sf):
    """A documents frame with a clashing extra column; rows are ``(doc_id, text)``."""

    def make(rows, **columns):
        rows = [(d, t, *columns.values()) for d, t in rows]
        kinds = "".join(f", {c} string" for c in columns)
        return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")

    return make
