"""What the operators on embeddings share: usable vectors, classes of equal ones, runs of rows with one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part() -> Column:
    """Whether a row has an id and a vector that is not null, empty or zero and holds finite components only."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, e, d1, d2`` of the rows that take part; ``e`` as float or double, without negative zeros."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.where(takes_part())
    e = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).select("vec_id", "e", F.xxhash64("e").alias("d1"), F.xxhash64(F.lit(1), "e").alias("d2"))


def classes(rows: DataFrame) -> DataFrame:
    """Equal vectors as one: ``d1, d2, cid`` (the smallest id), ``copies, e``."""
    return rows.groupBy("d1", "d2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("e").alias("e"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are all of one length as a matrix, in double precision if it holds vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return (values.astype(np.float64) if values.dtype.kind == "f" else values).reshape(len(column), -1)


def by_length(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Batches whose lists in one column are all of one length."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column(place)))
        for size in np.unique(sizes):
            yield batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, cut where it changes, as tables of whole runs; holds one batch and the run in progress."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = rest.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield rest.slice(0, int(cuts[-1]))
            rest = rest.slice(int(cuts[-1])).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:]))
