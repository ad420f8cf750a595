"""What the operators share: intermediate tables, connected components, checksums of token ids."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.sources.workspace import shared_folder


class Scratch:
    """Intermediate tables of one operator call, in the folder that the whole cluster shares.

    A written table ends the lineage: a lost executor re-reads files. ``free`` deletes tables that no later step reads and
    lets Spark's cleaner drop the shuffle files of finished steps.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/teleproof/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def inner(self, name: str) -> Scratch:
        """A folder in this one, for the tables of an operator that is called more than once."""
        made = Scratch(self.spark, name)
        made.folder = self.path(name)
        return made

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (two columns of one type) by alternating large and small stars.

    Returns ``node, component``, the component being the smallest node it holds; nodes without an edge to another node do
    not appear. Every round is two joins on the node with partial minima before the shuffle; the edges never leave Spark.
    """
    a, b = (F.col(c) for c in edges.columns)
    start = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, turn, seen = scratch.keep(start, "edges-0"), 0, None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == seen:
            break
        seen, turn = mark, turn + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least).distinct()
        now = scratch.keep(small, f"edges-{turn}")
        scratch.free(f"edges-{turn - 1}", f"large-{turn}")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v")))


def crc32_of(ids: np.ndarray | bytes) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, (bytes, memoryview)) else ids.astype("<u4").tobytes())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this library's modules, for sessions that were not started with it on their Python path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
