"""Files as rows: hashes, inventories, JSON documents and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Path, size and SHA-256 of whole files (up to 2 GB each)."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with size, time of change and hash."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")
    )


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines log with its file name; a log that was never written is empty."""
    with_file = T.StructType([*schema.fields, T.StructField("log_file", T.StringType())])
    try:
        return spark.read.schema(schema).json(path).withColumn("log_file", F.input_file_name())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], with_file)
