"""Query requests arriving as JSON lines, answered in micro-batches by the batched query service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from teleproof.operators.blocks import RECORD
from teleproof.operators.queries import query_bins, query_rows, query_schema, run_queries


def read_requests(lines: DataFrame, record_type: T.DataType | None = None) -> DataFrame:
    """Text lines to requests, each with ``refusal``: null, ``malformed_line`` or ``unknown_fields``.

    A request may hold the fields of the schema and no others. A line that names no query gets an id made from its own text.
    """
    schema = query_schema(record_type)
    fields = F.json_object_keys("value")
    extra = F.size(F.array_except(fields, F.array(*[F.lit(n) for n in schema.names]))) > 0
    refusal = F.when(fields.isNull(), "malformed_line").when(extra, "unknown_fields")
    named = F.coalesce(F.col("_q.query_id"), F.concat(F.lit("line_"), F.substring(F.sha2("value", 256), 1, 16)))
    return lines.select("value", F.from_json("value", schema).alias("_q"), refusal.alias("refusal")).select(
        named.alias("query_id"), *[F.col(f"_q.{n}").alias(n) for n in schema.names if n != "query_id"], "refusal"
    )


def answer_lines(rows: DataFrame, lines: DataFrame, channels: Sequence[str], record_type: T.DataType | None = None) -> DataFrame:
    """One answer for every line, in the form of ``run_queries``; refused lines answer their refusal."""
    requests = read_requests(lines, record_type)
    answered = run_queries(rows, requests.filter("refusal IS NULL").drop("refusal"), channels)
    refused = requests.filter("refusal IS NOT NULL").select("query_id", RECORD, "op", F.col("refusal").alias("status"))
    return answered.unionByName(refused, allowMissingColumns=True)


def answer_requests(
    spark: SparkSession, rows: DataFrame, channels: Sequence[str], inbox: str, outbox: str, checkpoint: str,
    record_type: T.DataType | None = None,
) -> StreamingQuery:
    """Watch ``inbox`` for request files; each micro-batch writes its answers, and the rows and bins they refer to, to folders of its own.

    A batch that is retried after a failure overwrites its folders, so every request is answered once.
    """
    lines = spark.readStream.text(inbox)

    def answer(batch: DataFrame, batch_id: int) -> None:
        asked = read_requests(batch, record_type).filter("refusal IS NULL").drop("refusal")
        for name, found in (
            ("", answer_lines(rows, batch, channels, record_type)), ("_rows", query_rows(rows, asked, channels)), ("_bins", query_bins(rows, asked, channels)),
        ):
            found.write.mode("overwrite").parquet(f"{outbox}{name}/batch={batch_id}")

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
