"""Streaming id-mapping upserts: each micro-batch is merged into a table of stored rows, one for each key (SNK15, IDX7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.entities import normalized_mapping


def merge_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's stored rows that the table at path doesn't have are appended under the batch's number.

    A batch written again after a failure replaces its own files, so each row is there once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = normalized_mapping(batch)
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).filter(F.col("batch") != number).select("doc_id")
            new = new.join(known, "doc_id", "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def upsert_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str):
    """A query that upserts the mapping files that appear in a folder, as they come; available now, then it ends."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
