"""Incremental ingestion with Structured Streaming: file-source streams, exact online deduplication and
append with a progress table. Every stream has a checkpoint folder and can be stopped and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bounded_shuffle(df: DataFrame, salt: str, id_column: str) -> DataFrame:
    """A column that orders rows as a seeded shuffle would, without a buffer."""
    return df.withColumn("shuffle_key", F.sha2(F.concat_ws(":", F.lit(salt), F.col(id_column).cast("string")), 256))


def online_dedup(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen in this or an earlier batch. State is one entry a key in the state
    store, partitioned by key."""
    return stream.dropDuplicates([key])


def run_to_table(stream: DataFrame, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> dict:
    """Run what is there and stop; rows are appended under ``out`` by batch, a repeated batch replaces
    itself. Returns the progress: batches and rows."""
    progress = {"batches": 0, "rows": 0}

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        progress["batches"] += 1
        progress["rows"] += batch.sparkSession.read.parquet(f"{out}/batch={number}").count()
        if on_batch:
            on_batch(batch, number)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    return progress
