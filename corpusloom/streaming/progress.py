"""Append with progress: a stream's rows by batch, a manifest of its state, and what a listener has heard."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType


class BatchListener(StreamingQueryListener):
    """Numbers and input rows of the batches of one query, as Spark reports them."""

    def __init__(self) -> None:
        self.query, self.batches, self.error = None, {}, None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.query = self.query or event.id

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.id == self.query:
            self.batches[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.id == self.query:
            self.error = event.exception


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced in one step, in any store that Spark can write."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    stream = new.getFileSystem(conf).create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, old, options)


def manifest(spark: SparkSession, out: str) -> dict:
    """What the manifest of a run says."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/manifest.json", wholetext=True).collect()))


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, rows) of the batches that are done: one small row each."""
    schema = StructType([StructField("batch", LongType()), StructField("rows", LongType())])
    return spark.read.schema(schema).json(f"{out}/progress")


def rollup(spark: SparkSession, out: str, every: int) -> DataFrame:
    """(batch, accepted, reports): rows so far after each batch, and how often a multiple of ``every`` was passed in it.
    One row a batch meets in the window, whatever the rows."""
    so_far = F.sum("rows").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    steps = F.floor(F.col("accepted") / every) - F.floor((F.col("accepted") - F.col("rows")) / every)
    return progress(spark, out).withColumn("accepted", so_far).select("batch", "accepted", steps.alias("reports"))


def append(stream: DataFrame, out: str, facts: dict | None = None, check: Callable[[DataFrame, int], None] | None = None) -> dict:
    """Run what is there, append it under ``out/rows`` by batch, and return the manifest.

    The manifest goes from initializing to running, counts after each batch, and ends completed, or failed (with the
    error, which is raised). A batch is a folder of rows and one line of progress, both replaced when the batch is
    repeated; counts are sums of those lines, so neither a failure nor a restart counts anything twice. ``check``
    sees a batch before it is written. ``facts`` are kept in the manifest. An empty stream completes with no batch.
    """
    spark = stream.sparkSession
    told = {**(facts or {}), "status": "initializing", "batches": 0, "count": 0, "error": None}

    def save(status: str, error: str | None = None) -> None:
        done = progress(spark, out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        told.update(status=status, batches=done["n"], count=done["rows"], error=error)
        write_text(spark, f"{out}/manifest.json", json.dumps(told, indent=2, sort_keys=True) + "\n")

    def write(batch: DataFrame, number: int) -> None:
        if check:
            check(batch, number)
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = batch.sparkSession.read.parquet(f"{out}/rows/batch={number}").count()
        write_text(spark, f"{out}/progress/{number}.json", json.dumps({"batch": number, "rows": rows}) + "\n")
        save("running")

    spark.createDataFrame([], "batch long, rows long").write.mode("ignore").json(f"{out}/progress")
    save("initializing")
    listener = BatchListener()
    spark.streams.addListener(listener)
    try:
        save("running")
        query = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        save("completed")
    except BaseException as error:
        save("failed", str(error).splitlines()[0][:500] if str(error) else type(error).__name__)
        raise
    finally:
        spark.streams.removeListener(listener)
    return told | {"input_rows": dict(listener.batches)}
