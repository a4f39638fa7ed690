"""Lines of text files with their numbers, however Spark splits the files, and strict positional rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

_LINE = "file string, block long, own long, value string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of the files, numbered from 1 as a reader from the start of each file would.

    Files are read in splits as Spark plans them. Within a split lines come in order and are counted; how many lines the
    splits before it have is a sum over one small row for each split, which joins the lines by (file, split). Files are
    read twice, texts are not shuffled. An empty last line is none. Splits must not change between the two readings:
    don't alter the files or spark.sql.files settings meanwhile.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(files, blocks)):
                if key != at:
                    at, n = key, 0
                n += 1
                own[i] = n
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own), batch.column(0)], ["file", "block", "own", "value"])

    counted = raw.mapInArrow(count, _LINE)
    sizes = counted.groupBy("file", "block").agg(F.max("own").alias("n"))
    # one row a split
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(sizes.select("file", "block", before.alias("before")))
    return counted.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("own")).alias("line"), "value")


def _wanted(lines: DataFrame) -> DataFrame:
    return lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))


def positional_faults(lines: DataFrame, fields: int, row_id: str) -> DataFrame:
    """(file, line, fault) of lines(file, line, value) that don't have exactly so many tab-separated fields, or whose
    first one isn't wholly ``row_id`` (a regular expression). Comments (#) and blank lines are no rows."""
    parts = F.split("value", "\t", -1)
    fault = F.when(F.size(parts) != fields, F.concat(F.lit(f"expected {fields} fields, got "), F.size(parts).cast("string"))).when(
        ~F.get(parts, F.lit(0)).rlike(f"^(?:{row_id})$"), F.concat(F.lit("invalid row id "), F.get(parts, F.lit(0)))
    )
    return _wanted(lines).select("file", "line", fault.alias("fault")).where("fault is not null")


def read_positional(spark: SparkSession, path: str, names: list[str], row_id: str) -> DataFrame:
    """(file, line, named fields) of tab-separated files. The first fault, by file and line, is an error that names both."""
    lines = numbered_lines(spark, path)
    bad = positional_faults(lines, len(names), row_id).orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file'].rsplit('/', 1)[-1]}:{bad[0]['line']}: {bad[0]['fault']}")
    parts = F.split("value", "\t", -1)
    return _wanted(lines).select("file", "line", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
