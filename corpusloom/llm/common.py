"""Shared plumbing of the llm operators: tables, scratch tables in the shared folder, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import shared_folder, tune  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def place(df: DataFrame, name: str) -> int:
    """Number of the column called ``name``; names are compared as Spark does."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    return (exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()])[0]


def with_columns(
    df: DataFrame, sources: str | list[str], fields: list[T.StructField], task: Callable[[], Callable[..., list[pa.Array]]]
) -> DataFrame:
    """df with ``fields`` computed from the columns ``sources``, one Arrow batch at a time. ``task`` is called
    once in each task for the function that makes a batch's new columns of its sources. Columns of df that
    have the name of a new one, in whatever case, are replaced; all others are kept, whatever their names:
    inside, columns are known by number."""
    own = {f.name.lower() for f in fields}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in own]
    read = [place(df, s) for s in ([sources] if isinstance(sources, str) else sources)]
    taken = kept + [i for i in dict.fromkeys(read) if i not in kept]
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in taken])
    whole = [df.schema.fields[i] for i in kept] + fields
    names = [f"c{i}" for i in range(len(whole))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = task()
        for batch in batches:
            new = apply(*[batch.column(taken.index(i)) for i in read])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, whole)])
    return numbered.mapInArrow(run, schema).toDF(*[f.name for f in whole])


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def bit_place(column: str, size: int) -> Column:
    """Where a value's bit stands in a table of 2 ** size bits."""
    return F.pmod(F.xxhash64(column), F.lit(1 << size))


def bits_for(n: int) -> int:
    """Size of a bit table of n values: sixteen bits for each, 2 ** 30 (128 MB) at most. Beyond some 300 million values
    the table fills up and lets more through; what it lets through is joined exactly."""
    return min(30, max(16, (16 * n).bit_length()))


def bit_table(df: DataFrame, column: str, size: int) -> Broadcast:
    """A table of 2 ** size bits (bytes, lowest bit first), set where the values of a column have their places: of
    fixed size whatever the column holds, and true of all its values and by chance of few others."""
    return bits_at(df, bit_place(column, size), size)


def bits_at(df: DataFrame, place: Column, size: int) -> Broadcast:
    """The same for places that a column of numbers from 0 to 2 ** size - 1 names."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = df.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), "<i8")
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(table.tobytes())


def without_ids(df: DataFrame, key: str, ids: DataFrame, broadcast_most: int = 1 << 20) -> DataFrame:
    """df without the rows whose column ``key`` is in ``ids``, a written table of one long column. Null keys
    stay; columns are kept as they are.

    Up to ``broadcast_most`` ids are broadcast. Of more, a bit table (sixteen bits an id, 128 MB at most) tells the
    rows that are surely none of them, which stay where they are; only the others are shuffled for the join.
    """
    n, gone = ids.count(), fresh("gone")
    other = ids.toDF(gone)
    same = F.col(key) == F.col(gone)
    if n <= broadcast_most:
        return df.join(F.broadcast(other), same, "left_anti")
    size = bits_for(n)
    bits = bit_table(other, gone, size)

    @F.pandas_udf(T.BooleanType())
    def told(places: pd.Series) -> pd.Series:
        table, at = np.frombuffer(bits.value, np.uint8), places.to_numpy()
        return pd.Series((table[at >> 3] >> (at & 7) & 1).astype(bool))

    maybe = F.coalesce(F.col(key).isNotNull() & told(F.coalesce(bit_place(key, size), F.lit(0))), F.lit(False))
    flagged = df.withColumn(own := fresh("maybe"), maybe)
    stay, look = flagged.where(~F.col(own)).drop(own), flagged.where(F.col(own)).drop(own)
    return stay.unionByName(look.join(other, same, "left_anti"))


def drop_tables(*frames: DataFrame) -> None:
    """Delete the files behind materialized tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (comparable ids, any type): rows (node, root), root being
    the smallest node of the component.

    Alternates the large-star and small-star steps until a round changes nothing. Each step groups by
    node with a partial min and joins back on the node; neighbour lists are never gathered, so a hub
    costs one aggregate row per task plus a join that adaptive execution splits. Each round is written to
    the shared folder, which keeps the plan short and makes rounds restartable. Self-loops and nulls in
    an edge are ignored; an empty input gives an empty result. ``drop_tables`` takes the result.
    """
    current = materialize(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    size = current.count()
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(low, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.where(F.col("a") != F.col("b")).distinct()
        # small star: every node's smaller neighbours and itself point to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        )
        following = materialize(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        before, size = size, following.count()
        # both are sets: as many rows, and none that is new
        settled = before == size and following.join(current, ["a", "b"], "left_anti").isEmpty()
        drop_tables(current)
        current = following
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    out._scratch_path = current._scratch_path
    return out
