"""Graphs as tables: written rounds, connected components, dependency graphs and edit conflicts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []

#: tasks of a file that one task of Spark pairs with as many others
SQUARE = 2048


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset, a master on one machine gets a temporary
    folder that goes with the driver; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="corpusloom-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        base = f"file://{_own_folder[0]}"
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that executors share and read again: cuts the lineage, survives lost executors."""
    path, schema = f"{shared_folder(df.sparkSession)}/corpusloom/rounds-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of checkpointed tables that no later plan reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't pile up in a Python worker. Spark reads
    these settings when a plan runs, after the operator has returned it; so they are lowered in the caller's
    session where its own are larger, and stay so."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        have = spark.conf.get(key)
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of ``edges(a, b)``: root is the smallest node that is connected.

    Every node points to the smallest label around it, then to its label's label, until nothing changes.
    Labels are taken by partial aggregates and joins that adaptive execution splits; the rounds grow with
    the logarithm of the longest path. Nulls and self-loops are ignored.
    """
    links = edges.where(F.col("a") != F.col("b")).select("a", "b")
    current = checkpointed(links.union(links.select("b", "a")).distinct())
    for _ in range(max_rounds):
        # the least neighbour becomes the parent, and all other neighbours get an edge to it
        least = current.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hooked = current.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select("a", "m"))
        following = hooked.where("x <> y").distinct()
        following = checkpointed(following.union(following.select("y", "x")).distinct().toDF("a", "b"))
        settled = following.count() == current.count() and following.join(current, ["a", "b"], "left_anti").isEmpty()
        drop(current)
        current = following
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = current.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    out._scratch_path = current._scratch_path
    return out


def closure(edges: DataFrame, max_rounds: int = 60, max_levels: int = 40) -> DataFrame:
    """Transitive closure (id, ancestor) of edges(id, parent). A cycle is an error.

    Nodes are dealt into levels, those without parents first. Level by level, a node's ancestors are its parents and what these
    have: each edge hands over its parent's list once, so the work is that of edges times ancestors, and no pair is found
    by way of each node between. A row holds one node's ancestors. Graphs of more than ``max_levels`` levels are doubled.
    """
    edges = checkpointed(edges.select("id", "parent").distinct())
    levels = _levels(edges, max_levels)
    if levels is None:
        return _doubled(edges, max_rounds)
    placed, last = levels
    steps = checkpointed(edges.join(placed, "id").withColumnRenamed("level", "to").join(placed.toDF("parent", "from"), "parent"))
    handed = f"{shared_folder(edges.sparkSession)}/corpusloom/rounds-{uuid.uuid4().hex}"
    schema = f"id {edges.schema['id'].dataType.simpleString()}, up array<{edges.schema['parent'].dataType.simpleString()}>, to int"
    done = []
    for level in range(last + 1):
        if level:
            own = edges.sparkSession.read.schema(schema).parquet(handed).where(F.col("to") == level)
            done.append(checkpointed(own.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("up"))).alias("up"))))
        if level < last:
            out = steps.where(F.col("from") == level)
            if level:
                out = out.join(done[-1].withColumnRenamed("id", "parent"), "parent").withColumn("up", F.array_append("up", F.col("parent")))
            else:
                out = out.withColumn("up", F.array("parent"))
            out.select("id", "up", "to").write.mode("append").partitionBy("to").parquet(handed)
    drop(edges, placed, steps)
    if not done:
        return edges.sparkSession.createDataFrame([], edges.schema).toDF("id", "ancestor")
    context = edges.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(handed)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return reduce(DataFrame.union, done).select("id", F.explode("up").alias("ancestor"))


def _levels(edges: DataFrame, most: int) -> tuple[DataFrame, int] | None:
    """(id, level) of all nodes of edges(id, parent): 0 without parents, else one more than the highest parent's; and the
    highest level. None if there are more than ``most``."""
    open_, parts = edges, []
    for level in range(most + 1):
        nodes = open_.select("id").union(open_.select("parent")).distinct() if not level else waiting
        ready = checkpointed(nodes.join(open_.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        parts.append(ready)
        if open_.isEmpty():
            out = checkpointed(reduce(DataFrame.union, parts))
            drop(*parts)
            return out, level
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        waiting = checkpointed(open_.select("id").distinct())
        following = checkpointed(open_.join(ready.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent"))
        open_ = following
    return None


def _doubled(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The closure by joining paths to paths, so that the number of rounds is the logarithm of the longest path."""
    paths = checkpointed(edges.select("id", F.col("parent").alias("ancestor")).distinct())
    size = paths.count()
    for _ in range(max_rounds):
        if not paths.where("id = ancestor").isEmpty():
            raise ValueError("the graph has a cycle")
        tail = paths.select(F.col("id").alias("mid"), "ancestor")
        more = paths.select("id", F.col("ancestor").alias("mid")).join(tail, "mid").select("id", "ancestor")
        following = checkpointed(paths.union(more).distinct())
        drop(paths)
        paths = following
        n = paths.count()
        if n == size:
            return paths
        size = n
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def dependencies(tasks: DataFrame) -> DataFrame:
    """Edges (id, parent) of tasks(id, depends_on array). Repeated ids and parents that are no task are errors."""
    if not tasks.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate task ids")
    edges = tasks.select("id", F.explode("depends_on").alias("parent")).distinct()
    unknown = edges.join(tasks.select(F.col("id").alias("parent")), "parent", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown dependency: {unknown[0]['parent']}")
    return edges


def normal_path(path: Column) -> Column:
    """A path with / between its parts, in lower case, without "." parts, empty parts and "x/.." pairs."""
    parts = F.split(F.translate(F.lower(path), "\\", "/"), "/")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), done).when(back, shorter).otherwise(F.concat(done, F.array(part)))

    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(F.startswith(F.translate(path, "\\", "/"), F.lit("/")), F.concat(F.lit("/"), out)).otherwise(out)


def conflicts(tasks: DataFrame) -> DataFrame:
    """Pairs (left, right), left < right, of tasks(id, depends_on, implementation_files) that edit a file in
    common and are not ordered by the dependencies, with the files."""
    named = tasks.select("id", F.array_distinct(F.transform("implementation_files", normal_path)).alias("files")).where(F.size("files") > 0)
    listed = checkpointed(named.select("id", "files", F.explode("files").alias("file")))
    # of all ordered pairs only those that share a file matter: each task takes its own along
    before = closure(dependencies(tasks))
    at = listed.select("id", "file")
    both = before.join(at, "id").join(at.toDF("ancestor", "file"), ["ancestor", "file"])
    ordered = both.select("id", F.col("ancestor").alias("other"), "file").union(both.select("ancestor", "id", "file"))
    known = ordered.groupBy("id", "file").agg(F.collect_set("other").alias("ordered"))
    # tasks of a file are met in squares of so many at most, dealt out by their own number: few rows make many pairs
    cuts = checkpointed(at.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", "n", F.ceil(F.col("n") / SQUARE).cast("long").alias("cut")))
    made = cuts.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    parts = max(1, min(1 << 14, round(made / (SQUARE * SQUARE / 2))), int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = listed.join(cuts.select("file", "cut"), "file").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cut")))
    others = F.sequence(F.lit(0), F.col("cut") - 1)
    x = cut.join(known, ["id", "file"], "left").withColumn("i", F.col("own")).withColumn("j", F.explode(others))
    y = cut.withColumn("j", F.col("own")).withColumn("i", F.explode(others))
    square = ["file", "i", "j"]
    x = x.select(*square, F.col("id").alias("left"), F.col("files").alias("fl"), "ordered").repartition(parts, *square)
    y = y.select(*square, F.col("id").alias("right"), F.col("files").alias("fr")).repartition(parts, *square)
    pairs = x.join(y, square).where(F.col("left") < F.col("right")).where(F.col("ordered").isNull() | ~F.array_contains("ordered", F.col("right")))
    # a pair is met at each common file, and counts at the first
    files = F.when((F.size("fl") == 1) | (F.size("fr") == 1), F.array("file")).otherwise(F.array_sort(F.array_intersect("fl", "fr")))
    return pairs.withColumn("files", files).where(F.col("file") == F.get("files", F.lit(0))).select("left", "right", "files")
