"""Readers, writers and provenance of row files. All go through Spark's own sources and commit protocol."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as t
from ..operators.graph import shared_folder


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_folder(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a line, blank lines skipped; strict: a bad line fails the read, else it becomes a row
    with the line in ``_bad`` and nulls elsewhere. Order is not kept: carry an id."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.select(F.from_json("value", f"{schema}, _bad string", options).alias("r")).select("r.*")


def read_jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of each file before its first bad line, with the file and the line; the rest of such a file is
    left. Files are read whole, one a task."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    parsed = lines.where(F.trim("value") != "").withColumn("bad", F.expr("try_parse_json(value) is null"))
    first = parsed.where("bad").groupBy("file").agg(F.min("line").alias("first_bad"))
    kept = parsed.join(first, "file", "left").where("first_bad is null or line < first_bad")
    return kept.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Header, quoted multi-line fields, everything a string; a byte order mark is dropped from the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Positional fields; lines that start with # are comments; ``bad`` marks another number of fields."""
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], (F.size(parts) != len(names)).alias("bad"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def parse_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, section, fields array<struct<field, value>>) of texts made of ``=== section`` headers and
    ``@@FIELD`` blocks; place: number of the section in its text, from 0. Lines of a value that begin like
    a header are written with a backslash before them (``escaped_lines``), which is taken off. Text before
    the first header, or the first field of a section, belongs to none. A null text has no sections."""
    parts = F.split(text, r"(?md)^=== ", -1)
    sections = df.select(key, F.posexplode(F.slice(parts, 2, 1 << 30)).alias("place", "s"))
    value = lambda b: F.regexp_replace(_stripped(F.substring(b, F.instr(b, "\n") + 1, F.length(b))), r"(?md)^\\(?=\\*(?:=== |@@))", "")
    field = lambda b: F.struct(
        F.trim(F.substring_index(b, "\n", 1)).alias("field"), F.when(F.instr(b, "\n") > 0, value(b)).otherwise("").alias("value")
    )
    fields = F.transform(F.slice(F.split("s", r"(?md)^@@", -1), 2, 1 << 30), field)
    return sections.select(key, "place", F.trim(F.substring_index("s", "\n", 1)).alias("section"), fields.alias("fields"))


def escaped_lines(c: Column | str) -> Column:
    """A value as it is written into a block."""
    return F.regexp_replace(c, r"(?md)^(?=\\*(?:=== |@@))", r"\\")


SEVERITIES = ("info", "low", "medium", "high")


def section_flags(sections: DataFrame, key: str, field: str = "FLAGS") -> DataFrame:
    """(key, place, section, severity, type, note) of the ``severity|type|note`` lines of a field."""
    found = sections.select(key, "place", "section", F.explode("fields").alias("f")).where(F.col("f.field") == field)
    lines = found.select(key, "place", "section", F.explode(F.split("f.value", "\n")).alias("line")).where(F.trim("line") != "")
    part = F.split("line", r"\|", 3)
    at = lambda i: F.trim(F.get(part, F.lit(i)))
    return lines.select(key, "place", "section", at(0).alias("severity"), at(1).alias("type"), at(2).alias("note"))


def section_faults(sections: DataFrame, key: str, required: list[str], flags: str = "FLAGS") -> DataFrame:
    """(key, section, fault) of section headers that a text has twice, required fields that are missing or
    empty, fields that a section has twice, and flags that aren't severity|type|note."""
    names = F.transform("fields", lambda f: f["field"])
    filled = F.transform(F.filter("fields", lambda f: f["value"] != ""), lambda f: f["field"])
    wanted = F.array(*[F.lit(x) for x in required])
    lacking = F.transform(F.array_except(wanted, filled), lambda x: F.concat(F.lit("empty "), x))
    twice = F.when(F.size(F.array_distinct(names)) < F.size(names), F.array(F.lit("repeated field"))).otherwise(F.array().cast("array<string>"))
    by_section = sections.select(key, "section", F.explode(F.concat(lacking, twice)).alias("fault"))
    headers = sections.groupBy(key, "section").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "section", F.lit("repeated section").alias("fault"))
    bad = section_flags(sections, key, flags).where(F.col("note").isNull() | ~F.col("severity").isin(*SEVERITIES))
    return by_section.union(headers).union(bad.select(key, "section", F.lit("bad flag").alias("fault")))


def content_fingerprint(df: DataFrame) -> Column:
    """Order-insensitive fingerprint of rows, as an aggregate: count and sum of row hashes."""
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string"))


def frozen_write(df: DataFrame, path: str) -> bool:
    """Write once. A second write must have the same rows, else it raises; True if it wrote."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    one, two = (x.agg(content_fingerprint(x).alias("f")).first()["f"] for x in (held.select(*df.columns), df))
    if one != two:
        raise ValueError(f"{path} holds other rows")
    return False


def git_blob_sha1(content: Column) -> Column:
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(b"\x00"), content.cast("binary")))


def verify_files(spark: SparkSession, path: str, declared: DataFrame) -> DataFrame:
    """(name, ok) of files against declared(name, size, sha256)."""
    found = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("found")
    )
    return declared.join(found, "name", "left").select("name", F.coalesce((F.col("length") == F.col("size")) & (F.col("found") == F.col("sha256")), F.lit(False)).alias("ok"))


def pack_archives(df: DataFrame, name: str, content: str, archives: int) -> DataFrame:
    """(archive int, data binary): gzipped tar files of the members df(name, content) in order of name, dealt by
    a hash of the name into ``archives`` files. The same members make the same bytes: no times, owners or
    modes of the machine enter. A task packs one archive after the other."""
    dealt = df.select(F.pmod(F.xxhash64(name), F.lit(archives)).cast("int").alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))

    def pack(batches):
        of, raw, tar = None, None, None

        def closed():
            tar.close()
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([gzip.compress(raw.getvalue(), mtime=0)], pa.binary())], ["archive", "data"])

        for batch in batches:
            for number, member, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number != of:
                    if tar is not None:
                        yield closed()
                    of, raw = number, io.BytesIO()
                    tar = tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        if tar is not None:
            yield closed()

    return dealt.repartition("archive").sortWithinPartitions("archive", "name").mapInArrow(pack, "archive int, data binary")


def verify_archives(archives: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, size, sha256, ok): every member that ``archives(data)`` hold or declared(name, size, sha256) names,
    read again from the archives; ok: it is in both, with the declared size and hash."""

    def members(batches):
        for batch in batches:
            rows = []
            for data in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(data.as_py()), mode="r:gz") as tar:
                    for member in tar:
                        content = tar.extractfile(member).read()
                        rows.append((member.name, len(content), hashlib.sha256(content).hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["name", "size", "sha256"])

    found = archives.select("data").mapInArrow(members, "name string, size long, sha256 string")
    wanted = declared.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    same = (F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha256"))
    return found.join(wanted, "name", "full").select(
        "name", F.coalesce("size", "_size").alias("size"), F.coalesce("sha256", "_sha256").alias("sha256"), F.coalesce(same, F.lit(False)).alias("ok")
    )


PROMPT_FIELDS = ("prompt", "question", "user_prompt", "user")


def _prompts(tree) -> list[str]:
    """Every list and object of the tree is walked, but those under ``messages`` only for user messages."""
    found, open_ = [], [tree]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            messages = x.get("messages")
            for m in messages if isinstance(messages, list) else ():
                if isinstance(m, dict) and m.get("role") == "user" and isinstance(m.get("content"), str):
                    found.append(m["content"])
            for k, v in x.items():
                if k in PROMPT_FIELDS and isinstance(v, str):
                    found.append(v)
                elif k != "messages" and isinstance(v, (dict, list)):
                    open_.append(v)
        elif isinstance(x, list):
            open_ += x
    return found


def harvest_prompts(df: DataFrame, key: str, json_text: str) -> DataFrame:
    """(key, prompt) of user messages and of fields prompt, question, user_prompt and user anywhere in JSON
    text, by walking the parsed tree. Null texts have none; text that isn't JSON, or is nested too deep for
    the parser, has none either."""
    rows = df.select(F.col(key), F.col(json_text).alias("__json"))

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                try:
                    found.append([] if text is None else [re.sub("[\ud800-\udfff]", "\ufffd", p) for p in _prompts(json.loads(text))])
                except (ValueError, RecursionError):
                    found.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "__prompts"])

    schema = StructType([rows.schema[key], StructField("__prompts", ArrayType(StringType()))])
    return rows.mapInArrow(run, schema).select(key, F.explode("__prompts").alias("prompt"))


def manifest(df: DataFrame, id_column: str) -> DataFrame:
    """One row: rows, least and greatest id, and a digest of the content."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"), content_fingerprint(df).alias("fingerprint")
    )


canonical_text = t.canonical_newlines
