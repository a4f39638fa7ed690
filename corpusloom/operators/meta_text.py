"""Scan of texts for words about the making of a data set: what blocks, what is to be assessed, what is allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words to be looked at, and phrases that tell of the making of a data set
TERMS = r"revisions?|references?|papers?|reviews?|reviewer"
META = r"assistant-authored|assistant-proposed|dataset-construction|annotation (?:feedback|status)|absent from model input"
#: fixed values: fields of an application's contract
FIELDS = ("model_revision", "data_revision", "code_revision", "source_revision", "tokenizer_revision")
SOURCES = ("source", "model", "data", "code", "tokenizer", "effective")


def findings(df: DataFrame, terms: str = TERMS, meta: str = META, key: str = "id") -> DataFrame:
    """(id, line, term, status, reason) of df(id, text, roots array<string>), lines from 1.

    A phrase of ``meta`` blocks. A name (letters, digits and low lines) that holds one of ``terms`` between signs that are no
    letters is allowed as a field of the contract, as a revision of a source or model named before it, or as a declared
    root (compared without - and _, in lower case) in a code fence or in backticks; else it is to be assessed. A line of
    three backticks opens or closes a fence and is outside neither. Null texts have no findings, null roots declare
    nothing. Each name of a line counts. Fences are counted over a text's lines, in one window a text.
    """
    lines = df.select(F.col(key).alias("id"), F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), F.posexplode(F.split("text", "\n")).alias("p", "l"))
    fences = F.sum(F.startswith(F.ltrim("l"), F.lit("```")).cast("int")).over(Window.partitionBy("id").orderBy("p"))
    low = lines.withColumn("fenced", fences % 2 == 1).where(F.col("l").rlike(f"(?i){terms}|{meta}"))
    found = low.select("id", "p", "l", "fenced", "roots")
    blocks = found.select("id", "p", F.explode(F.regexp_extract_all("l", F.lit(f"(?i)(?:{meta})"), F.lit(0))).alias("term")).select(
        "id", (F.col("p") + 1).cast("long").alias("line"), "term", F.lit("block").alias("status"), F.lit("commentary on the making of the data").alias("reason")
    )
    # names with what stands before them: backticks decide whether one is quoted
    pieces = F.regexp_extract_all("l", F.lit("[A-Za-z_][A-Za-z0-9_]*|`|[^A-Za-z_`]+"), F.lit(0))
    listed = found.withColumn("w", pieces).select("id", "p", "fenced", "roots", "w", F.posexplode("w").alias("i", "name"))
    hit = listed.where(F.col("name").rlike(f"(?i)(?<![A-Za-z])(?:{terms})(?![A-Za-z])"))
    ticks = F.size(F.filter(F.slice("w", F.lit(1), F.col("i")), lambda x: x == "`")) % 2 == 1
    before = F.lower(F.get("w", F.col("i") - 2))
    plain = F.lower(F.translate("name", "-_", ""))
    reason = (
        F.when(F.col("name").isin(*FIELDS), "field of the contract")
        .when(F.lower("name").rlike("^revisions?$") & before.isin(*SOURCES), "provenance of a source or model")
        .when(F.array_contains("roots", plain) & (F.col("fenced") | ticks), "declared name")
    )
    told = hit.select("id", (F.col("p") + 1).cast("long").alias("line"), F.col("name").alias("term"), F.when(reason.isNull(), "assess").otherwise("allowed").alias("status"), F.coalesce(reason, F.lit("a word alone proves nothing")).alias("reason"))
    return blocks.unionByName(told).withColumnRenamed("id", key)
