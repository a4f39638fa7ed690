"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes what its predecessor kept (written as Parquet and read again), with the columns of
documents, and returns them; the last returns tokens. Other columns are kept, whatever their names. Repeated
rows, ties, null and very long texts and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.op2_simhash import keep_first
from corpusloom.llm.op4_decontaminate import contamination
from corpusloom.llm.op5_quality import THRESHOLD, score, train
from corpusloom.llm.op8_byte_bpe import digests
from corpusloom.llm.op10_pii import sanitise_documents
from corpusloom.llm.tokenizer_files import path_of, pattern


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    trees = train(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    own = common.fresh("score")
    return score(docs, trees, own).where(F.col(own) >= THRESHOLD).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    own = (common.fresh("words"), common.fresh("spans"), common.fresh("items"))
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"), names=own)
    return found.where(F.size(own[1]) == 0).drop(*own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced; n_chars follows the text."""
    clean = sanitise_documents(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of their decoding, and the ids."""
    # workers are shared with the other stages, hence a smaller memo than the operator's own
    return digests(docs, path_of("byte_bpe_50k.tiktoken"), pattern(), with_ids=True, memory=80_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

#: No stage but the third can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.drop_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
