"""The corpus pipeline: its stages, in order, each over all that the one before it kept.

All stages but the last return the columns of their input, whatever other
columns it has. The last returns each document that is left with its token ids.
Every stage takes null and empty texts, null and repeated ids, repeated rows and
an empty table; what becomes of them is said for each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm import bpe, linededup, mixing, quality, simhash
from grovekit.storage import discard, materialize, scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones speak for.

    The score depends on the text alone: repeated rows stay or go together, and
    null and empty texts are scored by their length of none.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals.

    No row goes. Null texts stay null, blank lines and rows without id stay as
    they are, rows of one id lose lines by their own text, and rows of equal id
    and text count as one.
    """
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, rows without id last.

    Null and empty texts and those of blanks are one group. Of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw with the sources, languages and topics at their target weights.

    Null sources and languages are values of their own. Texts without words, null
    ones among them, weigh nothing and are drawn with their cell. Rows of one id
    in one cell are drawn alike, rows without id by their text.
    """
    return mixing.mixture(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with their decoded length as a check; a row for each row, and no ids for null and empty texts."""
    out = bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("decoded").cast("long").alias("n_bytes"), "ids")


STAGES = [
    ("quality", good_quality),
    ("lines", unique_lines),
    ("near duplicates", near_unique),
    ("mixture", mixed),
    ("tokens", tokenized),
]
#: The stages' models and samplers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written before the next reads it; tables within a stage go when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as kept:
            docs = materialize(stage(spark, before, sf_dir), "stage")
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
