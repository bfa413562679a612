"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one with the
packed pieces. run() writes each stage's result to the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import line_dedup, mixing, packing, quality, simhash
from voltlake.llm.common import cut, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.judge(docs, read(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document holds first go; n_chars is that of the text left."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat(mixing.mix(docs), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: The learned rules, fingerprints and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
