"""From raw documents to packed training sequences, one operator per stage.

Each stage takes ``(spark, docs, sf_dir)``, works on everything its predecessor kept and returns
documents with the columns they came with; the last returns packed pieces. :func:`run` writes
each stage's result to the shared folder and reads it again for the next, so a lost executor
costs part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnish.llm import line_dedup, mixing, packing, quality_rules, simhash
from tarnish.session import discard, materialise
from tarnish.sources.files import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, and all of a host that fails too often, go."""
    return quality_rules.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are deleted from the later one."""
    return line_dedup.cleaned(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays: by SimHash, and
    at a Jaccard of 0.8 over five words."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with the sequence each goes to and its place there."""
    made = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality rules", quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Bitset packing and the Newton iterations have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        if hasattr(before, "scratch_path"):
            discard(before)
        before = docs
    return docs
