"""The corpus pipeline: five stages from documents to token ids, each on all that the one before kept.

Null, empty, very long and repeated texts are handled as each operator's module states; an empty table
passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules
from verbatlas.session import discard, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a low score go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or lie beyond their group's limits go."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each component stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as its rate says, once at least."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), targets=TARGETS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the number of tokens and the digests of ids and decoded bytes, for each row."""
    return bpe.tokenize_documents(docs)


#: A weight for each domain (language), or None: the domains' own shares, evened out.
TARGETS: dict[str, float] | None = None

STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The classifier, the join and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next one."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:  # nothing reads it any more
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
