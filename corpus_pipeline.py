"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents. Between stages the rows are written to the shared folder
and read again, so that each stage starts from data that no lost executor can take away.

Defined cases: null and empty texts, and all others below ten words, are rejected by the first
stage; of repeated rows, as of other copies, one stays; very long texts are handled whole; an empty
table gives no rows; further columns, of whatever names, are handed on up to packing, which returns
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breachlens.llm import jaccard, packing, quality, registry, suffix_dedup
from breachlens.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles and a similarity of 0.8 tie together, the
    first stays."""
    return jaccard.deduplicate(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur twice go, in all their places and however few bytes they
    have; documents that were nothing else go too. Repeats of 400 bytes and more are among
    them unless their words are long: 50 words or fewer stay, whatever their bytes."""
    return suffix_dedup.cleaned(docs, words=51)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, as pieces of sequences of 2048 tokens."""
    return registry.packed_digests(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", pack),
]

#: Tokenizing cannot be expressed in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(spark, docs, f"stage-{name}")
    return docs
