"""Corpus pipeline: from documents to packed sequences.

Stages, in order: documents of low quality go, one document of each group of near
duplicates stays, repeated strings are cut out of what is left, sources are mixed to
their targets (a document comes as often as its number of copies), and all of it is
packed into sequences. Each stage works on what the one before it kept; all but the
last return the columns of ``documents``.

In every stage a null text counts as empty, rows with a null or repeated id are rows of
their own, null sources form a source, columns of any other name pass through, and an
empty table gives an empty result. Empty texts are scored like others, are never near
duplicates, lose nothing to the removal of repeats, are taken by the mix as often as the
whole part of their source's rate, and are packed as their end mark. Of near duplicates
the smallest id stays; rows with one id are one document there, so that they stay or go
together. Ties elsewhere are broken by hashes of id and size, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import mixing, near_dups, packing, quality_model, suffix_dedup
from tidewatch.llm.common import table
from tidewatch.llm.registered import tokenizer_path
from tidewatch.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.good(docs, table(spark, sf_dir, "labels"))


#: Similarity of word shingles, in hundredths, from which documents of a corpus are near
#: duplicates. The operator's own default is that of the query ``op10``.
NEAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.deduplicate(docs, limit=NEAR)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(docs, with_text=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix", mix),
    ("pack", pack),
]

#: Models, sketches and tokenizers are not SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
