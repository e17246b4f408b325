"""The operators as queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (collocations, context_trees, html_text, license_scan, mixing, near_dups, neighbours, packing, quality_model, quality_rules,
                           sharding, suffix_dedup, whitening)
from tidewatch.llm.common import table
from tidewatch.llm.oracle import ORACLE  # noqa: F401  the queries' SQL, by name


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"), license_scan.known(spark))


def op2_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op4_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"),
                                  table(spark, folder, "labels"))


def op5_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return (mixing.copies(table(spark, folder, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "source", "copies"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op8_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return (sharding.shard(docs, [1.0] * 8, grow_by=1.0)
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                    "grown_shard"))


def op9_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.lit(quality_rules.mask("base"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words",
                      (F.col("failed_rules").bitwiseAND(base) != 0).alias("base_failed"),
                      quality_rules.kept("2024-2").alias("kept"), "n_lines", "n_capitals",
                      "n_exclamations", "failed_rules")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.link(table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return context_trees.score(table(spark, folder, "documents"), held_out)


REGISTRY = {
    "op1_license_scan": op1_license_scan,
    "op2_projected_neighbours": op2_projected_neighbours,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_page_text": op5_page_text,
    "op6_source_mix": op6_source_mix,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_rule_ledger": op9_rule_ledger,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_context_tree_scores": op13_context_tree_scores,
}
