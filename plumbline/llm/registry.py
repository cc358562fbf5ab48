"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import quality_cascade

    return quality_cascade(read(spark, sf_dir, "documents"), measures=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontaminate import decontaminate

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.near import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.lm import lm_score

    scores = lm_score(read(spark, sf_dir, "documents"))
    return scores.withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.classifier import classify, grades, train

    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, grades(read(spark, sf_dir, "labels")))).withColumn("rejected", ~F.col("kept"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen side of pair k and conversation 2k + 1 the rejected one."""
    from plumbline.llm.chat import mask_of, preference_pairs, text_of

    pairs = preference_pairs(read(spark, sf_dir, "conversations"), pair=F.floor(F.col("conv_id") / 2), chosen=F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    return pairs.select("pair_id", "n_prompt_turns", "prompt", text_of("chosen").alias("chosen"), mask_of("chosen").alias("chosen_mask"), text_of("rejected").alias("rejected"), mask_of("rejected").alias("rejected_mask"), "tied")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.warc import archive_folder, read_archives, write_archives

    manifest = write_archives(read(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(manifest).select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html import extract_main_text

    return extract_main_text(read(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.centroids import cluster_vectors

    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.repair import repair_conversations

    return repair_conversations(read(spark, sf_dir, "conversations"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.private import KINDS, find_private, labelled_forms, listed, train

    found = find_private(read(spark, sf_dir, "documents"), train(labelled_forms(spark)))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_score": op2_lm_score,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_html_main_text": op7_html_main_text,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_preference_pairs": op9_preference_pairs,
    "op10_decontaminate": op10_decontaminate,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_private_data": op13_private_data,
}
