"""The queries of the training-data operators with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, html_text, neardup, oracle, order_minhash, packing, personal_data, repair, toxicity, url_filter
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_text_density_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(spark, table(spark, sf_dir, "documents"))


def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match", "longest_at")  # SQL checks the rest


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(spark, table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_host_trust_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(spark, table(spark, sf_dir, "pages"))


#: Both texts of conversation -1 hold control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op10_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.tree(spark, rows.union(added)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_text_density_extraction": op1_text_density_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_repair_token_files": op3_repair_token_files,
    "op4_weak_supervision_pii": op4_weak_supervision_pii,
    "op5_boosted_toxicity": op5_boosted_toxicity,
    "op6_suffix_array_decontamination": op6_suffix_array_decontamination,
    "op7_order_minhash": op7_order_minhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_host_trust_urls": op9_host_trust_urls,
    "op10_prefix_tree_chat": op10_prefix_tree_chat,
}
SQL: dict[str, str] = oracle.sql(CONTROL)
