"""The registered queries: each applies its operator to a whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.llm import byte_pairs, exact, identifiers, language_model, link_graph, main_text, mixing, packing, resampling, rules, simhash, substrings, whitening
from tallyhouse.llm.common import WORD, SharedFolder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mixing.mix(docs, SharedFolder.of(spark), word_count(docs["text"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = SharedFolder.of(spark).fresh("token-files")
    packing.write_token_files(
        documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return packing.read_token_files(spark, path)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), SharedFolder.of(spark))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), SharedFolder.of(spark))
    return found.select("doc_id", "fingerprint", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = rules.cascade(documents(spark, sf_dir), figures=figures)
    return judged.select("doc_id", *figures, "base_failed", "kept")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = link_graph.judge(table(spark, sf_dir, "pages"), SharedFolder.of(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"), SharedFolder.of(spark))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.personal_data(documents(spark, sf_dir), SharedFolder.of(spark))
    counts = [f"n_{kind}" for kind in identifiers.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def byte_pair_digests(docs: DataFrame) -> DataFrame:
    coded = byte_pairs.byte_pair_ids(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair_digests(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), SharedFolder.of(spark))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), SharedFolder.of(spark))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), SharedFolder.of(spark))
    spread = white.select("*", F.posexplode("whitened").alias("at", "value"))
    return spread.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(documents(spark, sf_dir), SharedFolder.of(spark))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_lm_scores": op3_lm_scores,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_main_text": op7_main_text,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_whitening": op12_whitening,
    "op13_substring_dedup": op13_substring_dedup,
}
