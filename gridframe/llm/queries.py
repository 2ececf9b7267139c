"""Driver queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm.common import table
from gridframe.llm.oracles import ORACLES  # noqa: F401


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, num=80, den=100)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.decontaminate import contaminated_pairs

    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.drop("row_key", "row_tag")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.bpe import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.suffix_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents"), length=400).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "text",
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridframe.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), min_chars=5, min_count=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroids": op12_centroids,
    "op13_variants": op13_variants,
}
