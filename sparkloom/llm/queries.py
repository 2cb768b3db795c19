"""Queries over the driver's tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


#: Fixed values of the query: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.katz import score

    return score(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.pieces import sampled

    return sampled(table(spark, sf_dir, "documents"), piece_model(), k=2)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.sharding import assign

    placed = assign(table(spark, sf_dir, "documents"), shards=40, virtual=64, slack=0.0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "own_shard"
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.fingerprint import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard import Threshold, components

    return components(table(spark, sf_dir, "documents"), width=4, rule=Threshold(85))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least=30, most=50)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64)


#: Fixed value of the query: what both turns of conversation -1 say.
SPOKEN = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.chat import digests, formatted

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SPOKEN), (-1, 1, "assistant", SPOKEN)], rows.schema)
    return digests(formatted(rows.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_chat_formatting": op13_chat_formatting,
    "op2_url_filters": op2_url_filters,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_secret_scans": op4_secret_scans,
    "op5_html_extraction": op5_html_extraction,
    "op6_sharding": op6_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_document_fingerprints": op9_document_fingerprints,
}
