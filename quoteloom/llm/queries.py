"""The queries of the operators; ``__spark_entry__`` adds them to the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, media, ngram_join, pieces, quality, ranked_search, substring_dedup, token_files, tool_calls, turn_repair, vector_search, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.ordered(tool_calls.link(calls, results, tool_calls.ASK, scope="conversation"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), percent=75)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), size=5, percent=75)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), pieces.model_path(), n=3)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), token_files.vocabulary_path(), end_id=2)
    return token_files.read_token_files(manifest)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=1000))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), n=35)


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_line_dedup": op3_line_dedup,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_media_columns": op7_media_columns,
        "op8_token_files": op8_token_files,
        "op9_warc": op9_warc,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_vector_search": op11_vector_search,
        "op12_ranked_search": op12_ranked_search,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": ngram_join.ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE, "op11_vector_search": vector_search.ORACLE, "op12_ranked_search": ranked_search.ORACLE}
