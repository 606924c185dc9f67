"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thriftline.llm import bm25, chat, collocations, histogram_sort, jaccard_join, lang_id, line_dedup, pfair, prefix_trie, secrets, sentencepiece_fst, url_filter, vp_tree
from thriftline.llm.common import table


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.query(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.query(table(spark, sf_dir, "documents"))


def op3_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.query(table(spark, sf_dir, "embeddings"))


def op4_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.query(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(table(spark, sf_dir, "documents"))


def op8_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.expand_targets(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.query(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bm25_top_k, op2_sentencepiece, op3_vp_tree_neighbours, op4_histogram_sort_sharding, op5_pfair_mix, op6_line_dedup, op7_jaccard_join, op8_chat_prefix_targets, op9_language_id, op10_url_filters, op11_phrase_collocations, op12_prefix_trie, op13_secret_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_bm25_top_k": bm25.SQL, "op5_pfair_mix": pfair.SQL, "op6_line_dedup": line_dedup.SQL, "op7_jaccard_join": jaccard_join.SQL, "op8_chat_prefix_targets": chat.SQL, "op10_url_filters": url_filter.SQL, "op11_phrase_collocations": collocations.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_secret_scan": secrets.SQL}
