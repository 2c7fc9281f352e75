"""Registered queries of the dealt operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bladewatch.llm import (
    collocations, lexical_search, license_scan, line_dedup, mixing, ngram_join, oracles, packing, sentence_spans, suffixes,
    url_graph, vector_graph, warc, weak_rules)
from bladewatch.llm.common import table


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/")]


def op1_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.repeated_passages(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_host_graph": op1_host_graph,
    "op2_bounded_packing": op2_bounded_packing,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_sparse_suffixes": op4_sparse_suffixes,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_vector_graph": op7_vector_graph,
    "op8_license_scan": op8_license_scan,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_source_mix": op10_source_mix,
    "op11_line_runs": op11_line_runs,
    "op12_lexical_scan": op12_lexical_scan,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = oracles.SQL
