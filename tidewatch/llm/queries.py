"""The registered queries of the corpus operators and the SQL some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (alignment, decontaminate, grammar, html_extract, licences, line_dedup, mixing, ngram_join, passages,
                           quality, secret_scan, shards, whitening)
from tidewatch.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op9_quality_rules", quality.sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and verdict of every document, with cutoffs certified on the labels."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    rows = quality.verdicts(docs, read(spark, folder, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", *(F.col(f"cut_{r.name}") for r in quality.DEFAULT_RULES))


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its place in 24 contiguous shards of nearly equal bytes."""
    rows = shards.placed(read(spark, folder, "documents").select("doc_id", "text"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in a mix in which no source comes more than twice as often as another."""
    rows = mixing.mixed(read(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "source", "tokens", "copy", "passes", "mix_order")


@query("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that a near copy elsewhere makes redundant, with the line that stays."""
    return line_dedup.removals(read(spark, folder, "documents").select("doc_id", "text"))


@query("op8_ngram_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links."""
    return ngram_join.joined(read(spark, folder, "documents").select("doc_id", "text")).drop("h")


@query("op10_substring_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of 50 words or more that repeats across documents."""
    return passages.repeats(read(spark, folder, "documents").select("doc_id", "text"))


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed patterns and values that are costly to guess."""
    return secret_scan.scanned(read(spark, folder, "documents").select("doc_id", "text"))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that leaked into a document, verbatim or with other numbers and names."""
    return decontaminate.leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark")).drop("h")


@query("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(read(spark, folder, "pages").select("page_id", "url", "html"))


@query("op3_license_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The licences that every document's paragraphs grant."""
    return licences.document_licences(read(spark, folder, "documents").select("doc_id", "text"))


@query("op11_token_files")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it comes back from token files compressed by grammars."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return grammar.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers cut every document into."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rows = alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.scored(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the leading 32 whitened components."""
    return whitening.whitened(read(spark, folder, "embeddings").select("vec_id", "embedding"))
