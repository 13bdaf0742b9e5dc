"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import ann, exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, segmentation, token_output, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, and how many lines there were and went."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract asks for each row's digest, so full hashes are made in the one scan; groups are refined in steps."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_tokens(token_output.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, n_licenses, and the names, coverages and places of those found."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.col("licenses.license").alias("names"), F.col("licenses.coverage").alias("coverages"),
        F.col("licenses.start").alias("starts"), F.col("licenses.end").alias("ends"),
    )


def op6_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: ids, lengths, checksums, log probabilities and inclusion scores of its sampled segmentations."""
    return segmentation.sample_segmentations(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).totals().select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_exact_dedup, op4_token_output, op5_license_scan, op6_sampled_segmentations, op7_source_mix, op8_url_filter, op9_near_dedup, op10_nearest_neighbours)}
