"""A training-data pipeline over `documents`: each stage is written as Parquet and read again by the next.

All stages read whole texts. Of every stage: columns beyond those of documents pass through, whatever their names; a null text
counts as empty; an empty table gives no rows; a null doc_id is an id of its own kind, which equals only itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import line_dedup, mixing, near_dedup, quality, segmentation
from gritstone.llm.common import scratch, stored
from gritstone.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go; it is fitted on the labels of documents that came in.

    Repeated rows go or stay together. Without labelled documents all stay, as every score is 0.5.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each. All rows stay; a text may become empty, and a null one does.

    Repeated rows are one document and lose the same lines.
    """
    return line_dedup.line_dedup(docs, counts=False)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the rows of the smallest doc_id stay; texts without words and null ids stay."""
    return near_dedup.without_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Texts without words go; rows equal in doc_id, source and text count once,
    with the copies of all."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, as ids with inclusion scores. Repeated rows have equal ones; an empty text has one, of no piece."""
    return segmentation.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("sentencepiece sampling", encode_stage),
]

#: The first and last stages are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that the mix takes, as often as it takes it; what a stage has stored goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
