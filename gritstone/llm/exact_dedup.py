"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import SPACES, scratch, stored, text_of


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACES, " ")


def exact_dedup(docs: DataFrame, prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became one space; null counts as
    empty, so null and empty texts are one group. Of a group the smallest doc_id stays (null ids sort last);
    rows that repeat that doc_id with an equal text are one document and all stay. An empty table gives no
    rows; other columns of docs are not read.

    Lengths are grouped first, prefix hashes within the lengths that repeat, and full hashes only within the
    prefixes that repeat. By default only those rows are hashed in full, and text_sha256 is null for the rest;
    digest_all=True hashes each row in the one scan, for callers that want every digest. Texts of any length are read whole.
    """
    with scratch(docs.sparkSession):
        return _exact_dedup(docs, prefix_chars, digest_all)


def _exact_dedup(docs: DataFrame, prefix_chars: int, digest_all: bool) -> DataFrame:
    text = docs.select("doc_id", normalised().alias("t"))
    columns = [F.length("t").alias("n"), F.md5(F.substring("t", 1, prefix_chars)).alias("prefix")]
    digest = F.sha2(F.col("t").cast("binary"), 256).alias("sha")
    rows = stored(text.select("doc_id", *columns, *([digest] if digest_all else [])), "exact-rows", keep=True)
    lengths = stored(rows.groupBy("n").count().where("count > 1").select("n"), "exact-lengths")
    by_length = rows.join(lengths, "n", "left_semi")
    prefixes = stored(by_length.groupBy("n", "prefix").count().where("count > 1").select("n", "prefix"), "exact-prefixes", keep=True)
    if digest_all:
        full = rows.join(prefixes, ["n", "prefix"], "left_semi")
        left = rows
    else:
        full = stored(text.select("doc_id", "t", *columns).join(prefixes, ["n", "prefix"], "left_semi").select("doc_id", "n", "prefix", digest), "exact-full", keep=True)
        rest = rows.join(prefixes, ["n", "prefix"], "left_anti").withColumn("sha", F.lit(None).cast("string"))
        left = full.unionByName(rest)
    groups = full.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return left.join(stored(groups, "exact-groups", keep=True), "sha", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
