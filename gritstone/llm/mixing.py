"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.llm.common import SPACES, free_names, scratch, stored, text_of

#: Points of the schedule: n * GOLDEN mod 2**31, GOLDEN being 2**31 divided by the golden ratio, in whole numbers.
MODULUS, GOLDEN = 1 << 31, 1_327_217_885
CELLS = 4096


def word_count(column: str = "text") -> Column:
    """Number of runs of other than white space; null: 0."""
    flat = F.trim(F.regexp_replace(text_of(column), SPACES, " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def running_before(df: DataFrame, group: str, bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of value over the earlier rows of the same group, earlier by (bucket, order).

    No task holds a group: sums run within buckets, over buckets within 1024 of them, and over those. The
    rows are read twice, so df should be a stored table. Adds `place`, the row's number in its bucket.
    """
    df = df.withColumn("v_", value)
    per_bucket = df.groupBy(group, bucket).agg(F.sum("v_").alias("v_")).withColumn("high_", F.shiftright(bucket, 10))
    highs = per_bucket.groupBy(group, "high_").agg(F.sum("v_").alias("h_"))
    before = W.partitionBy(group).orderBy("high_").rowsBetween(W.unboundedPreceding, -1)
    highs = highs.select(group, "high_", F.coalesce(F.sum("h_").over(before), F.lit(0)).alias("h_"))
    within = W.partitionBy(group, "high_").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.withColumn("b_", F.coalesce(F.sum("v_").over(within), F.lit(0))).join(highs, [group, "high_"])
    starts = starts.select(group, bucket, (F.col("b_") + F.col("h_")).alias("b_"))
    rows = W.partitionBy(group, bucket).orderBy(*order)
    own = F.coalesce(F.sum("v_").over(rows.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # starts grows with df: never broadcast, and the window has dealt df by the same keys
    return df.withColumns({"place": F.row_number().over(rows), "o_": own}).join(starts.hint("merge"), [group, bucket]).withColumn(name, F.col("b_") + F.col("o_")).drop("v_", "b_", "o_")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, k (its place by code point, null last), source_size, target.

    The sources share all words by weight; a target stops at cap times its source's size, and the excess is
    shared again by weight. One small sum over the table of sources for each round of sharing.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = stored(ranked.select("source", "k", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most")), "mix-sources")
    total, share = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(1.0))).first()
    level = total / share
    while True:
        full = F.col("w") * F.lit(level) > F.col("most")
        above, open_ = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        after = (total - above) / open_ if open_ else level
        if after <= level:
            break
        level = after
    return ranked.select("source", "k", "source_size", F.least(F.col("w") * F.lit(level), F.col("most").cast("double")).alias("target"))


@dataclass
class Mixture:
    """docs: a row per document with its place in its source's shuffled words; slots: the schedule."""

    docs: DataFrame
    slots: DataFrame
    block: int

    def segments(self) -> DataFrame:
        """A row for each document in each block: the words [a, b) of its source, by k and blk; blk null without words."""
        first, last = F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)
        return self.docs.withColumn("blk", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))

    def pieces(self) -> DataFrame:
        """The mix itself, in order of (slot, k, r, start): words [from_word, to_word) of each document."""
        both = self.segments().where("blk is not null").join(self.slots.hint("merge"), ["k", "blk"]).where("greatest(start, a) < least(start + size, b)")
        return both.select("slot", "k", "r", "epoch", "doc_id", "start", F.expr("greatest(start, a) - start").alias("from_word"), F.expr("least(start + size, b) - start").alias("to_word"))

    def totals(self) -> DataFrame:
        """A row per document: doc_id, size, source_size, target, taken, and what else docs carries as `key`."""
        used = self.slots.groupBy("k", "blk", "a", "b").agg(F.count("*").alias("times"))
        words = F.expr("coalesce(greatest(least(start + size, b) - greatest(start, a), 0) * times, 0)")
        same = ["doc_id", "key", "k", "bucket", "place", "size", "source_size", "target"]
        return self.segments().join(used.hint("merge"), ["k", "blk"], "left").groupBy(*same).agg(F.sum(words).cast("long").alias("taken")).drop("k", "bucket", "place")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 2048, key: Column | None = None) -> Mixture:
    """Plan a mix of as many words as docs has, sources weighing 1, 2, 3, repeating, by code point (null last).

    The documents of a source, shuffled by the md5 of doc_id, are one stream of words, cut into blocks of
    `block` words. Slot n of the schedule has the point n * GOLDEN mod 2**31; the source whose stretch of
    the cumulative targets holds that point gets the slot, and the r-th slot of a source takes block
    r mod (its blocks), in epoch r div (its blocks). A source stops at its target, within its last block; the
    few slots by which the points fall short of a target follow at the end (slot = the number of points).
    So each source gives its target rounded down, and no block, so no document, is taken more than `cap` times.

    Null texts and texts without words have size 0 and are never taken. Null sources are one source. Repeated
    rows are documents of their own; rows that share a doc_id keep the same place among the others. Reruns
    agree. A text of any length is counted whole, and fills as many blocks as it needs. Only doc_id, source and
    text are read (and what key reads). An empty table gives no rows. `key` is a column to carry through to totals().
    The table of sources is ranked by one task: it should hold sources, not a row for each document.
    """
    with scratch(docs.sparkSession):
        return _mix(docs, weights, cap, block, key)


def _mix(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int, key: Column | None) -> Mixture:
    columns = ["doc_id", "source", word_count().alias("size"), (key if key is not None else F.lit(None).cast("long")).alias("key")]
    hashed = docs.select(*columns).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sizes = stored(hashed, "mix-sizes")
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(31, max(0, (rows // 256).bit_length()))
    sources = stored(targets(sizes, weights, cap), "mix-targets")
    bucket = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits)
    known = sizes.withColumn("bucket", bucket).join(sources.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "source")
    placed = running_before(stored(known, "mix-known"), "k", "bucket", [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    return Mixture(stored(placed, "mix-docs", keep=True), _schedule(sources, total, block), block)


def _schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """k, r, slot, epoch, blk, a, b: the words [a, b) of source k, which fill the slot."""
    spark = sources.sparkSession
    goal = F.floor("target").cast("long")
    per_epoch = F.floor((F.col("source_size") + (block - 1)) / block)
    plan = sources.where("source_size > 0").withColumns({"goal": goal, "per_epoch": per_epoch, "epochs": F.expr("floor(target) div source_size")})
    plan = plan.withColumn("over", F.col("goal") - F.col("epochs") * F.col("source_size")).withColumn("need", F.col("epochs") * F.col("per_epoch") + F.ceil(F.col("over") / block))
    upto = F.floor(F.sum("target").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) / F.lit(float(max(total, 1))) * MODULUS)
    plan = plan.withColumn("hi", F.when(F.lead("k").over(W.orderBy("k")).isNull(), MODULUS).otherwise(F.least(upto, F.lit(MODULUS))))
    plan = stored(plan.withColumn("lo", F.lag("hi", 1, 0).over(W.orderBy("k"))), "mix-plan")

    cell = MODULUS // CELLS
    stretches = plan.where("lo < hi").select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    points = -(-total // block)
    slots = spark.range(points).withColumnRenamed("id", "slot").withColumn("u", (F.col("slot") % MODULUS) * GOLDEN % MODULUS).withColumn("cell", F.floor(F.col("u") / cell))
    dealt = slots.join(stretches, "cell").where("u >= lo and u < hi").select("k", "slot", F.shiftright("slot", 8).alias("bucket"))
    ranked = running_before(stored(dealt, "mix-dealt"), "k", "bucket", [F.col("slot")], F.lit(1), "r").select("k", "slot", "r")
    ranked = stored(ranked, "mix-ranked")
    have = ranked.groupBy("k").agg(F.count("*").alias("have"))
    short = plan.join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    short = short.select("k", F.lit(points).cast("long").alias("slot"), F.explode(F.sequence("have", F.col("need") - 1)).alias("r"))
    filled = ranked.unionByName(short).join(plan, "k").where("r < need")
    filled = filled.withColumns({"epoch": F.expr("r div per_epoch"), "blk": F.expr("r % per_epoch")}).withColumn("a", F.col("blk") * block)
    full = F.least(F.col("a") + block, "source_size")
    filled = filled.withColumn("b", F.when(F.col("epoch") == F.col("epochs"), F.least(full, "over")).otherwise(full))
    return stored(filled.select("k", "r", "slot", "epoch", "blk", "a", "b"), "mix-slots", keep=True)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole number; columns as in docs.

    A document of which less than half is taken goes, as do null and empty texts, which have no words. Rows that are equal
    in doc_id, source and text are one row that gets the copies of all; of their other columns one row's are kept.
    Null ids, sources and texts are matched as equal. Other columns pass through, whatever their names; texts are whole. An
    empty table gives no rows.
    """
    key_, id_, of_, copies_, n_ = free_names(docs, "key_of_mix", "id_of_mix", "key_of_copies", "copies_of_mix", "n_of_mix")
    key = F.xxhash64("doc_id", "source", "text")
    with scratch(docs.sparkSession):
        plan = mix(docs.select("doc_id", "source", "text"), key=key, **options).totals()
        copies = plan.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(of_)).agg(F.sum(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias(copies_))
        copies = stored(copies.where(F.col(copies_) > 0), "mix-copies", keep=True)
    whole = docs.withColumn(key_, key).dropDuplicates(["doc_id", key_])
    both = whole.join(copies.hint("merge"), (F.col(key_) == F.col(of_)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    return both.withColumn(n_, F.explode(F.sequence(F.lit(1), copies_))).select(*docs.columns)
