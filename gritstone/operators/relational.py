"""Joins, aggregates and window shapes of the lookup and monitoring paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_match(asked: DataFrame, store: DataFrame, rules: Sequence[tuple[Column, Column]], asked_id: str, order: str) -> DataFrame:
    """Cascade: the rules are equalities of a key of `asked` with a key of `store`; the first rule that hits wins, then `order`.

    Each rule is an equi-join over what no earlier rule resolved, so a later, looser rule reads only the rest.
    """
    out, rest = None, asked
    for n, (left, right) in enumerate(rules):
        keyed = store.withColumn("key_", right)
        hits = rest.withColumn("key_", left).join(keyed, "key_").drop("key_")
        best = hits.withColumn("n_", F.row_number().over(W.partitionBy(asked_id).orderBy(order))).where("n_ = 1").drop("n_").withColumn("rule", F.lit(n))
        rest = rest.join(best.select(asked_id), asked_id, "left_anti")
        out = best if out is None else out.unionByName(best)
    return out


def left_with_coverage(left: DataFrame, right: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Left outer lookup with the number of rows and of rows with a value, per group."""
    return left.join(right, on, "left").groupBy(group).agg(F.count("*").alias("n_all"), F.count(value).alias("n_found"))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df as the broadcast side of a join, after a check of its number of rows; larger tables are an error."""
    rows = df.limit(most + 1).count()
    if rows > most:
        raise ValueError(f"a side of a nested loop has over {most} rows")
    return F.broadcast(df)


def _prefixes(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(key, F.lit(1), n))


def prefix_join(left: DataFrame, right: DataFrame, a: Column, b: Column, left_id: str, order: str) -> DataFrame:
    """Left outer join where either key begins with the other; of several, equality and then `order` wins.

    Two equality joins: on the prefixes of the left key, and on those of the right one; no pair is tried that does not match.
    """
    ours, theirs = left.withColumn("a_", a), right.withColumn("b_", b)
    longer = ours.select(left_id, "a_", F.explode(_prefixes(F.col("a_"))).alias("k_")).join(theirs.withColumn("k_", F.col("b_")), "k_")
    shorter = ours.select(left_id, "a_", F.col("a_").alias("k_")).join(theirs.withColumn("k_", F.explode(_prefixes(F.col("b_")))), "k_")
    w = W.partitionBy(left_id).orderBy(F.when(F.col("a_") == F.col("b_"), 0).otherwise(1), F.asc_nulls_last(order))
    best = longer.unionByName(shorter).withColumn("n_", F.row_number().over(w)).where("n_ = 1").select(left_id, *right.columns)
    return left.join(best, left_id, "left")


def longest_term(texts: DataFrame, terms: DataFrame, text: str, term: str, text_id: str, gram: int = 3) -> DataFrame:
    """The longest vocabulary term that stands in each text, inside words too, ties to the smaller.

    Terms are met by their first `gram` signs (all of a shorter term), which the text must hold: an equality join that grows
    with the matches, not with texts times terms. Texts that are the same are searched once.
    """
    every, texts = texts.select(text_id, text), texts.select(F.col(text).alias(text_id), text).where(F.col(text).isNotNull()).distinct()
    low = F.lower(text)
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.substring(low, i, n)))))
    keyed = terms.select(term, F.lower(F.substring(term, 1, gram)).alias("g_")).where(F.length(term) > 0)
    hits = texts.select(text_id, text, F.explode(grams).alias("g_")).join(keyed, "g_").where(F.contains(low, F.lower(term)))
    best = hits.groupBy(text_id).agg(F.max_by(term, F.struct(F.length(term), term)).alias(term)).withColumnRenamed(text_id, text)
    return every.join(best, text).select(text_id, term)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def fill_down(df: DataFrame, value: Column, group: str, order: str, name: str) -> DataFrame:
    """The last value at or before each row of its group."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def context(turns: DataFrame, value: Column, name: str, back: int = 24) -> DataFrame:
    """The latest value among a turn and the `back` turns before it."""
    return turns.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, 0)))


def section_ends(sections: DataFrame, group: str, pos: str, level: str, levels: Sequence[int] | None = None) -> DataFrame:
    """end_pos: the place of the first later heading of the same or a higher rank; null for the last ones.

    One running value for each of the few levels, read from the end of a group to its start, so the work is linear in its rows.
    """
    if levels is None:
        levels = [r[0] for r in sections.select(level).where(F.col(level).isNotNull()).distinct().limit(65).collect()]
        if len(levels) > 64:
            raise ValueError("more than 64 levels of headings")
    w = W.partitionBy(group).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, -1)
    out = F.lit(None).cast(sections.schema[pos].dataType)
    for n in sorted(levels):
        out = F.when(F.col(level) == n, F.last(F.when(F.col(level) <= n, F.col(pos)), ignorenulls=True).over(w)).otherwise(out)
    return sections.withColumn("end_pos", out)


def accepted(scored: DataFrame, group: str, score: str, tie: str, threshold: float, margin: float) -> DataFrame:
    """The best candidate, the margin to the runner-up, and whether both suffice."""
    w = W.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumns({"n_": F.row_number().over(w), "second_": F.lead(score).over(w)})
    gap = F.col(score) - F.coalesce("second_", F.lit(0.0))
    return ranked.where("n_ = 1").withColumn("ok", (F.col(score) >= threshold) & (gap >= margin)).drop("n_", "second_")


def metric_stats(events: DataFrame, metric: str, value: str) -> DataFrame:
    return events.groupBy(metric).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))


def histogram(events: DataFrame, metric: str, value: str, order: Sequence[Column], last: int = 1000) -> DataFrame:
    """Summary of the last 1000 values; a percentile is the value at place int(n * p) of the sorted ones, from 0."""
    recent = events.withColumn("n_", F.row_number().over(W.partitionBy(metric).orderBy(*order))).where(F.col("n_") <= last)
    sorted_ = recent.groupBy(metric).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda p: F.element_at("v", (F.floor(F.size("v") * p) + 1).cast("int"))
    return sorted_.select(metric, F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def resample(events: DataFrame, ts: str, value: str, minutes: int = 5) -> DataFrame:
    """Tumbling bins with mean and sum, empty bins too (null mean, sum 0)."""
    size = f"{minutes} minutes"
    bins = events.groupBy(F.window(ts, size).alias("w")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total")).select(F.col("w.start").alias("bin"), "mean", "total")
    span = bins.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {size}"))).alias("bin"))
    return every.join(bins, "bin", "left").select("bin", "mean", F.coalesce("total", F.lit(0.0)).alias("total"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Rows with a session number per key: a new one begins after a gap."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.lag(F.unix_timestamp(F.col(ts).cast("timestamp"))).over(w)
    return events.withColumn("session", F.sum(F.when(gap > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def group_index(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The rows of a key as one array, in their order: an index by key."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: F.struct(*(r[v].alias(v) for v in values))).alias("rows"))


def one_metric(metrics: DataFrame, name: str, last: int) -> DataFrame:
    """count, mean, min and max of one metric among the last rows of a log (the limit comes before the filter); one row of zeros without any."""
    recent = metrics.orderBy(F.desc("ts"), F.desc("event_id")).limit(last).where(F.col("metric") == name)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return recent.agg(F.count("value").alias("n"), zero(F.avg("value")).alias("mean"), zero(F.min("value")).alias("least"), zero(F.max("value")).alias("most"))


def counters(events: DataFrame, name: Column, amount: Column) -> DataFrame:
    """Counters by name; tags of events are not looked at."""
    return events.select(name.alias("name"), amount.alias("x")).groupBy("name").agg(F.sum("x").alias("total"))


def gauges(events: DataFrame, name: Column, value: str, ts: str, tie: str) -> DataFrame:
    """The latest value of each name."""
    return events.withColumn("name", name).groupBy("name").agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def tracked(queries: DataFrame, keep: int = 100) -> DataFrame:
    """A row for each measure of a query that is not null: query (its first `keep` signs), metric, value."""
    parts = {
        "query.total_time": "total_time", "query.retrieval_time": "retrieval_time", "query.llm_time": "llm_time", "query.tokens.input": "input_tokens", "query.tokens.output": "output_tokens",
        "query.retrieval.num_docs": "num_docs", "query.cache.hit": "cache_hit",
    }
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("value")) for k, v in parts.items()))
    return queries.select("query_id", F.substring("query", 1, keep).alias("query"), F.explode(F.filter(each, lambda m: m["value"].isNotNull())).alias("m")).select("query_id", "query", "m.*")


def ordered_union(parts: Sequence[DataFrame], key: Sequence[str], order: str) -> DataFrame:
    """The parts one behind the other, each key once, where it came first: with place, from 1."""
    tagged = [p.withColumn("part_", F.lit(n)) for n, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    first = whole.withColumn("n_", F.row_number().over(W.partitionBy(*key).orderBy("part_", order))).where("n_ = 1")
    group = [k for k in key if k == "query_id"]
    return first.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("part_", order))).drop("n_", "part_")


def resolve_file(asked: DataFrame, files: DataFrame) -> DataFrame:
    """ask_id, path: the file for each asked path. files: path and name; top says that it lies in the folder itself.

    In order: the well's folder and the name joined by _, the name, the name in any folder, the well's folder before a name that
    ends with it, the name in any case, a name that holds the other. The last rule compares texts; it is asked only for what no
    other found, and files must be a table of bounded size.
    """
    steps = F.filter(F.split(F.replace("asked", F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    named = asked.select("ask_id", F.element_at(steps, -1).alias("want"), F.try_element_at(F.filter(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), lambda p: p.rlike(r"^\d+[\s_/-]*\d+")), F.lit(-1)).alias("well"))
    top = files.where("top")
    tight = F.concat_ws("_", "well", "want")
    rules = [(F.when(F.col("well").isNotNull(), tight), F.col("name"), top), (F.col("want"), F.col("name"), top), (F.col("want"), F.col("name"), files)]
    hits, rest = None, named
    for n, (left, right, where) in enumerate(rules):
        best = rest.withColumn("k_", left).join(where.withColumn("k_", right), "k_").groupBy("ask_id").agg(F.min("path").alias("path")).withColumn("rule", F.lit(n))
        rest = rest.join(best, "ask_id", "left_anti")
        hits = best if hits is None else hits.unionByName(best)
    low = top.withColumn("low", F.lower("name")).where(F.endswith("low", F.lit(".pdf")))
    want = F.lower("want")
    prefixed = F.col("well").isNotNull() & F.startswith("name", F.concat("well", F.lit("_"))) & F.endswith("name", F.col("want"))
    for n, rule in enumerate((prefixed, F.col("low") == want, F.contains("low", want) | F.contains(want, F.col("low"))), 3):
        best = rest.join(small(low), rule).groupBy("ask_id").agg(F.min("path").alias("path")).withColumn("rule", F.lit(n))
        rest = rest.join(best, "ask_id", "left_anti")
        hits = hits.unionByName(best)
    return hits
