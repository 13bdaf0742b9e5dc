"""Line deduplication by a template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import free_names, scratch, stored, text_of

#: Fixed value: what stands for a variable field.
FIELD = "<*>"


def _lines() -> Column:
    return F.split(text_of("text"), "\n")


def plain_lines() -> Column:
    """The lines of text, white space in runs of one space."""
    return F.transform(F.split(F.regexp_replace(text_of("text"), r"[\x20\x09\x0B-\x0D]+", " "), "\n"), lambda x: F.trim(x))


def masked(line: str | Column) -> Column:
    """line with digits replaced by a field."""
    return F.regexp_replace(line, "[0-9]+", FIELD)


def line_templates(docs: DataFrame, min_docs: int = 3, depth: int = 3, similarity: float = 0.7, min_tokens: int = 4, long_tokens: int = 50) -> DataFrame:
    """Lines to drop: doc_id, th (hash of the text), drop (their places, from 0).

    A line of fewer than min_tokens tokens is a template if it stands, digits and all, in min_docs documents.
    The tree of the others has a leaf for each number of tokens and first `depth` tokens, digits masked. Lines
    whose masked form stands in min_docs documents, or in two if they have more than long_tokens tokens, are a
    template as they are. All lines of a leaf that min_docs documents share, those too, are judged by how many
    distinct lines of the leaf have a token in the same place: of a line the `similarity` of its tokens that
    most lines have are constant, with those that as many have; any other token is a field. So a value of a
    field is no constant, however often it recurs, if the line's own constants recur more. Lines with the same
    constants are one template. It is recurring if min_docs documents have it.

    Null texts are one empty line, and empty lines are no line here; only doc_id and text are read, whatever else docs
    holds. Repeated rows are one document, null ids one id. A long text is as many rows as it has lines. An
    empty table gives no rows.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(plain_lines()).alias("i", "line"))
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth))
    base = base.where(F.col("line") != "").withColumn("n", tokens)
    base = base.withColumn("line", F.when(F.col("n") >= min_tokens, masked("line")).otherwise(F.col("line")))
    leaf = F.when(F.col("n") >= min_tokens, leaf)  # shorter lines are not generalised
    need = F.when(F.col("n") > long_tokens, F.least(F.lit(2), F.lit(min_docs))).otherwise(F.lit(min_docs)).cast("int")
    lines = stored(base.select("doc_id", "th", "i", leaf.alias("leaf"), F.unhex(F.md5("line")).alias("key"), need.alias("need")), "line-keys")

    first = F.min(F.struct("doc_id", "th", "i")).alias("first")
    groups = stored(lines.groupBy("leaf", "key", "need").agg(F.countDistinct("doc_id", "th").alias("docs"), first), "line-groups")
    recurring = groups.where(F.col("docs") >= F.col("need")).select("key", "first")

    crowded = groups.where(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("lines")).where((F.col("docs") >= min_docs) & (F.col("lines") > 1))
    variants = stored(groups.join(crowded.select("leaf"), "leaf", "left_semi").select("leaf", "key", "first"), "line-variants")
    wanted = variants.groupBy("first.doc_id", "first.th").agg(F.collect_list(F.struct("first.i", "leaf", "key")).alias("want"))
    wanted = stored(wanted.withColumnRenamed("doc_id", "id_"), "line-wanted").hint("merge")  # as for line-drops
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["id_"]) & (keyed["th"] == wanted["th"])).select(plain_lines().alias("all"), F.explode("want").alias("w"))
    words = found.select("w.leaf", "w.key", F.split(masked(F.element_at("all", F.col("w.i") + 1)), " ").alias("words")).dropDuplicates(["key"])
    at = stored(words.select("leaf", "key", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).where(F.col("at") >= depth), "line-at")
    held = at.groupBy("leaf", "at", "word").agg(F.count("*").alias("held"))
    known = at.join(stored(held, "line-held"), ["leaf", "at", "word"])
    tokens_of = known.groupBy("leaf", "key", "n").agg(F.collect_list(F.struct("held", "at", "word")).alias("all"))
    need = F.greatest(F.ceil(F.col("n") * similarity).cast("int") - depth, F.lit(0))  # besides the leading tokens
    counts = F.sort_array(F.transform("all", lambda x: x["held"]), asc=False)
    least = F.array(F.when(need > 0, F.element_at(counts, F.greatest(need, F.lit(1)))))  # an array: sorted once, not for each token
    shape = F.flatten(F.transform(least, lambda m: F.transform(F.filter("all", lambda x: x["held"] >= m), lambda x: F.struct(x["at"], x["word"]))))
    shape = F.array_join(F.transform(F.sort_array(shape), lambda x: F.concat_ws(" ", x["at"].cast("string"), x["word"])), " ")
    shapes = tokens_of.select("key", F.unhex(F.md5(F.concat_ws("|", F.col("leaf").cast("string"), shape))).alias("shape"))
    general = lines.join(stored(shapes, "line-shapes"), "key").select("doc_id", "th", "i", F.col("shape").alias("key"))
    general = stored(general, "line-general")
    general_groups = general.groupBy("key").agg(F.countDistinct("doc_id", "th").alias("docs"), first).where(F.col("docs") >= min_docs).select("key", "first")

    hits = [part.join(stored(g, "line-recurring"), "key").where(~F.struct("doc_id", "th", "i").eqNullSafe(F.col("first"))) for part, g in ((lines, recurring), (general, general_groups))]
    drops = hits[0].select("doc_id", "th", "i").unionByName(hits[1].select("doc_id", "th", "i"))
    return drops.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("i")).alias("drop"))


def line_dedup(docs: DataFrame, counts: bool = True, **options) -> DataFrame:
    """docs with text without the lines of recurring templates, and (if counts) with n_lines and n_dropped.

    Of a template the first line, by doc_id, the hash of its text and its place, stays; every other line goes, in the
    same document too. Lines of fewer than min_tokens tokens go only where they recur as they are; empty lines stay. Null texts count as
    empty: one empty line, and text comes back empty. Documents are rows by (doc_id, text): repeated rows
    are one document, lose the same lines and all come back; null ids match each other. Other columns
    pass through as they are, whatever their names (with counts, n_lines and n_dropped of the input are replaced). Texts of any
    length are read whole. An empty table gives no rows. Each row comes back, with an empty text if each of its lines went.
    """
    added = ["n_lines", "n_dropped"] if counts else []
    own = docs.select(*(c for c in docs.columns if c not in added))
    hash_, id_, th_, drop_ = free_names(own, "hash_of_text", "id_of_drop", "th_of_drop", "places_of_drop")
    with scratch(docs.sparkSession):
        drops = line_templates(docs.select("doc_id", "text"), **options)
        drops = stored(drops.select(F.col("doc_id").alias(id_), F.col("th").alias(th_), F.col("drop").alias(drop_)), "line-drops", keep=True)
    drops = drops.hint("merge")  # the list grows with docs: one plan for every size
    keyed = own.withColumn(hash_, F.xxhash64("text"))
    both = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(th_)), "left")
    kept = F.filter(_lines(), lambda x, i: ~F.array_contains(F.coalesce(drop_, F.array().cast("array<int>")), i))
    new = F.when(F.col(drop_).isNull(), text_of("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    numbers = {"n_lines": F.size(_lines()).cast("long"), "n_dropped": F.coalesce(F.size(drop_), F.lit(0)).cast("long")}
    return both.select(*(new if c == "text" else F.col(c) for c in own.columns), *(numbers[c].alias(c) for c in added))
