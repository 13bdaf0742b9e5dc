"""Lexical and dense retrieval, fusion, diversification and evaluation over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions import wells
from gritstone.functions.wells import any_in
from gritstone.operators import relational

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, questions: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score for each document that shares a term with a question (others score 0).

    The term statistics are one aggregate over (term, document) counts; questions are short and meet the postings by
    term. Terms in over half of the documents, whose idf is negative, get EPSILON times the mean idf. A question's terms
    count as often as it has them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), T.tokens(F.col(text)).alias("toks"))
    tf = rows.select("doc_id", F.explode("toks").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    # lengths and document frequencies read the counts, not the texts: one exchange serves all three
    length = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("term").alias("terms")).drop("terms")
    whole = docs.agg(F.count("*").alias("n")).crossJoin(tf.agg(F.sum("tf").alias("all"), F.count("term").alias("x"), F.count("doc_id").alias("y"))).select("n", (F.col("all") / F.col("n")).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("tf").alias("df"), F.count("doc_id").alias("y")).drop("y").crossJoin(F.broadcast(whole))  # whole: one row
    idf = df.select("term", "avgdl", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    asked = questions.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.join(idf, "term").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")))
    hits = tf.join(wanted, "term").join(length, "doc_id")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_top(docs: DataFrame, questions: DataFrame, k: int, digits: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank: the k best of all documents, those without a term of the question (score 0) too, ties to the smaller id.

    A question with fewer than k hits is filled up from the 2k smallest ids, of which k at least are no hits of it.
    """
    scored = bm25(docs, questions, doc_id, text).withColumn("score", F.round("score", digits))
    first = docs.select(F.col(doc_id).alias("doc_id")).distinct().orderBy("doc_id").limit(2 * k)
    best = top_k(scored, k)
    rest = questions.select("query_id").crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(best.drop("rank").unionByName(rest.withColumn("score", F.lit(0.0))), k)


def top_k(scored: DataFrame, k: int, by: Iterable[str] = ("query_id",), score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best of each group, by score and then tie; a window limit, so each task keeps k rows a group before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def vector_scores(vectors: DataFrame, questions: DataFrame, measure: Callable[[Column, Column], Column]) -> DataFrame:
    """query_id, vec_id, score of each vector for each of a few questions (query_id, query): these are broadcast by Spark if small."""
    return vectors.join(questions, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", measure(F.col("embedding"), F.col("query")).alias("score"))


def _scores(measure: str, a: pd.Series, b: pd.Series) -> np.ndarray:
    """A row for each of a, a column for each of b: cosine, 0 where there is none, or 1 / (1 + squared distance), else NaN."""
    out = np.full((len(a), len(b)), 0.0 if measure == "cosine" else np.nan)
    sizes = [np.array([-1 if v is None else len(v) for v in s]) for s in (a, b)]
    for n in set(sizes[0]) & set(sizes[1]) - {-1}:
        i, j = (np.flatnonzero(s == n) for s in sizes)
        x, y = (np.array([s.iloc[k] for k in at], float).reshape(len(at), n) for s, at in ((a, i), (b, j)))
        if measure == "cosine":
            norm = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            part = np.where(norm > 0, x @ y.T / np.where(norm > 0, norm, 1), 0.0)
        else:
            part = 1 / (1 + np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
        out[np.ix_(i, j)] = part
    return out


def nearest(vectors: DataFrame, questions: DataFrame, measure: str, k: int, digits: int, question_block: int = 256, vector_block: int = 4096) -> DataFrame:
    """query_id, vec_id, score, rank: the k best vectors of each question (query_id, query) by the score, rounded, and then vec_id.

    Every vector but the question's own is scored (measure: cosine or l2), a block of questions with a block of
    vectors at a time; each pair of blocks keeps k rows a question.
    """
    down, across = (max(1, -(-t.count() // n)) for t, n in ((questions, question_block), (vectors, vector_block)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("q"), upto(across).alias("v"))
    right = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("v"), upto(down).alias("q"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id")
        scores, ids = _scores(measure, a["query"], b["embedding"]), b["vec_id"].to_numpy()
        # halves go away from zero, as Spark and SQL round them
        scores = np.sign(scores) * np.floor(np.abs(scores) * 10.0**digits + 0.5) / 10.0**digits
        found = []
        for q, row in zip(a["query_id"].to_numpy(), scores, strict=True):
            other = np.flatnonzero(ids != q)
            low = np.where(np.isnan(row[other]), np.inf, -row[other])
            if len(low) > k:
                other = other[(near := low <= np.partition(low, k - 1)[k - 1])]
                low = low[near]
            at = other[np.argsort(low, kind="stable")[:k]]
            found.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    tiles = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(tile, "query_id long, vec_id long, score double")
    return top_k(tiles.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))), k, tie="vec_id")


def fuse_reciprocal(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) of each document over the lists; k of 0 or less means 60."""
    k = k if k > 0 else 60
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def fuse_weighted(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Weighted fusion of two lists with `score` and 0-based place `idx`.

    A dense hit scores 0.65 score + 0.35 / (1 + idx), and a later hit of a document replaces an earlier one; a lexical
    hit scores 0.55 of its share of the highest score + 0.45 / (1 + idx), and replaces only a smaller score.
    """
    d = dense.withColumn("s", 0.65 * F.col("score") + 0.35 / (1 + F.col("idx"))).groupBy("query_id", "doc_id").agg(F.max_by("s", "idx").alias("dense"))
    top = F.max("score").over(W.partitionBy("query_id"))
    x = lexical.withColumn("top", top).withColumn("s", 0.55 * F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) + 0.45 / (1 + F.col("idx")))
    x = x.groupBy("query_id", "doc_id").agg(F.max("s").alias("lexical"))
    return d.join(x, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.greatest("dense", "lexical").alias("score"))


def diversify(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over query_id, doc_id, score, embedding (and idx, the place they came in): query_id, doc_id, place.

    The first is the most relevant; each next one has the largest trade * score - (1 - trade) * its largest similarity to
    those before, 0 at least. Ties go to the smaller doc_id. k candidates or fewer stay in the order they came in (by idx, or
    by score). Candidates are a top-k list, so a group is small.
    """
    came = ["idx", "doc_id"] if "idx" in candidates.columns else ["score", "doc_id"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= k:
            pdf = pdf.sort_values(came, ascending=[came[0] == "idx", True])
            return pd.DataFrame({"query_id": pdf["query_id"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "place": np.arange(1, len(pdf) + 1)})
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        x = np.array([np.asarray(v, float) for v in pdf["embedding"]])
        norm = np.linalg.norm(x, axis=1)
        sim = (x @ x.T) / np.where(np.outer(norm, norm) > 0, np.outer(norm, norm), 1)
        score, left, taken = pdf["score"].to_numpy(float), list(range(len(pdf))), []
        while left and len(taken) < k:
            value = [trade * score[i] - (1 - trade) * max([0.0, *(sim[i, j] for j in taken)]) if taken else score[i] for i in left]
            taken.append(left.pop(int(np.argmax(value))))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[taken].to_numpy(), "doc_id": pdf["doc_id"].iloc[taken].to_numpy(), "place": np.arange(1, len(taken) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, place long")


def merge_diversified(candidates: DataFrame, k_final: int, trade: float = 0.7, least: int = 24) -> DataFrame:
    """The diversified ten or k_final first, then the rest as they were, max(k_final, least) in all: query_id, doc_id, place."""
    picked = diversify(candidates, max(k_final, 10), trade).select("query_id", "doc_id", "place")
    rest = candidates.select("query_id", "doc_id", F.col("idx").cast("long").alias("place"))
    return relational.ordered_union([picked, rest], ["query_id", "doc_id"], "place").where(F.col("place") <= max(k_final, least))


# Acronyms, and words that name kinds of reports and evaluation parameters with what is searched as well.
ACRONYMS = (
    ("owc", "oil-water contact"), ("odt", "oil down to"), ("goc", "gas-oil contact"), ("rkb", "rotary kelly bushing"), ("md", "measured depth"), ("tvd", "true vertical depth"), ("tvdss", "true vertical depth sub sea"),
    ("wlc", "well log correlation wireline logging composite"), ("lfp", "log formation parameters low frequency permeability"), ("dato", "data report"), ("cpi", "composite petrophysical interpretation"),
)
REPORTS = (
    ((("wlc",), ("wireline",), ("composite", "report")), "wlc wireline logging composite composite report well log correlation wlc_petrophysical_composite"),
    ((("lfp",), ("low frequency", "permeability")), "lfp low frequency permeability log formation parameters lfp report"),
    ((("dato",),), "dato data report dato report"),
    ((("cpi",), ("composite", "petrophysical", "interpretation")), "cpi composite petrophysical interpretation"),
)
PARAMETERS = (
    ((("matrix density",), ("matrix dens",)), (), ("rhoma", "ρma", "rho ma", "matrix density", "evaluation parameters", "evaluation parameter table")),
    ((("fluid density",), ("fluid dens",)), (), ("rhofl", "ρfl", "rho fl", "fluid density", "evaluation parameters", "evaluation parameter table")),
    ((("density",),), ("matrix", "fluid"), ("rhoma", "rhofl", "ρma", "ρfl", "matrix density", "fluid density", "evaluation parameters")),
    ((("grmax",), ("gr max",)), (), ("gamma ray max", "gr maximum", "evaluation parameters", "evaluation parameter table")),
    ((("grmin",), ("gr min",)), (), ("gamma ray min", "gr minimum", "evaluation parameters", "evaluation parameter table")),
    ((("archie",),), (), ("archie a", "archie m", "archie n", "tortuosity", "cementation exponent", "saturation exponent", "evaluation parameters")),
)


def expanded(question: Column, most: int = 6) -> Column:
    """Variants of a question, itself first: with acronyms and report names written out, with each of three synonyms of a parameter,
    with its well spelled in other ways; distinct but for case, `most` in all."""
    low, none = F.lower(question), F.array().cast("array<string>")
    holds = lambda ways: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in way)) for way in ways))
    terms = [F.when(low.rlike(rf"\b{a}\b"), full) for a, full in ACRONYMS] + [F.when(holds(ways), words) for ways, words in REPORTS]
    more = F.array_compact(F.array(*terms))
    whole = F.when(F.size(more) > 0, F.array(F.concat(question, F.lit(" "), F.array_join(more, " ")))).otherwise(none)
    synonyms = F.concat(*(F.when(holds(ways) & ~any_in(low, no) if no else holds(ways), F.array(*map(F.lit, words))).otherwise(none) for ways, no, words in PARAMETERS))
    named = F.transform(F.filter(F.slice(synonyms, 1, 3), lambda s: ~F.contains(low, s)), lambda s: F.concat(question, F.lit(" "), s))
    raw = wells.found(question, wells.SECTION_WELL)
    tight = F.regexp_replace(raw, r"\s+", "")
    split = F.when(tight.rlike(r"(?i)f\d"), F.array(F.regexp_replace(tight, r"(?i)f(\d+)", "f-$1"), F.regexp_replace(tight, r"(?i)f-(\d+)", F.concat(F.lit("f"), F.regexp_extract(tight, r"(?i)f(\d+)", 1))))).otherwise(none)
    spelled = F.concat(F.array(F.translate(tight, "_-", "//"), F.translate(tight, "/-", "__"), F.translate(tight, "/_", "--"), raw), split)
    ways = F.slice(F.array_sort(F.array_distinct(F.concat(spelled, F.transform(spelled, lambda v: F.concat(F.lit("Well "), v))))), 1, 6)
    by_well = F.when(raw.isNotNull(), F.transform(F.filter(ways, lambda v: ~F.contains(question, v)), lambda v: F.replace(question, raw, v))).otherwise(none)
    every = F.transform(F.concat(F.array(question), whole, named, by_well), lambda x: F.trim(x))
    return F.slice(T.distinct_ignoring_case(F.filter(every, lambda x: x != "")), 1, most)


def hybrid(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, questions: DataFrame, k_final: int = 10, fusion: str = "weighted", scorer: Callable[[DataFrame], DataFrame] | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """The retrieval from end to end: query_id, doc_id, place, k_final for each question.

    dense and lexical are ranked lists (query_id, variant, doc_id, score, rank from 1) over all variants of the questions. They are
    fused with weights (places run across the variants) or by reciprocal ranks, tables of contents leave unless the question asks
    for them, the result is diversified, scored again by `scorer` (overlap by default) over 24, and last put in the order that
    a model `chosen` (query_id, chosen), where there is one.
    """
    across = lambda df: df.withColumn("idx", F.row_number().over(W.partitionBy("query_id").orderBy("variant", "rank")) - 1)
    if fusion == "weighted":
        fused = fuse_weighted(across(dense).select("query_id", "doc_id", "score", "idx"), across(lexical).select("query_id", "doc_id", "score", "idx"))
    else:
        fused = fuse_reciprocal(dense.select("query_id", "doc_id", "rank").unionByName(lexical.select("query_id", "doc_id", "rank")))
    top = top_k(fused, max(k_final, 24))
    own = top.join(chunks.select("doc_id", "text", "embedding"), "doc_id").join(questions.select("query_id", "query"), "query_id")
    own = own.where(~T.is_toc(F.col("text")) | T.wants_toc(F.col("query"))).withColumn("idx", F.col("rank"))
    order = merge_diversified(own.select("query_id", "doc_id", "score", "embedding", "idx"), k_final)
    scored = (scorer or overlap_scores)(order.join(own.select("query_id", "doc_id", "text", "query"), ["query_id", "doc_id"]))
    placed = scored.withColumn("idx", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place")) - 1).select("query_id", "doc_id", "idx")
    if chosen is not None:
        placed = merge_order(placed.join(chosen, "query_id", "left"), F.coalesce("chosen", F.array().cast("array<int>")))
    else:
        placed = placed.withColumn("place", F.col("idx") + 1)
    return placed.where(F.col("place") <= k_final).select("query_id", "doc_id", "place")


def whole_documents(hits: DataFrame, general: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Document-level retrieval: all chunks of the documents that the hits come from, with a citation: query_id, doc_id, text, cite.

    To the hits on picks come general hits of sources not there yet, the first of each, where a question asks for all or found
    nothing. A question that names one well, and does not list all, keeps the sources and then the chunks of that well.
    """
    members, kept = document_classes(hits, general, chunks, questions)
    return members.join(kept, ["source", "about"]).select("query_id", "doc_id", "text", "cite")


def document_classes(hits: DataFrame, general: DataFrame, chunks: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """whole_documents in classes: its members (query_id, source, about: the one well that is asked for, else empty) and the chunks of each
    class (source, about, doc_id, text, cite). Questions on a well share the chunks, which are compared with it once."""
    low = F.lower("query")
    many = any_in(low, ("all", "every", "each", "list", "summary", "overview"))
    listed = any_in(low, ("list", "each", "all", "every")) & any_in(low, ("formation", "well picks", "all wells"))
    asked = questions.select("query_id", "query", wells.retriever_well(F.col("query")).alias("well"), many.alias("many"), listed.alias("listed"))
    own = hits.select("query_id", "source", "filename").distinct()
    empty = asked.join(own, "query_id", "left_anti").select("query_id", F.lit(True).alias("empty"))
    open_ = asked.join(empty, "query_id", "left").where(F.col("many") | F.col("empty")).select("query_id")
    more = general.select("query_id", "source", "filename").distinct().join(open_, "query_id", "left_semi").join(own.select("query_id", "source"), ["query_id", "source"], "left_anti")
    sources = own.unionByName(more).join(asked, "query_id")
    single = F.col("well").isNotNull() & ~F.col("listed")
    fits = wells.source_of_well(F.col("well"), F.col("source"), F.col("filename"))
    sources = sources.withColumn("fits", single & F.coalesce(fits, F.lit(False))).withColumn("some", F.max("fits").over(W.partitionBy("query_id"))).where("fits or not some")
    members = sources.select("query_id", "source", F.when(single, F.col("well")).otherwise("").alias("about")).distinct()
    found = chunks.join(members.select("source", "about").distinct(), "source")
    kept = found.where((F.col("about") == "") | wells.mentions_well(F.col("about"), F.col("text"), F.col("source"), F.col("filename")))
    return members, kept.select("source", "about", "doc_id", "text", F.concat(F.lit("["), T.format_cite(F.col("source"), F.col("page"), F.col("page")), F.lit("]")).alias("cite"))


def fusion_hits(weighted: DataFrame, reciprocal: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, weighted, reciprocal: whether the expected file is among the results of either fusion (query_id, source)."""
    marked = lambda df, name: df.join(expected.withColumnRenamed("source", "want"), "query_id").where(F.contains("source", F.col("want"))).select("query_id").distinct().withColumn(name, F.lit(True))
    both = expected.select("query_id").distinct().join(marked(weighted, "weighted"), "query_id", "left").join(marked(reciprocal, "reciprocal"), "query_id", "left")
    return both.select("query_id", F.coalesce("weighted", F.lit(False)).alias("weighted"), F.coalesce("reciprocal", F.lit(False)).alias("reciprocal"))


def by_file(hits: DataFrame) -> DataFrame:
    """Hits of chunks (query_id, source, rank) as ranked files: each file name once, at its best place, ranked anew."""
    name = F.element_at(F.split(F.replace("source", F.lit("\\"), F.lit("/")), "/"), -1)
    best = hits.select("query_id", name.alias("doc_id"), "rank").where("doc_id <> ''").groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("best", "doc_id"))).drop("best")


def overlap_scores(pairs: DataFrame, query: str = "query", text: str = "text", chars: int = 512) -> DataFrame:
    """A stand-in for a cross-encoder: the share of the question's tokens in the first 512 characters."""
    q, t = F.array_distinct(T.tokens(F.col(query))), T.tokens(F.substring(F.col(text), 1, chars))
    return pairs.withColumn("score", F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0))


def merge_order(candidates: DataFrame, chosen: Column) -> DataFrame:
    """Places after a reranker named some: those in its order (unknown places dropped), then the rest as they were."""
    at = F.array_position(chosen, F.col("idx"))
    return candidates.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.when(at > 0, 0).otherwise(1), F.when(at > 0, at), "idx")))


def evaluate(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """query_id, k, precision, recall, rr and ndcg of ranked runs (query_id, doc_id, rank) against qrels (query_id, doc_id).

    Precision is over what was retrieved, up to k. Gains are binary; the ideal has min(relevant, k) of them at the top.
    Without relevant documents recall is 1 if nothing was retrieved either, else 0.
    """
    marked = runs.join(qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return evaluate_marked(marked, qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel")), ks)


def evaluate_marked(marked: DataFrame, total: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """evaluate, of runs whose rows say if they are relevant (rel, 0 or 1), with n_rel of each query_id."""
    each = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.col("rank") <= F.col("k")
    found = each.groupBy("query_id", "k").agg(
        F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias("hits"), F.sum(F.when(inside, 1).otherwise(0)).alias("shown"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    ).join(total, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.col("k")), lambda i: i <= F.col("n_rel")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return found.select(
        "query_id", "k", F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(F.when(F.col("shown") == 0, 1.0).otherwise(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )
