"""Chunking: headings, sections, greedy packing of sentences, semantic boundaries, scores.

Sentences end at . ! or ? before white space, words are runs of other than white space. A document is one row, so the
sequential packing runs over its sentences inside an Arrow batch; everything before and after it is built-in expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions.wells import stripped

# Kinds of headings in order of precedence, and what makes a sentence technical.
HEADINGS = (
    ("executive_summary", r"executive\s+summary|summary"), ("introduction", r"introduction|overview"), ("methodology", r"methodology|methods|approach"), ("data_analysis", r"data\s+analysis|analysis"),
    ("results", r"results|findings"), ("conclusions", r"conclusion|discussion"), ("recommendations", r"recommendation|advice"), ("appendices", r"appendix|appendices"),
    ("references", r"reference|bibliography"), ("tables", r"table\s+\d+|table\s+of\s+contents"), ("figures", r"figure\s+\d+|list\s+of\s+figures"),
)
TECHNICAL = (
    r"well\s+(?:name|number|id)|wellbore", r"formation|zone|interval|layer", r"porosity|permeability|saturation|resistivity", r"depth|measured\s+depth|true\s+vertical\s+depth",
    r"lithology|rock\s+type|mineralogy", r"oil|water|gas|hydrocarbon|fluid",
)
#: The first three letters of all TECHNICAL words, so that most places of a text are passed by at once.
_TECHNICAL_START = r"(?=[dfghilmoprstwz][aeilnory][acdlnprstuy])"
TERMINAL = r"[.!?:]$"


def words(text: Column) -> Column:
    """Number of runs of other than white space."""
    flat = stripped(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def is_technical(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"(?i){_TECHNICAL_START}(?:{'|'.join(TECHNICAL)})"))


def heading_kind(line: Column) -> Column:
    """The kind of heading that a line is, null if none: 10 signs or more, a heading's word, and the letters of a title.

    A title's words each begin with a capital and go on in small letters, or it has no small letters, or it has a second
    capital before any small letter.
    """
    low, kind = F.lower(line), None
    for name, pattern in HEADINGS:
        kind = F.when(F.regexp_like(low, F.lit(pattern)), name) if kind is None else kind.when(F.regexp_like(low, F.lit(pattern)), name)
    title = line.rlike(r"\p{Lu}") & ~line.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return F.when((F.length(stripped(line)) >= 10) & (title | capitals | line.rlike(r"^[A-Z][^a-z]*[A-Z]")), kind)


def headings(text: Column) -> Column:
    """Headings of a text, in order: an array of kind, header, line (from 0) and start (from 0)."""
    lines = F.split(text, "\n")
    every = F.transform(lines, lambda x, i: F.struct(heading_kind(x).alias("kind"), stripped(x).alias("header"), i.alias("line")))
    some = F.filter(every, lambda h: h["kind"].isNotNull())
    start = lambda n: F.when(n > 0, F.aggregate(F.slice(lines, F.lit(1), n), F.lit(0), lambda s, y: s + F.length(y) + 1)).otherwise(0)
    return F.transform(some, lambda h: F.struct(h["kind"].alias("kind"), h["header"].alias("header"), h["line"].alias("line"), start(h["line"]).alias("start")))


def boundaries(text: Column) -> Column:
    """For each sentence of text whether it is a boundary; the first always is.

    A sentence opens a new subject where it is technical or not, with digits or not, otherwise than the one before; or has over 50
    words. The text is cut once, and each sentence looked at once: a lambda's variable holds the marks, which an expression would
    make anew for each sentence.
    """
    over = F.lit(r"^\s*+(?:\S++\s++){50}\S")
    marks = lambda x: F.struct(is_technical(x).alias("t"), x.rlike("[0-9]").alias("d"), F.regexp_like(x, over).alias("w"))
    opens = lambda m: F.transform(m, lambda x, i: (i == 0) | (x["t"] != F.get(m, i - 1)["t"]) | (x["d"] != F.get(m, i - 1)["d"]) | x["w"])
    return F.get(F.transform(F.array(F.transform(T.sentences(text), marks)), opens), F.lit(0))


def strategy(text: Column) -> Column:
    """sections if over three headings are found, else semantic."""
    return F.when(F.size(headings(text)) > 3, "sections").otherwise("semantic")


def _packed(parts: list[tuple[str, int, bool]], size: int, overlap: int, by_meaning: bool) -> list[tuple[list[str], int]]:
    """Sentences (text, words, boundary) into lists of about `size` words, each new one after an overlap with the one before."""
    out: list[tuple[list[str], int]] = []
    held: list[str] = []
    n, back = 0, overlap // 10
    for text, count, boundary in parts:
        full = bool(held) and n + count > size
        if full or (by_meaning and boundary and len(held) > 3):
            out.append((held, n))
            repeated = (held[-back:] if back else []) if by_meaning or len(held) > 2 else []
            held = [*repeated, text]
            n = sum(len(x.split()) for x in held)
        else:
            held = [*held, text]
            n += count
    if held:
        out.append((held, n))
    return out


def pack_chunks(docs: DataFrame, size: int = 500, overlap: int = 150, least: int = 20) -> DataFrame:
    """Greedy packing of sentences into chunks of `size` words: doc_id, chunk_id, text, token_count, sentence_count.

    A new chunk repeats the last overlap // 10 sentences of one with more than two, all of one with fewer than that. Chunks under
    `least` words go; numbers are given before. Null texts give no rows.
    """
    parts = docs.select("doc_id", T.sentences(T.clean(F.col("text"))).alias("parts")).where("parts is not null")

    def pack(batches):
        for pdf in batches:
            rows = []
            for doc, parts in zip(pdf["doc_id"], pdf["parts"], strict=True):
                for n, (held, count) in enumerate(_packed([(p, len(p.split()), False) for p in parts], size, overlap, False)):
                    if count >= least:
                        rows.append((doc, n, " ".join(held), count, len(held)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "text", "token_count", "sentence_count"])

    return parts.mapInPandas(pack, "doc_id long, chunk_id long, text string, token_count long, sentence_count long")


def cleaned(text: Column) -> Column:
    """Text as the chunker reads it: clean, and without the lines that head and foot pages."""
    return stripped(T.drop_headers_footers(T.clean(text)))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, header, start, text: the stretches from heading to heading; what stands before the first is dropped."""
    own = docs.select("doc_id", cleaned(F.col("text")).alias("t")).withColumn("h", headings(F.col("t")))
    each = own.select("doc_id", "t", "h", F.posexplode("h").alias("section", "own"))
    end = F.coalesce(F.get(F.col("h"), F.col("section") + 1)["start"], F.length("t"))
    return each.select("doc_id", "section", F.col("own.header").alias("header"), F.col("own.start").alias("start"), F.substring(F.col("t"), F.col("own.start") + 1, end - F.col("own.start")).alias("text"))


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 150, least: int = 20) -> DataFrame:
    """Chunks of documents: doc_id, seq, chunk_id, text, token_count, sentence_count, section_header, strategy, confidence.

    Documents with more than three headings are cut at them, and sections over 1.5 * size words packed, with chunk_id from 0 in
    each; others are packed with breaks at boundaries, each chunk repeating up to overlap // 10 sentences. Chunks under
    `least` words go; one that ends within a sentence loses it, if another is left. Null and blank texts give no rows.
    A document that could not be cut, having no sentence, is one chunk.
    """
    text = cleaned(F.col("text"))
    own = docs.select("doc_id", text.alias("t")).where(F.length("t") > 0)
    marked = own.withColumns({"h": headings(F.col("t")), "s": T.sentences(F.col("t")), "b": boundaries(F.col("t"))})
    meant = marked.where(F.size("h") <= 3).select("doc_id", F.lit(0).alias("section"), F.lit(None).cast("string").alias("header"), "s", "b", F.lit("semantic").alias("strategy"), F.lit(None).cast("string").alias("whole"))
    cut = sections(docs.join(marked.where(F.size("h") > 3).select("doc_id"), "doc_id", "left_semi"))
    long_ = words(F.col("text")) > size * 1.5
    cut = cut.select("doc_id", "section", "header", T.sentences(F.col("text")).alias("s"), F.transform(T.sentences(F.col("text")), lambda x: F.lit(False)).alias("b"), F.lit("sections").alias("strategy"), F.when(~long_, stripped(F.col("text"))).alias("whole"))

    def pack(batches):
        for pdf in batches:
            rows = []
            for doc, section, header, s, b, how, whole in zip(pdf["doc_id"], pdf["section"], pdf["header"], pdf["s"], pdf["b"], pdf["strategy"], pdf["whole"], strict=True):
                if whole is not None:
                    packs = [([whole], len(whole.split()))]
                    counts = [len(s)]
                else:
                    packs = _packed([(x, len(x.split()), bool(y)) for x, y in zip(s, b, strict=True)], size, overlap, how == "semantic")
                    counts = [len(held) for held, _ in packs]
                for n, ((held, count), k) in enumerate(zip(packs, counts, strict=True)):
                    rows.append((doc, section, n, " ".join(held), count, k, header, how))
            yield pd.DataFrame(rows, columns=["doc_id", "section", "chunk_id", "text", "token_count", "sentence_count", "section_header", "strategy"])

    schema = "doc_id long, section int, chunk_id long, text string, token_count long, sentence_count long, section_header string, strategy string"
    return post_processed(meant.unionByName(cut).mapInPandas(pack, schema), least)


def post_processed(chunks: DataFrame, least: int = 20) -> DataFrame:
    """Without chunks under `least` words, each cut back to whole sentences where more than one is there, with its confidence."""
    s = T.sentences(F.col("text"))
    short = ~F.col("text").rlike(TERMINAL) & (F.size(s) > 1)
    cut = F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), " ")
    kept = chunks.where(F.col("token_count") >= least).withColumn("cut_", short)
    kept = kept.withColumns({"sentence_count": F.when(F.col("cut_"), (F.size(s) - 1).cast("long")).otherwise(F.col("sentence_count")), "text": F.when(F.col("cut_"), cut).otherwise(F.col("text"))})
    kept = kept.withColumn("token_count", F.when(F.col("cut_"), words(F.col("text")).cast("long")).otherwise(F.col("token_count"))).drop("cut_")
    score = T.chunk_confidence(words(F.col("text")), F.col("text").rlike(TERMINAL), is_technical(F.col("text")), F.size(T.sentences(F.col("text"))), F.col("token_count"))
    return kept.withColumn("confidence", score)


def enriched(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Chunks with is_toc, is_well_picks and document_type: a source named after well picks makes its chunks picks."""
    picks = F.contains(F.lower(source), F.lit("well_picks"))
    return chunks.withColumns({"is_toc": T.is_toc(F.col("text")), "is_well_picks": picks, "document_type": F.when(picks, "well_picks")})


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """doc_id, total_chunks, avg_chunk_size, total_tokens, sections: of each document's chunks."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.avg("token_count").alias("avg_chunk_size"), F.sum("token_count").alias("total_tokens"), F.countDistinct("section_header").alias("sections"))


