"""File sources and sinks: discovery, text by kind of file, JSON lines, cached tables, chunk and vector stores, logs.

Extractors read bytes inside Arrow batches, so a file's bytes never leave the executor that read it.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import formats
from gritstone.functions import text as T
from gritstone.sources import parsers, tables

SUFFIXES = ("pdf", "docx", "doc", "txt", "md", "dat")
#: An extractor gives pages of text from a file's bytes; `confidence` scores what it gave, from 0 to 1.
Extractor = Callable[[bytes], list[str]]


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, filename, file_size, checksum, suffix, text and content of the files below root, without readmes. text is for files of
    text: bytes that are not UTF-8 go; it is null for the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join((*suffixes, *(s.upper() for s in suffixes))) + "}").load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    files = files.where(~name.isin("readme.md", "readme.txt"))
    suffix = F.element_at(F.split(name, r"\."), -1)
    plain = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select("path", name.alias("filename"), F.col("length").alias("file_size"), F.md5("content").alias("checksum"), suffix.alias("suffix"), F.when(suffix.isin("txt", "md", "dat"), plain).alias("text"), "content")


def docx_text(content: bytes) -> str:
    """Paragraphs, tables as `[TABLE]` blocks of `cell | cell` lines, then headers and footers of a .docx file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
        blocks = list(body) if body is not None else []
        out += [said(b) for b in blocks if b.tag == f"{space}p" and said(b).strip()]
        for block in blocks:
            if block.tag == f"{space}tbl":
                rows = [" | ".join(said(c).strip() for c in row.iter(f"{space}tc")) for row in block.iter(f"{space}tr")]
                out.append("[TABLE]\n" + "\n".join(rows))
        for kind in ("header", "footer"):
            for name in sorted(n for n in archive.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", n)):
                text = said(ElementTree.fromstring(archive.read(name))).strip()
                out += [f"[{kind.upper()}] {text}"] if text else []
    return "\n".join(out)


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\[\]()])*\]\s*TJ|T\*|Td|TD|'", re.DOTALL)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def pdf_pages(content: bytes) -> list[str]:
    """Texts of a simple PDF's content streams, plain or deflated, in Latin script without embedded encodings: a page for each
    stream that shows text. For anything beyond that hand over an extractor of your own."""
    pages = []
    for match in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        data = match.group(1)
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        parts: list[str] = []
        for block in re.findall(rb"BT(.*?)ET", data, re.DOTALL):
            for token in _SHOWN.findall(block):
                if token in (b"T*", b"Td", b"TD", b"'"):
                    parts.append("\n")
                    continue
                for raw in _STRING.findall(token):
                    parts.append(re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), raw, flags=re.DOTALL).decode("latin-1"))
            parts.append("\n")
        text = re.sub(r"\n+", "\n", "".join(parts)).strip()
        if text:
            pages.append(text)
    return pages


def confidence(text: str, pages: int) -> float:
    """0 for a blank text; 0.8, 0.1 more for 1500 to 8000 signs a page, 0.3 less under 500, 0.05 more over 50 words."""
    if not text.strip():
        return 0.0
    per = len(text) / max(1, pages)
    return min(1.0, max(0.0, 0.8 + (0.1 if 1500 <= per <= 8000 else -0.3 if per < 500 else 0.0) + (0.05 if len(text.split()) > 50 else 0.0)))


def best_extraction(content: bytes, always: dict[str, Extractor], fallback: dict[str, Extractor], ocr: dict[str, Extractor]) -> tuple[str, float, list[str]]:
    """(method, confidence, pages) of the best extractor: all of `always`; `fallback` if the best is below 0.7; `ocr` if it is below 0.5
    or has under 100 signs a page. A later one must score more; an ocr text wins by half the length again as well. An extractor that fails gives nothing."""
    best: tuple[str, float, list[str]] = ("none", 0.0, [])

    def attempt(extractors: dict[str, Extractor], longer: bool = False) -> None:
        nonlocal best
        for name, extract in extractors.items():
            try:
                pages = extract(content)
            except Exception:  # noqa: BLE001 - a broken file or library is one failed method
                continue
            text = "\n".join(pages)
            score = confidence(text, len(pages))
            if score > best[1] or (longer and len(text) > 1.5 * len("\n".join(best[2]))):
                best = (name, score, pages)

    attempt(always)
    if best[1] < 0.7:
        attempt(fallback)
    if best[1] < 0.5 or len("".join(best[2])) < 100 * max(1, len(best[2])):
        attempt(ocr, True)
    return best


def read_documents(files: DataFrame, pdf: dict[str, Extractor] | None = None, pdf_fallback: dict[str, Extractor] | None = None, ocr: dict[str, Extractor] | None = None, doc: Extractor | None = None) -> DataFrame:
    """A row for each page of a PDF and for each other file: source, filename, page, text, method, confidence, file_size, checksum, warnings.

    files come from discover. Files of text are read as they are, .docx with its tables, .pdf by the best extractor, .doc by `doc`
    (0.9), which has to be given. A file that nothing could read is one row without text and with a warning.
    """
    always, fallback, seen = pdf or {"streams": pdf_pages}, pdf_fallback or {}, ocr or {}
    # text is decoded by built-in expressions; only files of other kinds go to Python
    plain = files.where("text is not null").select("path", "filename", F.lit(None).cast("int").alias("page"), "text", F.lit("text").alias("method"), F.lit(1.0).alias("confidence"), "file_size", "checksum")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for r in pdf_.itertuples():
                method, score, pages = "none", 0.0, []
                if r.suffix == "pdf":
                    method, score, pages = best_extraction(r.content, always, fallback, seen)
                elif r.suffix in ("docx", "doc") and (r.suffix == "docx" or doc):
                    try:
                        pages = [docx_text(r.content)] if r.suffix == "docx" else ["\n".join(doc(r.content))]
                        method, score = r.suffix, 0.95 if r.suffix == "docx" else 0.9
                    except Exception:  # noqa: BLE001
                        pages = []
                for n, text in enumerate(pages or [""]):
                    rows.append((r.path, r.filename, n if r.suffix == "pdf" else None, text, method, score, r.file_size, r.checksum))
            out = pd.DataFrame(rows, columns=["path", "filename", "page", "text", "method", "confidence", "file_size", "checksum"])
            yield out.astype({"page": "Int32"})

    schema = "path string, filename string, page int, text string, method string, confidence double, file_size long, checksum string"
    other = files.where("text is null").select("path", "filename", "suffix", "content", "file_size", "checksum").mapInPandas(extract, schema)
    both = plain.unionByName(other).withColumnRenamed("path", "source")
    picks = F.contains(F.lower("filename"), F.lit("well_picks"))
    return both.withColumns({"warnings": formats.extraction_warnings(F.col("text"), F.col("confidence"), F.col("file_size")), "is_well_picks": picks})


def is_scanned(first_page: Column) -> Column:
    """Whether a PDF is a scan: its first page has under 50 signs."""
    return F.length(F.trim(F.coalesce(first_page, F.lit("")))) < 50


def read_picks(files: DataFrame) -> DataFrame:
    """The picks of the .dat files among files."""
    lines = files.where("suffix = 'dat'").select(F.col("path").alias("source"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    return parsers.parse_picks(lines)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, checksum) the manifest does not hold."""
    return files.join(manifest.select("path", "checksum"), ["path", "checksum"], "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def cached_table(spark: SparkSession, path: str, files: DataFrame, parse: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The rows that parse makes of files, kept at path with the files' checksums, read from there while those stay the same.

    Without files the kept table is served, and without that an empty one. parse's rows go by `source`, a file's path: only new
    and changed files are parsed, and rows of files that are gone leave.
    """
    kept = exists(spark, f"{path}/manifest")
    if files.isEmpty():
        return spark.read.schema(schema).parquet(f"{path}/rows") if kept else spark.createDataFrame([], schema)
    own = files.select("path", "checksum")
    known = spark.read.schema("path string, checksum string, generation string").parquet(f"{path}/manifest") if kept else None
    if known is not None and own.join(known, ["path", "checksum"], "left_anti").isEmpty() and known.join(own, ["path", "checksum"], "left_anti").isEmpty():
        return spark.read.schema(schema).parquet(f"{path}/rows")
    fresh = parse(files if known is None else changed(files, known))
    if known is not None:
        same = known.join(own, ["path", "checksum"], "left_semi").select(F.col("path").alias("source"))
        fresh = fresh.unionByName(spark.read.schema(schema).parquet(f"{path}/rows").join(same, "source", "left_semi"))
    fresh.write.mode("overwrite").parquet(f"{path}/next")
    spark.read.schema(schema).parquet(f"{path}/next").write.mode("overwrite").parquet(f"{path}/rows")
    own.withColumn("generation", F.lit("1")).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_lexical(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of id, text and perhaps tokens; where those are absent they are made again."""
    rows = spark.read.schema("id string, text string, tokens array<string>").json(path)
    return rows.withColumn("tokens", F.coalesce("tokens", T.tokens(F.col("text"))))


def write_lexical(chunks: DataFrame, path: str) -> None:
    """Chunks (id, text) with their tokens as JSON lines."""
    chunks.select("id", "text", T.tokens(F.col("text")).alias("tokens")).write.mode("overwrite").json(path)


def write_vectors(chunks: DataFrame, embeddings: DataFrame, path: str, key: str = "doc_id") -> None:
    """The vector store: chunks with their embeddings, by document type, so that picks are read alone."""
    kind = F.coalesce(F.col("document_type") if "document_type" in chunks.columns else F.lit(None).cast("string"), F.lit("text"))
    chunks.join(embeddings, key).withColumn("document_type", kind).write.mode("overwrite").partitionBy("document_type").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vector store, null if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def fetch(store: DataFrame, sources: DataFrame | None = None, picks: bool | None = None, most: int = 10_000) -> DataFrame:
    """Chunks of the named sources, of picks alone, or both: the first `most` by doc_id, the fetch's own limit."""
    out = store.join(sources.select("source").distinct(), "source", "left_semi") if sources is not None else store
    return (out.where(F.col("is_well_picks") == picks) if picks is not None else out).orderBy("doc_id").limit(most)


def read_metrics(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The last rows of a log of JSON lines by time; malformed lines go."""
    rows = spark.read.schema("timestamp string, metric string, value double, metadata map<string,string>").option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp")).where("ts is not null").orderBy(F.desc("ts")).limit(last)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics (ts, metric, value, metadata) behind a log of JSON lines."""
    metrics.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), "metric", "value", "metadata").write.mode("append").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Extracted texts with all that is known of them; a folder for each source, so files of one name don't overwrite each other."""
    documents.withColumn("source_key", F.md5(F.col("source").cast("binary"))).write.mode("overwrite").partitionBy("source_key").parquet(path)


def write_evaluation(measures: DataFrame, path: str) -> None:
    measures.coalesce(1).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def section_store(documents: DataFrame) -> DataFrame:
    """The sections of read_documents' rows."""
    return tables.parse_sections(documents.select("source", "page", "text"))
