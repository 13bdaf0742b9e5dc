"""Scalar functions over text: keys, cleaning, redaction, predicates and formats. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical token, and the patterns that queries, validators and redaction use.
TOKEN = r"([a-z0-9]+(?:[/-][a-z0-9]+)*)"
DANGEROUS = (r"<script", r"javascript:", r"onerror=", r"onload=", r"eval\(", r"exec\(")
DANGEROUS_QUERY = (*DANGEROUS, r"import\s+os", r"__import__", r"subprocess", r"shell\s*=")
DANGEROUS_NAME = (r"<script", r"javascript:", r"\.\./", r"\.\.\\")
REDACTIONS = (
    (r"[A-Z]:\\[^\s]+", "[FILE_PATH]"),
    (r"/[^\s]+", "[FILE_PATH]"),
    (r"\.\./[^\s]+", "[FILE_PATH]"),
    (r"\.\\[^\s]+", "[FILE_PATH]"),
    (r"sk-[a-zA-Z0-9]{10,}", "[API_KEY]"),
    (r"(?i)api[_-]?key\s*[:=]\s*[^\s]+", "api_key=[REDACTED]"),
    (r"(?i)password\s*[:=]\s*[^\s]+", "password=[REDACTED]"),
    (r"(?i)secret\s*[:=]\s*[^\s]+", "secret=[REDACTED]"),
    (r"(?i)token\s*[:=]\s*[^\s]+", "token=[REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"(?s)Traceback \(most recent call last\):.*", "[STACK_TRACE]"),
    (r'File "[^"]+", line \d+.*', "[STACK_TRACE]"),
    (r"C:\\Users\\[^\\]+", "[USER_HOME]"),
    (r"/home/[^/]+", "[USER_HOME]"),
)
UNFINISHED_VERBS = ("was", "is", "has", "did", "will", "were", "are", "have", "had", "would", "could", "should")
UNFINISHED_WORDS = ("and", "or", "but")
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f]"


def tokens(text: Column) -> Column:
    """Lexical tokens: ASCII letters and digits, joined by single / or -."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def well_key(name: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^0-9A-Z]+", "")


def picks_well_key(name: Column) -> Column:
    """As well_key, without the words WELL and NO."""
    return well_key(F.replace(F.replace(F.upper(name), F.lit("WELL"), F.lit("")), F.lit("NO"), F.lit("")))


def strip_first_suffix(key: Column, suffixes: tuple[str, ...] = ("PETROPHYSICAL", "FORMATION", "REPORT")) -> Column:
    """Without the first of suffixes that the key ends with."""
    out = None
    for s in suffixes:
        hit, cut = F.endswith(key, F.lit(s)), F.substring(key, F.lit(1), F.length(key) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(key)


def strip_suffixes(key: Column, suffixes: tuple[str, ...] = ("PARAMETER", "EVALUATION", "PARAMETERS", "TABLE")) -> Column:
    """Without each of suffixes in turn."""
    for s in suffixes:
        key = F.regexp_replace(key, f"{s}$", "")
    return key


def canonical_well(name: Column) -> Column:
    """`15_9_F_5`, `15-9 F5` and the like as `15/9-F-5`."""
    steps = ((r"_", "/"), (r" ", ""), (r"^([0-9]+)-([0-9]+)", "$1/$2"), (r"^([0-9]+/[0-9]+)/", "$1-"), (r"^([0-9]+/[0-9]+)([A-Z])", "$1-$2"), (r"([A-Z])/?([0-9])", "$1-$2"), (r"-{2,}", "-"))
    out = F.upper(name)
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return out


def formation_key(name: Column, keep_fm: bool = True) -> Column:
    """Upper case without FORMATION, letters and digits only; keep_fm keeps FM, as picks do and properties do not."""
    out = F.replace(F.replace(F.upper(name), F.lit("FORMATION"), F.lit("")), F.lit("FM."), F.lit("FM"))
    return F.regexp_replace(out if keep_fm else F.replace(out, F.lit("FM"), F.lit("")), "[^0-9A-Z]+", "")


def canonical_token(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ρ"), F.lit("rho")), "[^a-z0-9]", "")


def extract_well(text: Column) -> Column:
    """The first well name in text, canonical: the platform form first, then the plain one; null if none."""
    up = F.upper(text)
    platform = F.regexp_extract(up, r"([0-9]{1,2}[/_-][0-9]{1,2}[-_ ]?[A-Z][-_ ]?[0-9]+[A-Z]?)", 1)
    plain = F.regexp_extract(up, r"([0-9]{1,2}[/_-][0-9]{1,2}[-_][0-9]+[A-Z]?)", 1)
    return canonical_well(F.coalesce(F.nullif(platform, F.lit("")), F.nullif(plain, F.lit(""))))


def clean(text: Column) -> Column:
    """At most one empty line in a row, one space for runs of space and tab, plain dashes, no white space at the ends."""
    out = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "[–—]", "-"), r"^[ \n]+|[ \n]+$", "")


def drop_headers_footers(text: Column, least: int = 10) -> Column:
    """In texts of 10 lines or more, without lines of digits, and lines that begin with page N, confidential or draft."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.regexp_like(F.lower(F.trim(x)), F.lit(r"^([0-9]+$|page [0-9]+|confidential|draft)")))
    return F.when(F.size(lines) >= least, F.array_join(kept, "\n")).otherwise(text)


def redact(text: Column) -> Column:
    for pattern, new in REDACTIONS:
        text = F.regexp_replace(text, pattern, F.lit(new))
    return text


def without_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def is_dangerous(text: Column, patterns: tuple[str, ...] = DANGEROUS) -> Column:
    return F.regexp_like(F.lower(text), F.lit("|".join(patterns)))


def query_error(text: Column, longest: int = 2000) -> Column:
    """Why a question is refused: empty, too_long or dangerous; null for a good one."""
    return F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty").when(F.length(text) > longest, "too_long").when(is_dangerous(without_control(text), DANGEROUS_QUERY), "dangerous")


def name_error(text: Column, longest: int = 50, digit: bool = True) -> Column:
    """Why a name is refused: a well has up to 50 signs and a digit, a formation up to 100."""
    bare = F.regexp_replace(text, r"[\x00-\x1f]", "")
    out = F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty").when(F.length(text) > longest, "too_long")
    out = out.when(~bare.rlike("[0-9]"), "no_digit") if digit else out
    return out.when(is_dangerous(bare, DANGEROUS_NAME), "dangerous")


def is_unfinished(query: Column) -> Column:
    """Ends with dots, a dangling verb or conjunction (a full stop may follow), or says of a well that it `was`."""
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    ends = "|".join((*UNFINISHED_VERBS, *UNFINISHED_WORDS))
    return F.endswith(q, F.lit("...")) | F.regexp_like(F.lower(q), F.lit(rf" (?:{ends})\.?$")) | F.regexp_like(q, F.lit(r"(?i)(?:Wellbore|Well)\s+[A-Z0-9/_-]+\s+was\s*\.\.?\.?$"))


def is_toc_line(line: Column) -> Column:
    """A dotted leader to a number, or a short line that spaces part from a number at its end."""
    return line.rlike(r"\.{4,}\s*\d+\s*$") | (line.rlike(r"\s{2,}\d+\s*$") & (F.length(F.regexp_replace(line, r"^\s+|\s+$", "")) < 80))


def wants_toc(query: Column) -> Column:
    low = F.lower(query)
    return F.contains(low, F.lit("table of contents")) | F.contains(low, F.lit("toc")) | F.contains(low, F.lit("page"))


def is_toc(text: Column) -> Column:
    """A table of contents: two dotted leaders, or one and over 40 % of lines that lead to a number."""
    lines = F.split(text, "\n")
    dotted = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"\.{4,}\s*[0-9]+\s*$"))))
    short = F.size(F.filter(lines, lambda x: (F.length(x) < 60) & F.regexp_like(x, F.lit(r"[0-9]+\s*$")) & ~F.regexp_like(x, F.lit(r"\.{4,}\s*[0-9]+\s*$"))))
    return (dotted >= 2) | ((dotted >= 1) & ((dotted + short) / F.size(lines) > 0.4))


def doc_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u001e"), "\u001e"), lambda s: s != "")


def pdf_confidence(chars: Column, pages: Column, words: Column) -> Column:
    per = chars / F.greatest(pages, F.lit(1))
    score = F.lit(0.8) + F.when(per.between(1500, 8000), 0.1).when(per < 500, -0.3).otherwise(0.0) + F.when(words > 50, 0.05).otherwise(0.0)
    return F.when(chars == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def chunk_confidence(words: Column, terminal: Column, technical: Column, sentence_count: Column, token_count: Column | None = None) -> Column:
    """1, less 0.2 under 50 tokens, less 0.1 without an end, 0.1 more for technical words and for 10 to 30 words a sentence; 0.1 to 1."""
    per = words / F.greatest(sentence_count, F.lit(1))
    score = F.lit(1.0) - F.when((token_count if token_count is not None else words) < 50, 0.2).otherwise(0.0) - F.when(~terminal, 0.1).otherwise(0.0)
    score = score + F.when(technical, 0.1).otherwise(0.0) + F.when(per.between(10, 30), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


def distinct_ignoring_case(items: Column) -> Column:
    """Without later items that differ in case only; the first spelling and the order stay."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def format_cite(source: Column, first: Column, last: Column) -> Column:
    pages = F.when(first.isNull(), "").when(first == last, F.concat(F.lit(" (page "), first.cast("string"), F.lit(")")))
    return F.concat(F.lit("Source: "), source, pages.otherwise(F.concat(F.lit(" (pages "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))))


def percent_change(now: Column, base: Column) -> Column:
    return F.when(base > 0, (now - base) / base * 100).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
