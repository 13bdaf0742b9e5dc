"""Wells, formations and properties in questions, texts and paths, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritstone.functions import text as T

# How the field's wells are written.
_FIELD = r"15[\s_/-]*9[\s_/-]*"
# A number that only begins with 159, or holds it, is no well: one written without signs between needs a letter (159F4, 15919A).
_NO_NUMBER = r"(?<![0-9])(?!159[0-9]+(?![0-9A-Z]))"
QUERY_WELL = rf"(?i)({_FIELD}[A-Z0-9\s_/-]+?)(?:\s+formations?|\s+in|\s+for|$|[^\w/\s-])"
PLATFORM_WELL = rf"(?i)({_FIELD}(?:F[\s_/-]*-?[\s_/-]*)?-?\s*\d+(?:\s*[A-Z])?\b)"
PATH_WELL = rf"(?i)({_FIELD}F[\s_/-]*-?\s*\d+[A-Z]?)"
SECTION_WELL = rf"(?i){_NO_NUMBER}({_FIELD}(?:f[\s_/-]*)?\d+[a-z]?(?:[\s_/-]*t2)?)"
RETRIEVED_WELLS = (
    r"(?i)(15[_\s/-]9[_\s/-]?[Ff][\s_/-]*-?\s*\d+[A-Z]?)", r"(?i)(15[_\s/-]9[_\s/-]?\d+[A-Z]?)", r"(?i)well\s+(15[_\s/-]9[_\s/-]?\d+[A-Z]?)",
    r"(?i)(15[_\s/-]9[_\s/-]?[-]?\d+[A-Z]?)", r"(?i)(\d+[_\s/-]\d+[_\s/-]\d+[A-Z]?)",
)
MENTIONED_WELL = rf"(?i){_NO_NUMBER}15[_\s/-]?9[_\s/-]?F?[_\s/-]*-?\s*\d+[A-Z]?"
WELL_NUMBER = r"(?i)F[\s_/-]*-?\s*(\d+)"

# Phrases that name a property, and the tool that knows it.
PHRASES = (
    ("matrix density", "matrix_density"), ("density of matrix", "matrix_density"), ("rhoma", "matrix_density"), ("ρma", "matrix_density"), ("pma", "matrix_density"),
    ("fluid density", "fluid_density"), ("density of fluid", "fluid_density"), ("density fluid", "fluid_density"), ("rho fluid", "fluid_density"), ("rhofl", "fluid_density"), ("ρfl", "fluid_density"),
    ("grmax", "grmax"), ("gr min", "grmin"), ("grmin", "grmin"), ("archie a", "archie_a"), ("archie m", "archie_m"), ("archie n", "archie_n"),
    ("tortuosity factor", "archie_a"), ("cementation exponent", "archie_m"), ("saturation exponent", "archie_n"),
    ("net to gross", "netgros"), ("net-to-gross", "netgros"), ("net/gross", "netgros"), ("ntg", "netgros"), ("phif", "phif"), ("porosity", "phif"), ("phi", "phif"),
    ("water saturation", "sw"), ("sw", "sw"), ("klogh", "klogh"), ("permeability", "klogh"), ("perm", "klogh"), ("poro", "phif"),
    ("rw", "rw"), ("temperature gradient", "temperature_gradient"), ("reservoir temperature", "reservoir_temperature"), ("cutoff", "cutoff"), ("cut-off", "cutoff"), ("cut off", "cutoff"),
)
#: canonical name, tool, key in its table (in the registry's order).
REGISTRY = (
    ("matrix_density", "lookup_evaluation_parameters", "Rhoma"), ("fluid_density", "lookup_evaluation_parameters", "Rhofl"), ("grmin", "lookup_evaluation_parameters", "Grmin"),
    ("grmax", "lookup_evaluation_parameters", "Grmax"), ("archie_a", "lookup_evaluation_parameters", "a"), ("archie_m", "lookup_evaluation_parameters", "m"),
    ("archie_n", "lookup_evaluation_parameters", "n"), ("A", "lookup_evaluation_parameters", "A"), ("B", "lookup_evaluation_parameters", "B"),
    ("netgros", "lookup_petrophysical_params", "netgros"), ("phif", "lookup_petrophysical_params", "phif"), ("sw", "lookup_petrophysical_params", "sw"), ("klogh", "lookup_petrophysical_params", "klogh"),
    ("rw", "lookup_structured_facts", None), ("temperature_gradient", "lookup_structured_facts", None), ("reservoir_temperature", "lookup_structured_facts", None), ("cutoff", "lookup_structured_facts", None),
)
#: Phrases of compact text (letters and digits only) that name a property, in order.
COMPACT_PHRASES = (
    ("matrixdensity", "matrix_density"), ("fluiddensity", "fluid_density"), ("nettogross", "netgros"), ("netgross", "netgros"), ("watersaturation", "sw"), ("temperaturegradient", "temperature_gradient"),
    ("reservoirtemperature", "reservoir_temperature"), ("permeability", "klogh"), ("porosity", "phif"), ("perm", "klogh"), ("poro", "phif"),
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def any_in(text: Column, words) -> Column:
    """Whether text contains one of words, inside words too."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def query_well(question: Column) -> Column:
    """A well with all that follows it up to `in`, `for`, `formation` or a sign; null if shorter than 5 signs."""
    name = F.regexp_replace(stripped(F.regexp_replace(stripped(found(question, QUERY_WELL)), r"[^\w\s/-]+$", "")), r"\s+", " ")
    return F.when(F.length(name) >= 5, name)


def platform_well(question: Column) -> Column:
    """A well with one letter at most behind its number, without a trailing sidetrack `T2`."""
    return stripped(F.regexp_replace(stripped(found(question, PLATFORM_WELL)), r"(?i)\s+T\d+\b", ""))


def retriever_well(question: Column) -> Column:
    """The first match of the first form that matches, spaces and underscores as slashes."""
    return F.regexp_replace(F.coalesce(*(found(question, p) for p in RETRIEVED_WELLS)), r"[\s_]", "/")


def well_of_path(path: Column) -> Column:
    return T.canonical_well(found(path, PATH_WELL))


def section_well(question: Column) -> Column:
    return stripped(found(question, SECTION_WELL))


def well_number(name: Column) -> Column:
    """The platform number: 4 in 15/9-F-4, so that F-4 and F-14 are told apart."""
    return found(name, WELL_NUMBER)


def asked_formation(question: Column) -> Column:
    """What stands between `depth of` and ` in `, without the word formation."""
    got = stripped(F.regexp_replace(stripped(found(F.lower(question), r"depth\s+of\s+(.+?)(?:\s+in\s+|$)")), r"\bformation\b", ""))
    return got


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _literal(text: Column) -> Column:
    """text as a pattern that matches it alone."""
    return F.regexp_replace(text, r"([^A-Za-z0-9])", r"\\$1")


def _matches(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_like", text, pattern)


def mentions_well(well: Column, text: Column, source: Column, filename: Column) -> Column:
    """Whether a chunk is about the well: the number in its source must be the well's, and its text, source or file name must
    spell the well in one of eight ways, or the text without separators hold it as a word."""
    well, text, source, filename = (F.coalesce(c, F.lit("")) for c in (well, text, source, filename))
    short = F.coalesce(found(well, r"(?i)(F[\s_/-]*-?\s*\d+[A-Z]?|\d+[A-Z]?)$"), well)
    number = found(short, r"(\d+)[A-Za-z]?$")
    place = F.upper(F.concat(source, F.lit(" "), filename))
    there = well_number(place)
    right = number.isNull() | there.isNull() | (there == number)
    fields = ("15/9-", "15_9-", "15-9-")
    spelled = [F.upper(well), *(F.concat(F.lit(f), F.upper(short)) for f in fields), *(F.concat(F.lit(p + f), F.upper(short)) for p, f in (("NO ", fields[0]), ("NO_", fields[0]), ("NO ", fields[1]), ("NO ", fields[2])))]
    pattern = F.concat(F.lit(r"\b(?:"), F.concat_ws("|", *map(_literal, spelled)), F.lit(r")\b"))
    tight = F.concat(F.lit("(?:^|[^0-9A-Z])"), _literal(F.regexp_replace(F.upper(well), r"[\s_/-]", "")), F.lit("(?:[^0-9A-Z]|$)"))
    hit = _matches(F.upper(text), pattern) | _matches(F.upper(source), pattern) | _matches(F.upper(filename), pattern) | _matches(F.regexp_replace(F.upper(text), r"[\s_/-]", ""), tight)
    return (well != "") & right & hit


def source_of_well(well: Column, source: Column, filename: Column) -> Column:
    """Whether a source is the well's by its names alone: its number is the well's, or, for a well without number, it spells it."""
    place = F.upper(F.concat_ws(" ", source, filename))
    short = F.coalesce(found(well, r"(?i)(F[\s_/-]*-?\s*\d+[A-Z]?|\d+[A-Z]?)$"), well)
    number = found(short, r"(\d+)[A-Za-z]?$")
    named = reduce(lambda a, b: a | b, (F.contains(place, x) for x in (F.upper(well), *(F.concat(F.lit(f), F.upper(short)) for f in ("15/9-", "15_9-", "15-9-")))))
    return F.when(number.isNotNull(), F.coalesce(well_number(place) == number, F.lit(False))).otherwise(named)


def phrase_property(question: Column) -> Column:
    """The property of the longest phrase that the question contains, inside words too."""
    low, out = F.lower(question), None
    for phrase, name in sorted(PHRASES, key=lambda p: -len(p[0])):
        hit = F.contains(low, F.lit(phrase))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def rho_shorthand(question: Column) -> Column:
    """rhoma or rhofl, from `rho ma`, `ρfl`, `pma` and the like."""
    t = T.canonical_token(question)
    short = lambda s: (t == s) | (F.endswith(t, F.lit(s)) & (F.length(t) <= 5))
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(has("rhoma"), "rhoma").when(has("rhofl"), "rhofl").when(short("pma"), "rhoma").when(short("pfl"), "rhofl")
        .when(has("rho") & has("ma"), "rhoma").when(has("rho") & has("fl"), "rhofl")
    )


def resolved_property(question: Column, have: Column | None = None) -> Column:
    """The property by rules alone: the rho shorthand, then the key of a table (a single letter as a word, not as a well's suffix),
    then a phrase; null if none decides. Of `have`, an array of names, the others are not known."""
    t, rho = T.canonical_token(question), rho_shorthand(question)
    known = lambda hit, name: hit if have is None else hit & F.array_contains(have, name)
    suffix = F.upper(found(question, r"(?i)15[\s_/-]*9[\s_/-]*(?:F[\s_/-]*-?[\s_/-]*)?-?\s*\d+\s*([A-Z])\b"))
    out = F.when(known(rho == "rhoma", "matrix_density"), "matrix_density").when(known(rho == "rhofl", "fluid_density"), "fluid_density")
    for name, _, key in REGISTRY:
        if key and len(key) == 1:
            out = out.when(known(~F.coalesce(suffix == key.upper(), F.lit(False)) & F.regexp_like(question, F.lit(rf"(?i)\b{key}\b")), name), name)
        elif key:
            out = out.when(known(F.contains(t, F.lit(key.lower())), name), name)
    for phrase, name in COMPACT_PHRASES:
        out = out.when(known(F.contains(t, F.lit(phrase)), name), name)
    return out


def tool_of_property(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for n, tool, _ in REGISTRY for x in (n, tool)))
    return F.try_element_at(known, name)
