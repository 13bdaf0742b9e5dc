"""Values, notes, depths, paths and messages as readers see them: built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritstone.functions.wells import found, stripped

NUMERIC = r"^[-+]?\d+(?:\.\d+)?$"
#: Order and labels of evaluation parameters.
EVAL_ORDER = ("Rhoma", "Rhofl", "A", "B", "Grmin", "Grmax", "a", "n", "m")
EVAL_LABELS = {"Rhoma": "ρma (g/cc)", "Rhofl": "ρfl (g/cc)", "Grmin": "GRmin", "Grmax": "GRmax", "a": "Archie a", "m": "Archie m", "n": "Archie n"}
EVAL_NAMES = EVAL_LABELS | {"Rhoma": "Matrix density (ρma)", "Rhofl": "Fluid density (ρfl)"}
SYNONYMS = ((("poro", "porosity"), (("poro", "porosity"), ("porosity", "phif"))), (("perm", "permeability"), (("perm", "permeability"), ("permeability", "klogh"))))


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded by its binary value, ties to even, as C and Python print it (format_string rounds its shortest digits up)."""
    x = x.cast("double")
    near = F.call_function("format_number", x, F.lit("0." + "0" * digits))
    return F.when(F.abs(x) < float("inf"), near).otherwise(F.format_string(f"%.{digits}f", x))


def fraction(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(fixed(x, 3))


def klogh(x: Column) -> Column:
    """Whole numbers without decimals, one decimal from 10 on, else three."""
    x = x.cast("double")
    return F.when(x.isNull(), "N/A").when(x == F.floor(x), x.cast("long").cast("string")).when(F.abs(x) >= 10, fixed(x, 1)).otherwise(fixed(x, 3))


def eval_value(key: Column, value: Column) -> Column:
    """`*` is derived; what is no number stays; densities, constants and exponents have two decimals, GR limits none if whole."""
    v = F.trim(value)
    number = v.try_cast("double")
    return (
        F.when(v == "*", "Derived*").when(~v.rlike(NUMERIC), v).when(key.isin("Rhoma", "Rhofl", "A", "B", "a", "m", "n"), fixed(number, 2))
        .when(key.isin("Grmin", "Grmax") & (number == F.floor(number)), number.cast("long").cast("string"))
        .when(key.isin("Grmin", "Grmax"), number.cast("string")).otherwise(v)
    )


def label_of(key: Column, labels: dict[str, str] = EVAL_LABELS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key), key)


def depth_line(kind: Column, md: Column, tvd: Column, tvdss: Column) -> Column:
    """`Top: MD 1.00 m TVD 2.00 m`: what is null is left out."""
    part = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(name + " "), fixed(x, 2), F.lit(" m")))
    return F.concat_ws(" ", F.when(kind == "-", "Pick:").otherwise(F.concat(kind, F.lit(":"))), part("MD", md), part("TVD", tvd), part("TVDSS", tvdss))


def note(line: Column) -> Column:
    """Spelling, units and spaces of a note; its numbers stay."""
    for pattern, new in ((r"(?i)\bReservoar\b", "Reservoir"), (r"\boC\b", "°C"), (r"\bOC\b", "°C"), (r"(\d)m\b", "$1 m"), (r"\s{2,}", " ")):
        line = F.regexp_replace(line, pattern, new)
    return stripped(line)


def assumptions(notes: Column) -> Column:
    """Notes as clean lines, one or two for each: the derived exponent, water resistivity with the gradient on its line, the reservoir's temperature."""

    def lines(raw: Column) -> Column:
        x = note(raw)
        formula = F.replace(F.regexp_replace(F.replace(stripped(F.regexp_replace(x, r"^\*\s*", "")), F.lit("**"), F.lit("^")), r"(?i)(Klogh)\s*\^\s*([-+]?[\d.]+)", "$1^($2)"), F.lit("*"), F.lit("·"))
        water = r"(?i)rw\s*=\s*([-\d.]+)\s*([a-z]+)\s+at\s+([-\d.]+)\s*°c"
        get = lambda p, g: F.regexp_extract(x, p, g)
        first = F.when(x.rlike(water), F.concat(F.lit("Rw (at "), get(water, 3), F.lit(" °C): "), get(water, 1), F.lit(" "), get(water, 2))).otherwise(x)
        gradient = found(x, r"(?i)temp\s*gradient\s*:\s*([-\d.]+)\s*°c")
        second = F.when(gradient.isNotNull(), F.concat(F.lit("Temperature gradient: "), gradient, F.lit(" °C")))
        deep = r"(?i)reservoir temperature\s*:\s*([-\d.]+)\s*°c\s+at\s+([-\d.]+)\s*m\s*tvdss"
        warm = F.when(x.rlike(deep), F.concat(F.lit("Reservoir temperature (at "), get(deep, 2), F.lit(" m TVDSS): "), get(deep, 1), F.lit(" °C"))).otherwise(x)
        return (
            F.when(x.rlike(r"(?i)\bm\s*=\s*1\.865\b") & F.contains(F.lower(x), F.lit("klogh")), F.array(F.concat(F.lit("Derived Archie m: "), formula)))
            .when(F.startswith(F.lower(x), F.lit("rw")), F.array_compact(F.array(first, second)))
            .when(F.contains(F.lower(x), F.lit("reservoir temperature")), F.array(warm)).otherwise(F.array(x))
        )

    return F.flatten(F.transform(notes, lines))


def table_text(rows: Column) -> Column:
    """An array of rows of cells as lines `a | b`; a null cell is empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def reader_path(path: Column) -> Column:
    """A path as readers see it: the well's folder and the file, the file alone, or else the last step."""
    steps = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    known = F.filter(steps, lambda p: ~F.endswith(p, F.lit(":")) & (p.rlike(r"^\d+[\s_/-]*\d+") | F.endswith(F.lower(p), F.lit(".pdf"))))
    last = F.slice(known, F.greatest(F.size(known) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(known) > 0, F.array_join(last, "/")).when(F.size(steps) > 0, F.element_at(steps, -1)).otherwise(path)


def synonym_variants(question: Column) -> Column:
    """The question and its spellings with other words for a property, case-insensitively distinct, in order."""
    low = F.lower(question)

    def swap(a: str, b: str, upper: bool = False) -> Column:
        first, other = (a.upper(), " ".join(w.upper() if upper else w.capitalize() for w in b.split())) if upper else (a.capitalize(), b.capitalize() if b not in ("phif", "klogh") else b.upper())
        return F.replace(F.replace(question, F.lit(a), F.lit(b)), F.lit(first), F.lit(other))

    has = lambda *words: F.contains(low, F.lit(words[0])) if len(words) == 1 else F.contains(low, F.lit(words[0])) | has(*words[1:])
    parts = [F.array(question)]
    for words, swaps in SYNONYMS:
        parts.append(F.when(has(*words), F.array(*(swap(a, b) for a, b in swaps))).otherwise(F.array().cast("array<string>")))
    water = F.replace(F.replace(question, F.lit("sw"), F.lit("water saturation")), F.lit("SW"), F.lit("Water Saturation"))
    parts.append(F.when(has("sw", "water saturation"), F.array(water)).otherwise(F.array().cast("array<string>")))
    net = F.replace(F.replace(question, F.lit("ntg"), F.lit("net to gross")), F.lit("NTG"), F.lit("Net to Gross"))
    slash = F.replace(F.replace(question, F.lit("net to gross"), F.lit("net/gross")), F.lit("Net to Gross"), F.lit("Net/Gross"))
    parts.append(F.when(has("ntg") | (has("net") & has("gross")), F.array(net, slash)).otherwise(F.array().cast("array<string>")))
    whole = F.concat(*parts)
    keys = F.transform(whole, lambda x: F.lower(x))
    return F.filter(whole, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def extraction_warnings(text: Column, confidence: Column, file_size: Column | None = None) -> Column:
    """Warnings about an extracted text; an empty one has only the first."""
    blank = F.length(stripped(text)) == 0
    spaces = (F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))) / F.greatest(F.length(text), F.lit(1))
    little = (F.length(text) < 100) & (F.coalesce(file_size, F.lit(0)) > 10000) if file_size is not None else F.lit(False)
    found_ = F.array_compact(F.array(F.when(little, "LOW_TEXT_RATIO"), F.when(spaces > 0.6, "HIGH_WHITESPACE_RATIO"), F.when(confidence < 0.7, "LOW_CONFIDENCE_SCORE")))
    return F.when(blank | text.isNull(), F.array(F.lit("NO_TEXT_EXTRACTED"))).otherwise(found_)


def tagged_json(tag: str, record: Column) -> Column:
    return F.concat(F.lit(f"[{tag}] "), F.to_json(record))


def untagged_json(text: Column, tag: str, schema: str) -> Column:
    """The record behind a tag; null where the tag is missing or the JSON is not sound."""
    return F.when(F.startswith(text, F.lit(f"[{tag}]")), F.from_json(F.substring(text, len(tag) + 3, 1 << 30), schema))


def json_in_prose(text: Column, schema: str) -> Column:
    """The record from the first `{` to the last `}`."""
    return F.from_json(found(text, r"(?s)(\{.*\})"), schema)


def log_line(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def unwrapped(text: Column) -> Column:
    """The text inside `Result.ok('...')`; other texts as they are."""
    inner = F.regexp_extract(text, r"(?s)^Result\.ok\((['\"])(.*)\1\)$", 2)
    return F.when(F.startswith(text, F.lit("Result.ok(")) & (inner != ""), F.replace(inner, F.lit("\\n"), F.lit("\n"))).otherwise(text)
