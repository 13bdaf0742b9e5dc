"""Queries of the text rules over made-up texts: extraction, formats, validation, routing, chunk rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions import formats, wells
from gritstone.functions import text as T
from gritstone.operators import chunking, lookup, retrieval
from gritstone.plans import router
from gritstone.plans.cases import by_cases

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name, names, cases, columns) -> None:
    by_cases(QUERIES, ORACLES, name, names, cases, columns)


# --- names of wells and formations --------------------------------------------------------------------------------

_add(
    "well_forms", ("canonical", "stripped", "first"),
    [
        ("15_9_F_{k}", "15/9-F-{k}", "159F{k}", "15/9-F-{k}"), ("15/9-F-{k}", "15/9-F-{k}", "159F{k}", "15/9-F-{k}"), ("15-9-F-{k}", "15/9-F-{k}", "159F{k}", "15/9-F-{k}"),
        ("159F{k} PETROPHYSICAL", "159F-{k}PETROPHYSICAL", "159F{k}", None), ("159F{k} REPORT", "159F-{k}REPORT", "159F{k}", None),
    ],
    lambda t: (T.canonical_well(t), T.strip_first_suffix(T.well_key(t)), F.when(t.rlike("^15."), T.extract_well(t))),
)

_add(
    "well_extraction", ("asked", "platform", "retrieved", "in_path", "number"),
    [
        ("formations in Well NO 15/9-F-{k} A", "15/9-F-{k} A", "15/9-F-{k} A", "15/9-F-{k}", "15/9-F-{k}", "{k}"),
        ("what of 15/9-F-{k} formation tops", "15/9-F-{k}", "15/9-F-{k}", "15/9-F-{k}", "15/9-F-{k}", "{k}"),
        ("data for 15_9-F-{k} in the report", "15_9-F-{k}", "15_9-F-{k}", "15/9-F-{k}", "15/9-F-{k}", "{k}"),
        ("no well here", None, None, None, None, None),
        ("depth in 15/9-{k}A?", "15/9-{k}A", "15/9-{k}A", "15/9-{k}A", None, None),
    ],
    lambda t: (wells.query_well(t), wells.platform_well(t), wells.retriever_well(t), wells.well_of_path(t), wells.well_number(wells.query_well(t))),
)

_add(
    "asked_formation", ("formation", "compacted"),
    [
        ("Depth of Hugin formation in 15/9-F-{k}", "hugin", "depthofhuginformationin159f{k}"), ("the depth of  Ty", "ty", "thedepthofty"), ("depth of Sleipner Fm. in well {k}", "sleipner fm.", "depthofsleipnerfminwell{k}"),
        ("no such thing {k}", None, "nosuchthing{k}"),
    ],
    lambda t: (wells.asked_formation(t), wells.compact(t)),
)

_add(
    "property_rules", ("phrase", "shorthand", "resolved", "tool"),
    [
        ("matrix density of {k}", "matrix_density", None, "matrix_density", "lookup_evaluation_parameters"), ("rho fl in {k}", None, "rhofl", "fluid_density", "lookup_evaluation_parameters"),
        ("ρma", "matrix_density", "rhoma", "matrix_density", "lookup_evaluation_parameters"), ("pfl", None, "rhofl", "fluid_density", "lookup_evaluation_parameters"),
        ("GRmin {k}", "grmin", None, "grmin", "lookup_evaluation_parameters"), ("net to gross {k}", "netgros", None, "netgros", "lookup_petrophysical_params"),
        ("porosity {k}", "phif", None, "phif", "lookup_petrophysical_params"), ("water saturation {k}", "sw", None, "sw", "lookup_petrophysical_params"),
        ("reservoir temperature {k}", "reservoir_temperature", None, "reservoir_temperature", "lookup_structured_facts"), ("the exponent n of 15/9-F-{k} N", None, None, None, None),
        ("the exponent m of {k}", None, None, "archie_m", "lookup_evaluation_parameters"), ("cementation exponent {k}", "archie_m", None, None, None), ("hello {k}", None, None, None, None),
    ],
    lambda t: (wells.phrase_property(t), wells.rho_shorthand(t), wells.resolved_property(t), wells.tool_of_property(wells.resolved_property(t))),
)

_add(
    "well_mentions", ("chunk", "source"),
    [
        ("15/9-F-4|tops of 15/9-F-4 are|x/15_9-F-4/a.pdf|a.pdf", True, True), ("15/9-F-4|tops of 15/9-F-14 are|x/15_9-F-14/a.pdf|a.pdf", False, False),
        ("15/9-F-4|tops of 15/9-F-4 are|x/15_9-F-14/a.pdf|a.pdf", False, False), ("15/9-F-4|nothing|x/b.pdf|b.pdf", False, False), ("15/9-F-4|see 15_9-F-4|x/b.pdf|b.pdf", True, False),
        ("15/9-19A|see 15/9-19A|x/15_9-19A/c.pdf|c.pdf", True, False), ("15/9-F-14|see F-4|x/15_9-F-4/a.pdf|a.pdf", False, False),
    ],
    lambda t: (lambda p: (wells.mentions_well(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.get(p, F.lit(3))), wells.source_of_well(F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(3)))))(F.split(t, r"\|")),
)

# --- formats ------------------------------------------------------------------------------------------------------

_add(
    "value_formats", ("fraction", "klogh"),
    [("0.25", "0.250", "0.250"), ("12", "12.000", "12"), ("123.75", "123.750", "123.8"), ("-10.25", "-10.250", "-10.3"), ("x", "N/A", "N/A"), ("{k}", None, "{k}"), ("9.5", "9.500", "9.500")],
    lambda t: (lambda x: (F.when(t.rlike("[.x]") | (t == "12"), formats.fraction(x)), formats.klogh(x)))(F.when(t == "12", F.lit(12.0)).otherwise(t.try_cast("double"))),
)
# a key of 12 would be shown by the fraction as well: the case's own text is told apart by its place
ORACLES["value_formats"] = ORACLES["value_formats"].replace("fraction, replace(", "CASE WHEN c = 5 AND p_partkey = 12 THEN '12.000' ELSE fraction END AS fraction, replace(")

_add(
    "eval_formats", ("value", "label", "name"),
    [
        ("Rhoma|2.6", "2.60", "ρma (g/cc)", "Matrix density (ρma)"), ("Grmin|20.0", "20", "GRmin", "GRmin"), ("Grmax|20.5", "20.5", "GRmax", "GRmax"), ("m|*", "Derived*", "Archie m", "Archie m"),
        ("a|1", "1.00", "Archie a", "Archie a"), ("B|N/A", "N/A", "B", "B"), ("other|{k}", "{k}", "other", "other"),
    ],
    lambda t: (lambda p: (formats.eval_value(F.get(p, F.lit(0)), F.get(p, F.lit(1))), formats.label_of(F.get(p, F.lit(0))), formats.label_of(F.get(p, F.lit(0)), formats.EVAL_NAMES)))(F.split(t, r"\|")),
)

_add(
    "depth_lines", ("line",),
    [("Top|{k}.25|2.5|-3", "Top: MD {k}.25 m TVD 2.50 m TVDSS -3.00 m"), ("Base|1|x|2", "Base: MD 1.00 m TVDSS 2.00 m"), ("-|x|x|{k}", "Pick: TVDSS {k}.00 m"), ("Top|x|x|x", "Top:")],
    lambda t: (lambda p: (formats.depth_line(F.get(p, F.lit(0)), *(F.get(p, F.lit(i)).try_cast("double") for i in (1, 2, 3))),))(F.split(t, r"\|")),
)

_add(
    "note_lines", ("clean", "lines"),
    [
        ("Reservoar temp  20 oC at 3m", "Reservoir temp 20 °C at 3 m", "Reservoir temp 20 °C at 3 m"),
        ("Rw = 0.{k} ohmm at 20 oC, Temp Gradient : 2.6 oC", "Rw = 0.{k} ohmm at 20 °C, Temp Gradient : 2.6 °C", "Rw (at 20 °C): 0.{k} ohmm|Temperature gradient: 2.6 °C"),
        ("*  m = 1.865 * ( Klogh ** -0.0083)", "* m = 1.865 * ( Klogh ** -0.0083)", "Derived Archie m: m = 1.865 · ( Klogh^(-0.0083))"),
        ("Reservoar temperature : {k} oC at 2800 m TVDSS.", "Reservoir temperature : {k} °C at 2800 m TVDSS.", "Reservoir temperature (at 2800 m TVDSS): {k} °C"),
        ("Rw unknown", "Rw unknown", "Rw unknown"),
    ],
    lambda t: (formats.note(t), F.array_join(formats.assumptions(F.array(t)), "|")),
)

_add(
    "table_text", ("text",),
    [("a|b;c|{k}", "a | b\nc | {k}"), ("x", "x"), ("a|-;-|-", "a | \n | ")],
    lambda t: (formats.table_text(F.transform(F.split(t, ";"), lambda r: F.transform(F.split(r, r"\|"), lambda c: F.when(c != "-", c)))),),
)

_add(
    "reader_paths", ("short",),
    [
        ("C:\\Users\\me\\Downloads\\15_9-F-{k}\\REPORT.PDF", "15_9-F-{k}/REPORT.PDF"), ("../data/report_{k}.pdf", "report_{k}.pdf"), ("x/15_9-F-5/sub/notes.txt", "15_9-F-5"), ("plain/file_{k}.txt", "file_{k}.txt"),
        ("..\\spwla_volve-main\\15_9-F-5\\A.PDF", "15_9-F-5/A.PDF"),
    ],
    lambda t: (formats.reader_path(t),),
)

_add(
    "synonym_variants", ("variants",),
    [
        ("perm of {k}", "perm of {k}|permeability of {k}"), ("porosity of {k}", "porosity of {k}|porositysity of {k}|phif of {k}"), ("sw {k}", "sw {k}|water saturation {k}"),
        ("NTG {k}", "NTG {k}|Net to Gross {k}"), ("net to gross {k}", "net to gross {k}|net/gross {k}"), ("nothing {k}", "nothing {k}"),
    ],
    lambda t: (F.array_join(formats.synonym_variants(t), "|"),),
)

_add(
    "extraction_warnings", ("warnings",),
    [("  ", "NO_TEXT_EXTRACTED"), ("a    b     c", "HIGH_WHITESPACE_RATIO"), ("good text {k}", ""), ("low   ", "LOW_CONFIDENCE_SCORE"), (None, "NO_TEXT_EXTRACTED")],
    lambda t: (F.array_join(formats.extraction_warnings(t, F.when(F.startswith(F.coalesce(t, F.lit("")), F.lit("low")), 0.5).otherwise(0.9)), "|"),),
)

_add(
    "tagged_json", ("tagged", "back", "broken", "inside", "log"),
    [
        ("a{k}", '[FACTS_JSON] {"v":"a{k}"}', "a{k}", None, "a{k}", '{"level":"INFO","message":"a{k}"}'), ('q"{k}', '[FACTS_JSON] {"v":"q\\"{k}"}', 'q"{k}', None, 'q"{k}', '{"level":"INFO","message":"q\\"{k}"}'),
    ],
    lambda t: (
        formats.tagged_json("FACTS_JSON", F.struct(t.alias("v"))), formats.untagged_json(formats.tagged_json("FACTS_JSON", F.struct(t.alias("v"))), "FACTS_JSON", "v string")["v"],
        formats.untagged_json(t, "FACTS_JSON", "v string")["v"], formats.json_in_prose(F.concat(F.lit("I think "), F.to_json(F.struct(t.alias("v"))), F.lit(" fits")), "v string")["v"], formats.log_line(level=F.lit("INFO"), message=t),
    ),
)

_add(
    "tool_text", ("text", "message"),
    [("Result.ok('a {k}')", "a {k}", "a {k}"), ("plain {k}", "plain {k}", "plain {k}"), ("fail /home/u/x.py {k}", "fail /home/u/x.py {k}", '{"error":"PROCESSING_ERROR","message":"fail [FILE_PATH] {k}"}')],
    lambda t: (formats.unwrapped(t), lookup.tool_message(formats.unwrapped(t), F.when(F.startswith(t, F.lit("fail")), t), F.lit("PROCESSING_ERROR"))),
)

# --- cleaning, validation, redaction ------------------------------------------------------------------------------

_add(
    "redaction_rules", ("safe",),
    [
        ("open C:\\a\\b.txt now {k}", "open [FILE_PATH] now {k}"), ("open /home/x/y.py now {k}", "open [FILE_PATH] now {k}"), ("see ../a/b {k}", "see ..[FILE_PATH] {k}"), ("see .\\a {k}", "see [FILE_PATH] {k}"),
        ("key sk-abcdefghijkl {k}", "key [API_KEY] {k}"), ("api_key: z{k} x", "api_key=[REDACTED] x"), ("Password=z{k} x", "password=[REDACTED] x"), ("my secret : z{k} x", "my secret=[REDACTED] x"), ("token=z{k} x", "token=[REDACTED] x"),
        ("mail a.b{k}@c.org x", "mail [EMAIL] x"), ("x Traceback (most recent call last):\nline {k}\nend", "x [STACK_TRACE]"), ('at File "a.py", line {k}, in f', "at [STACK_TRACE]"), ("nothing {k}", "nothing {k}"),
    ],
    lambda t: (T.redact(t),),
)

_add(
    "validation_rules", ("query_", "well", "formation", "shown"),
    [
        ("what is {k}", None, None, None, "what is {k}"), (" ", "empty", "empty", "empty", " "), ("<SCRIPT>{k}", "dangerous", "dangerous", "dangerous", "<SCRIPT>{k}"), ("import  os {k}", "dangerous", None, None, "import  os {k}"),
        ("../up{k}", None, "dangerous", "dangerous", "../up{k}"), ("letters only", None, "no_digit", None, "letters only"), ("shell = {k}", "dangerous", None, None, "shell = {k}"), ("a\x01b\x0b{k}", None, None, None, "ab{k}"),
        ("x" * 60 + "{k}", None, "too_long", None, "x" * 60 + "{k}"), ("onerror = {k}", None, None, None, "onerror = {k}"), ("eval({k})", "dangerous", None, None, "eval({k})"),
    ],
    lambda t: (T.query_error(t), T.name_error(t), T.name_error(t, 100, False), T.without_control(t)),
)

_add(
    "unfinished_questions", ("open",),
    [
        ("the depth of {k} is", True), ("Well 15/9-F-{k} was...", True), ("wellbore 15/9-F-{k} was.", True), ("porosity and", True), ("what about {k}...", True), ("what is {k}", False), ("this {k}", False), ("it would.", True), ("of the", False), (" ", False),
    ],
    lambda t: (T.is_unfinished(t),),
)

_add(
    "toc_lines", ("page", "line", "asked"),
    [
        ("1 Intro ..... 3\n2 Body ...... {k}", True, True, False), ("Intro .... {k}\nshort {k}\nprose", True, False, False), ("Intro .... {k}\nprose\nmore\nprose", False, False, False), ("Heading   {k}", False, True, False),
        ("show the table of contents", False, False, True), ("which page is {k}", False, False, True), ("plain text", False, False, False),
    ],
    lambda t: (T.is_toc(t), T.is_toc_line(t), T.wants_toc(t)),
)

_add(
    "cleaned_texts", ("clean", "bare"),
    [
        ("a\n\n\n\nb \t c – {k}", "a\n\nb c - {k}", "a\n\n\n\nb \t c – {k}"), ("  x{k}\n", "x{k}", "  x{k}\n"),
        ("12\nPage 3 of {k}\nDraft v{k}\nCONFIDENTIAL\na\nb\nc\nd\ne\nf{k}", "12\nPage 3 of {k}\nDraft v{k}\nCONFIDENTIAL\na\nb\nc\nd\ne\nf{k}", "a\nb\nc\nd\ne\nf{k}"),
    ],
    lambda t: (T.clean(t), T.drop_headers_footers(t)),
)

# --- routing ------------------------------------------------------------------------------------------------------

_W = "15/9-F-{k}"
_add(
    "routing_rules", ("tool",),
    [
        ("  ", "empty"), ("x" * 5001, "too_long"), (f"depth of Hugin formation in {_W}", router.PICKS), (f"net to gross in {_W}", router.PETRO), (f"matrix density of Hugin in {_W}", f"{router.EVAL}+{router.DOCS}"),
        (f"pressure test of {_W}", router.DOCS), (f"density of Hugin in {_W}", "clarify"), (f"temperature gradient in {_W}", router.FACTS), (f"summary for {_W}", router.SECTION),
        (f"list all formations in {_W}", router.PROPS), ("list all formations", router.PROPS), (f"formation parameters of {_W}", router.PROPS), (f"rw of {_W}", router.FACTS),
        ("tops of each formation by well", router.PICKS), (f"which formations are present in {_W}", router.PICKS), ("hello there", "llm"), (f"pres_form of {_W}", router.DOCS), ("k of sand", router.PETRO), (f"conclusion on {_W}", router.SECTION),
    ],
    lambda t: (router.route(t),),
)

_add(
    "strategy_rules", ("tool",),
    [(f"tvd in {_W}", router.PICKS), ("tvd here", "llm"), ("porosity here", router.PETRO), (f"archie m of {_W}", router.EVAL), (f"abstract of {_W}", router.SECTION), ("abstract of it", "llm"), ("nothing", "llm")],
    lambda t: (router.route_by_strategy(t),),
)

_add(
    "tool_queries", ("query_", "searched"),
    [
        ("rhoma in 15/9-F-77 now|15/9-F-4|Hugin", "rhoma in now in well 15/9-F-4 formation Hugin", "rhoma in 15/9-F-77 now"), ("depth of hugin in 15/9-F-4|15/9-F-4|Hugin", "depth of hugin in 15/9-F-4", "depth of hugin in 15/9-F-4"),
        ("depth {k}|-|-", "depth {k}", "depth {k}"), ("matrix density {k}|15/9-F-4|-", "matrix density {k} in well 15/9-F-4", "matrix density {k} rhoma ρma matrix density evaluation parameters density matrix"),
    ],
    lambda t: (lambda p: (
        router.tool_query(F.get(p, F.lit(0)), F.nullif(F.get(p, F.lit(1)), F.lit("-")), F.nullif(F.get(p, F.lit(2)), F.lit("-"))),
        router.searched_query(F.get(p, F.lit(0)), F.when(F.contains(t, F.lit("matrix")), f"{router.EVAL}+{router.DOCS}").otherwise(router.PICKS)),
    ))(F.split(t, r"\|")),
)

_add(
    "normalised_queries", ("well", "property", "tool", "intent"),
    [
        ("porosity in 15/9-F-{k}?", "15/9-F-{k}", "phif", "lookup_petrophysical_params", "fact"), ("summary of 15/9-F-{k}?", "15/9-F-{k}", None, None, "section"), ("formations of 15/9-F-{k}?", "15/9-F-{k}", None, None, "list"),
        ("porosity", None, "phif", "lookup_petrophysical_params", "unknown"), ("cutoff of 15/9-F-{k}?", "15/9-F-{k}", "cutoff", "lookup_structured_facts", "fact"), ("hello", None, None, None, "unknown"),
    ],
    lambda t: tuple(router.normalised_query(t)[c] for c in ("well", "property", "tool", "intent")),
)

_add(
    "grading_rules", ("step", "next_"),
    [
        ("q {k}?|2|60", "answer", "answer"), ("q {k}?|0|40", "rewrite", "rewrite"), ("the depth is|0|600", "answer", "answer"), ("the depth is:|0|600", "llm", "answer"), ("the depth is|0|400", "llm", "answer"), ("reported {k}|1|501", "answer", "answer"),
        ("Why {k}.|0|900", "llm", "answer"),
    ],
    lambda t: (lambda p: (lambda s: (s, router.next_step(F.lit("lookup_well_picks"), s, F.lit(False))))(router.grade(F.get(p, F.lit(0)), F.repeat(F.lit("x"), F.get(p, F.lit(2)).cast("int")), F.get(p, F.lit(1)).cast("int"))))(F.split(t, r"\|")),
)

_add(
    "completions", ("kept",),
    [
        ("the depth of {k} is|1. What is the depth of {k}?\n- short\n* How deep is {k} below sea?", ". What is the depth of {k}?#How deep is {k} below sea?"), ("what is {k}|1. Anything that was written", "what is {k}"), ("the top is|-\nno", "the top is"),
    ],
    lambda t: (lambda p: (F.array_join(router.completions(F.get(p, F.lit(0)), F.get(p, F.lit(1))), "#"),))(F.split(t, r"\|")),
)

_add(
    "answer_parameters", ("petro", "evaluated"),
    [
        ("klogh harmonic of {k}", "klogh_h", None), ("net/gross {k}", "netgros", None), ("harmonic mean {k}", "klogh_h", None), ("water saturation {k}", "sw", None), ("porosity {k}", "phif", None), ("gr max {k}", None, "Grmax"),
        ("saturation exponent {k}", None, "n"), ("rho ma {k}", None, "Rhoma"), ("other {k}", None, None),
    ],
    lambda t: (lookup.petro_parameter(t), lookup.first_word(F.lower(t), lookup.EVAL_SYNONYMS)),
)

_add(
    "answer_contexts", ("picks", "completed"),
    [
        ("Well NO 15/9-{k}", True, None), ("Pick: a. Quality: b", True, None), ("Pick: a {k}", False, None), ("Before. The well was drilled in the year {k} by them. After.", False, "The well was drilled in the year {k} by them."),
    ],
    lambda t: (lookup.is_picks_context(t), lookup.exact_completion(F.lit("the well was drilled in the year"), t)),
)

_add(
    "expanded_questions", ("variants",),
    [
        ("OWC of {k}", "OWC of {k}|OWC of {k} oil-water contact"), ("grmin {k}", "grmin {k}|grmin {k} gamma ray min|grmin {k} gr minimum|grmin {k} evaluation parameters"), ("nothing {k}", "nothing {k}"),
        ("dato {k}", "dato {k}|dato {k} data report dato data report dato report"),
        ("matrix density {k}", "matrix density {k}|matrix density {k} rhoma|matrix density {k} ρma|matrix density {k} rho ma"),
    ],
    lambda t: (F.array_join(retrieval.expanded(t), "|"),),
)

# --- chunk rules --------------------------------------------------------------------------------------------------

_add(
    "chunk_headings", ("kind",),
    [
        ("EXECUTIVE SUMMARY {k}", "executive_summary"), ("Introduction And Scope", "introduction"), ("the results of {k}", None), ("Results", None), ("DATA ANALYSIS OF {k}", "data_analysis"), ("List Of Figures", "figures"), ("A MIXED Results heading", "results"),
        ("Plain Title Line", None),
    ],
    lambda t: (chunking.heading_kind(t),),
)

_add(
    "chunk_boundaries", ("flags", "technical"),
    [
        ("No terms. Oil is here. Gas is there. None now.", "true|true|false|true", True), ("One 1. Two 2. Three.", "true|false|true", False), ("a b c", "true", False), ("Plain. " + "w " * 51 + ". End.", "true|true|false", False),
    ],
    lambda t: (F.array_join(F.transform(chunking.boundaries(t), lambda b: b.cast("string")), "|"), chunking.is_technical(t)),
)

_add(
    "chunk_confidences", ("score",),
    [("30|y|n|3", 0.9), ("60|y|n|5", 1.0), ("60|n|n|1", 0.9), ("30|n|n|1", 0.8), ("20|n|n|20", 0.7), ("60|n|y|1", 1.0), ("30|y|y|20", 0.9)],
    lambda t: (lambda p: (F.round(T.chunk_confidence(F.get(p, F.lit(0)).cast("int"), F.get(p, F.lit(1)) == "y", F.get(p, F.lit(2)) == "y", F.get(p, F.lit(3)).cast("int")), 6),))(F.split(t, r"\|")),
)

_add(
    "chunk_strategy", ("how", "n"),
    [
        ("SUMMARY OF ALL\na\nINTRODUCTION A\nb\nRESULTS OF ALL\nc\nCONCLUSION {k}", "sections", 4), ("SUMMARY OF ALL\na\nINTRODUCTION A\nb\nRESULTS OF ALL", "semantic", 3), ("nothing {k}", "semantic", 0),
    ],
    lambda t: (chunking.strategy(t), F.size(chunking.headings(t)).cast("long")),
)
