"""Rule-based routing, grading and completion of questions, as ordered CASE expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions import wells
from gritstone.functions.wells import any_in

PICKS, PETRO, EVAL, SECTION, FACTS, PROPS, DOCS = (
    "lookup_well_picks", "lookup_petrophysical_params", "lookup_evaluation_parameters", "lookup_section", "lookup_structured_facts", "lookup_formation_properties", "retrieve_petrophysical_docs",
)

# The words that rules look for, inside words too.
DEPTH_WORDS = ("depth", "md", "tvd", "tvdss", "measured depth", "true vertical depth", "depth of")
PETRO_WORDS = (
    "petrophysical parameters", "petrophysical parameter", "net to gross", "net-to-gross", "netgros", "net/gross", "ntg", "n/g", "phif", "phi", "poro", "porosity", "water saturation", "sw", "klogh",
    "permeability", "permeab", "perm",
)
EVAL_WORDS = (
    "evaluation parameter", "evaluation parameters", "grmax", "grmin", "rhoma", "rhofl", "archie a", "archie m", "archie n", "tortuosity factor", "cementation exponent", "saturation exponent",
    "matrix density", "fluid density", "ρma", "ρfl",
)
EVAL_SYNONYMS = (
    ("matrix density", ("rhoma", "ρma", "matrix density", "evaluation parameters", "density matrix")),
    ("fluid density", ("rhofl", "ρfl", "fluid density", "evaluation parameters", "density fluid")),
    ("density", ("rhoma", "rhofl", "ρma", "ρfl", "matrix density", "fluid density", "evaluation parameters")),
    ("grmax", ("gr max", "gamma ray max", "gr maximum", "evaluation parameters")),
    ("grmin", ("gr min", "gamma ray min", "gr minimum", "evaluation parameters")),
    ("archie", ("archie a", "archie m", "archie n", "tortuosity", "cementation", "saturation exponent", "evaluation parameters")),
)
PRESSURE_WORDS = ("formation pressure", "formation pressures", "pressure data", "pressure test", "pressure testing", "testrak", "testtrak", "pres_form", "pres_qual")
PRESSURE_TERMS = " evaluation of formation pressure data testrak pres_form pres_qual"
FACT_WORDS = ("density", "rho", "archie", "gr", "dens", "permeability", "permeab", "perm", "porosity", "poro", "phi")
SECTION_WORDS = ("summary", "introduction", "conclusion", "results", "discussion", "abstract")
ALL_WORDS = ("all", "each", "every", "complete", "entire", "list all")
PROPERTY_WORDS = ("properties", "petrophysical", "petro", "parameter", "parameters", "reported", "values", "data", "net", "gross", "phif", "sw", "klogh")
WELL_PROPERTY_WORDS = ("petrophysical", "properties", "parameters", "porosity", "phif", "sw", "net to gross", "net-to-gross", "klogh")
STATED_WORDS = ("rw", "temperature gradient", "reservoir temperature", "cutoff", "cut-offs", "cut off")
EVERY_WORDS = ("each", "every", "all", "complete", "entire")
NO_LIST_WORDS = (
    "characteristic", "characteristics", "property", "properties", "pressure", "permeability", "porosity", "saturation", "density", "explain", "describe", "what are", "how", "why",
    "interpretation", "evaluation", "analysis", "data", "measurement", "test",
)
PARTIAL_WORDS = ("is", "accordingly", "reported")
#: Rules of the variant by strategies: priority, tool, words, and whether a well is needed.
STRATEGIES = (
    (1, PICKS, ("depth", "md", "tvd", "tvdss"), True), (2, PETRO, PETRO_WORDS, False), (3, EVAL, EVAL_WORDS, True), (4, SECTION, SECTION_WORDS, True),
)


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def features(question: Column, well: Column | None = None, formation: Column | None = None) -> dict[str, Column]:
    """Boolean columns that the rules are made of; well and formation are known from the context, if any."""
    q, low = question, F.lower(question)
    known = well if well is not None else F.lit(None).cast("string")
    place = formation if formation is not None else F.lit(None).cast("string")
    named = known.isNotNull() | wells.query_well(q).isNotNull() | T.extract_well(q).isNotNull()
    specific = named | (F.contains(low, F.lit("well")) & low.rlike(r"\d+[\s_/-]*\d+"))
    return {
        "named": named, "loose": named | (F.contains(low, F.lit("15")) & F.contains(low, F.lit("9"))), "specific": specific, "place": place.isNotNull(),
        "formation": F.contains(low, F.lit("formation")), "all": any_in(low, ALL_WORDS), "every": any_in(low, EVERY_WORDS), "k": low.rlike(r"\bk\b"),
    }


def route(question: Column, longest: int = 5000, well: Column | None = None, formation: Column | None = None, has_petro: bool = True) -> Column:
    """The tool of the first rule that holds, in the order of the rules; `clarify` where a density is not told apart, else llm.

    Two tools that are asked together are joined by +. has_petro says whether a table of petrophysical parameters exists.
    """
    low, f = F.lower(question), features(question, well, formation)
    has = lambda *words: any_in(low, words)
    inside = (has("in") | has("for")) & (has("well") | f["specific"])
    every_well = ~f["specific"] & f["formation"] & ((f["all"] & has(*PROPERTY_WORDS)) | (has("list") & has("all")) | (f["all"] & has("available")))
    asked = F.coalesce(wells.phrase_property(question), wells.resolved_property(question))
    factual = has(*FACT_WORDS) | f["k"] | wells.phrase_property(question).isNotNull()
    density = has("density", "rho", "dens") & ~_no(asked.isin("matrix_density", "fluid_density"))
    listing = f["specific"] & f["formation"] & ~has(*NO_LIST_WORDS)
    return (
        F.when(F.coalesce(F.length(F.trim(question)), F.lit(0)) == 0, "empty").when(F.length(question) > longest, "too_long")
        .when(f["named"] & has(*DEPTH_WORDS) & (f["place"] | f["formation"]), PICKS)
        .when((has(*PETRO_WORDS) | f["k"]) & (F.lit(has_petro) | f["loose"]), PETRO)
        .when(f["loose"] & has(*EVAL_WORDS), f"{EVAL}+{DOCS}")
        .when(f["named"] & has(*PRESSURE_WORDS), DOCS)
        .when(f["named"] & factual & density, "clarify")
        .when(f["named"] & factual, F.coalesce(wells.tool_of_property(asked), F.lit(DOCS)))
        .when(f["loose"] & has(*SECTION_WORDS), SECTION)
        .when(f["specific"] & f["formation"] & f["all"] & inside, PROPS)
        .when(every_well, PROPS)
        .when(f["specific"] & f["formation"] & has(*WELL_PROPERTY_WORDS), PROPS)
        .when(f["named"] & has(*STATED_WORDS), FACTS)
        .when(~f["specific"] & f["formation"] & has("well") & f["every"], PICKS)
        .when(listing, PICKS).otherwise("llm")
    )


def tool_query(question: Column, well: Column, formation: Column) -> Column:
    """The question for a tool: without mentions of other wells, and with the well and the formation that it does not name."""
    key = lambda x: F.regexp_replace(F.upper(x), r"[\s_/-]", "")
    others = F.filter(F.regexp_extract_all(question, F.lit(wells.MENTIONED_WELL), F.lit(0)), lambda m: key(m) != key(well))
    cut = F.when(well.isNotNull() & (F.size(others) > 0), wells.stripped(F.regexp_replace(F.aggregate(others, question, lambda s, m: F.replace(s, m, F.lit(""))), r"\s+", " "))).otherwise(F.trim(question))
    placed = F.when(well.isNotNull() & ~_no(F.contains(key(cut), key(well))), F.concat(cut, F.lit(" in well "), well)).otherwise(cut)
    return F.when(formation.isNotNull() & ~F.contains(F.lower(placed), F.lower(formation)), F.concat(placed, F.lit(" formation "), formation)).otherwise(placed)


def searched_query(question: Column, tool: Column) -> Column:
    """The question for the document search that goes with a tool: with synonyms of the first evaluation parameter named, or with words on pressure."""
    low, synonyms = F.lower(question), None
    for term, words in EVAL_SYNONYMS:
        hit, more = F.contains(low, F.lit(term)), F.concat(question, F.lit(" " + " ".join(words)))
        synonyms = F.when(hit, more) if synonyms is None else synonyms.when(hit, more)
    return F.when(F.startswith(tool, F.lit(EVAL)), synonyms.otherwise(question)).when((tool == DOCS) & any_in(low, PRESSURE_WORDS), F.concat(question, F.lit(PRESSURE_TERMS))).otherwise(question)


def route_by_strategy(question: Column) -> Column:
    """The variant with strategies: the one of the lowest priority that holds, else llm. More rules are more rows of STRATEGIES."""
    low, named, out = F.lower(question), T.extract_well(question).isNotNull() | wells.query_well(question).isNotNull(), None
    for _, tool, words, needs_well in sorted(STRATEGIES):
        hit = any_in(low, words) & (named if needs_well else F.lit(True))
        out = F.when(hit, tool) if out is None else out.when(hit, tool)
    return out.otherwise("llm")


def intent(question: Column) -> Column:
    """section, fact, list or unknown: what a question about a well is after."""
    low, named = F.lower(question), T.extract_well(question).isNotNull() | wells.query_well(question).isNotNull()
    prop = F.coalesce(wells.phrase_property(question), wells.resolved_property(question))
    return (
        F.when(named & prop.isNotNull() & wells.resolved_property(question).isNotNull(), "fact").when(named & any_in(low, ("summary", "introduction", "conclusion", "abstract")), "section")
        .when(named & prop.isNotNull(), "fact").when(named & any_in(low, ("list", "formation")), "list").otherwise("unknown")
    )


def normalised_query(question: Column) -> Column:
    """A struct of well, property, tool and intent."""
    prop = F.coalesce(wells.resolved_property(question), wells.phrase_property(question))
    return F.struct(T.extract_well(question).alias("well"), prop.alias("property"), wells.tool_of_property(prop).alias("tool"), intent(question).alias("intent"))


def grade(question: Column, context: Column, rewrites: Column) -> Column:
    """answer, rewrite or llm: at most two rewrites, short contexts are rewritten, an unfinished question with a long context is answered."""
    bare = F.regexp_replace(question, r"^\s+|\s+$", "")
    unfinished = ~F.regexp_like(bare, F.lit(r"[.!?:]$")) & any_in(F.lower(question), PARTIAL_WORDS)
    return F.when(rewrites >= 2, "answer").when(F.length(context) < 50, "rewrite").when(unfinished & (F.length(context) > 500), "answer").otherwise("llm")


def graded(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """grade, and for what it leaves to a model the model's stored verdict (question key, yes or no); without one, rewrite.

    pairs: key, question, context, rewrites; verdicts are asked once per key, so repeated questions share them.
    """
    once = verdicts.groupBy("key").agg(F.min("verdict").alias("verdict"))
    step = grade(F.col("question"), F.col("context"), F.col("rewrites"))
    return pairs.join(once, "key", "left").withColumn("step", F.when(step == "llm", F.when(F.lower("verdict") == "yes", "answer").otherwise("rewrite")).otherwise(step)).drop("verdict")


def completions(question: Column, written: Column, most: int = 3) -> Column:
    """A model's completions of an unfinished question, one a line: bullets go, lines of 10 signs or fewer go, `most` stay; a
    finished question, and one without completions, is its own."""
    lines = F.transform(F.split(F.coalesce(written, F.lit("")), "\n"), lambda x: F.regexp_replace(wells.stripped(x), r"^[\d.\-*)]\s*", ""))
    kept = F.slice(F.filter(lines, lambda x: F.length(x) > 10), 1, most)
    return F.when(T.is_unfinished(question) & (F.size(kept) > 0), kept).otherwise(F.array(question))


def sub_questions(asked: DataFrame, decomposed: DataFrame) -> DataFrame:
    """query_id, n, question: the parts of a complex question, its rewriting, or itself where the model gave nothing."""
    own = asked.join(decomposed, "query_id", "left")
    parts = F.when(F.col("is_complex") & (F.size("sub_queries") > 0), F.col("sub_queries")).otherwise(F.array(F.coalesce("rewritten", "question")))
    return own.select("query_id", F.posexplode(parts).alias("n", "question"))


def answers_of_completions(hits: DataFrame) -> DataFrame:
    """The hits (query_id, variant, rank, source, page, ...) of all completions of a question, one for each source and page, the earliest."""
    w = W.partitionBy("query_id", "source", "page").orderBy("variant", "rank")
    return hits.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def next_step(tool: Column, step: Column, answered: Column) -> Column:
    """The node after a node, of the graph route, tools, grade, answer or rewrite: what a batch of conversations does next."""
    return F.when(answered, "end").when(step.isNull() & tool.isin("empty", "too_long", "clarify"), "end").when(step.isNull(), "tools").when(step == "rewrite", "rewrite").otherwise("answer")
