"""Lookups in the tables of picks, parameters, facts and sections, and the answers made of them.

Each lookup takes a table of questions (query_id, query) and gives one answer a question, so a batch is a few joins. Stores are
joined by normalised well keys; a looser rule reads only what no stricter one resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.functions import formats, wells
from gritstone.functions import text as T
from gritstone.functions.wells import any_in, compact
from gritstone.operators import matching, relational

#: Words for the parameters of the table of petrophysical parameters, in order, and how they are shown.
PETRO_SYNONYMS = (
    ("netgros", "netgros"), ("net to gross", "netgros"), ("net-to-gross", "netgros"), ("net/gross", "netgros"), ("ntg", "netgros"), ("n/g", "netgros"), ("phif", "phif"), ("porosity", "phif"), ("phi", "phif"),
    ("sw", "sw"), ("water saturation", "sw"), ("klogh", "klogh"), ("permeability", "klogh"), ("arithmetic", "klogh_a"), ("harmonic", "klogh_h"), ("geometric", "klogh_g"),
)
EVAL_SYNONYMS = (
    ("matrix density", "Rhoma"), ("rhoma", "Rhoma"), ("ρma", "Rhoma"), ("rho ma", "Rhoma"), ("pma", "Rhoma"), ("fluid density", "Rhofl"), ("rhofl", "Rhofl"), ("ρfl", "Rhofl"), ("rho fl", "Rhofl"), ("pfl", "Rhofl"),
    ("grmax", "Grmax"), ("gr max", "Grmax"), ("gamma ray max", "Grmax"), ("grmin", "Grmin"), ("gr min", "Grmin"), ("gamma ray min", "Grmin"), ("archie a", "a"), ("tortuosity factor", "a"), ("archie m", "m"),
    ("cementation exponent", "m"), ("archie n", "n"), ("saturation exponent", "n"),
)
FACT_SYNONYMS = (("rw", "RW"), ("temperature gradient", "TEMPERATUREGRADIENT"), ("reservoir temperature", "RESERVOIRTEMPERATURE"))
SECTION_KEYWORDS = ("summary", "introduction", "conclusion", "results", "discussion", "abstract")
SECTION_FALLBACKS = {"summary": ("results", "introduction"), "introduction": ("summary",)}
#: Tags of tool outputs that are answers as they are, the first of them first.
PRIORITY = ("[WELL_PICKS]", "[WELL_PICKS_ALL]", "[WELL_FORMATION_PROPERTIES]", "[SECTION]", "[EVAL_PARAMS_JSON]", "[PETRO_PARAMS_JSON]", "[FACTS_JSON]")
STRONG_PICKS, WEAK_PICKS = ("Well_picks", "NO 15/9", "Well NO "), ("well picks", "formation picks", "Pick:", "Quality:", "Top: MD", "Base: MD", "Top: TVD", "Base: TVD")


def _lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def _ordered(order: list, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(o) for o in order), value.alias("v_")))), lambda x: x["v_"])


def first_word(text: Column, pairs) -> Column:
    """The value of the first of pairs whose word the text contains, in their order."""
    out = None
    for word, value in pairs:
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def find_wells(asked: DataFrame, stored: DataFrame, fuzzy: bool = True) -> DataFrame:
    """query_id, well: the stored well (label) that a question means. asked: query_id, query.

    In order: the key of the well in the question; the nearest label (weighted ratio from 65); the key with or without a trailing A; a
    key that begins with the other, two signs apart at most; a label that holds the other. Of several the smallest label.
    """
    every = asked.select("query_id", "query", wells.query_well(F.col("query")).alias("named"))
    other = F.when(F.col("named").isNull() & (F.length("query") < 50), F.trim("query")) if fuzzy else F.lit(None).cast("string")
    # many questions ask for the same well, so each wording is looked up once
    every = every.withColumn("other", other).withColumn("ask", F.coalesce(F.concat(F.lit("n"), "named"), F.concat(F.lit("o"), "other")))
    own = every.where("ask is not null").select("ask", "named", "other").distinct().withColumn("k", T.picks_well_key(F.col("named")))
    store = stored.select("well").distinct().withColumn("k", T.picks_well_key(F.col("well")))
    cut = lambda n: F.substring(F.col("k"), F.lit(1), F.length("k") - n)
    other = F.when(F.endswith("k", F.lit("A")), cut(1)).otherwise(F.concat("k", F.lit("A")))
    keyed = own.where("k <> ''")
    # every rule of the key is an equality: the asked key as it is, changed or cut, with the stored key as it is or cut
    tries = F.array(F.struct(F.lit(0).alias("rule"), F.col("k").alias("key")), F.struct(F.lit(2).alias("rule"), other.alias("key")), *(F.struct(F.lit(3).alias("rule"), cut(n).alias("key")) for n in (1, 2)))
    by_key = keyed.select("ask", F.explode(tries).alias("t")).select("ask", "t.rule", "t.key").where("length(key) > 2").join(store.withColumnRenamed("k", "key"), "key")
    longer = store.select("well", F.explode(F.array(cut(1), cut(2))).alias("k")).where("length(k) > 2")
    by_cut = keyed.join(longer, "k").select("ask", F.lit(3).alias("rule"), "well")
    tight = lambda c: F.regexp_replace(F.upper(c), r"\s", "")
    label = store.select("well", tight("well").alias("label"))
    stretches = lambda c, least: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(least), F.greatest(F.length(c) - i + 1, F.lit(least))), lambda n: F.substring(c, i, n)))))
    said = own.where("named is not null").select("ask", tight("named").alias("said"))
    inside = said.join(label.withColumn("said", F.explode(stretches(F.col("label"), 5))), "said").select("ask", F.lit(4).alias("rule"), "well")
    around = said.withColumn("label", F.explode(stretches(F.col("said"), 5))).join(label, "label").select("ask", F.lit(4).alias("rule"), "well")
    hits = by_key.select("ask", "rule", "well").unionByName(by_cut).unionByName(inside).unionByName(around)
    if fuzzy:
        rest = own.join(keyed.join(store.select("k"), "k", "left_semi").select("ask"), "ask", "left_anti")
        named = rest.select("ask", F.coalesce("named", "other").alias("named"))
        hits = hits.unionByName(matching.match_label(named, store, "named", "well", "ask").select("ask", F.lit(1).alias("rule"), "well"))
    best = hits.groupBy("ask").agg(F.min(F.struct("rule", "well")).alias("best"))
    return every.select("query_id", "ask").join(best, "ask").select("query_id", "best.well")


def lookup_picks(asked: DataFrame, picks: DataFrame, fuzzy: bool = True, preview: int = 25) -> DataFrame:
    """query_id, answer: of picks (well, formation, pick_type, md_m, tvd_m, tvdss_m, quality, seq).

    A question about all wells lists each well's formations; one for formations those of its well; one for a depth the first top
    and base of a formation, by its key, else by its letters; any other the first 25 rows.
    """
    low = F.lower("query")
    own = asked.join(find_wells(asked, picks, fuzzy), "query_id", "left")
    depth = any_in(low, ("depth", "md", "tvd", "tvdss"))
    every = any_in(low, ("each", "every", "all", "complete", "entire")) & F.contains(low, F.lit("formation")) & F.contains(low, F.lit("well"))
    listed = (any_in(low, ("list", "all")) & F.contains(low, F.lit("formation"))) | (F.contains(low, F.lit("formations")) & any_in(low, ("in", "for", "all")))
    form = wells.asked_formation(F.col("query"))
    mode = F.when(F.col("well").isNull() & every, "all").when(F.col("well").isNull(), "none").when(listed, "list").when(depth & form.isNotNull(), "depth").otherwise("preview")
    own = own.withColumns({"mode": mode, "form": form})
    by_well = picks.groupBy("well").agg(F.array_sort(F.collect_set("formation")).alias("forms"))
    bullets = F.transform("forms", lambda x: F.concat(F.lit("- "), x))
    listing = own.where("mode = 'list'").join(by_well, "well").select("query_id", F.concat(F.lit("[WELL_PICKS] Well "), "well", F.lit(" formations:\n"), _lines(bullets)).alias("answer"))
    whole = by_well.agg(F.count("*").alias("n"), _lines(_ordered(["well"], F.concat(F.lit("\n"), "well", F.lit(":\n"), _lines(bullets)))).alias("body"))
    text = F.concat(F.lit("[WELL_PICKS_ALL] Wells: "), F.col("n").cast("string"), F.lit("\n"), "body")
    all_ = own.where("mode = 'all'").crossJoin(F.broadcast(whole)).select("query_id", text.alias("answer"))
    nothing = own.where("mode = 'none'").select("query_id", F.lit("No well detected in query. Provide a well like 15/9-19A.").alias("answer"))
    key = T.formation_key(F.col("form"))
    # the answer depends on well and form alone, and on the first rows of each formation's tops, bases and other picks
    first = picks.withColumn("n_", F.row_number().over(W.partitionBy("well", "formation", "pick_type").orderBy("seq"))).where(F.col("n_") <= 10).drop("n_")
    rows = own.where("mode = 'depth'").select("well", "form").distinct().join(first, "well")
    rule = F.when((key != "") & F.contains(T.formation_key(F.col("formation")), key), 0).when(F.contains(F.lower("formation"), F.lower("form")), 1)
    rows = rows.withColumn("rule", rule).where("rule is not null").withColumn("r_", F.min("rule").over(W.partitionBy("well", "form"))).where("rule = r_")
    line = F.concat(F.lit("- "), formats.depth_line(F.col("pick_type"), F.col("md_m"), F.col("tvd_m"), F.col("tvdss_m")))
    rows = rows.withColumns({"line": line, "n_": F.row_number().over(W.partitionBy("well", "form", "pick_type").orderBy("seq")), "m_": F.row_number().over(W.partitionBy("well", "form").orderBy("seq"))})
    rows = rows.withColumn("ends", F.max(F.col("pick_type").isin("Top", "Base")).over(W.partitionBy("well", "form")))
    shown = rows.where((F.col("ends") & F.col("pick_type").isin("Top", "Base") & (F.col("n_") == 1)) | (~F.col("ends") & (F.col("m_") <= 10)) | (F.col("m_") == 1))
    head = F.min_by("formation", "seq")
    place = F.when(F.col("pick_type") == "Top", 0).otherwise(1)
    visible = (F.col("ends") & F.col("pick_type").isin("Top", "Base") & (F.col("n_") == 1)) | ~F.col("ends")
    body = F.transform(F.array_sort(F.collect_list(F.when(visible, F.struct(place.alias("p"), "seq", "line")))), lambda x: x["line"])
    deep = shown.groupBy("well", "form").agg(head.alias("f"), body.alias("b")).select("well", "form", F.concat(F.lit("[WELL_PICKS] "), "f", F.lit(" in well "), "well", F.lit("\n"), _lines(F.col("b"))).alias("answer"))
    deep = own.where("mode = 'depth'").join(deep, ["well", "form"], "left")
    missing = deep.where("answer is null").select("query_id", F.concat(F.lit("Formation '"), "form", F.lit("' not found in well "), "well", F.lit(".")).alias("answer"))
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    row = F.concat(F.lit("- "), "formation", F.lit(" "), "pick_type", F.lit(": MD="), show("md_m"), F.lit(", TVD="), show("tvd_m"), F.lit(", TVDSS="), show("tvdss_m"), F.lit(" (Q="), "quality", F.lit(")"))
    few = picks.withColumn("n_", F.row_number().over(W.partitionBy("well").orderBy("seq"))).where(F.col("n_") <= preview)
    few = few.groupBy("well").agg(_lines(_ordered(["seq"], row)).alias("body"))
    front = own.where("mode = 'preview'").join(few, "well").select("query_id", F.concat(F.lit("[WELL_PICKS] Preview rows for well "), "well", F.lit(" (showing up to 25):\n"), "body").alias("answer"))
    return reduce(DataFrame.unionByName, (listing, all_, nothing, deep.where("answer is not null").select("query_id", "answer"), missing, front))


def find_petro(asked: DataFrame, petro: DataFrame) -> DataFrame:
    """query_id, k: the key of a stored well for each named one (query_id, well): the key itself, the key without WELL and NO, a stored key
    without its suffix, and last a key that begins with the other, two signs apart at most."""
    base = T.well_key(F.col("well"))
    store = petro.select(T.well_key(F.col("well")).alias("stored")).distinct()
    own = asked.select("query_id", base.alias("a"), T.picks_well_key(F.col("well")).alias("b"))
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    rule = lambda n, c: F.struct(F.lit(n).alias("rule"), c.alias("key"))
    a, b, stored = F.col("a"), F.col("b"), F.col("stored")
    whole = own.select("query_id", F.explode(F.array(rule(0, a), rule(1, b), rule(4, cut(b, 1)), rule(4, cut(b, 2)))).alias("t")).select("query_id", "t.*").join(store.withColumn("key", stored), "key")
    bare = own.select("query_id", F.explode(F.array(rule(2, a), rule(3, b))).alias("t")).select("query_id", "t.*").join(store.withColumn("key", T.strip_first_suffix(stored)), "key")
    longer = own.select("query_id", F.lit(4).alias("rule"), b.alias("key")).join(store.withColumn("key", F.explode(F.array(cut(stored, 1), cut(stored, 2)))), "key")
    hits = whole.unionByName(bare).unionByName(longer).where("key <> ''")
    return hits.groupBy("query_id").agg(F.min(F.struct("rule", "stored")).alias("best")).select("query_id", F.col("best.stored").alias("k"))


def petro_by_formation(petro: DataFrame) -> DataFrame:
    """A row for each well and formation, the last of them (by source, page_start, row): with k, the well's key."""
    last = F.max_by(F.struct(*(c for c in petro.columns if c not in ("well", "formation"))), F.struct("source", "page_start", "row")).alias("r")
    return petro.groupBy("well", "formation").agg(last).select("well", "formation", "r.*", T.well_key(F.col("well")).alias("k"))


def petro_parameter(question: Column) -> Column:
    """The parameter that a question is after: klogh with its kind of mean, else the first synonym in order."""
    low = F.lower(question)
    both = lambda word: F.contains(low, F.lit("klogh")) & F.contains(low, F.lit(word))
    return F.when(both("harmonic"), "klogh_h").when(both("arithmetic"), "klogh_a").when(both("geometric"), "klogh_g").otherwise(first_word(low, PETRO_SYNONYMS))


def _petro_value(param: Column) -> Column:
    means = F.concat(F.lit("Arithmetic "), formats.klogh(F.col("klogh_a")), F.lit(", Harmonic "), formats.klogh(F.col("klogh_h")), F.lit(", Geometric "), formats.klogh(F.col("klogh_g")))
    out = F.when(param == "klogh", means)
    for name in ("netgros", "phif", "sw"):
        out = out.when(param == name, formats.fraction(F.col(name)))
    for name in ("klogh_a", "klogh_h", "klogh_g"):
        out = out.when(param == name, formats.klogh(F.col(name)))
    return out


def _means() -> Column:
    return F.concat_ws("/", *(formats.klogh(F.col(c)) for c in ("klogh_a", "klogh_h", "klogh_g")))


def answer_petro(asked: DataFrame, petro: DataFrame) -> DataFrame:
    """query_id, shape, answer, of questions (query_id, query) and petrophysical parameters.

    A parameter and a formation give a cell, a parameter alone a row over the formations, a formation alone its column, neither the
    table. A cell without value says N/A, with the formations that have one. Formations are told by name, or by a near word.
    """
    own = asked.select("query_id", "query", T.extract_well(F.col("query")).alias("well"), petro_parameter(F.col("query")).alias("p"))
    own = own.join(find_petro(own.where("well is not null"), petro), "query_id", "left")
    table = petro_by_formation(petro)
    forms = table.select("k", "formation").distinct()
    named = matching.answer_formation(own.where("k is not null"), forms, "query", "formation", "query_id", "k").withColumnRenamed("formation", "f")
    own = own.join(named, "query_id", "left")
    rows = own.join(table.drop("well"), "k")
    w = W.partitionBy("query_id").orderBy("source", "page_start")
    pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.concat(F.lit(" (pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(")"))).otherwise("")
    rows = rows.withColumns({"cite": F.first(F.concat(F.lit("Source: "), "source", pages)).over(w), "value": _petro_value(F.col("p"))})
    empty = F.col("p").isNotNull() & (F.col("value") == "N/A")
    rows = rows.withColumn("others", F.when(~empty & (F.col("p") != "klogh"), F.concat("formation", F.lit(" ("), "value", F.lit(")"))))
    title = F.concat(F.upper("p"), F.lit(" for "), F.col("f"), F.lit(" in well "), F.col("well"), F.lit(": "))
    each = F.when(F.col("p") == "klogh", F.concat(F.lit("A/H/G = "), _means())).otherwise(F.col("value"))
    line = F.concat(F.lit("| "), "formation", F.lit(" | "), F.when(F.col("p").isNotNull(), each).otherwise(F.concat_ws(" | ", *(formats.fraction(F.col(c)) for c in ("netgros", "phif", "sw")), _means())), F.lit(" |"))
    column = F.concat(
        F.lit("| Parameter | Value |\n|---|---:|\n| Net/Gross | "), formats.fraction(F.col("netgros")), F.lit(" |\n| PHIF | "), formats.fraction(F.col("phif")), F.lit(" |\n| SW | "), formats.fraction(F.col("sw")),
        F.lit(" |\n| KLOGH (A/H/G) | "), _means(), F.lit(" |"),
    )
    own_row = F.col("formation") == F.col("f")
    got = rows.groupBy("query_id", "well", "p", "f").agg(
        F.first("cite").alias("cite"), F.max(F.when(own_row, F.col("value"))).alias("cell"), F.max(F.when(own_row, column)).alias("column"),
        F.array_join(F.array_compact(_ordered(["source", "page_start", "row"], F.col("others"))), ", ").alias("have"), _lines(_ordered(["source", "page_start", "row"], line)).alias("body"),
    )
    shape = F.when(F.col("p").isNotNull() & F.col("f").isNotNull(), "cell").when(F.col("p").isNotNull(), "row").when(F.col("f").isNotNull(), "column").otherwise("table")
    note = F.concat(F.lit("N/A\n\nNote: "), F.col("f"), F.lit(" formation does not have a "), F.upper("p"), F.lit(" value in the petrophysical parameters table for this well."))
    known = F.when(F.col("have") != "", F.concat(F.lit("\nAvailable formations with "), F.upper("p"), F.lit(" values: "), F.col("have"), F.lit("."))).otherwise("")
    cell = F.concat(title, F.when(F.col("cell") == "N/A", F.concat(note, known, F.lit("\n\n"))).otherwise(F.concat("cell", F.lit("\n"))), "cite")
    lead = F.concat(F.lit("Petrophysical parameters — Well "), F.col("well"))
    text = (
        F.when(shape == "cell", cell)
        .when(shape == "row", F.concat(F.upper("p"), F.lit(" — Well "), "well", F.lit("\n\n| Formation | Value |\n|---|---:|\n"), "body", F.lit("\n\n"), "cite"))
        .when(shape == "column", F.concat(lead, F.lit(" — "), "f", F.lit("\n\n"), "column", F.lit("\n\n"), "cite"))
        .otherwise(F.concat(lead, F.lit("\n\n| Formation | Net/Gross | PHIF | SW | KLOGH (A/H/G) |\n|---|---:|---:|---:|---|\n"), "body", F.lit("\n\n"), "cite"))
    )
    found = got.select("query_id", shape.alias("shape"), text.alias("answer"))
    lost = own.where("k is null").select("query_id", F.lit("none").alias("shape"), F.when(F.col("well").isNull(), "No well detected. Provide a well like 15/9-F-5.").otherwise(F.concat(F.lit("No petrophysical parameters found for well "), "well", F.lit("."))).alias("answer"))
    return found.unionByName(lost)


def petro_payload(asked: DataFrame, petro: DataFrame) -> DataFrame:
    """query_id, payload: the tagged JSON of a well's table, a record for each formation (the last row wins)."""
    own = asked.select("query_id", T.extract_well(F.col("query")).alias("well")).where("well is not null")
    rows = own.join(find_petro(own, petro), "query_id").join(petro_by_formation(petro).drop("well"), "k")
    record = F.struct("netgros", "phif", "sw", "klogh_a", "klogh_h", "klogh_g")
    maps = rows.groupBy("query_id", "well").agg(F.map_from_entries(F.collect_list(F.struct("formation", record.alias("v")))).alias("values"))
    return maps.select("query_id", formats.tagged_json("PETRO_PARAMS_JSON", F.struct("well", "values")).alias("payload"))


def answer_eval(asked: DataFrame, values: DataFrame, within: str | None = None) -> DataFrame:
    """query_id, shape, answer, of questions and the long values of evaluation parameters (well, param, formation, value, source, page, nth).

    The shapes of answer_petro; parameters come in their own order. A formation without parameter asks which one is meant. Of a
    well's tables the first by source and page counts; pages count from 0 and are shown from 1. A column `within` of both tables
    names the collection that a question is asked of; tables of other collections do not answer it.
    """
    part = [within] if within else []
    low = F.lower("query")
    param = first_word(low, EVAL_SYNONYMS)
    for letter in ("A", "B"):
        param = F.when(param.isNull() & F.col("query").rlike(rf"\b{letter}\b"), letter).otherwise(param)
    own = asked.select("query_id", "query", *part, T.extract_well(F.col("query")).alias("well"), param.alias("p")).withColumn("k", T.well_key(F.col("well")))
    key = T.strip_suffixes(T.well_key(F.col("well")))
    first = values.withColumn("k", key).withColumn("n_", F.dense_rank().over(W.partitionBy("k", *part).orderBy("source", "page"))).where("n_ = 1").drop("well", "n_")
    rows = own.join(first, ["k", *part])
    named = F.max(F.when(F.contains(low, F.lower("formation")), F.struct((-F.col("nth")).alias("n"), "formation"))).over(W.partitionBy("query_id"))
    order = F.array_position(F.array(*map(F.lit, formats.EVAL_ORDER)), F.col("param"))
    rows = rows.withColumns({"f": named["formation"], "place": F.when(order > 0, order).otherwise(99), "shown": formats.eval_value(F.col("param"), F.col("value"))})
    page = F.col("page") + 1
    cite = F.concat(F.lit("Source: "), "source", F.lit(" (pages "), page.cast("string"), F.lit("-"), page.cast("string"), F.lit(")"))
    rows = rows.withColumns({"cite": cite, "head": F.concat(F.lit("| "), formats.label_of(F.col("param")), F.lit(" | "))})
    wide = rows.groupBy("query_id", "well", "p", "f", "param", "place", "head").agg(
        F.max("cite").alias("cite"), F.max(F.when(F.col("formation") == F.col("f"), F.col("shown"))).alias("cell"),
        _lines(_ordered(["nth"], F.concat(F.lit("| "), "formation", F.lit(" | "), "shown", F.lit(" |")))).alias("down"), F.array_join(_ordered(["nth"], F.col("shown")), " | ").alias("across"),
        F.array_join(_ordered(["nth"], F.col("formation")), " | ").alias("forms"), F.count("*").alias("n"),
    )
    unit = F.when(F.col("p").isin("Rhoma", "Rhofl"), " g/cc").otherwise("")
    label = formats.label_of(F.col("p"), formats.EVAL_NAMES)
    mine = F.col("param") == F.col("p")
    got = wide.groupBy("query_id", "well", "p", "f").agg(
        F.max("cite").alias("cite"), F.max(F.when(mine, F.col("cell"))).alias("cell"), F.max(F.when(mine, F.col("down"))).alias("down"), F.max("forms").alias("forms"), F.max("n").alias("n"),
        _lines(_ordered(["place", "param"], F.concat("head", "across", F.lit(" |")))).alias("body"),
    )
    shape = F.when(F.col("p").isNotNull() & F.col("f").isNotNull(), "cell").when(F.col("p").isNotNull(), "row").when(F.col("f").isNotNull(), "ask").otherwise("table")
    menu = F.when(any_in(low, ("dens", "rho", "ρ")), "matrix density (ρma), fluid density (ρfl)").otherwise("matrix density (ρma), fluid density (ρfl), GRmin, GRmax, Archie a, Archie m, Archie n")
    got = got.join(own.select("query_id", menu.alias("menu")), "query_id")
    dashes = F.concat(F.lit("|---|"), F.repeat(F.lit("---:|"), F.col("n").cast("int")))
    text = (
        F.when(shape == "cell", F.concat(label, F.lit(" for "), "f", F.lit(" in well "), "well", F.lit(": "), F.coalesce("cell", F.lit("N/A")), unit, F.lit("\n"), "cite"))
        .when(shape == "row", F.concat(label, F.lit(" — Well "), "well", F.lit("\n\n| Formation | Value |\n|---|---:|\n"), F.coalesce("down", F.lit("")), F.lit("\n\n"), "cite"))
        .when(shape == "ask", F.concat(F.lit("I found formation "), "f", F.lit(" in well "), "well", F.lit(". Which parameter do you want: "), "menu", F.lit("?")))
        .otherwise(F.concat(F.lit("Evaluation parameters — Well "), "well", F.lit(" (Table 1)\n\n| Parameter | "), "forms", F.lit(" |\n"), dashes, F.lit("\n"), "body", F.lit("\n\n"), "cite"))
    )
    found = got.select("query_id", shape.alias("shape"), text.alias("answer"))
    lost = own.join(found, "query_id", "left_anti").select("query_id", F.lit("none").alias("shape"), F.lit("No evaluation parameters found.").alias("answer"))
    return found.unionByName(lost)


def eval_column(values: DataFrame, well: str, formation: str) -> DataFrame:
    """All parameters of a formation of a well, in their order: param, label, shown."""
    order = F.array_position(F.array(*map(F.lit, formats.EVAL_ORDER)), F.col("param"))
    rows = values.where((T.well_key(F.col("well")) == T.well_key(F.lit(well))) & (F.lower("formation") == formation.lower()))
    return rows.select("param", formats.label_of(F.col("param")).alias("label"), formats.eval_value(F.col("param"), F.col("value")).alias("shown"), F.when(order > 0, order).otherwise(99).alias("place"))


def pivoted(values: DataFrame, formations: list[str]) -> DataFrame:
    """well, param and a column for each of formations: the first value of each."""
    return values.groupBy("well", "param").pivot("formation", formations).agg(F.min_by("value", F.struct("source", "page")))


def lookup_facts(asked: DataFrame, facts: DataFrame, preview: int = 20, within: str | None = None) -> DataFrame:
    """query_id, wanted, and the fact columns (parameter, value, unit, source, page_start, page_end), with n (from 1): the facts of a question.

    The parameter by a synonym, else the longest parameter of the well that the question contains; its facts, those whose parameter
    holds it too, once each, by source and page. Without a parameter the first fact of each of the well's, 20 at most. A column
    `within` of both tables names the collection that a question is asked of; facts of other collections do not count.
    """
    part = [within] if within else []
    param = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z]+", "")
    own = asked.select("query_id", "query", *part, T.well_key(T.extract_well(F.col("query"))).alias("k")).where("k is not null")
    own = own.withColumns({"q": param("query"), "said": first_word(F.lower("query"), FACT_SYNONYMS)})
    store = facts.withColumns({"k": T.well_key(F.col("well")), "pn": param("parameter")})
    rows = own.join(store, ["k", *part])
    longest = F.max(F.when((F.col("pn") != "") & F.contains("q", F.col("pn")), F.struct(F.length("pn").alias("n"), "pn"))).over(W.partitionBy("query_id"))
    rows = rows.withColumn("wanted", F.coalesce("said", longest["pn"]))
    shown = ("parameter", "value", "unit", "source", "page_start", "page_end")
    hits = rows.where(F.col("wanted").isNotNull() & F.contains("pn", F.col("wanted"))).select("query_id", "wanted", *shown).distinct()
    order = W.partitionBy("query_id").orderBy("source", F.coalesce("page_start", F.lit(-1)), "parameter", "value", "unit", "page_end")
    hits = hits.withColumn("n", F.row_number().over(order))
    firsts = rows.where("wanted is null").withColumn("n_", F.row_number().over(W.partitionBy("query_id", "pn").orderBy("source", "page_start", "line", "item"))).where("n_ = 1")
    firsts = firsts.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("source", "page_start", "line", "item"))).where(F.col("n") <= preview)
    return hits.unionByName(firsts.select("query_id", "wanted", *shown, "n"))


def answer_facts(found: DataFrame, most: int = 25) -> DataFrame:
    """query_id, answer: one fact as a line, several as a table of 25 at most."""
    unit = F.when(F.col("unit").isNotNull(), F.concat(F.lit(" "), "unit")).otherwise("")
    both = F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    a, b = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    cite = F.concat(F.lit("Source: "), "source", F.when(both, F.concat(F.lit(" (pages "), a, F.lit("-"), b, F.lit(")"))).otherwise(""))
    page = F.when(both & (F.col("page_start") == F.col("page_end")), F.concat(F.lit("p."), a)).when(both, F.concat(F.lit("pp."), a, F.lit("-"), b)).otherwise("")
    name = F.element_at(F.split("source", "/"), -1)
    row = F.concat(F.lit("| "), "parameter", F.lit(" | "), "value", unit, F.lit(" | "), name, F.lit(" "), page, F.lit(" |"))
    line = F.concat("parameter", F.lit(": "), "value", unit, F.lit("\n"), cite)
    each = found.select("query_id", "n", row.alias("row"), line.alias("line"), cite.alias("cite"))
    got = each.groupBy("query_id").agg(F.count("*").alias("c"), F.min_by("line", "n").alias("line"), F.min_by("cite", "n").alias("cite"), _lines(F.slice(_ordered(["n"], F.col("row")), 1, most)).alias("body"))
    return got.select("query_id", F.when(F.col("c") == 1, F.col("line")).otherwise(F.concat(F.lit("| Parameter | Value | Source (page) |\n|---|---:|---|\n"), "body", F.lit("\n\n"), "cite")).alias("answer"))


def lookup_section(asked: DataFrame, sections: DataFrame, within: str | None = None) -> DataFrame:
    """query_id, heading, source, score, answer: the section that a question means, null without one.

    Scores: 50 for the same heading (letters and digits), 10 for the question's keyword, 15 for its well in the heading, and up to
    10 for words in common. A section of another platform number, by its source or else its heading, is no candidate. Under 10
    points other keywords stand in: results or introduction for a summary, a summary for an introduction. Questions with a number are joined by
    it, so only those without one meet all sections; the table of sections is checked to be small. A column `within` of both tables
    names the collection that a question is asked of; sections of other collections are no candidates.
    """
    part = [within] if within else []
    q, none = F.col("query"), F.lit(None).cast("string")
    own = asked.select("query_id", "query", *part, compact(q).alias("qn"), wells.section_well(q).alias("w")).withColumns({"wn": compact(F.col("w")), "num": wells.well_number(F.col("w"))})
    low = F.lower("query")
    own = own.withColumn("kw", first_word(low, [(k, k) for k in SECTION_KEYWORDS]))
    back = F.when(F.col("kw") == "summary", F.array(*map(F.lit, SECTION_FALLBACKS["summary"]))).when(F.col("kw") == "introduction", F.array(*map(F.lit, SECTION_FALLBACKS["introduction"]))).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("back", F.when(F.col("w").isNotNull(), back).otherwise(F.array().cast("array<string>")))
    heading_well = wells.section_well(F.col("heading"))
    store = sections.withColumns({"hw": compact(heading_well), "sec_num": F.coalesce(wells.well_number(F.col("source")), wells.well_number(heading_well)), "source_well": compact(wells.section_well(F.col("source")))})
    numbered = own.where("num is not null").join(store.withColumn("num", F.col("sec_num")), ["num", *part])
    bare = own.where("num is null")
    other = bare.join(store, part) if part else bare.join(relational.small(store), F.lit(True))
    fits = F.col("wn").isNull() | ((F.col("hw").isNull() | (F.col("hw") == F.col("wn"))) & (F.contains(compact(F.col("source")), F.col("wn")) | F.col("source_well").isNull() | (F.col("source_well") == F.col("wn"))))
    both = numbered.unionByName(other.where(fits))
    head = F.lower("heading")
    common = F.when((F.length("qn") >= 3) & F.contains("heading_norm", F.col("qn")), 1.0).otherwise(0.0)
    rest = F.when(F.col("heading_norm") == F.col("qn"), 50.0).otherwise(0.0) + F.when(F.col("wn").isNotNull() & F.contains(compact(F.col("heading")), F.col("wn")), 15.0).otherwise(0.0) + common
    score = rest + F.when(F.col("kw").isNotNull() & F.contains(head, F.col("kw")), 10.0).otherwise(0.0)
    second = rest + F.when(F.exists("back", lambda k: F.contains(head, k)), 10.0).otherwise(0.0)
    both = both.withColumns({"s1": score, "s2": F.when(F.size("back") > 0, second)})
    pick = lambda s: F.max_by(F.struct("heading", "source", "start_page", "end_page", "text", F.col(s).alias("score")), F.struct(F.col(s), F.expr("-seq")))
    best = both.groupBy("query_id").agg(pick("s1").alias("a"), F.max_by(F.struct("heading", "source", "start_page", "end_page", "text", F.col("s2").alias("score")), F.when(F.col("s2").isNotNull(), F.struct(F.col("s2"), F.expr("-seq")))).alias("b"))
    got = F.when(F.col("a.score") >= 10, F.col("a")).when(F.col("b.score") >= 10, F.col("b"))
    best = asked.select("query_id").join(best.select("query_id", got.alias("g")), "query_id", "left")
    pages = F.when(F.col("g.start_page").isNotNull() & F.col("g.end_page").isNotNull(), F.concat(F.lit(" (pages "), F.col("g.start_page").cast("string"), F.lit("-"), F.col("g.end_page").cast("string"), F.lit(")"))).otherwise("")
    text = F.when(F.col("g").isNull(), "[SECTION] No matching section heading found for query.").otherwise(F.concat(F.lit("[SECTION] "), F.col("g.heading"), F.lit("\nSource: "), F.col("g.source"), pages, F.lit("\n\n"), F.col("g.text")))
    return best.select("query_id", F.coalesce("g.heading", none).alias("heading"), F.col("g.source").alias("source"), F.col("g.score").alias("score"), text.alias("answer"))


def formation_properties(picks: DataFrame, petro: DataFrame, by_key: bool = True) -> DataFrame:
    """well, formation, netgros, phif, sw, klogh_a, klogh_h, klogh_g, found: each picked formation with its parameters, if there are any.

    Formations meet by key, the last row of a key; else by a key that begins with the other, the first row. Wells meet by their keys;
    with by_key=False also where a key holds the other, as F-1 does in F-11.
    """
    listed = picks.select("well", "formation").distinct().withColumns({"k": T.picks_well_key(F.col("well")), "f": T.formation_key(F.col("formation"), keep_fm=False)})
    values = ("netgros", "phif", "sw", "klogh_a", "klogh_h", "klogh_g")
    rows = petro.select(T.picks_well_key(F.col("well")).alias("pk"), T.formation_key(F.col("formation"), keep_fm=False).alias("pf"), F.struct("source", "page_start", "row").alias("o"), *values)
    pairs = listed.select("well", "k").distinct().join(rows.select("pk").distinct(), F.col("k") == F.col("pk"))
    if not by_key:
        rest = listed.select("well", "k").distinct().join(pairs, "well", "left_anti")
        loose = rest.join(relational.small(rows.select("pk").distinct()), F.contains("k", F.col("pk")) | F.contains("pk", F.col("k"))).groupBy("well", "k").agg(F.min("pk").alias("pk"))
        pairs = pairs.unionByName(loose)
    near = listed.join(pairs.select("well", "pk"), "well").join(rows, "pk").where((F.col("f") == F.col("pf")) | F.startswith("f", F.col("pf")) | F.startswith("pf", F.col("f")))
    same = F.col("f") == F.col("pf")
    value = F.struct(*values)
    best = near.groupBy("well", "formation").agg(F.max_by(F.when(same, value), F.when(same, F.col("o"))).alias("a"), F.min_by(value, "o").alias("b")).withColumn("v", F.coalesce("a", "b"))
    return listed.select("well", "formation").join(best.select("well", "formation", "v"), ["well", "formation"], "left").select("well", "formation", "v.*", F.col("v").isNotNull().alias("found"))


def properties_table(found: DataFrame) -> DataFrame:
    """well, answer: the table of a well's formations with what is known of each, and the coverage."""
    number = lambda c: formats.fraction(F.col(c))
    means = F.when(F.col("found"), F.concat_ws("/", number("klogh_a"), number("klogh_h"), number("klogh_g"))).otherwise("N/A")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("formation"), number("netgros"), number("phif"), number("sw"), means), F.lit(" |"))
    got = found.groupBy("well").agg(F.count("*").alias("n"), F.count(F.when(F.col("found"), 1)).alias("have"), _lines(_ordered(["formation"], row)).alias("body"))
    text = F.concat(
        F.lit("[WELL_FORMATION_PROPERTIES] Well: "), "well", F.lit("\nFormations (from well picks): "), F.col("n").cast("string"), F.lit("\n\n| Formation | Net/Gross | PHIF (Porosity) | SW | KLOGH (A/H/G) |\n|---|---:|---:|---:|---|\n"),
        "body", F.lit("\n\nCoverage: "), F.col("have").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" formations have petrophysical table values."),
    )
    return got.select("well", text.alias("answer"))


def direct_answers(outputs: DataFrame) -> DataFrame:
    """query_id, priority, answer: of tool outputs (query_id, query, seq, content) the one that is the answer without a model.

    A list of picked formations comes first (for a question about formations), then lists of all wells, properties and sections, then what
    picks could not find, then a well that was not told, then the JSON of evaluation, petrophysical parameters and facts.
    """
    c = formats.unwrapped(F.col("content"))
    about = F.contains(F.lower("query"), F.lit("formation"))
    starts = lambda tag: F.startswith(c, F.lit(tag))
    lost = any_in(c, ("no_well_detected", "No well detected")) & (F.contains(F.lower(c), F.lit("error")) | any_in(c, ("FACTS_JSON", "EVAL_PARAMS_JSON", "PETRO_PARAMS_JSON")))
    rank = (
        F.when(starts("[WELL_PICKS]") & F.contains(c, F.lit("formations:")) & about, 1).when(starts("[WELL_PICKS_ALL]") | starts("[WELL_FORMATION_PROPERTIES]") | starts("[SECTION]"), 2)
        .when(starts("[WELL_PICKS]") & any_in(c, ("No rows found", "No well detected")) & about, 3).when(lost, 4).when(starts("[EVAL_PARAMS_JSON]"), 5).when(starts("[PETRO_PARAMS_JSON]"), 6).when(starts("[FACTS_JSON]"), 7)
    )
    name = F.regexp_extract(c, r"(?i)Well\s+(.+?)\s+formations:", 1)
    bullets = F.transform(F.filter(F.split(c, "\n"), lambda x: F.startswith(F.trim(x), F.lit("-"))), lambda x: F.concat(F.lit("- "), F.trim(F.regexp_replace(x, r"^[-\s]+", ""))))
    text = (
        F.when(rank == 1, F.concat(F.lit("The formations in "), name, F.lit(" are:\n"), _lines(bullets))).when(rank == 3, F.concat(F.lit("Could not find formations for the specified well. "), c))
        .when(rank == 4, "I couldn't identify which well you're asking about. Please specify the well name clearly (e.g., 15/9-F-5, 19/9-19 bt2).").otherwise(c)
    )
    ranked = outputs.withColumns({"priority": rank, "answer": text}).where("priority is not null")
    return ranked.withColumn("n_", F.row_number().over(W.partitionBy("query_id").orderBy("priority", "seq"))).where("n_ = 1").select("query_id", "priority", "answer")


def is_picks_context(context: Column) -> Column:
    """Whether a context is about picks: one strong sign, or two weak ones."""
    count = lambda words: reduce(lambda a, b: a + b, (F.contains(context, F.lit(w)).cast("int") for w in words))
    return (count(STRONG_PICKS) >= 1) | (count(WEAK_PICKS) >= 2)


def exact_completion(question: Column, context: Column) -> Column:
    """For a question of over five words without an end: the first sentence of the context that begins with it."""
    bare = wells.stripped(question)
    literal = F.regexp_replace(bare, r"([^A-Za-z0-9\s])", r"\\$1")
    found = F.call_function("regexp_extract", context, F.concat(F.lit("(?is)("), literal, F.lit(r"[^.]*\.)")), F.lit(1))
    return F.when(~bare.rlike(r"[.!?:]$") & (F.size(F.split(bare, r"\s+")) > 5) & (found != ""), found)


def context_text(parts: DataFrame) -> DataFrame:
    """query_id, context: the contents of a question's tool outputs, in order, with an empty line between them."""
    return parts.groupBy("query_id").agg(F.array_join(_ordered(["seq"], F.col("content")), "\n\n").alias("context"))


def tool_message(value: Column, error: Column, kind: Column) -> Column:
    """What a tool hands on: its text, or a record of its error, redacted."""
    return F.when(error.isNull(), value).otherwise(F.to_json(F.struct(kind.alias("error"), T.redact(error).alias("message"))))
