"""Boundaries of sentences: texts are cut once, and sentences looked at once."""

import re

from pyspark.sql import functions as F

from gritstone.operators import chunking

TECH = re.compile("|".join(chunking.TECHNICAL), re.I)


def plain(text):
    parts = [s for s in re.sub(r"([.!?])[ \t\n\r\f\v]+", "\\1\x1e", text).split("\x1e") if s]
    seen = [(bool(TECH.search(s)), bool(re.search("[0-9]", s)), len(re.findall(r"[^ \t\n\r\f\v]+", s)) > 50) for s in parts]
    return [n == 0 or x[:2] != seen[n - 1][:2] or x[2] for n, x in enumerate(seen)]


def test_boundaries_cut_a_text_once(spark):
    texts = ["", " ", "One. Two 2. three 3! oil? " + "a " * 49 + "b. " + "a " * 50 + "b. x", "\n a b. . . 1", "w " * 51, "  " + "a " * 60 + ". b", "a " * 50 + "\x1c b. c   " * 3, "gas. Gas 1. " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", chunking.boundaries(F.col("text")).alias("b"))
    assert {r["id"]: r["b"] for r in rows.collect()} == {n: plain(t) for n, t in enumerate(texts)}
    # a text is cut by one expression: a second one stood in the lambda and cut the whole text for each sentence
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_every_technical_word_is_found(spark):
    said = [f"an {w.upper()} b" for w in ("well  name|well number|well\tid|wellbore|formation|zone|interval|layer|porosity|permeability|saturation|resistivity|depth|measured depth|true vertical depth|lithology|rock type|mineralogy|oil|water|gas|hydrocarbon|fluid").split("|")]
    rows = spark.createDataFrame([(s,) for s in [*said, "well", "rock", "other words here"]], "s string").select("s", chunking.is_technical(F.col("s")).alias("t"))
    assert [r["s"] for r in rows.collect() if not r["t"]] == ["well", "rock", "other words here"]
