"""Wells of the same name in two collections, values that stand twice, and rounding."""

from pyspark.sql import functions as F

from gritstone.functions import formats
from gritstone.operators import lookup, retrieval
from gritstone.sources import tables


def test_fixed_rounds_as_python_does(spark):
    xs = [2.125, 2.675, 2.135, 0.5, 1.005, -2.125, 1e9 + 0.005, 0.0, 123456.785]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(formats.fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in rows] == [f"{x:.2f}" for x in xs]


def test_answer_eval_within(spark):
    """Each collection's table answers its own questions."""
    values = spark.createDataFrame([("15/9-F-5", "Rhoma", "Hugin", v, f"{c}.pdf", 0, 1, c) for v, c in (("2.60", "a"), ("2.70", "b"))], "well string, param string, formation string, value string, source string, page int, nth int, c string")
    asked = spark.createDataFrame([(1, "rhoma of hugin in 15/9-F-5", "a"), (2, "rhoma of hugin in 15/9-F-5", "b"), (3, "rhoma of hugin in 15/9-F-5", "z")], "query_id int, query string, c string")
    got = {r["query_id"]: r["answer"] for r in lookup.answer_eval(asked, values, "c").collect()}
    assert "2.60" in got[1] and "a.pdf" in got[1] and "2.70" in got[2] and "b.pdf" in got[2] and got[3].startswith("No evaluation")


def test_lookup_section_within(spark):
    row = lambda c: (f"15_9-F-5/{c}.pdf", "Summary of 15/9-F-5", "summaryof159f5", 1, 1, f"text {c}", 0, c)
    sections = spark.createDataFrame([row("a"), row("b")], "source string, heading string, heading_norm string, start_page int, end_page int, text string, seq int, c string")
    asked = spark.createDataFrame([(1, "summary for 15/9-F-5", "a"), (2, "summary for 15/9-F-5", "b"), (3, "summary", "b"), (4, "summary", "z")], "query_id int, query string, c string")
    got = {r["query_id"]: r["source"] for r in lookup.lookup_section(asked, sections, "c").collect()}
    assert got == {1: "15_9-F-5/a.pdf", 2: "15_9-F-5/b.pdf", 3: "15_9-F-5/b.pdf", 4: None}


def test_lookup_facts_within(spark):
    facts = spark.createDataFrame([("15/9-F-5", "Rw", v, "ohmm", f"{c}.pdf", 1, 1, 0, 0, c) for v, c in (("0.1", "a"), ("0.2", "b"))], "well string, parameter string, value string, unit string, source string, page_start int, page_end int, line int, item int, c string")
    asked = spark.createDataFrame([(1, "rw of 15/9-F-5", "a"), (2, "tell of 15/9-F-5", "b")], "query_id int, query string, c string")
    got = sorted((r["query_id"], r["value"]) for r in lookup.lookup_facts(asked, facts, within="c").collect())
    assert got == [(1, "0.1"), (2, "0.2")]


def test_nested_values_of_two_tables(spark):
    """A well with two tables: the first by source and page counts, and values of the second that the first lacks stay."""
    values = spark.createDataFrame([("w", "Rhoma", "Hugin", "2.7", "b.pdf", 0), ("w", "Rhoma", "Hugin", "2.6", "a.pdf", 3), ("w", "Rhoma", "Ty", "2.5", "b.pdf", 0)], "well string, param string, formation string, value string, source string, page int")
    assert [r.asDict() for r in tables.nested_values(values).collect()] == [{"well": "w", "params": {"Rhoma": {"Hugin": "2.6", "Ty": "2.5"}}}]


def test_document_classes(spark):
    """Questions on one well share its chunks: each chunk is compared with it once, and none is lost."""
    hits = spark.createDataFrame([(q, f"15_9-F-{w}/r.pdf", "r.pdf") for q in range(40) for w in (4, 5)], "query_id int, source string, filename string")
    asked = spark.createDataFrame([(q, "depth in 15/9-F-4" if q < 39 else "tell of it") for q in range(40)], "query_id int, query string")
    chunks = spark.createDataFrame([(d, f"15_9-F-{4 + d % 2}/r.pdf", "r.pdf", 1, "in 15/9-F-4 we see") for d in range(10)], "doc_id int, source string, filename string, page int, text string")
    members, kept = retrieval.document_classes(hits, hits.limit(0), chunks, asked)
    assert members.count() == 41 and kept.count() == 5 + 10
    got = [(r["query_id"], r["doc_id"]) for r in retrieval.whole_documents(hits, hits.limit(0), chunks, asked).collect()]
    assert sorted(got) == sorted([(q, d) for q in range(39) for d in range(0, 10, 2)] + [(39, d) for d in range(10)])
