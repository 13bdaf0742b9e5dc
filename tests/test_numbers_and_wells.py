"""Numbers in a question are no wells."""

from pyspark.sql import functions as F

from gritstone.operators import retrieval
from gritstone.plans import router


def test_tool_query_keeps_numbers(spark):
    """A number that begins with 159, or holds it, stays; a well without signs between goes."""
    texts = ["matrix density 1590", "matrix density 15912 now", "depth 1159123", "depth 159F77 now", "depth 15/9-77 now", "depth 15919A now"]
    asked = spark.createDataFrame([(t,) for t in texts], "q string")
    got = [r[0] for r in asked.select(router.tool_query(F.col("q"), F.lit("15/9-F-4"), F.lit(None).cast("string"))).collect()]
    assert got == [f"{t} in well 15/9-F-4" for t in (*texts[:3], "depth now", "depth now", "depth now")]


def test_expanded_questions_keep_numbers(spark):
    asked = spark.createDataFrame([("nothing 1590",), ("nothing 115912",), ("nothing 15 9 F 4",)], "q string")
    got = [r[0] for r in asked.select(retrieval.expanded(F.col("q"))).collect()]
    assert got[:2] == [["nothing 1590"], ["nothing 115912"]] and len(got[2]) > 1
