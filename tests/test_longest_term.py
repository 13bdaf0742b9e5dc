"""Texts that are the same are searched once, and each row keeps its answer."""

from gritstone.operators import relational


def test_longest_term_of_copies(spark):
    texts = spark.createDataFrame([(n, ("blue steel", "steel", None, "zzz")[n % 4]) for n in range(40)], "id int, name string")
    terms = spark.createDataFrame([("blue",), ("steel",), ("ee",)], "w string")
    found = relational.longest_term(texts, terms, "name", "w", "id")
    assert sorted((r["id"], r["w"]) for r in found.collect()) == sorted((n, "steel") for n in range(40) if n % 4 < 2)
